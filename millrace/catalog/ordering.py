"""Splits, samples, folds, leakage, ranks and time series queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.operators import columns as C
from millrace.operators import correlation, leakage, ranks, sampling, timeline
from millrace.operators.profile import small_table


def hashed(key: str, seed: int) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


def ranked(table: str, key: str, by: str | None, seed: int, cols: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {cols}, row_number() OVER ({part}ORDER BY {hashed(key, seed)}) AS rn,
  count(*) OVER ({part.strip()}) AS n FROM {table}"""


SPLIT_CASE = """CASE WHEN rn <= round_even(n * 20 / 100.0, 0) THEN 'test'
  WHEN rn <= round_even(n * 20 / 100.0, 0) + round_even(n * 10 / 100.0, 0) THEN 'val' ELSE 'train' END AS part"""


@query("g1_split_stratified", f"SELECT o_orderkey, o_orderstatus, {SPLIT_CASE} FROM ({ranked('orders', 'o_orderkey', 'o_orderstatus', 42, 'o_orderkey, o_orderstatus')})")
def _(t):
    s = sampling.assign_split(t.orders, "o_orderstatus", 20, 10, key="o_orderkey")
    return s.select("o_orderkey", "o_orderstatus", F.col("_split").alias("part"))


@query("g1_split_plain", f"SELECT event_id, {SPLIT_CASE} FROM ({ranked('events', 'event_id', None, 7, 'event_id')})")
def _(t):
    return sampling.assign_split(t.events, "value", 20, 10, seed=7, key="event_id").select("event_id", F.col("_split").alias("part"))


@query("g1_split_missing_target", with_views("dirty_orders") + f""", d AS (SELECT * FROM dirty_orders WHERE status IS NOT NULL)
SELECT part, status, count(*) AS n FROM (SELECT status, {SPLIT_CASE} FROM ({ranked('d', 'id', 'status', 42, 'id, status')})) GROUP BY 1, 2""")
def _(t):
    s = sampling.split_frame(t.view("dirty_orders"), "status", 20, 10, key="id")
    parts = [getattr(s, n).groupBy("status").agg(F.count("*").alias("n")).withColumn("part", F.lit(n)) for n in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g1_split_without_key")
def _(t):
    s = sampling.assign_split(t.lineitem, "l_returnflag", 20, 10)
    return s.groupBy("l_returnflag", F.col("_split").alias("part")).agg(F.count("*").alias("n"))


@query("g2_is_classification", union_all([f"""
SELECT '{c}' AS "column", {'true' if s else f'count(DISTINCT {c}) <= 20'} AS is_class FROM orders {'HAVING count(*) > 0' if s else ''}"""
                                          for c, s in (("o_orderstatus", True), ("o_totalprice", False), ("o_custkey", False))]
                                         + ["SELECT 'l_linenumber', count(DISTINCT l_linenumber) <= 20 FROM lineitem"]))
def _(t):
    rows = [{"column": c, "is_class": sampling.is_classification(t.orders, c)} for c in ("o_orderstatus", "o_totalprice", "o_custkey")]
    rows.append({"column": "l_linenumber", "is_class": sampling.is_classification(t.lineitem, "l_linenumber")})
    return small_table(t.spark, rows, "column string, is_class boolean")


@query("g3_oversample", f"""
WITH k AS ({ranked('orders', 'o_orderkey', 'o_orderstatus', 42, 'o_orderkey, o_orderstatus')}), m AS (SELECT max(n) AS hi FROM k)
SELECT o_orderkey, o_orderstatus, copies FROM (SELECT o_orderkey, o_orderstatus, hi // n + CASE WHEN rn <= hi % n THEN 1 ELSE 0 END AS copies FROM k, m)""")
def _(t):
    b = sampling.balance_train(t.orders, "o_orderstatus", "Oversample minority", key="o_orderkey")
    return b.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("copies"))


@query("g4_undersample", f"""
WITH k AS ({ranked('orders', 'o_orderkey', 'o_orderstatus', 42, 'o_orderkey, o_orderstatus')})
SELECT o_orderkey, o_orderstatus FROM k WHERE rn <= (SELECT min(n) FROM k)""")
def _(t):
    return sampling.balance_train(t.orders, "o_orderstatus", "Undersample majority", key="o_orderkey").select("o_orderkey", "o_orderstatus")


@query("g5_sample", f"SELECT event_id FROM ({ranked('events', 'event_id', None, 0, 'event_id')}) WHERE rn <= 2000")
def _(t):
    return sampling.sample_rows(t.events, 2000, key="event_id").select("event_id")


@query("g6_class_sample", f"""
SELECT l_status, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT o_orderkey AS id, o_orderpriority AS l_status, rn, n FROM ({ranked('orders', 'o_orderkey', 'o_orderpriority', 0, 'o_orderkey, o_orderpriority')}))
WHERE rn <= least(n, greatest(least(n, 50), round_even(n * 3000.0 / (SELECT count(*) FROM orders), 0))) GROUP BY 1""")
def _(t):
    s = sampling.class_sample(t.orders, 3000, "o_orderpriority", key="o_orderkey")
    return s.groupBy(F.col("o_orderpriority").alias("l_status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("g7_robust_extremes", f"""
WITH m AS (SELECT median(value) AS med FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, m)
SELECT event_id, {s9('value')} AS value, {s9('0.6745 * (value - med) / mad')} AS robust_z FROM events, m, d
WHERE abs(0.6745 * (value - med) / mad) > 3.5 ORDER BY abs(0.6745 * (value - med) / mad) DESC LIMIT 10""")
def _(t):
    return shown(sampling.robust_extremes(t.events, "value", ["event_id", "value"]))


@query("g9_folds", f"""
SELECT o_orderkey, CASE WHEN rn <= n * 1 // 5 THEN 0 WHEN rn <= n * 2 // 5 THEN 1 WHEN rn <= n * 3 // 5 THEN 2 WHEN rn <= n * 4 // 5 THEN 3 ELSE 4 END AS fold
FROM ({ranked('orders', 'o_orderkey', 'o_orderstatus', 42, 'o_orderkey')})""")
def _(t):
    return shown(sampling.folds(t.orders, 5, 42, "o_orderstatus", key="o_orderkey").select("o_orderkey", F.col("_fold").alias("fold")))


# --- leakage -----------------------------------------------------------------------------------------------------

OVERLAP_COLS = "c_nationkey, c_mktsegment, c_acctbal"


@query("c1_row_overlap", """
WITH a AS (SELECT nation, segment, positive FROM (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal > 3000 AS positive, c_acctbal FROM customer) WHERE c_acctbal < 2000),
b AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal > 3000 AS positive FROM customer)
SELECT count(*) AS overlap_rows FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.nation IS NOT DISTINCT FROM b.nation AND a.segment IS NOT DISTINCT FROM b.segment AND a.positive IS NOT DISTINCT FROM b.positive)""")
def _(t):
    b = t.sql("SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal > 3000 AS positive, c_acctbal FROM {customer}")
    return leakage.row_overlap(b.filter("c_acctbal < 2000").drop("c_acctbal"), b.drop("c_acctbal"))


@query("c1_row_overlap_documents", """
WITH a AS (SELECT text, lang FROM documents WHERE source < 'src2'), b AS (SELECT text, lang FROM documents WHERE source >= 'src2')
SELECT count(*) AS overlap_rows FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.text = b.text AND a.lang = b.lang)""")
def _(t):
    d = t.documents
    return leakage.row_overlap(d.filter("source < 'src2'").select("text", "lang"), d.filter("source >= 'src2'").select("text", "lang"))


@query("e35_leakage_report", f"""
WITH d AS (SELECT *, o_totalprice * 2 + o_custkey AS copy FROM orders)
SELECT 'warning' AS level, 'copy' AS item, {r6('corr(copy, o_totalprice)')} AS value FROM d HAVING abs(corr(copy, o_totalprice)) >= 0.98
UNION ALL SELECT 'warning', 'o_custkey', {r6('corr(o_custkey, o_totalprice)')} FROM d HAVING abs(corr(o_custkey, o_totalprice)) >= 0.98
UNION ALL SELECT 'error', 'test', (SELECT count(*) FROM d WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00')""")
def _(t):
    d = t.orders.withColumn("copy", F.col("o_totalprice") * 2 + F.col("o_custkey"))
    train, test = d.filter("o_orderdate < timestamp_ntz'1999-01-01'"), d.filter("o_orderdate >= timestamp_ntz'1998-01-01'")
    return shown(leakage.leakage_report(train, None, test, "o_totalprice", d).drop("message"), "value")


# --- ranks and order ----------------------------------------------------------------------------------------------

@query("f1_average_ranks", """
SELECT value, count(*) AS n, avg(rn) AS rank FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM events) GROUP BY 1""")
def _(t):
    return ranks.average_ranks(t.events, C.as_numeric(t.events, "value"))


@query("f2_row_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def _(t):
    return ranks.row_index(t.events, timeline.as_seconds(t.events, "ts"), F.col("event_id"), "position").select("event_id", "position")


@query("f2_row_index_ties", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def _(t):
    return ranks.row_index(t.orders, timeline.as_seconds(t.orders, "o_orderdate"), F.col("o_orderkey"), "position").select("o_orderkey", "position")


@query("f3_gaps", """
SELECT CAST(gap AS BIGINT) AS gap, count(*) AS rows FROM (SELECT epoch_us(o_orderdate) / 1e6 - lag(epoch_us(o_orderdate) / 1e6) OVER (ORDER BY o_orderdate) AS gap FROM orders)
WHERE gap IS NOT NULL GROUP BY 1""")
def _(t):
    g = timeline.gaps(t.orders, timeline.as_seconds(t.orders, "o_orderdate"))
    return g.groupBy(F.col("gap").cast("long").alias("gap")).agg(F.sum("w").alias("rows"))


def time_sql(table: str, c: str, period: str, unit: str) -> str:
    span = {"D": "date_diff('day', a, b) + 1", "W": "date_diff('day', a, b) // 7 + 1", "M": "date_diff('month', a, b) + 1"}[period]
    return f"""
WITH g AS (SELECT epoch_us({c}) / 1e6 - lag(epoch_us({c}) / 1e6) OVER (ORDER BY {c}) AS gap FROM {table}), m AS (SELECT median(gap) AS med FROM g),
p AS (SELECT DISTINCT date_trunc('{unit}', {c}) AS p FROM {table}), s AS (SELECT min(p) AS a, max(p) AS b, count(*) AS k FROM p)
SELECT '{c}' AS "column", {s9(f"min(epoch_us({c})) / 1e6")} AS first, {s9(f"max(epoch_us({c})) / 1e6")} AS last, count(*) AS rows,
  count(*) - count({c}) AS unparseable, {s9('any_value(med)')} AS median_gap, count(*) - count(DISTINCT {c}) AS duplicates,
  CASE WHEN any_value(med) > 0 THEN (SELECT count(*) FROM g, m WHERE gap > 3 * med) ELSE 0 END AS irregular,
  '{period}' AS period, any_value({span} - k) AS empty_periods, CAST(NULL AS VARCHAR) AS note FROM {table}, m, s"""


@query("d15_time_profile", time_sql("events", "ts", "D", "day"))
def _(t):
    return shown(timeline.time_profile(t.events, "ts"))


@query("d15_time_profile_dates", time_sql("orders", "o_orderdate", "D", "day"))
def _(t):
    return shown(timeline.time_profile(t.orders, "o_orderdate"))


for _p, _u in (("D", "day"), ("W", "week"), ("M", "month")):
    query(f"d16_period_counts_{_u}", f"SELECT strftime(date_trunc('{_u}', o_orderdate), '%Y-%m-%d') AS period_start, count(*) AS n FROM orders GROUP BY 1")(
        lambda t, p=_p: timeline.period_counts(t.orders, "o_orderdate", p))


@query("d17_trend", f"""
WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS i, row_number() OVER (ORDER BY value) AS r FROM events),
a AS (SELECT i, avg(r) OVER (PARTITION BY value) AS r FROM p)
SELECT 'value' AS "column", {r6('corr(i, r)')} AS trend FROM a""")
def _(t):
    return shown(timeline.trends(t.events, "ts", ["value"], "event_id").drop("p_value"), "trend")


ACF_SQL = f"""
WITH p AS (SELECT value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
l AS (SELECT regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM p), e AS (SELECT i, y - (a + b * i) AS e FROM p, l)
SELECT lag, {r6('sum(x.e * z.e) / (SELECT sum(e * e) FROM e)')} AS autocorrelation
FROM (SELECT unnest(range(1, 61)) AS lag) k JOIN e x ON true JOIN e z ON z.i = x.i + k.lag GROUP BY 1"""


@query("f6_autocorrelation", ACF_SQL)
def _(t):
    e = t.events
    return shown(timeline.autocorrelation(timeline.in_time_order(e, timeline.as_seconds(e, "ts"), F.col("value"), F.col("event_id"))), "autocorrelation")


@query("c6_lag_match", """
WITH d AS (SELECT date_trunc('day', ts) AS d, count(*) AS y FROM events GROUP BY 1), p AS (SELECT y, row_number() OVER (ORDER BY d) - 1 AS i FROM d),
l AS (SELECT regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM p), e AS (SELECT i, y - (a + b * i) AS e FROM p, l)
SELECT lag, round(sum(x.e * z.e) / (SELECT sum(e * e) FROM e), 6) + 0.0 AS autocorrelation
FROM (SELECT unnest(range(1, 16)) AS lag) k JOIN e x ON true JOIN e z ON z.i = x.i + k.lag GROUP BY 1""")
def _(t):
    days = timeline.period_counts(t.events, "ts", "D").withColumn("d", F.to_timestamp("period_start"))
    s = timeline.in_time_order(days, timeline.as_seconds(days, "d"), F.col("n").cast("double"), F.lit(0))
    return shown(timeline.autocorrelation(s), "autocorrelation")


KENDALL_SQL = """
WITH p AS (SELECT a.{x} AS xa, b.{x} AS xb, a.{y} AS ya, b.{y} AS yb FROM {t} a JOIN {t} b ON a.{k} < b.{k}),
s AS (SELECT sum(sign(xa - xb) * sign(ya - yb)) AS c, count(CASE WHEN xa <> xb THEN 1 END) AS nx, count(CASE WHEN ya <> yb THEN 1 END) AS ny FROM p)
SELECT '{x}' AS column_a, '{y}' AS column_b, round(c / sqrt(CAST(nx AS DOUBLE) * ny), 6) AS kendall, (SELECT count(*) FROM {t}) AS n FROM s"""


@query("c7_kendall_concordance", KENDALL_SQL.format(t="customer", k="c_custkey", x="c_acctbal", y="c_nationkey"))
def _(t):
    return shown(correlation.kendall(t.customer, ["c_acctbal", "c_nationkey"]), "kendall")


@query("e8_kendall_matrix", union_all([f"SELECT * FROM ({KENDALL_SQL.format(t='part', k='p_partkey', x=x, y=y)})"
                                       for x, y in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))]))
def _(t):
    return shown(correlation.kendall(t.part, ["p_partkey", "p_size", "p_retailprice"]), "kendall")
