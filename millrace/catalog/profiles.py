"""Univariate profile queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.operators import columns as C
from millrace.operators import counts, profile

LINE_NUM = ["l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sql(table: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", n AS "count", {r6('(rows - n) * 100.0 / rows')} AS missing_pct, u AS "unique",
  {s9('m')} AS mean, {s9('q2')} AS median, {s9('sd')} AS std, {s9('vr')} AS variance, {s9('lo')} AS "min",
  {s9('q1')} AS q1, {s9('q3')} AS q3, {s9('hi')} AS "max", {s9('q3 - q1')} AS iqr,
  {r6('sqrt(n * (n - 1.0)) / (n - 2) * m3 / power(m2, 1.5)')} AS skew,
  {r6('(n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)')} AS kurtosis,
  outliers, {r6('outliers * 100.0 / n')} AS outliers_pct, {r6('zeros * 100.0 / n')} AS zeros_pct
FROM (SELECT any_value(n) n, any_value(rows) rows, any_value(u) u, any_value(m) m, any_value(sd) sd, any_value(vr) vr,
        any_value(lo) lo, any_value(hi) hi, any_value(q1) q1, any_value(q2) q2, any_value(q3) q3, any_value(zeros) zeros,
        avg(power(v - m, 2)) m2, avg(power(v - m, 3)) m3, avg(power(v - m, 4)) m4,
        count(CASE WHEN q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) THEN 1 END) outliers
      FROM (SELECT CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END v FROM {table}) x,
           (SELECT count(*) rows, count(v) n, count(DISTINCT v) u, avg(v) m, stddev_samp(v) sd, var_samp(v) vr, min(v) lo, max(v) hi,
              quantile_cont(v, CAST(0.25 AS DOUBLE)) q1, quantile_cont(v, CAST(0.5 AS DOUBLE)) q2,
              quantile_cont(v, CAST(0.75 AS DOUBLE)) q3, count(CASE WHEN v = 0 THEN 1 END) zeros
            FROM (SELECT CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END v FROM {table}) y) s)""")
    return prefix + union_all(parts)


SIX = ("missing_pct", "skew", "kurtosis", "outliers_pct", "zeros_pct")


@query("d1_numeric_profile", profile_sql("lineitem", LINE_NUM))
def _(t):
    return shown(profile.numeric_profile(t.lineitem, LINE_NUM).drop("normality_p", "shape"), *SIX)


@query("d1_numeric_profile_events", profile_sql("events", ["value", "user_id"]))
def _(t):
    return shown(profile.numeric_profile(t.events, ["value", "user_id"]).drop("normality_p", "shape"), *SIX)


@query("d1_numeric_profile_dirty", profile_sql("dirty_orders", ["price", "amount", "sparse"], with_views("dirty_orders")))
def _(t):
    return shown(profile.numeric_profile(t.view("dirty_orders"), ["price", "amount", "sparse"]).drop("normality_p", "shape"), *SIX)


@query("d1_numeric_profile_wide_ids", """
SELECT 'wide' AS "column", count(o_orderkey) AS "count", count(DISTINCT o_orderkey) AS "unique" FROM orders
UNION ALL SELECT 'fine', count(o_orderkey), count(DISTINCT o_orderkey) FROM orders""")
def _(t):
    df = t.sql("SELECT CAST(o_orderkey AS BIGINT) + 1152921504606846976 AS wide, CAST(o_orderkey AS DECIMAL(20, 0)) / 1000000007.0 + 123456789012 AS fine FROM {orders}")
    return profile.numeric_profile(df.withColumn("fine", F.col("fine").cast("decimal(38,15)")), ["wide", "fine"]).select("column", "count", "unique")


@query("d2_normality")
def _(t):
    return shown(profile.normality(t.lineitem, LINE_NUM), "p_value")


def category_sql(table: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", CAST(coalesce(sum(n), 0) AS BIGINT) AS "count",
  {r6(f"(SELECT count(*) - count({c}) FROM {table}) * 100.0 / (SELECT count(*) FROM {table})")} AS missing_pct,
  count(*) AS "unique", min(CASE WHEN place = 1 THEN v END) AS top_value,
  {r6('max(n) * 100.0 / sum(n)')} AS top_share_pct,
  {r6('CASE WHEN count(*) > 1 THEN -sum(n / total * ln(n / total)) / ln(count(*)) ELSE 0 END')} AS entropy,
  count(CASE WHEN n * 100.0 / total < 1 THEN 1 END) AS rare_categories, count(CASE WHEN n = 1 THEN 1 END) AS singletons
FROM (SELECT v, n, CAST(sum(n) OVER () AS DOUBLE) total, row_number() OVER (ORDER BY n DESC, v) place
      FROM (SELECT CAST({c} AS VARCHAR) v, count(*) n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1))""")
    return prefix + union_all(parts)


CAT_SIX = ("missing_pct", "top_share_pct", "entropy")


@query("d3_categorical_profile", category_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def _(t):
    return shown(counts.category_profile(t.orders, ["o_orderstatus", "o_orderpriority"]), *CAT_SIX)


@query("d3_categorical_profile_dirty", category_sql("dirty_orders", ["priority", "cust_text", "status"], with_views("dirty_orders")))
def _(t):
    return shown(counts.category_profile(t.view("dirty_orders"), ["priority", "cust_text", "status"]), *CAT_SIX)


@query("d4_spelling_variants", with_views("dirty_orders") + """
SELECT 'priority' AS "column", "group", key, spellings, forms FROM (
  SELECT key, spellings, forms, row_number() OVER (ORDER BY place) AS "group" FROM (
    SELECT key, count(*) AS spellings, string_agg(v, '|' ORDER BY v) AS forms, min(place) AS place FROM (
      SELECT v, regexp_replace(lower(v), '[\\W_]+', '', 'g') AS key, row_number() OVER (ORDER BY n DESC, v) AS place
      FROM (SELECT priority AS v, count(*) AS n FROM dirty_orders WHERE priority IS NOT NULL GROUP BY 1))
    GROUP BY key HAVING count(*) > 1))""")
def _(t):
    d = counts.spelling_variants(t.view("dirty_orders"), ["priority"])
    return shown(d.withColumn("forms", F.concat_ws("|", "values")).drop("values"))


@query("d5_value_shares", f"""
SELECT event_type AS value, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM events)')} AS share_pct
FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def _(t):
    return shown(counts.top_values(t.events, "event_type", 3), "share_pct")


def histogram_sql(table: str, c: str, bins: int) -> str:
    return f"""
WITH b AS (SELECT min({c}) lo, max({c}) hi FROM {table}),
h AS (SELECT least(CAST(floor(({c} - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS bin, count(*) n FROM {table}, b GROUP BY 1)
SELECT r.bin, {s9(f'lo + r.bin * ((hi - lo) / {bins})')} AS low, {s9(f'lo + (r.bin + 1) * ((hi - lo) / {bins})')} AS high,
  coalesce(h.n, 0) AS n FROM (SELECT unnest(range({bins})) AS bin) r CROSS JOIN b LEFT JOIN h ON r.bin = h.bin"""


@query("d6_histogram", histogram_sql("events", "value", 20))
def _(t):
    return shown(profile.histogram(t.events, "value", 20))


@query("d6_histogram_price", histogram_sql("orders", "o_totalprice", 30))
def _(t):
    return shown(profile.histogram(t.orders, "o_totalprice", 30))


@query("d7_describe_numeric", union_all([f"""
SELECT '{c}' AS "column", count({c}) AS "count", {s9(f'avg({c})')} AS mean, {s9(f'stddev_samp({c})')} AS std, {s9(f'min({c})')} AS "min",
  {s9(f'quantile_cont(CAST({c} AS DOUBLE), CAST(0.25 AS DOUBLE))')} AS q25, {s9(f'quantile_cont(CAST({c} AS DOUBLE), CAST(0.5 AS DOUBLE))')} AS q50,
  {s9(f'quantile_cont(CAST({c} AS DOUBLE), CAST(0.75 AS DOUBLE))')} AS q75, {s9(f'max({c})')} AS "max" FROM lineitem""" for c in LINE_NUM]))
def _(t):
    return shown(profile.describe_numeric(t.lineitem, LINE_NUM))


@query("d7_describe_categorical", union_all([f"""
SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS "count", count(*) AS "unique", min(CASE WHEN place = 1 THEN v END) AS top, max(n) AS freq
FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) place FROM (SELECT {c} v, count(*) n FROM lineitem GROUP BY 1))"""
                                             for c in ("l_returnflag", "l_linestatus")]))
def _(t):
    return shown(profile.describe_categorical(t.lineitem))


def preview_sql() -> str:
    parts = []
    for c, ty in (("id", "bigint"), ("price", "double"), ("priority", "string"), ("status", "string"), ("sparse", "bigint")):
        num = ty != "string"
        value = f"avg(CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE {c} END)" if num else "CAST(NULL AS DOUBLE)"
        best = "CAST(NULL AS VARCHAR)" if num else f"""(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        parts.append(f"""SELECT '{c}' AS "column", '{ty}' AS type, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct,
  count(DISTINCT {c}) AS "unique", {s9(value)} AS mean, {best} AS most_common FROM dirty_orders""")
    return with_views("dirty_orders") + union_all(parts)


@query("d8_column_preview", preview_sql())
def _(t):
    return shown(profile.column_preview(t.view("dirty_orders"), ["id", "price", "priority", "status", "sparse"]), "missing_pct")


def outlier_count(c: str, table: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT {c} v FROM {table}), (SELECT quantile_cont(CAST({c} AS DOUBLE), CAST(0.25 AS DOUBLE)) a,
  quantile_cont(CAST({c} AS DOUBLE), CAST(0.75 AS DOUBLE)) b FROM {table}) WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))"""


@query("d9_health", f"""
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
SELECT 'rows' AS metric, count(*) AS value FROM events
UNION ALL SELECT 'columns', 6
UNION ALL SELECT 'missing_cells', 0
UNION ALL SELECT 'duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) FROM events
UNION ALL SELECT 'constant', 0
UNION ALL SELECT 'outliers', {outlier_count('value', 'events')} + {outlier_count('user_id', 'events')} + {outlier_count('event_id', 'events')}
UNION ALL SELECT 'unencoded', 2
UNION ALL SELECT 'high_cardinality', (SELECT CASE WHEN count(DISTINCT props) > 20 AND count(DISTINCT props) > 0.5 * count(*) THEN 1 ELSE 0 END FROM events)
UNION ALL SELECT 'numeric_columns', 3
UNION ALL SELECT 'categorical_columns', 2)""")
def _(t):
    return profile.health_table(t.events)


@query("d10_row_gaps", with_views("dirty_orders") + f"""
SELECT count(*) AS rows, {r6('avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) * 100')} AS rows_with_gap_pct,
  count(CASE WHEN g > 5 THEN 1 END) AS rows_over_half_missing, count(CASE WHEN g = 0 THEN 1 END) AS complete_rows
FROM (SELECT (price IS NULL)::INT + (status IS NULL)::INT + (sparse IS NULL)::INT + (mostly_empty IS NULL)::INT AS g FROM dirty_orders)""")
def _(t):
    return shown(profile.row_gaps(t.view("dirty_orders")), "rows_with_gap_pct")


def bounds_sql(cols: list[str], table: str, low: str, high: str, stats: str) -> str:
    return union_all([f"""
SELECT '{c}' AS "column", count(CASE WHEN v < lo OR v > hi THEN 1 END) AS outliers,
  {r6('count(CASE WHEN v < lo OR v > hi THEN 1 END) * 100.0 / count(v)')} AS outliers_pct,
  {s9('any_value(lo)')} AS lower_bound, {s9('any_value(hi)')} AS upper_bound
FROM (SELECT CAST({c} AS DOUBLE) v FROM {table}), (SELECT {low} AS lo, {high} AS hi FROM ({stats.format(c=c, t=table)}))""" for c in cols])


QUART = "SELECT quantile_cont(CAST({c} AS DOUBLE), CAST(0.25 AS DOUBLE)) a, quantile_cont(CAST({c} AS DOUBLE), CAST(0.75 AS DOUBLE)) b FROM {t}"
MEANSD = "SELECT avg({c}) m, stddev_samp({c}) s FROM {t}"
MAD = "SELECT any_value(med) med, median(abs({c} - med)) mad FROM {t}, (SELECT median(CAST({c} AS DOUBLE)) med FROM {t})"


@query("d11_outliers_iqr", bounds_sql(["value", "user_id"], "events", "a - 1.5 * (b - a)", "b + 1.5 * (b - a)", QUART))
def _(t):
    return shown(profile.outlier_table(t.events, ["value", "user_id"], "IQR")[0], "outliers_pct")


@query("d11_outliers_zscore", bounds_sql(["value", "user_id"], "events", "m - 3 * s", "m + 3 * s", MEANSD))
def _(t):
    return shown(profile.outlier_table(t.events, ["value", "user_id"], "Z")[0], "outliers_pct")


@query("d11_outliers_mad", bounds_sql(["value", "user_id"], "events", "med - 3.5 * mad / 0.6745", "med + 3.5 * mad / 0.6745", MAD))
def _(t):
    return shown(profile.outlier_table(t.events, ["value", "user_id"], "MAD")[0], "outliers_pct")


@query("d12_outlier_rates", union_all([f"""
SELECT '{c}' AS "column", {outlier_count(c, 'lineitem')} AS outliers, {r6(f"{outlier_count(c, 'lineitem')} * 100.0 / (SELECT count(*) FROM lineitem)")} AS outliers_pct"""
                                       for c in ("l_quantity", "l_extendedprice", "l_tax")]))
def _(t):
    found = profile.iqr_outliers(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    rows = [{"column": c, "outliers": o["outliers"], "outliers_pct": o["outliers"] / o["n"] * 100} for c, o in found.items()]
    return shown(profile.small_table(t.spark, rows, "column string, outliers long, outliers_pct double"), "outliers_pct")


@query("d14_file_summary")
def _(t):
    return shown(profile.file_summary(t.lineitem), "null_pct")


@query("d18_compare_numeric", with_views("dirty_orders") + union_all([f"""
SELECT '{c}' AS "column", {s9(f'(SELECT avg({o}) FROM orders)')} AS mean_before, {s9(f'avg({e})')} AS mean_after,
  {s9(f'(SELECT stddev_samp({o}) FROM orders)')} AS std_before, {s9(f'stddev_samp({e})')} AS std_after,
  CAST(0 AS BIGINT) AS missing_before, count(*) - count({e}) AS missing_after FROM dirty_orders"""
                                                                       for c, o, e in (("id", "o_orderkey", "id"), ("price", "o_totalprice", "CASE WHEN isinf(price) THEN NULL ELSE price END"))]))
def _(t):
    return shown(profile.compare_numeric(t.view("clean_orders"), t.view("dirty_orders")))


@query("b34_column_pickers")
def _(t):
    df = t.lineitem
    num, cat, when = C.by_role(df, target="l_tax", roles={"l_orderkey": "id", "l_linenumber": "categorical"})
    top = C.most_filled(df, num, 3)
    rows = [{"column": c, "picked_as": k, "in_top": c in top} for k, cols in (("numeric", num), ("categorical", cat), ("datetime", when)) for c in cols]
    return profile.small_table(t.spark, rows, "column string, picked_as string, in_top boolean")
