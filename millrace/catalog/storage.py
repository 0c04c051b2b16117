"""Sources, sinks, saved pipelines, model comparison, identity, running profile and stream queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.catalog.profiles import profile_sql  # noqa: F401
from millrace.catalog.steps import ORDERS_TRAIN, SCALED_OUT, pipeline_sql
from millrace.operators import identity, missingness, profile, running
from millrace.operators.contract import infer_contract
from millrace.operators.profile import small_table
from millrace.operators.sampling import split_frame
from millrace.plans import bundle, lab, scaling, spec
from millrace.plans.pipeline import build_pipeline
from millrace.plans.settings import default_settings, merged
from millrace.sources import readers, writers
from millrace.streaming import jobs

DIRTY = with_views("dirty_orders")
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority"


def roundtrip(t, kind: str, ext: str, **read):
    """orders written to the shared folder and read back by extension."""
    path = jobs.scratch(t.spark, "orders") + "." + ext
    writers.write_table(t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), path, kind)
    df = readers.read_table(t.spark, path, **read)
    return shown(df.withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


ROUNDTRIP = f"SELECT o_orderkey, o_custkey, o_orderstatus, {s9('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"


@query("a1_read_csv", ROUNDTRIP)
def _(t):
    return roundtrip(t, "csv", "csv")


@query("a2_detect_separator", ROUNDTRIP)
def _(t):
    path = jobs.scratch(t.spark, "orders") + ".csv"
    t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option("header", True).option("sep", ";").csv(path)
    return shown(readers.read_table(t.spark, path).withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


@query("a3_read_tsv", ROUNDTRIP)
def _(t):
    path = jobs.scratch(t.spark, "orders") + ".tsv"
    t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.option("header", True).option("sep", "\t").csv(path)
    return shown(readers.read_table(t.spark, path).withColumn("o_orderdate", F.col("o_orderdate").cast("string")))


@query("a4_read_json", ROUNDTRIP)
def _(t):
    return roundtrip(t, "json", "json")


@query("a4_read_json_pretty", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def _(t):
    # each file of this folder is one array of records written over several lines
    path = jobs.scratch(t.spark, "pretty")
    part = F.pmod(F.col("c_custkey"), F.lit(16))
    record = F.concat(F.lit('{"c_custkey": '), F.col("c_custkey"), F.lit(',\n "c_name": "'), F.col("c_name"), F.lit('",\n "c_nationkey": '), F.col("c_nationkey"), F.lit("}"))
    t.customer.groupBy(part.alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value")).select("part", "value").write.partitionBy("part").text(path)
    return shown(readers.read_json(t.spark, path).drop("part"))


@query("a5_read_parquet", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, " + s9("c_acctbal") + " AS c_acctbal, c_mktsegment FROM customer")
def _(t):
    return shown(readers.read_table(t.spark, f"{t.folder}/customer.parquet"))


@query("a6_read_by_extension", ROUNDTRIP)
def _(t):
    return roundtrip(t, "parquet", "parquet")


@query("a7_tidy_headers", 'SELECT n_nationkey::BIGINT AS "key", n_name AS "key_1", n_regionkey::BIGINT AS "column_3" FROM nation')
def _(t):
    return shown(readers.tidy(t.nation.toDF(" key", "key ", "  ")))


@query("a9_csv_head")
def _(t):
    path = jobs.scratch(t.spark, "orders") + ".csv"
    writers.write_table(t.orders, path, "csv")
    return readers.csv_head(t.spark, path, 100)


@query("a10_write_with_index", f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS \"index\", o_orderkey, {s9('o_totalprice')} AS o_totalprice FROM orders")
def _(t):
    path = jobs.scratch(t.spark, "orders") + ".parquet"
    writers.write_table(t.orders.select("o_orderkey", "o_totalprice"), path, "parquet", index_by="o_orderkey")
    return shown(readers.read_table(t.spark, path))


def prepared_log(t):
    p = build_pipeline(merged(default_settings(), {"Transform": {"outliers": "Remove rows with outliers (IQR)"}}), "status")
    p.fit_transform(t.view("dirty_orders").select("id", "amount", "priority", "status"))
    log = writers.log_from_pipeline(t.spark, p.log)
    p.release()
    return log


LOG_SQL = DIRTY + """
, k AS (SELECT amount FROM dirty_orders WHERE status IS NOT NULL), b AS (SELECT quantile_cont(amount, CAST(0.25 AS DOUBLE)) a, quantile_cont(amount, CAST(0.75 AS DOUBLE)) b FROM k),
n AS (SELECT (SELECT count(*) FROM dirty_orders) AS n0, (SELECT count(*) FROM k) AS n1, (SELECT count(*) FROM k, b WHERE NOT (amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a))) AS n2)
SELECT position::BIGINT AS position, step, rows, 4::BIGINT AS cols, rows - lag(rows) OVER (ORDER BY position) AS row_change, CASE WHEN position > 1 THEN 0 END::BIGINT AS col_change FROM (
SELECT 1 AS position, 'Infinite values' AS step, n0 AS rows FROM n UNION ALL SELECT 2, 'Text cleanup', n0 FROM n UNION ALL SELECT 3, 'Column filter', n0 FROM n
UNION ALL SELECT 4, 'Missing values', n1 FROM n UNION ALL SELECT 5, 'Outliers', n2 FROM n UNION ALL SELECT 6, 'Encoding', n2 FROM n UNION ALL SELECT 7, 'Scaling', n2 FROM n)"""


@query("f7_log_deltas", LOG_SQL)
def _(t):
    return prepared_log(t).drop("detail")


@query("a11_log_sink", LOG_SQL)
def _(t):
    path = jobs.scratch(t.spark, "log")
    writers.write_log(prepared_log(t), path, "csv")
    back = t.spark.read.option("header", True).option("inferSchema", True).csv(path)
    return shown(back.drop("detail"))


@query("d13_mergeable_numbers", union_all([f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct, {s9(f'avg({c})')} AS mean,
  {s9(f'stddev_samp({c})')} AS std, {s9(f'min({c})')} AS "min", {s9(f'max({c})')} AS "max" FROM ({with_views('dirty_events')} SELECT * FROM dirty_events)""" for c in ("value", "user_id")]))
def _(t):
    parts = running.number_partials(t.view("dirty_events"), ["value", "user_id"], F.col("event_type"))
    return shown(running.merged_numbers(parts), "missing_pct")


TEXT_PROFILE = with_views("dirty_events") + f"""
SELECT 'props' AS "column", (SELECT count(*) FROM dirty_events) AS rows, (SELECT count(*) - count(props) FROM dirty_events) AS missing,
  {r6('(SELECT (count(*) - count(props)) * 100.0 / count(*) FROM dirty_events)')} AS missing_pct, count(*) AS "unique", min(CASE WHEN p = 1 THEN props END) AS top_value, {r6('max(n) * 100.0 / sum(n)')} AS top_share_pct
FROM (SELECT props, n, row_number() OVER (ORDER BY n DESC, props) AS p FROM (SELECT props, count(*) AS n FROM dirty_events WHERE props IS NOT NULL GROUP BY 1))"""


@query("d13_mergeable_texts", TEXT_PROFILE)
def _(t):
    d = t.view("dirty_events")
    halves = running.text_partials(d.filter("event_type < 'm'"), ["props"]).unionByName(running.text_partials(d.filter("event_type >= 'm'"), ["props"]))
    return shown(running.merged_texts(halves), "missing_pct", "top_share_pct")


# --- saved pipelines ------------------------------------------------------------------------------------------------

def saved(t, **split):
    cfg = default_settings()
    p = build_pipeline(cfg, "status")
    train = t.view("dirty_orders").filter(ORDERS_TRAIN)
    p.fit_transform(train)
    p.release()
    return spec.loads(spec.dumps(spec.make_spec(p, cfg, split, train)))


@query("k1_step_order")
def _(t):
    p = build_pipeline({"Scale": {}, "Encode": {}, "Transform": {"skew": True, "corr": 0.95, "drop": ["id"]}, "Clean": default_settings()["Clean"], "Types": {"types": {"priority": "categorical"}}}, "status")
    p.fit_transform(t.view("dirty_orders").select("id", "amount", "priority", "status", "sparse"))
    return p.log_table(t.spark).select("position", "step")


@query("k4_restored_pipeline", pipeline_sql(ORDERS_TRAIN, "true"))
def _(t):
    from millrace.plans.pipeline import Pipeline
    return shown(Pipeline.from_state(saved(t)["pipeline_state"]).transform(t.view("dirty_orders")), *SCALED_OUT)


@query("k5_spec_contract")
def _(t):
    from millrace.operators.contract import contract_table
    return shown(contract_table(t.spark, saved(t)["input_contract"]))


@query("k6_apply_saved", pipeline_sql(ORDERS_TRAIN, "true"))
def _(t):
    # a reviewed contract: that of all rows, without an upper end of price, as infinite prices are for the pipeline to treat
    reviewed = infer_contract(t.view("dirty_orders").drop("status"))
    reviewed["columns"]["price"]["max"] = None
    return shown(spec.apply_saved(saved(t) | {"input_contract": reviewed}, t.view("dirty_orders")), *SCALED_OUT)


@query("k6_apply_saved_refused", DIRTY + f""", tr AS (SELECT * FROM dirty_orders WHERE {ORDERS_TRAIN}), new AS (SELECT * REPLACE (amount * 100 AS amount, 'late' AS priority) FROM dirty_orders)
SELECT 'amount' AS "column", 'max' AS rule, count(*) AS "count", 0::BIGINT AS applied FROM new WHERE amount > (SELECT max(amount) FROM tr)
UNION ALL SELECT 'priority', 'allowed', count(*), 0 FROM new""")
def _(t):
    new = t.view("dirty_orders").withColumns({"amount": F.col("amount") * 100, "priority": F.lit("late")})
    applied, issues = 1, None
    try:
        spec.apply_saved(saved(t), new)
    except spec.ContractBroken as broken:
        applied, issues = 0, broken.report.issues
    return issues.filter("level = 'error' AND column IN ('amount', 'priority')").select("column", "rule", "count", F.lit(applied).cast("long").alias("applied"))


@query("k4_bundle_many_categories", """
SELECT l_orderkey AS id, dense_rank() OVER (ORDER BY name) - 1.0 AS name FROM (SELECT l_orderkey, concat('name-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS name FROM lineitem)""")
def _(t):
    d = t.sql("SELECT l_orderkey AS id, concat('name-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS name FROM {lineitem}")
    cfg = {"Clean": {"dups": False, "max_missing": 100, "drop_constant": False}, "Encode": {"high": "Ordinal"}}
    p = build_pipeline(cfg, None)
    p.fit_transform(d)
    p.release()
    path = jobs.scratch(t.spark, "bundle")
    bundle.save_bundle(t.spark, spec.make_spec(p, cfg, {}, d), path)
    return spec.transform_saved(bundle.load_bundle(t.spark, path), d).select(F.col("id").cast("long"), F.col("name").cast("double"))


REFIT = """SELECT part, count(*) AS rows FROM (SELECT CASE WHEN rn <= round_even(n * 20 / 100.0, 0) THEN 'test' WHEN rn <= round_even(n * 20 / 100.0, 0) + round_even(n * 10 / 100.0, 0) THEN 'val' ELSE 'train' END AS part
  FROM (SELECT count(*) OVER (PARTITION BY status) AS n, row_number() OVER (PARTITION BY status ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR)))) AS rn FROM dirty_orders WHERE status IS NOT NULL)) GROUP BY 1"""


@query("k7_refit_sizes", DIRTY + REFIT)
def _(t):
    parts = spec.refit(saved(t, test_pct=20, val_pct=10, seed=42, stratify=True, key="id"), t.view("dirty_orders"))
    sizes = [parts[k].agg(F.lit(k).alias("part"), F.count("*").alias("rows")) for k in ("train", "val", "test")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("k7_refit_seed_zero", DIRTY + """SELECT id FROM (
  SELECT id, count(*) OVER (PARTITION BY status) AS n, row_number() OVER (PARTITION BY status ORDER BY md5(concat_ws('|', '0', CAST(id AS VARCHAR)))) AS rn
  FROM dirty_orders WHERE status IS NOT NULL) WHERE rn <= round_even(n * 20 / 100.0, 0)""")
def _(t):
    how = spec.split_of(saved(t, test_pct=20, val_pct=0, seed=0, stratify=True, key="id")["split"])
    return split_frame(t.view("dirty_orders"), "status", how["test_pct"], how["val_pct"], how["seed"], how["stratify"], how["key"]).test.select("id")


@query("k8_default_settings")
def _(t):
    kind = lab.is_classification(t.orders, "o_orderstatus")
    return small_table(t.spark, [{"step": s, "setting": k, "value": str(v)} for s, p in default_settings(kind).items() for k, v in p.items()], "step string, setting string, value string")


# --- model comparison -----------------------------------------------------------------------------------------------

@query("k17_lab_variants")
def _(t):
    v = lab.variants_for("Missing numbers", is_class=lab.is_classification(t.orders, "o_orderstatus"))
    return small_table(t.spark, [{"variant": n, "num_missing": c["Clean"]["num_missing"], "scaling": c["Scale"]["method"]} for n, c in v.items()], "variant string, num_missing string, scaling string")


LEVELS = ("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, c_nationkey AS nation, "
          "CASE WHEN c_acctbal > 4000 THEN 'high' ELSE 'low' END AS level FROM {customer}")


def lab_of(t, values=None, model=None):
    """Default folds over all customers."""
    roles = {"types": {"c_custkey": "id"}}
    return lab.run_lab(t.sql(LEVELS), "level", lab.variants_for("Missing numbers", values, roles=roles), model, key="c_custkey")


@query("k18_lab_folds")
def _(t):
    return shown(lab_of(t)["folds"].select("variant", "fold", "metric", "score", "error"), "score")


@query("k18_lab_boosting_with_gaps")
def _(t):
    return shown(lab_of(t, ["Median", lab.LEFT], "Gradient boosting")["folds"].select("variant", "fold", "metric", "score", "error"), "score")


@query("k18_lab_rows_kept", f"""
WITH d AS ({LEVELS.format(customer='customer')}),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('42|' || c_custkey)) AS r, count(*) OVER (PARTITION BY level) AS n FROM d),
f AS (SELECT CAST((r > n // 5) AS BIGINT) + CAST((r > n * 2 // 5) AS BIGINT) + CAST((r > n * 3 // 5) AS BIGINT) + CAST((r > n * 4 // 5) AS BIGINT) AS fold, balance FROM r)
SELECT v.variant, f.fold, {r6("count(CASE WHEN v.variant <> 'Drop rows' OR balance IS NOT NULL THEN 1 END) * 100.0 / count(*)")} AS kept
FROM f, (VALUES ('Fill with 0'), ('Leave as is'), ('Drop rows')) AS v(variant) GROUP BY v.variant, f.fold""")
def _(t):
    folds = lab_of(t, ["Fill with 0", lab.LEFT, "Drop rows"])["folds"]
    return shown(folds.filter("metric = 'rows kept %'").select("variant", "fold", F.col("score").alias("kept")), "kept")


PREDICTED = "SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN o_orderstatus ELSE 'O' END AS prediction FROM {orders}"


@query("k19_class_metrics", f"""
WITH p AS ({PREDICTED.format(orders='orders')}), c AS (SELECT DISTINCT label AS c FROM p),
m AS (SELECT c, (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS hit, (SELECT count(*) FROM p WHERE label = c) AS real, (SELECT count(*) FROM p WHERE prediction = c) AS said FROM c)
SELECT 'accuracy' AS metric, {r6('(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) FROM p)')} AS score FROM (SELECT 1)
UNION ALL SELECT 'balanced accuracy', {r6('avg(hit * 1.0 / real)')} FROM m UNION ALL SELECT 'macro F1', {r6('avg(2.0 * hit / (real + said))')} FROM m""")
def _(t):
    s = lab.class_scores(t.sql(PREDICTED), "label", "prediction")
    return shown(small_table(t.spark, [{"metric": k, "score": v} for k, v in s.items()], "metric string, score double"), "score")


@query("k19_roc_auc", f"""
WITH r AS (SELECT event_type = 'click' AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events)
SELECT {r6('(sum(CASE WHEN y THEN r END) - count(CASE WHEN y THEN 1 END) * (count(CASE WHEN y THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y THEN 1 END) * 1.0 * count(CASE WHEN NOT y THEN 1 END))')} AS auc FROM r""")
def _(t):
    auc = lab.roc_auc(t.events, F.col("event_type") == "click", F.col("value"))
    return shown(small_table(t.spark, [{"auc": auc}], "auc double"), "auc")


@query("k19_number_metrics", f"""
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT 'R2' AS metric, {s9('1 - avg(power(y - p, 2)) / var_pop(y)')} AS score FROM p UNION ALL SELECT 'RMSE', {s9('sqrt(avg(power(y - p, 2)))')} FROM p UNION ALL SELECT 'MAE', {s9('avg(abs(y - p))')} FROM p""")
def _(t):
    s = lab.number_scores(t.sql("SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM {lineitem}"), "y", "p")
    return shown(small_table(t.spark, [{"metric": k, "score": v} for k, v in s.items()], "metric string, score double"))


@query("k20_verdicts", f"""
WITH f AS (SELECT c_nationkey % 5 AS fold, avg(c_acctbal) AS a, avg(c_acctbal) + 500 + 10 * (c_nationkey % 5) AS b, median(c_acctbal) AS c FROM customer GROUP BY 1, c_nationkey % 5),
v AS (SELECT 'a' AS variant, a AS s, a FROM f UNION ALL SELECT 'b', b, a FROM f UNION ALL SELECT 'c', c, a FROM f)
SELECT variant, {s9('avg(s)')} AS mean, {s9('stddev_samp(s)')} AS std, 0::BIGINT AS failed_folds, {s9('avg(s - a)')} AS difference,
  CASE WHEN variant = 'a' THEN 'baseline' WHEN abs(avg(s - a)) <= stddev_samp(s - a) THEN 'no clear difference' WHEN avg(s - a) > 0 THEN 'better than the first' ELSE 'worse than the first' END AS verdict FROM v GROUP BY variant""")
def _(t):
    f = t.sql("SELECT c_nationkey % 5 AS fold, avg(c_acctbal) AS a, avg(c_acctbal) + 500 + 10 * (c_nationkey % 5) AS b, median(c_acctbal) AS c FROM {customer} GROUP BY c_nationkey % 5")
    scores = f.unpivot("fold", ["a", "b", "c"], "variant", "score").select("variant", F.col("fold").cast("long"), F.lit("R2").alias("metric"), "score", F.lit(None).cast("string").alias("error"))
    return shown(lab.verdicts(scores, "R2", 5, ["a", "b", "c"]))


# --- identity and types ---------------------------------------------------------------------------------------------

@query("l1_narrow_types", union_all([f"""SELECT '{c}' AS "column", 'bigint' AS before, CASE WHEN max({c}) < 128 THEN 'tinyint' WHEN max({c}) < 32768 THEN 'smallint' ELSE 'int' END AS after FROM lineitem""" for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    + ["SELECT 'l_linenumber', 'int', 'tinyint' FROM lineitem HAVING max(l_linenumber) < 128"]))
def _(t):
    return identity.narrow_types(t.lineitem)[1]


@query("l1_category_candidates", union_all([f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", count(DISTINCT {c}) <= 5000 AND count(DISTINCT {c}) <= 0.5 * count(*) AS suggested FROM orders""" for c in ("o_orderstatus", "o_orderpriority")]))
def _(t):
    return identity.category_candidates(t.orders)


@query("l2_fingerprint")
def _(t):
    return small_table(t.spark, [{"table": n, "fingerprint": identity.fingerprint(getattr(t, n))} for n in ("orders", "events")], "table string, fingerprint string")


@query("l3_content_fingerprint")
def _(t):
    return small_table(t.spark, [{"table": n, "fingerprint": identity.content_fingerprint(getattr(t, n))} for n in ("orders", "events", "documents")], "table string, fingerprint string")


# --- streams --------------------------------------------------------------------------------------------------------

@query("l5_stream_apply", pipeline_sql(ORDERS_TRAIN, "true"))
def _(t):
    s, path = saved(t), jobs.scratch(t.spark, "applied")
    from millrace.catalog.base import VIEWS
    stream = jobs.read_files(t.spark, t.folder, "orders.parquet", t.orders.schema)
    jobs.write_available(jobs.apply_stream(s, t.spark.sql(VIEWS["dirty_orders"], orders=stream)), path)
    return shown(t.spark.read.parquet(path), *SCALED_OUT)


@query("l6_stream_contract", DIRTY + """
SELECT CASE WHEN price IS NULL OR isinf(price) OR status IS NULL OR priority NOT IN (SELECT o_orderpriority FROM orders) THEN 'bad' ELSE 'good' END AS side, count(*) AS rows, sum(id)::BIGINT AS ids FROM dirty_orders GROUP BY 1""")
def _(t):
    from millrace.catalog.base import VIEWS
    k = infer_contract(t.view("clean_orders").select("price", "priority", "status", "odate"))
    stream = t.spark.sql(VIEWS["dirty_orders"], orders=jobs.read_files(t.spark, t.folder, "orders.parquet", t.orders.schema))
    path = jobs.scratch(t.spark, "checked")
    good, bad = jobs.split_by_contract(stream.select("id", "price", "priority", "status", "odate"), k)
    jobs.write_available(good.select("id"), path + "/good")
    jobs.write_available(bad.select("id"), path + "/bad")
    sides = [t.spark.read.parquet(f"{path}/{s}").agg(F.lit(s).alias("side"), F.count("*").alias("rows"), F.sum("id").alias("ids")) for s in ("good", "bad")]
    return sides[0].unionByName(sides[1])


@query("l7_stream_profile", TEXT_PROFILE)
def _(t):
    from millrace.catalog.base import VIEWS
    path = jobs.scratch(t.spark, "profile")
    stream = t.spark.sql(VIEWS["dirty_events"], events=jobs.read_files(t.spark, t.folder, "events.parquet", t.events.schema))
    jobs.profile_stream(stream, ["value", "user_id"], ["props"], path)
    return shown(jobs.stream_profile(t.spark, path)[1], "missing_pct", "top_share_pct")


@query("l7_stream_profile_numbers", union_all([f"""
SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct, {s9(f'avg({c})')} AS mean,
  {s9(f'stddev_samp({c})')} AS std, {s9(f'min({c})')} AS "min", {s9(f'max({c})')} AS "max" FROM ({with_views('dirty_events')} SELECT * FROM dirty_events)""" for c in ("value", "user_id")]))
def _(t):
    from millrace.catalog.base import VIEWS
    path = jobs.scratch(t.spark, "profile")
    stream = t.spark.sql(VIEWS["dirty_events"], events=jobs.read_files(t.spark, t.folder, "events.parquet", t.events.schema))
    jobs.profile_stream(stream, ["value", "user_id"], ["props"], path)
    return shown(jobs.stream_profile(t.spark, path)[0], "missing_pct")


# --- growth ---------------------------------------------------------------------------------------------------------

SAMPLED = """WITH p AS (SELECT *, CAST('0x' || substr(md5('0|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS place FROM orders),
n AS (SELECT share, count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM p, (VALUES (0.25), (0.5), (1.0)) s(share) WHERE place < share GROUP BY 1)"""


def order_work(t):
    """Tasks that read the table once and shuffle one row for each key, or for each row."""
    tasks = {"count by key": lambda d: d.groupBy("o_orderkey").count().write.format("noop").mode("overwrite").save(),
             "distinct rows": lambda d: d.distinct().write.format("noop").mode("overwrite").save()}
    return scaling.measure(t.orders, tasks, "o_orderkey")


@query("l4_growth_rows", SAMPLED + """
SELECT task, CAST(share AS DOUBLE) AS share, rows, rows AS rows_read, CASE WHEN task = 'count by key' THEN keys ELSE rows END AS rows_shuffled
FROM n, (VALUES ('count by key'), ('distinct rows')) w(task)""")
def _(t):
    return order_work(t).drop("seconds")


@query("l4_growth", SAMPLED + f"""
SELECT task, count(*) AS points, {r6('regr_slope(ln(rows), ln(rows))')} AS read_slope, {r6("regr_slope(ln(CASE WHEN task = 'count by key' THEN keys ELSE rows END), ln(rows))")} AS shuffle_slope
FROM n, (VALUES ('count by key'), ('distinct rows')) w(task) GROUP BY 1""")
def _(t):
    return shown(scaling.growth_slopes(order_work(t)), "read_slope", "shuffle_slope")


@query("l4_growth_of_analysis")
def _(t):
    """Slopes of whole analyses: passes over the table show as the same slope, a plan that outgrows the table as a larger one."""
    tasks = {"numeric profile": lambda d: profile.numeric_profile(d).collect(), "missing analysis": lambda d: [x.collect() for x in missingness.missing_analysis(d).values()]}
    return shown(scaling.growth_slopes(scaling.measure(t.view("dirty_events"), tasks, "id")), "read_slope", "shuffle_slope")
