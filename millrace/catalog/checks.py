"""Contract, drift, role, advice and target queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.catalog.profiles import outlier_count
from millrace.catalog.relations import NUMBER, ORDER_GAPS, TRIMMED, V_FIX, chi_sql, eta_sql, nmi_sql, rank_cte
from millrace.operators import advice, contract, drift, roles, target
from millrace.operators import columns as C
from millrace.operators.profile import small_table
from millrace.plans.pipeline import build_pipeline
from millrace.plans.settings import default_settings, merged

DIRTY = with_views("dirty_orders")
Q25, Q75 = "quantile_cont(CAST({c} AS DOUBLE), CAST(0.25 AS DOUBLE))", "quantile_cont(CAST({c} AS DOUBLE), CAST(0.75 AS DOUBLE))"

# --- contract ------------------------------------------------------------------------------------------------------


def contract_sql() -> str:
    parts = []
    for c, kind in (("id", "numeric"), ("amount", "numeric"), ("sparse", "numeric"), ("cust_text", "numeric"), ("priority", "text"), ("status", "text"), ("odate", "datetime")):
        num = kind == "numeric"
        value = f"TRY_CAST({c} AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        nullable = "true" if c == "cust_text" else f"count(*) > count({c})"
        allowed = f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM dirty_orders WHERE {c} IS NOT NULL))" if kind == "text" else "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, {nullable} AS nullable, false AS "unique", {s9(f'min({value})')} AS "min", {s9(f'max({value})')} AS "max", {allowed} AS allowed FROM dirty_orders""")
    return DIRTY + union_all(parts)


@query("j1_infer_contract", contract_sql())
def _(t):
    df = t.view("dirty_orders").select("id", "amount", "sparse", "cust_text", "priority", "status", "odate")
    return shown(contract.contract_table(t.spark, contract.infer_contract(df)))


@query("j1_infer_contract_unique", """SELECT 'c_name' AS "column", count(DISTINCT c_name) = count(*) AS "unique" FROM customer
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) = count(*) FROM customer""")
def _(t):
    k = contract.contract_table(t.spark, contract.infer_contract(t.customer))
    return k.filter("kind = 'text'").select("column", "unique")


def learned(t):
    return contract.infer_contract(t.view("clean_orders").select("price", "priority", "status", "odate"))


@query("j2_schema_rules", """
SELECT 'error' AS level, 'cust' AS "column", 'exists' AS rule FROM orders HAVING count(*) > 0
UNION ALL SELECT 'warning', 'amount, cust_text, sparse, mostly_empty, const_col', 'extra' FROM orders HAVING count(*) > 0""")
def _(t):
    k = contract.infer_contract(t.view("clean_orders"))
    issues = contract.validate(t.view("dirty_orders"), k).issues
    return issues.filter("rule in ('exists', 'extra')").select("level", "column", "rule")


@query("j3_type_rule", DIRTY + f"""
SELECT 'priority' AS "column", 'type' AS rule, count(CASE WHEN priority IS NOT NULL AND {TRIMMED.format(c='priority')} <> '' AND NOT regexp_full_match({TRIMMED.format(c='priority')}, {NUMBER}) THEN 1 END) AS "count" FROM dirty_orders
UNION ALL SELECT 'cust_text', 'nullable', count(CASE WHEN {TRIMMED.format(c='cust_text')} = '' THEN 1 END) FROM dirty_orders""")
def _(t):
    k = {"columns": {"priority": {"kind": "numeric", "nullable": True}, "cust_text": {"kind": "numeric", "nullable": False}}}
    return contract.validate(t.view("dirty_orders").select("priority", "cust_text"), k).issues.select("column", "rule", "count")


@query("j4_range_rules", DIRTY + """
SELECT * FROM (SELECT 'price' AS "column", 'max' AS rule, count(CASE WHEN price > (SELECT max(o_totalprice) FROM orders) THEN 1 END) AS "count" FROM dirty_orders
UNION ALL SELECT 'amount', 'min', count(CASE WHEN amount < 1000 THEN 1 END) FROM dirty_orders
UNION ALL SELECT 'amount', 'max', count(CASE WHEN amount > 500000 THEN 1 END) FROM dirty_orders) WHERE "count" > 0""")
def _(t):
    k = {"columns": {"price": {"kind": "numeric", "max": t.orders.agg(F.max("o_totalprice")).first()[0]}, "amount": {"kind": "numeric", "min": 1000.0, "max": 500000.0}}}
    return contract.validate(t.view("dirty_orders").select("price", "amount"), k).issues.select("column", "rule", "count")


@query("j5_nullable_rule", DIRTY + """
SELECT 'price' AS "column", count(*) - count(price) AS "count" FROM dirty_orders UNION ALL SELECT 'status', count(*) - count(status) FROM dirty_orders""")
def _(t):
    issues = contract.validate(t.view("dirty_orders").select("price", "priority", "status", "odate"), learned(t)).issues
    return issues.filter("rule = 'nullable'").select("column", "count")


@query("j6_allowed_rule", DIRTY + """
SELECT 'priority' AS "column", count(CASE WHEN priority NOT IN (SELECT o_orderpriority FROM orders) THEN 1 END) AS "count" FROM dirty_orders""")
def _(t):
    issues = contract.validate(t.view("dirty_orders").select("price", "priority", "status", "odate"), learned(t)).issues
    return issues.filter("rule = 'allowed'").select("column", "count")


@query("j7_unique_rule", """
SELECT 'text' AS "column", 'unique' AS rule, CAST(sum(n) AS BIGINT) AS "count" FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)""")
def _(t):
    return contract.validate(t.documents.select("text"), {"columns": {"text": {"kind": "text", "unique": True}}}).issues.select("column", "rule", "count")


@query("j7_unique_bad_rows", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def _(t):
    k = {"columns": {"text": {"kind": "text", "unique": True}}}
    return contract.validate(t.documents.select("doc_id", "text"), k).bad_rows.select("doc_id")


@query("j8_bad_rows", DIRTY + """
SELECT id, concat_ws(',', CASE WHEN price > (SELECT max(o_totalprice) FROM orders) THEN 'price:max' END, CASE WHEN price IS NULL THEN 'price:nullable' END,
  CASE WHEN priority NOT IN (SELECT o_orderpriority FROM orders) THEN 'priority:allowed' END, CASE WHEN status IS NULL THEN 'status:nullable' END) AS broken
FROM dirty_orders WHERE price IS NULL OR isinf(price) OR status IS NULL OR priority NOT IN (SELECT o_orderpriority FROM orders)""")
def _(t):
    bad = contract.validate(t.view("dirty_orders").select("id", "price", "priority", "status", "odate"), learned(t)).bad_rows
    return bad.select("id", F.array_join("broken_rules", ",").alias("broken"))


@query("j8_report", DIRTY + """
SELECT 'failed' AS status, count(*) AS issues FROM (SELECT 1 FROM dirty_orders HAVING count(*) > count(price) UNION ALL SELECT 1 FROM dirty_orders HAVING count(*) > count(status)
UNION ALL SELECT 1 FROM dirty_orders HAVING max(price) > (SELECT max(o_totalprice) FROM orders) UNION ALL SELECT 1 FROM dirty_orders HAVING count(CASE WHEN priority NOT IN (SELECT o_orderpriority FROM orders) THEN 1 END) > 0)""")
def _(t):
    r = contract.validate(t.view("dirty_orders").select("price", "priority", "status", "odate"), learned(t))
    return small_table(t.spark, [{"status": r.status, "issues": r.issues.count()}], "status string, issues long")


@query("i4_closest_name")
def _(t):
    k = contract.infer_contract(t.orders.select("o_orderkey", "o_totalprice"))
    renamed = t.orders.withColumnRenamed("o_totalprice", "o_total_price")
    return contract.validate(renamed, k).issues.filter("rule = 'exists'").select("column", "message")


# --- drift ----------------------------------------------------------------------------------------------------------

EARLY, LATE = "ts < TIMESTAMP '2024-01-16 00:00:00'", "ts >= TIMESTAMP '2024-01-16 00:00:00'"
LATE_SQL = "SELECT event_id, ts, user_id * 2 AS user_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE event_type END AS event_type, value + user_id / 10.0 AS value, 1 AS extra FROM events WHERE " + LATE


def versions(t):
    a = t.events.filter(EARLY.replace("TIMESTAMP", "timestamp_ntz"))
    b = t.sql(LATE_SQL.replace("FROM events", "FROM {events}").replace("TIMESTAMP", "timestamp_ntz"))
    return a, b.withColumn("value", F.col("value").cast("double"))


VERSIONS = f"WITH a AS (SELECT * FROM events WHERE {EARLY}), b AS ({LATE_SQL})\n"


@query("h1_union", "SELECT * EXCLUDE (ts) FROM events WHERE " + EARLY + " UNION ALL SELECT * EXCLUDE (ts) FROM events WHERE " + LATE)
def _(t):
    e = t.events.drop("ts")
    a = t.events.filter(EARLY.replace("TIMESTAMP", "timestamp_ntz")).drop("ts")
    b = t.events.filter(LATE.replace("TIMESTAMP", "timestamp_ntz")).drop("ts").select(*reversed(e.columns))
    return a.unionByName(b)


@query("h2_schema_diff", """
SELECT 'props' AS "column", 'removed' AS change, 'string' AS before, CAST(NULL AS VARCHAR) AS after FROM events HAVING count(*) > 0
UNION ALL SELECT 'extra', 'added', NULL, 'int' FROM events HAVING count(*) > 0""")
def _(t):
    return drift.schema_diff(*versions(t))


@query("h3_summary_diff", VERSIONS + """
SELECT metric, before::DOUBLE AS before, after::DOUBLE AS after, (after - before)::DOUBLE AS change FROM (
SELECT 'rows' AS metric, (SELECT count(*) FROM a) AS before, (SELECT count(*) FROM b) AS after UNION ALL SELECT 'columns', 6, 6
UNION ALL SELECT 'duplicate rows', (SELECT count(*) FROM a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM a)), (SELECT count(*) FROM b) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b))
UNION ALL SELECT 'missing cells %', 0, 0)""")
def _(t):
    return drift.summary_diff(*versions(t))


@query("h4_missing_diff", DIRTY + union_all([f"""SELECT '{c}' AS "column", 0::DOUBLE AS before_pct, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS after_pct, {r6(f'(count(*) - count({c})) * 100.0 / count(*)')} AS change FROM dirty_orders"""
                                              for c in ("id", "price", "priority", "status", "odate")]))
def _(t):
    return shown(drift.missing_diff(t.view("clean_orders").drop("cust"), t.view("dirty_orders")), "before_pct", "after_pct", "change")


def ks_sql(c: str) -> str:
    return f"""(SELECT max(abs(fa - fb)) FROM (SELECT sum(na) OVER (ORDER BY v) * 1.0 / (SELECT count(*) FROM a) AS fa, sum(nb) OVER (ORDER BY v) * 1.0 / (SELECT count(*) FROM b) AS fb
  FROM (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (SELECT {c} AS v, 1 AS na, 0 AS nb FROM a UNION ALL SELECT {c}, 0, 1 FROM b) GROUP BY v)))"""


def psi_sql(c: str, a: str = "a", b: str = "b") -> str:
    edges = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), CAST({j / 10} AS DOUBLE)) AS q{j}" for j in range(1, 10))
    code = " + ".join(f"CASE WHEN {c} >= q{j} THEN 1 ELSE 0 END" for j in range(1, 10))
    return f"""(SELECT sum((q - p) * ln(q / p)) FROM (SELECT bin, greatest(sum(s) * 1.0 / (SELECT count(*) FROM {a}), 0.0001) AS p, greatest(sum(1 - s) * 1.0 / (SELECT count(*) FROM {b}), 0.0001) AS q
  FROM (SELECT {code} AS bin, s FROM (SELECT {c}, 1 AS s FROM {a} UNION ALL SELECT {c}, 0 FROM {b}), (SELECT {edges} FROM {a}) UNION ALL SELECT unnest(range(10)), NULL) GROUP BY bin))"""


def drift_sql() -> str:
    parts = []
    for c in ("event_id", "user_id", "value"):
        med = "quantile_cont(CAST({c} AS DOUBLE), CAST(0.5 AS DOUBLE))".format(c=c)
        parts.append(f"""SELECT '{c}' AS "column", {s9(f'(SELECT avg({c}) FROM a)')} AS mean_before, {s9(f'(SELECT avg({c}) FROM b)')} AS mean_after,
  {s9(f'(SELECT {med} FROM a)')} AS median_before, {s9(f'(SELECT {med} FROM b)')} AS median_after,
  {r6(f'((SELECT avg({c}) FROM b) - (SELECT avg({c}) FROM a)) / (SELECT stddev_samp({c}) FROM a)')} AS mean_shift_sd, {r6(ks_sql(c))} AS ks, {r6(psi_sql(c))} AS psi,
  CASE WHEN {psi_sql(c)} < 0.1 THEN 'stable' WHEN {psi_sql(c)} < 0.25 THEN 'moderate' ELSE 'large' END AS drift""")
    return VERSIONS + union_all(parts)


@query("h5_numeric_drift", drift_sql())
def _(t):
    return shown(drift.numeric_drift(*versions(t)), "mean_shift_sd", "ks", "psi")


@query("f4_ks_statistic", VERSIONS + union_all([f"SELECT '{c}' AS \"column\", {r6(ks_sql(c))} AS ks" for c in ("user_id", "value")]))
def _(t):
    k = drift.ks_statistics(*versions(t), ["user_id", "value"])
    return shown(small_table(t.spark, [{"column": c, "ks": v} for c, v in k.items()], "column string, ks double"), "ks")


@query("h6_categorical_drift", VERSIONS + f"""
SELECT 'event_type' AS "column", coalesce(string_agg(CASE WHEN na = 0 THEN v END, ', ' ORDER BY v), '') AS new_categories, count(CASE WHEN na = 0 THEN 1 END) AS n_new,
  count(CASE WHEN nb = 0 THEN 1 END) AS disappeared, {r6('0.5 * sum(abs(na * 1.0 / (SELECT count(*) FROM a) - nb * 1.0 / (SELECT count(*) FROM b)))')} AS tvd
FROM (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (SELECT event_type AS v, 1 AS na, 0 AS nb FROM a UNION ALL SELECT event_type, 0, 1 FROM b) GROUP BY v)""")
def _(t):
    return shown(drift.categorical_drift(*versions(t)), "tvd")


@query("c2_category_changes", VERSIONS + """
SELECT 'event_type' AS "column", event_type AS value, 'new' AS change FROM (SELECT DISTINCT event_type FROM b EXCEPT SELECT event_type FROM a)
UNION ALL SELECT 'event_type', event_type, 'disappeared' FROM (SELECT DISTINCT event_type FROM a EXCEPT SELECT event_type FROM b)""")
def _(t):
    return drift.category_changes(*versions(t), ["event_type"])


@query("c3_frequency_alignment", VERSIONS + """
SELECT 'event_type' AS "column", coalesce(x.v, y.v) AS value, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b
FROM (SELECT event_type v, count(*) n FROM a GROUP BY 1) x FULL JOIN (SELECT event_type v, count(*) n FROM b GROUP BY 1) y ON x.v = y.v""")
def _(t):
    return drift.category_alignment(*versions(t), ["event_type"])


CORR_A = "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem WHERE l_returnflag = 'A'"
CORR_B = "SELECT l_quantity, l_extendedprice, l_discount + l_quantity / 100 AS l_discount FROM lineitem WHERE l_returnflag <> 'A'"


@query("h7_correlation_change", f"WITH a AS ({CORR_A}), b AS ({CORR_B}) SELECT * FROM (" + union_all(
    [f"SELECT '{x}' AS column_a, '{y}' AS column_b, {r6(f'(SELECT corr({x}, {y}) FROM a)')} AS before, {r6(f'(SELECT corr({x}, {y}) FROM b)')} AS after, {r6(f'(SELECT corr({x}, {y}) FROM b) - (SELECT corr({x}, {y}) FROM a)')} AS change"
     for x, y in (("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_discount"), ("l_quantity", "l_discount"))]) + ") WHERE abs(change) >= 0.2")
def _(t):
    a, b = (t.sql(s.replace("FROM lineitem", "FROM {lineitem}")) for s in (CORR_A, CORR_B))
    return shown(drift.correlation_change(a, b), "before", "after", "change")


@query("h8_drift_flags", VERSIONS + "SELECT * FROM (" + union_all(
    [f"SELECT 'warning' AS level, 'numeric drift' AS kind, '{c}' AS \"column\" WHERE {psi_sql(c)} >= 0.25" for c in ("event_id", "user_id", "value")]
    + ["SELECT 'warning', 'new categories', 'event_type' WHERE EXISTS (SELECT event_type FROM b EXCEPT SELECT event_type FROM a)",
       "SELECT 'warning', 'column removed', 'props'", "SELECT 'info', 'column added', 'extra'"]) + ")")
def _(t):
    return drift.drift_flags(*versions(t))


@query("h9_step_preview", DIRTY + """
SELECT 'rows' AS metric, count(*)::DOUBLE AS before, count(*)::DOUBLE AS after FROM dirty_orders UNION ALL SELECT 'columns', 10, 8 FROM orders HAVING count(*) > 0
UNION ALL SELECT 'missing cells', (SELECT count(*) * 4 - count(price) - count(status) - count(sparse) - count(mostly_empty) + count(CASE WHEN isinf(price) THEN 1 END) FROM dirty_orders),
  (SELECT count(*) - count(status) FROM dirty_orders)""")
def _(t):
    from millrace.plans.preview import preview
    return preview(t.view("dirty_orders"), {}, {"Clean": {**default_settings()["Clean"], "drop_missing_target": False}}, "status").filter("metric in ('rows', 'columns', 'missing cells')").select("metric", "before", "after")


# --- roles and advice -----------------------------------------------------------------------------------------------

@query("e28_infer_roles")
def _(t):
    return roles.roles_table(t.orders, target="o_orderstatus", order_by="o_orderkey")


@query("e28_role_evidence", union_all([f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS "unique", {x} AS numeric_values, {d} AS date_values, {f} AS fractions, {ln} AS mean_length FROM orders"""
    for c, x, d, f, ln in (("o_orderkey", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "0::BIGINT", "CAST(NULL AS DOUBLE)"),
                           ("o_totalprice", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "count(CASE WHEN o_totalprice <> floor(o_totalprice) THEN 1 END)", "CAST(NULL AS DOUBLE)"),
                           ("o_orderpriority", "0::BIGINT", "0::BIGINT", "CAST(NULL AS BIGINT)", s9("avg(length(o_orderpriority))")))]))
def _(t):
    return shown(roles.evidence_table(t.orders, ["o_orderkey", "o_totalprice", "o_orderpriority"]))


@query("e28_infer_roles_documents")
def _(t):
    return roles.roles_table(t.view("doc_labels").join(t.documents.select("doc_id", "text"), "doc_id"), target="quality", order_by="doc_id")


@query("e29_advisor", DIRTY + f"""
SELECT id, "column", severity FROM (
SELECT 'numtext:cust_text' AS id, 'cust_text' AS "column", 2::BIGINT AS severity, 1 AS ok FROM orders HAVING count(*) > 0
{''.join(f" UNION ALL SELECT 'missing:{c}', '{c}', CASE WHEN avg(CASE WHEN {w} THEN 1.0 ELSE 0 END) > 0.3 THEN 3 ELSE 2 END, 1 FROM dirty_orders" for c, w in ORDER_GAPS.items() if c != 'status')}
UNION ALL SELECT 'const', NULL, 1, 1 FROM orders HAVING count(*) > 0
UNION ALL SELECT 'id:id', 'id', 2, 1 FROM orders HAVING count(*) > 0
UNION ALL SELECT 'skew', NULL, 1, CASE WHEN skewness(amount) > 1 THEN 1 ELSE 0 END FROM dirty_orders
UNION ALL SELECT 'imbalance', 'status', 2, CASE WHEN (SELECT min(n) * 1.0 / sum(n) FROM (SELECT count(*) n FROM dirty_orders WHERE status IS NOT NULL GROUP BY status)) < 0.2 THEN 1 ELSE 0 END
) WHERE ok = 1""")
def _(t):
    return advice.diagnose(t.view("dirty_orders"), "status").select("id", "column", "severity")


@query("e29_advisor_options")
def _(t):
    d = advice.diagnose(t.view("dirty_events"), "event_type")
    return d.select("id", F.explode("options").alias("o")).select("id", "o.*")


def what_if_sql(c: str) -> str:
    fills = {"Median": f"(SELECT quantile_cont({c}, CAST(0.5 AS DOUBLE)) FROM dirty_events)", "Mean": f"(SELECT avg({c}) FROM dirty_events)", "Fill with 0": "0", "Drop rows": "NULL"}
    return with_views("dirty_events") + union_all([f"""
SELECT '{n}' AS strategy, {'0' if n == 'Drop rows' else f'count(*) - count({c})'}::BIGINT AS values_changed, {f'count({c})' if n == 'Drop rows' else 'count(*)'} AS rows_kept,
  {f'count(*) - count({c})' if n == 'Drop rows' else '0'}::BIGINT AS rows_lost, {s9(f'avg(coalesce({c}, {f}))')} AS mean, {s9(f'stddev_samp(coalesce({c}, {f}))')} AS std,
  {r6(f'(stddev_samp(coalesce({c}, {f})) / stddev_samp({c}) - 1) * 100')} AS std_change_pct, {r6(f'corr(coalesce({c}, {f}), user_id)')} AS corr_with_target FROM dirty_events""" for n, f in fills.items()])


@query("e30_what_if_number", what_if_sql("value"))
def _(t):
    return shown(advice.what_if_missing(t.view("dirty_events"), "value", "user_id"), "std_change_pct", "corr_with_target")


@query("e30_what_if_text", DIRTY + """
, s AS (SELECT status AS v, count(*) AS n FROM dirty_orders WHERE status IS NOT NULL GROUP BY 1), f AS (SELECT (SELECT count(*) FROM dirty_orders) AS rows, sum(n) AS n, max(n) AS top FROM s)
SELECT 'Most common' AS strategy, CAST(rows - n AS BIGINT) AS values_changed, rows AS rows_kept, 0::BIGINT AS rows_lost, round((top + rows - n) * 100.0 / rows, 1)::DOUBLE AS top_share_pct FROM f
UNION ALL SELECT 'Fill with ''Unknown''', CAST(rows - n AS BIGINT), rows, 0, round(greatest(top, rows - n) * 100.0 / rows, 1) FROM f
UNION ALL SELECT 'Drop rows', 0, CAST(n AS BIGINT), CAST(rows - n AS BIGINT), round(top * 100.0 / n, 1) FROM f""")
def _(t):
    return advice.what_if_missing(t.view("dirty_orders"), "status")


@query("e31_merged_settings")
def _(t):
    cfg = default_settings()
    for f in advice.diagnose(t.view("dirty_orders"), "status").select(F.col("options")[0]["patch"].alias("p")).filter("p is not null").collect():
        import json
        cfg = merged(cfg, json.loads(f["p"]))
    return small_table(t.spark, [{"step": s, "setting": k, "value": str(v)} for s, p in cfg.items() for k, v in p.items()], "step string, setting string, value string")


def missing_issue(c, w):
    return f"SELECT CASE WHEN avg(CASE WHEN {w} THEN 1.0 ELSE 0 END) > 0.3 THEN 3 ELSE 2 END::BIGINT AS severity, 'missing values' AS issue, '{c}' AS \"column\", {r6(f'avg(CASE WHEN {w} THEN 1.0 ELSE 0 END) * 100')} AS value, 'Clean' AS fix FROM dirty_orders"


G1 = "(SELECT avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) * sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2) FROM (SELECT {c} AS v, avg({c}) OVER () AS m FROM {t} WHERE {c} IS NOT NULL))"


@query("e32_issues", DIRTY + "SELECT * FROM (" + union_all([missing_issue(c, f"{c} IS NULL") for c in ("price", "status", "sparse", "mostly_empty")] + [
    "SELECT 2, 'constant column', 'const_col', 1.0, 'Clean' FROM orders HAVING count(*) > 0",
    f"SELECT 1, 'skew', 'amount', {r6(G1.format(c='amount', t='dirty_orders'))}, 'Transform'",
    "SELECT 2, 'columns not encoded', NULL, 3.0, 'Encode' FROM orders HAVING count(*) > 0",
    "SELECT 3, 'target has missing values', 'status', (count(*) - count(status))::DOUBLE, 'Split' FROM dirty_orders"]) + ")")
def _(t):
    return shown(advice.find_issues(t.view("dirty_orders"), "status"), "value")


@query("e32_recommended_steps")
def _(t):
    steps = advice.recommended_steps(t.view("dirty_orders"), "status")
    return small_table(t.spark, [{"position": i, "step": s} for i, s in enumerate(steps, 1)], "position long, step string")


@query("e33_key_findings", DIRTY + f"SELECT * FROM (" + union_all([
    "SELECT 'mostly missing' AS finding, 'sparse' AS \"column\", " + r6("(count(*) - count(sparse)) * 100.0 / count(*)") + " AS value FROM dirty_orders",
    "SELECT 'mostly missing', 'mostly_empty', " + r6("(count(*) - count(mostly_empty)) * 100.0 / count(*)") + " FROM dirty_orders",
    f"SELECT 'skewed', 'amount', {r6(G1.format(c='amount', t='dirty_orders'))}",
    "SELECT 'almost redundant', 'sparse / mostly_empty', 1.0 FROM orders HAVING count(*) > 0",
    "SELECT 'single value', 'const_col', 1.0 FROM orders HAVING count(*) > 0"]) + ")")
def _(t):
    return shown(advice.key_findings(t.view("dirty_orders").drop("price"), "status"), "value")


@query("e34_readiness", DIRTY + f"""
SELECT name, passed, weight::BIGINT AS weight, {r6('detail')} AS detail FROM (
SELECT 'Missing values' AS name, false AS passed, 3 AS weight, (SELECT count(*) * 4 - count(price) - count(status) - count(sparse) - count(mostly_empty) FROM dirty_orders)::DOUBLE AS detail
UNION ALL SELECT 'Duplicate rows', true, 2, 0 UNION ALL SELECT 'Constant columns', false, 1, 1
UNION ALL SELECT 'Outliers', {outlier_count('amount', 'dirty_orders')} * 100.0 / (SELECT count(*) * 6 FROM dirty_orders) <= 1, 1, {outlier_count('amount', 'dirty_orders')} * 100.0 / (SELECT count(*) * 6 FROM dirty_orders)
UNION ALL SELECT 'Text columns encoded', false, 3, 2 UNION ALL SELECT 'Train/test split', false, 3, 0
UNION ALL SELECT 'Target has no missing values', false, 3, (SELECT count(*) - count(status) FROM dirty_orders)
UNION ALL SELECT 'Class balance', (SELECT min(n) * 1.0 / sum(n) FROM (SELECT count(*) n FROM dirty_orders WHERE status IS NOT NULL GROUP BY status)) >= 0.2, 1,
  (SELECT min(n) * 100.0 / sum(n) FROM (SELECT count(*) n FROM dirty_orders WHERE status IS NOT NULL GROUP BY status)))""")
def _(t):
    return shown(advice.readiness(t.view("dirty_orders"), "status")[1], "detail")


@query("e36_key_points")
def _(t):
    df = t.view("dirty_orders")
    return shown(advice.key_points(df, "status", score=advice.readiness(df, "status")[0]), "value")


# --- target analysis ------------------------------------------------------------------------------------------------

@query("k9_guess_kind", union_all(["SELECT 'o_orderstatus' AS \"column\", 'Classification' AS kind FROM orders HAVING count(*) > 0"] + [
    f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 15 THEN 'Classification' ELSE 'Regression' END FROM {t}" for c, t in (("o_totalprice", "orders"), ("l_linenumber", "lineitem"))]))
def _(t):
    rows = [{"column": c, "kind": target.guess_kind(d, c)} for c, d in (("o_orderstatus", t.orders), ("o_totalprice", t.orders), ("l_linenumber", t.lineitem))]
    return small_table(t.spark, rows, "column string, kind string")


@query("k10_class_distribution", f"SELECT status AS class, count(*) AS rows, {r6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS share_pct, {r6('max(count(*)) OVER () * 1.0 / min(count(*)) OVER ()')} AS imbalance_ratio FROM ({DIRTY} SELECT * FROM dirty_orders) WHERE status IS NOT NULL GROUP BY 1")
def _(t):
    r = target.classification(t.view("dirty_orders").select("status", "amount"), "status")
    return shown(r["distribution"].withColumn("imbalance_ratio", F.lit(r["imbalance_ratio"])), "share_pct", "imbalance_ratio")


@query("k10_class_flags")
def _(t):
    return shown(target.classification(t.view("dirty_orders").drop("id"), "status")["flags"], "value")


@query("c4_split_class_shares", """
WITH p AS (SELECT o_orderstatus AS class, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS part FROM orders)
SELECT class, round(count(CASE WHEN part = 'train' THEN 1 END) * 100.0 / (SELECT count(*) FROM p WHERE part = 'train'), 6) AS train,
  round(count(CASE WHEN part = 'test' THEN 1 END) * 100.0 / (SELECT count(*) FROM p WHERE part = 'test'), 6) AS test FROM p GROUP BY 1""")
def _(t):
    a, b = (t.orders.filter(f"o_orderdate {op} timestamp_ntz'1999-01-01'") for op in ("<", ">="))
    return shown(target.split_shares({"train": a, "test": b}, "o_orderstatus"), "train", "test")


def nmi_value(*args) -> str:
    return f"(SELECT nmi FROM ({nmi_sql(*args)}))"


@query("k11_class_features", "SELECT *, true AS reliable FROM (" + union_all([
    f"SELECT '{c}' AS feature, 'numeric' AS type, 'eta' AS measure, {r6('sqrt(' + eta_sql('orders', 'o_orderstatus', c) + ')')} AS strength, {nmi_value('orders', c, 'o_orderstatus', True, False)} AS nmi, count(*) AS rows_used FROM orders" for c in ("o_totalprice", "o_custkey")]
    + [f"SELECT 'o_orderpriority', 'categorical', 'cramers_v', (SELECT v FROM ({chi_sql('orders', 'o_orderpriority', 'o_orderstatus', r6(V_FIX) + ' AS v')})), {nmi_value('orders', 'o_orderpriority', 'o_orderstatus', False, False)}, count(*) FROM orders"]) + ")")
def _(t):
    f = target.class_features(t.orders, "o_orderstatus", ["o_totalprice", "o_custkey"], ["o_orderpriority"])
    return shown(f.select("feature", "type", "measure", "strength", "nmi", "rows_used", "reliable"), "strength", "nmi")


@query("k12_regression_summary", f"""
SELECT n AS rows, {s9('m')} AS mean, {s9('q2')} AS median, {s9('s')} AS std, {s9('lo')} AS "min", {s9('hi')} AS "max", {r6(G1.format(c='value', t='events'))} AS skew,
  {r6('(SELECT (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * (avg(power(value - m, 4)) / power(avg(power(value - m, 2)), 2) - 3) + 6) FROM events)')} AS kurtosis,
  {r6('z * 100.0 / n')} AS zeros_pct, {r6('g * 100.0 / n')} AS negative_pct, {outlier_count('value', 'events')} AS outliers
FROM (SELECT count(*) n, avg(value) m, median(value) q2, stddev_samp(value) s, min(value) lo, max(value) hi, count(CASE WHEN value = 0 THEN 1 END) z, count(CASE WHEN value < 0 THEN 1 END) g FROM events)""")
def _(t):
    return shown(target.target_summary(t.events, "value"), "skew", "kurtosis", "zeros_pct", "negative_pct")


@query("k12_regression_flags")
def _(t):
    return shown(target.regression(t.events.drop("event_id"), "value")["flags"], "value")


@query("k13_number_features", f"WITH r AS {rank_cte('events', ['user_id', 'value'])} SELECT *, true AS reliable FROM (" + union_all([
    f"SELECT 'user_id' AS feature, 'numeric' AS type, 'correlation' AS measure, greatest({r6('abs(corr(user_id, value))')}, {r6('abs(corr(r_user_id, r_value))')}) AS strength, {r6('corr(user_id, value)')} AS pearson, {r6('corr(r_user_id, r_value)')} AS spearman, {nmi_value('events', 'user_id', 'value', True, True)} AS nmi, count(*) AS rows_used FROM r",
    f"SELECT 'event_type', 'categorical', 'eta', {r6('sqrt(' + eta_sql('events', 'event_type', 'value') + ')')}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {nmi_value('events', 'event_type', 'value', False, True)}, count(*) FROM events"]) + ")")
def _(t):
    return shown(target.number_features(t.events, "value", ["user_id"], ["event_type"]).drop("p_value"), "strength", "pearson", "spearman", "nmi")


@query("g8_leverage", """
WITH z AS (SELECT event_id, (user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER () AS a, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS b, count(*) OVER () AS n FROM events),
r AS (SELECT corr(a, b) AS r FROM z), h AS (SELECT event_id, 1.0 / n + (a * a - 2 * r * a * b + b * b) / ((1 - r * r) * (n - 1)) AS h, n FROM z, r)
SELECT event_id, round(h, 6) AS leverage FROM h WHERE h > 9.0 / n ORDER BY h DESC, event_id LIMIT 10""")
def _(t):
    return shown(target.leverage(t.events, ["user_id", "value"], ["event_id"]), "leverage")


HALVES = """WITH p AS (SELECT event_id, ts, value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events),
a AS (SELECT y FROM p WHERE i < (SELECT count(*) // 2 FROM p)), b AS (SELECT y FROM p WHERE i >= (SELECT count(*) // 2 FROM p)),
g AS (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts) AS gap FROM events), m AS (SELECT median(gap) AS med FROM g)
"""


@query("k14_series_summary", HALVES + f"""
SELECT count(*) AS rows, {s9('min(epoch_us(ts)) / 1e6')} AS first, {s9('max(epoch_us(ts)) / 1e6')} AS last, {s9('(SELECT med FROM m)')} AS median_step,
  (SELECT count(*) FROM g, m WHERE gap > 3 * med) AS irregular_gaps, count(*) - count(DISTINCT ts) AS duplicates, {r6('corr(i, r)')} AS trend,
  {r6('((SELECT avg(y) FROM b) - (SELECT avg(y) FROM a)) / (SELECT stddev_samp(y) FROM a)')} AS half_shift_sd, {r6(psi_sql('y'))} AS psi_halves FROM p""")
def _(t):
    s = target.timeseries(t.events, "value", "ts", "event_id")["summary"].drop("trend_p", "seasonal_lags")
    return shown(s, "trend", "half_shift_sd", "psi_halves")


@query("k15_unsupervised")
def _(t):
    return shown(target.unsupervised(t.lineitem)["flags"], "value")


@query("k16_analyze_target", "SELECT *, true AS reliable FROM (" + union_all([
    f"SELECT '{c}' AS feature, 'numeric' AS type, 'eta' AS measure, {r6('sqrt(' + eta_sql('events', 'event_type', c) + ')')} AS strength, CAST(NULL AS DOUBLE) AS pearson, CAST(NULL AS DOUBLE) AS spearman, {nmi_value('events', c, 'event_type', True, False)} AS nmi, count(*) AS rows_used FROM events" for c in ("event_id", "user_id", "value")]) + ")")
def _(t):
    return shown(target.analyze_target(t.events.drop("props"), "event_type")["features"].drop("p_value"), "strength", "nmi")


@query("k16_analyze_target_sample")
def _(t):
    return shown(target.analyze_target(t.events.drop("props"), "event_type", sample=5000, key="event_id")["features"].drop("p_value"), "strength", "nmi")
