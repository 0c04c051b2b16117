"""Cleaning, imputing, outlier, encoding and scaling steps, and pipelines made of them."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.operators import columns as C
from millrace.operators.profile import small_table
from millrace.plans import steps as P
from millrace.plans.pipeline import build_pipeline
from millrace.plans.settings import default_settings, merged

DIRTY = with_views("dirty_orders")
TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
FINITE = "CASE WHEN isinf({c}) THEN NULL ELSE {c} END"
ORDERS_TRAIN = "odate < TIMESTAMP '1999-01-01 00:00:00'"


def trim(c):
    return TRIM.format(c=c)


def q(c: str, p: float) -> str:
    return f"quantile_cont(CAST({c} AS DOUBLE), CAST({p} AS DOUBLE))"


def mode_sql(c: str, table: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def fitted(step, df, target=None, training=True, on=None):
    return step.fit(df if on is None else on, target).transform(df, training=training)


@query("b1_infinity_to_null", DIRTY + f"SELECT id, {FINITE.format(c='price')} AS price FROM dirty_orders")
def _(t):
    return fitted(P.InfinityToNull(), t.view("dirty_orders").select("id", "price"))


for _case, _sql in (("lowercase", "lower({})"), ("UPPERCASE", "upper({})"), ("Keep as is", "{}"), ("Title Case",
        "array_to_string(list_transform(regexp_extract_all(lower({}), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || substr(x, 2)), '')")):
    def _run(t, case=_case):
        step = P.TextCleanup(trim=True, case=case, to_num=False, dups=False)
        return fitted(step, t.view("dirty_orders").select("id", "priority", "status"))
    query("b2_text_" + _case.split()[0].lower(), DIRTY + f"""
SELECT id, nullif({_sql.format(trim('priority'))}, '') AS priority, nullif({_sql.format('status')}, '') AS status FROM dirty_orders""")(_run)


@query("b3_numeric_text", DIRTY + f"""
SELECT id, TRY_CAST(nullif({trim('cust_text')}, '') AS DOUBLE) AS cust_text, nullif({trim('priority')}, '') AS priority FROM dirty_orders""")
def _(t):
    return fitted(P.TextCleanup(dups=False), t.view("dirty_orders").select("id", "cust_text", "priority"))


@query("b3_numeric_text_protected", DIRTY + f"SELECT id, nullif({trim('cust_text')}, '') AS cust_text FROM dirty_orders")
def _(t):
    return fitted(P.TextCleanup(dups=False, protect=["cust_text"]), t.view("dirty_orders").select("id", "cust_text"))


@query("b4_drop_duplicates", with_views("repeated_customers") + "SELECT DISTINCT nation::BIGINT AS nation, segment, positive::BIGINT AS positive FROM repeated_customers")
def _(t):
    return shown(fitted(P.TextCleanup(), t.view("repeated_customers")))


FILTERED = ["price", "amount", "priority", "status", "sparse", "mostly_empty", "const_col"]


@query("b5_column_filter_missing", DIRTY + union_all([f"""
SELECT '{c}' AS "column", (count(*) - count({c})) * 100.0 / count(*) > 20 AS dropped FROM dirty_orders""" for c in FILTERED]))
def _(t):
    s = P.ColumnFilter(max_missing=20, const=False).fit(t.view("dirty_orders").select(FILTERED))
    return small_table(t.spark, [{"column": c, "dropped": c in s.state["drop"]} for c in FILTERED], "column string, dropped boolean")


@query("b6_column_filter_constant", DIRTY + union_all([f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) <= 1 AS dropped FROM dirty_orders""" for c in FILTERED]))
def _(t):
    s = P.ColumnFilter(max_missing=100).fit(t.view("dirty_orders").select(FILTERED))
    return small_table(t.spark, [{"column": c, "dropped": c in s.state["drop"]} for c in FILTERED], "column string, dropped boolean")


def imputed(t, cols=("price", "sparse", "status"), **params):
    df = P.InfinityToNull().fit(t.view("dirty_orders")).transform(t.view("dirty_orders").select("id", *cols))
    return shown(fitted(P.Imputer(**params), df))


def imputed_sql(price: str, sparse: str, status: str) -> str:
    return DIRTY + f""", d AS (SELECT id, {FINITE.format(c='price')} AS price, sparse, status FROM dirty_orders)
SELECT id, {s9(f'coalesce(price, {price})')} AS price, {sparse} AS sparse, coalesce(status, {status}) AS status FROM d"""


@query("b7_impute_median", imputed_sql(f"(SELECT {q('price', .5)} FROM d)", s9(f"coalesce(sparse, (SELECT {q('sparse', .5)} FROM d))"), mode_sql("status", "d")))
def _(t):
    return shown(imputed(t, num_missing="Median").withColumn("sparse", F.col("sparse").cast("double")))


@query("b8_impute_mean", imputed_sql("(SELECT avg(price) FROM d)", s9("coalesce(sparse, (SELECT avg(sparse) FROM d))"), mode_sql("status", "d")))
def _(t):
    return imputed(t, num_missing="Mean")


@query("b9_impute_most_common", imputed_sql(mode_sql("price", "d"), f"coalesce(sparse, {mode_sql('sparse', 'd')})", mode_sql("status", "d")))
def _(t):
    return imputed(t, num_missing="Most common")


@query("b10_impute_constant", imputed_sql("0", "coalesce(sparse, 0)", "'Unknown'"))
def _(t):
    return imputed(t, num_missing="Fill with 0", cat_missing="Fill with 'Unknown'")


@query("b11_drop_rows", DIRTY + f"SELECT id, {s9('price')} AS price, sparse, status FROM dirty_orders WHERE price IS NOT NULL AND NOT isinf(price) AND sparse IS NOT NULL")
def _(t):
    return imputed(t, num_missing="Drop rows", cat_missing="Leave as is")


@query("b12_per_column_strategy", imputed_sql("(SELECT avg(price) FROM d)", "coalesce(sparse, 0)", "'Unknown'"))
def _(t):
    return imputed(t, num_missing="Fill with 0", per_column={"price": "Mean", "status": "Fill with 'Unknown'"})


@query("b13_drop_missing_target", DIRTY + "SELECT id, status FROM dirty_orders WHERE status IS NOT NULL")
def _(t):
    return fitted(P.Imputer(num_missing="Leave as is"), t.view("dirty_orders").select("id", "status"), target="status")


def clip_sql(lo: str, hi: str) -> str:
    return DIRTY + f""", b AS (SELECT {lo} AS lo, {hi} AS hi FROM dirty_orders)
SELECT id, {r6('greatest(least(amount, hi), lo)')} AS amount FROM dirty_orders, b"""


IQR_LO, IQR_HI = f"{q('amount', .25)} - 1.5 * ({q('amount', .75)} - {q('amount', .25)})", f"{q('amount', .75)} + 1.5 * ({q('amount', .75)} - {q('amount', .25)})"


@query("b14_clip_percentiles", clip_sql(q("amount", .01), q("amount", .99)))
def _(t):
    return shown(fitted(P.Outliers(outliers="Clip at 1st and 99th percentile", out_cols=["amount"]), t.view("dirty_orders").select("id", "amount")), "amount")


@query("b15_clip_iqr", clip_sql(IQR_LO, IQR_HI))
def _(t):
    return shown(fitted(P.Outliers(outliers="Clip to IQR bounds", out_cols=["amount"]), t.view("dirty_orders").select("id", "amount")), "amount")


@query("b16_remove_outlier_rows", DIRTY + f""", b AS (SELECT {IQR_LO} AS lo, {IQR_HI} AS hi FROM dirty_orders)
SELECT id, {s9('amount')} AS amount FROM dirty_orders, b WHERE NOT (amount < lo OR amount > hi)""")
def _(t):
    return shown(fitted(P.Outliers(outliers="Remove rows with outliers (IQR)", out_cols=["amount"]), t.view("dirty_orders").select("id", "amount")))


@query("b17_column_scope", DIRTY + union_all([f"""
SELECT '{c}' AS "column", {s9(q(c, .01))} AS low, {s9(q(c, .99))} AS high FROM dirty_orders HAVING count(DISTINCT {c}) > 2""" for c in ("amount", "sparse", "const_col")]))
def _(t):
    df = t.view("dirty_orders").select("amount", "sparse", "const_col", "status")
    assert not P.Outliers(outliers="Clip at 1st and 99th percentile", out_cols=[]).fit(df).state["bounds"]
    b = P.Outliers(outliers="Clip at 1st and 99th percentile").fit(df).state["bounds"]
    return shown(small_table(t.spark, [{"column": c, "low": v[0], "high": v[1]} for c, v in b.items()], "column string, low double, high double"))


@query("b18_skew_log", f"SELECT event_id, user_id, {r6('ln(1 + value)')} AS value FROM events")
def _(t):
    return shown(fitted(P.SkewFix(skew_thr=1.0), t.events.select("event_id", "user_id", "value")), "value")


@query("b18_skew_sqrt", f"SELECT event_id, user_id, {r6('sqrt(value)')} AS value FROM events")
def _(t):
    return shown(fitted(P.SkewFix(skew_thr=1.0, skew_method="Square root"), t.events.select("event_id", "user_id", "value")), "value")


@query("b19_twin_columns", """
SELECT 'l_quantity' AS "column", false AS dropped FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'l_extendedprice', abs(corr(l_quantity, l_extendedprice)) > 0.9 FROM lineitem
UNION ALL SELECT 'twin', greatest(abs(corr(l_quantity, l_extendedprice * 2 + l_quantity)), abs(corr(l_extendedprice, l_extendedprice * 2 + l_quantity))) > 0.9 FROM lineitem
UNION ALL SELECT 'l_tax', greatest(abs(corr(l_quantity, l_tax)), abs(corr(l_extendedprice, l_tax)), abs(corr(l_extendedprice * 2 + l_quantity, l_tax))) > 0.9 FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("twin"), "l_tax")
    s = P.TwinColumns(corr=0.9).fit(df)
    return small_table(t.spark, [{"column": c, "dropped": c in s.state["drop"]} for c in df.columns], "column string, dropped boolean")


@query("b20_drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return fitted(P.DropColumns(drop=["o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"]), t.orders, target="o_orderstatus")


@query("b21_date_parts", """
SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day,
  isodow(o_orderdate) - 1 AS o_orderdate_weekday FROM orders""")
def _(t):
    return shown(fitted(P.Encoder(), t.orders.select("o_orderkey", "o_orderdate")))


@query("b21_text_dates", """
SELECT o_orderkey, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, day(o_orderdate) AS d_day, isodow(o_orderdate) - 1 AS d_weekday FROM orders""")
def _(t):
    df = t.sql("SELECT o_orderkey, CAST(o_orderdate AS STRING) AS d FROM {orders}")
    cast = fitted(P.RoleCaster(types={"d": "datetime"}), df)
    return shown(fitted(P.Encoder(), cast))


# one written form for each remainder of the key, all of the same moment
DATE_FORMS = ["yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss.S", "dd-MMM-yyyy", "MMMM d, yyyy", "yyyy/MM/dd HH:mm:ss"]


@query("b31_role_caster_dates", """
SELECT o_orderkey, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, day(o_orderdate) AS d_day, isodow(o_orderdate) - 1 AS d_weekday FROM orders""")
def _(t):
    form = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in DATE_FORMS]), (F.col("o_orderkey") % len(DATE_FORMS) + 1).cast("int"))
    df = t.orders.select("o_orderkey", form.alias("d"))
    return shown(fitted(P.Encoder(), fitted(P.RoleCaster(types={"d": "datetime"}), df)))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("b22_one_hot", "SELECT o_orderkey, " + ", ".join(
    [f"""CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END::BIGINT AS "o_orderpriority_{v}" """ for v in PRIORITIES[1:]]
    + [f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END::BIGINT AS o_orderstatus_{v}" for v in "OP"]) + " FROM orders")
def _(t):
    return shown(fitted(P.Encoder(), t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")))


@query("b22_one_hot_unseen", DIRTY + "SELECT id, " + ", ".join(
    [f"""CASE WHEN priority = '{v}' THEN 1 ELSE 0 END::BIGINT AS "priority_{v}" """ for v in PRIORITIES]) + " FROM dirty_orders")
def _(t):
    clean = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return shown(fitted(P.Encoder(drop_first=False), t.view("dirty_orders").select("id", "priority"), on=clean, training=False))


@query("b23_ordinal_codes", DIRTY + "SELECT id, CASE " + " ".join(
    f"WHEN priority = '{v}' THEN {i}" for i, v in enumerate(PRIORITIES)) + " WHEN priority IS NOT NULL THEN -1 END::DOUBLE AS priority, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::DOUBLE AS status FROM dirty_orders")
def _(t):
    clean = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return fitted(P.Encoder(low="Ordinal"), t.view("dirty_orders").select("id", "priority", "status"), on=clean, training=False)


@query("b23_ordinal_many", "SELECT event_id, (SELECT count(DISTINCT e2.props) FROM events e2 WHERE e2.props < e.props)::DOUBLE AS props FROM events e")
def _(t):
    return fitted(P.Encoder(high="Ordinal"), t.events.select("event_id", "props"))


@query("b24_frequency", f"""
SELECT event_id, {r6('n * 1.0 / (SELECT count(*) FROM events)')} AS props FROM events JOIN (SELECT props, count(*) n FROM events GROUP BY 1) f USING (props)""")
def _(t):
    return shown(fitted(P.Encoder(high="Frequency"), t.events.select("event_id", "props")), "props")


@query("b24_frequency_unseen", f"""
WITH f AS (SELECT props, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id, {r6('coalesce(share, 0)')} AS props FROM events LEFT JOIN f USING (props)""")
def _(t):
    clicks = t.events.filter("event_type = 'click'").select("event_id", "props")
    return shown(fitted(P.Encoder(high="Frequency"), t.events.select("event_id", "props"), on=clicks, training=False), "props")


@query("b25_drop_high_cardinality", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS event_type_error, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END::BIGINT AS event_type_purchase, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END::BIGINT AS event_type_signup, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END::BIGINT AS event_type_view FROM events")
def _(t):
    return shown(fitted(P.Encoder(high="Drop the column"), t.events.select("event_id", "props", "event_type")))


@query("b26_boolean_to_int", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END::BIGINT AS big FROM orders")
def _(t):
    return shown(fitted(P.Encoder(), t.orders.select("o_orderkey", (F.col("o_totalprice") > 100000).alias("big"))))


@query("b27_target_codes", DIRTY + "SELECT id, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END::BIGINT AS status FROM dirty_orders")
def _(t):
    return shown(fitted(P.Encoder(), t.view("dirty_orders").select("id", "status"), target="status"))


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def scaled(t, method):
    df = t.lineitem.select("l_orderkey", "l_linenumber", *SCALED)
    return shown(fitted(P.Scaler(method=method, cols=SCALED), df), *SCALED)


def scale_sql(center: str, scale: str) -> str:
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(
        r6(f"({c} - {center.format(c=c)}) / {scale.format(c=c)}") + f" AS {c}" for c in SCALED) + " FROM lineitem"


@query("b28_scale_standard", scale_sql("(SELECT avg({c}) FROM lineitem)", "(SELECT stddev_samp({c}) FROM lineitem)"))
def _(t):
    return scaled(t, "Standard (z-score)")


@query("b29_scale_minmax", scale_sql("(SELECT min({c}) FROM lineitem)", "(SELECT max({c}) - min({c}) FROM lineitem)"))
def _(t):
    return scaled(t, "Min-max (0 to 1)")


@query("b30_scale_robust", scale_sql(f"(SELECT {q('{c}', .5)} FROM lineitem)", f"(SELECT {q('{c}', .75)} - {q('{c}', .25)} FROM lineitem)"))
def _(t):
    return scaled(t, "Robust (median / IQR)")


@query("b31_role_caster", with_views("doc_labels") + """
SELECT lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, CAST(n_chars AS DOUBLE) AS n_chars FROM doc_labels""")
def _(t):
    df = t.view("doc_labels").withColumn("quality", F.col("quality").cast("double")).withColumn("n_chars", F.concat(F.lit(" "), F.col("n_chars").cast("string")))
    return fitted(P.RoleCaster(types={"doc_id": "id", "source": "text", "quality": "categorical", "toxic": "categorical", "n_chars": "continuous"}), df)


@query("b32_ordinal_order", DIRTY + f"SELECT id, CASE lower({trim('priority')}) " + " ".join(
    f"WHEN '{v.lower()}' THEN {i}" for i, v in enumerate(reversed(PRIORITIES))) + " END::DOUBLE AS priority FROM dirty_orders")
def _(t):
    df = t.view("dirty_orders").select("id", "priority")
    return fitted(P.RoleCaster(types={"priority": "ordinal"}, orders={"priority": PRIORITIES[::-1]}), df)


@query("b33_missing_mask", DIRTY + f"""
SELECT id, price IS NULL AS price, priority IS NULL OR {trim('priority')} = '' AS priority, {trim('cust_text')} = '' AS cust_text, status IS NULL AS status FROM dirty_orders""")
def _(t):
    df = t.view("dirty_orders")
    return df.select("id", *[F.coalesce(C.missing(df, c), F.lit(True)).alias(c) for c in ("price", "priority", "cust_text", "status")])


# --- whole pipelines --------------------------------------------------------------------------------------------

SCALED_OUT = ["id", "price", "amount", "priority", "cust_text", "sparse", "odate_year", "odate_month", "odate_day", "odate_weekday"]


def pipeline_sql(fit_where: str, apply_where: str) -> str:
    """The default preparation of dirty_orders stated in SQL: learned on fit_where, applied to apply_where."""
    learned = "(SELECT {f} FROM train)"
    fill = {c: learned.format(f=q(c, .5)) for c in ("price", "cust_text", "sparse")}
    return DIRTY + f""", clean AS (
  SELECT id, {FINITE.format(c='price')} AS price, amount, nullif({trim('priority')}, '') AS priority,
    TRY_CAST(nullif({trim('cust_text')}, '') AS DOUBLE) AS cust_text, nullif(status, '') AS status, sparse, odate FROM dirty_orders),
train AS (SELECT * FROM clean WHERE {fit_where}),
mode AS (SELECT priority AS v FROM train WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT id, coalesce(price, {fill['price']}) AS price, amount, coalesce(priority, (SELECT v FROM mode)) AS priority,
    coalesce(cust_text, {fill['cust_text']}) AS cust_text, status, coalesce(sparse, {fill['sparse']}) AS sparse, odate FROM clean),
ftrain AS (SELECT * FROM filled WHERE {fit_where} AND status IS NOT NULL),
freq AS (SELECT priority, count(*) * 1.0 / (SELECT count(*) FROM ftrain) AS share FROM ftrain GROUP BY 1),
coded AS (SELECT f.id, f.price, f.amount, coalesce(q.share, 0) AS priority, f.cust_text, f.sparse, f.odate, f.status AS label,
    CASE f.status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status, year(f.odate) AS odate_year, month(f.odate) AS odate_month,
    day(f.odate) AS odate_day, isodow(f.odate) - 1 AS odate_weekday FROM filled f LEFT JOIN freq q ON f.priority = q.priority),
stats AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in SCALED_OUT)} FROM coded WHERE {fit_where} AND label IS NOT NULL)
SELECT status::BIGINT AS status, {', '.join(r6(f'({c} - m_{c}) / s_{c}') + f' AS {c}' for c in SCALED_OUT)} FROM coded, stats WHERE {apply_where}"""


@query("k2_pipeline_fit_transform", pipeline_sql("true", "label IS NOT NULL"))
def _(t):
    return shown(build_pipeline(default_settings(), "status").fit_transform(t.view("dirty_orders")), *SCALED_OUT)


@query("k3_pipeline_transform", pipeline_sql(ORDERS_TRAIN, "true"))
def _(t):
    df = t.view("dirty_orders")
    p = build_pipeline(default_settings(), "status")
    p.fit_transform(df.filter(ORDERS_TRAIN))
    return shown(p.transform(df), *SCALED_OUT)


@query("k2_pipeline_log")
def _(t):
    p = build_pipeline(merged(default_settings(), {"Transform": {"outliers": "Remove rows with outliers (IQR)"}}), "status")
    p.fit_transform(t.view("dirty_orders"))
    return p.log_table(t.spark)


@query("e36_settings_table")
def _(t):
    p = build_pipeline(default_settings(), "status")
    p.fit_transform(t.view("dirty_orders"))
    return p.settings_table(t.spark)


@query("c5_learned_lookup", """
WITH codes AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, code::DOUBLE AS c_name FROM customer JOIN codes USING (c_name)""")
def _(t):
    return fitted(P.Encoder(high="Ordinal"), t.customer.select("c_custkey", "c_name"))
