"""Association, missingness, quality and personal-data queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.functions import text as X
from millrace.operators import association as A
from millrace.operators import columns as C
from millrace.operators import correlation, missingness, quality
from millrace.operators.profile import small_table

DIRTY = with_views("dirty_orders")
GAPS = with_views("dirty_events")
ORDERS, STATUS = "orders", "o_orderstatus"


@query("e1_contingency", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return A.contingency(t.lineitem, "l_returnflag", "l_linestatus")


@query("e1_contingency_dirty", DIRTY + "SELECT status AS a, priority AS b, count(*) AS n FROM dirty_orders WHERE status IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2")
def _(t):
    return A.contingency(t.view("dirty_orders"), "status", "priority")


def chi_sql(table: str, a: str, b: str, outer: str) -> str:
    """chi2 over the full grid of categories, zero cells included."""
    return f"""SELECT {outer} FROM (SELECT sum(power(coalesce(o, 0) - e, 2) / e) AS chi2, any_value(total) AS n, any_value(nr) AS r, any_value(nk) AS k FROM (
  SELECT x.va, y.vb, x.rn * y.cn / CAST(total AS DOUBLE) AS e, (SELECT count(*) FROM {table} t WHERE t.{a} = x.va AND t.{b} = y.vb) AS o, total, nr, nk
  FROM (SELECT {a} AS va, count(*) AS rn FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) x,
       (SELECT {b} AS vb, count(*) AS cn FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) y,
       (SELECT count(*) AS total, count(DISTINCT {a}) AS nr, count(DISTINCT {b}) AS nk FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"""


V_FIX = "sqrt(greatest(0, chi2 / n - (k - 1.0) * (r - 1) / (n - 1)) / least(k - power(k - 1, 2) / (n - 1.0) - 1, r - power(r - 1, 2) / (n - 1.0) - 1))"
V_PLAIN = "sqrt(chi2 / n / (least(r, k) - 1))"


@query("e2_chi_square", DIRTY + chi_sql("dirty_orders", "status", "priority",
       f"'status' AS column_a, 'priority' AS column_b, n, {r6('chi2')} AS chi2, {r6(V_FIX)} AS cramers_v, {r6(V_PLAIN)} AS cramers_v_plain"))
def _(t):
    return shown(A.chi_square_table(t.view("dirty_orders"), [("status", "priority")]).drop("p_value"), "chi2", "cramers_v", "cramers_v_plain")


DOC_PAIRS = [("lang", "source"), ("lang", "quality"), ("source", "quality")]


@query("e3_cramers_matrix", chi_sql("documents", "lang", "source", f"'lang' AS column_a, 'source' AS column_b, {r6(V_PLAIN)} AS value"))
def _(t):
    return shown(A.cramers_matrix(t.documents, max_values=50), "value")


@query("e2_chi_square_documents", with_views("doc_labels") + union_all(["SELECT * FROM (" + chi_sql("doc_labels", a, b,
       f"'{a}' AS column_a, '{b}' AS column_b, n, {r6('chi2')} AS chi2, {r6(V_FIX)} AS cramers_v, {r6(V_PLAIN)} AS cramers_v_plain") + ")" for a, b in DOC_PAIRS]))
def _(t):
    return shown(A.chi_square_table(t.view("doc_labels"), DOC_PAIRS).drop("p_value"), "chi2", "cramers_v", "cramers_v_plain")


def eta_sql(table: str, g: str, v: str) -> str:
    return f"""(SELECT greatest(0, 1 - sum(power(v - mg, 2)) / sum(power(v - mm, 2))) FROM (
  SELECT CAST({v} AS DOUBLE) AS v, avg({v}) OVER (PARTITION BY {g}) AS mg, avg({v}) OVER () AS mm FROM {table} WHERE {g} IS NOT NULL AND {v} IS NOT NULL))"""


@query("e4_eta_squared", GAPS + union_all([f"""
SELECT '{g}' AS category, '{v}' AS "value", (SELECT count(*) FROM {t} WHERE {g} IS NOT NULL AND {v} IS NOT NULL) AS n,
  {r6(eta_sql(t, g, v))} AS eta_squared, {r6(f'sqrt({eta_sql(t, g, v)})')} AS eta""" for t, g, v in (("dirty_events", "event_type", "value"), ("dirty_events", "props", "value"))]))
def _(t):
    return shown(A.eta_table(t.view("dirty_events"), [("event_type", "value"), ("props", "value")]), "eta_squared", "eta")


def code_sql(table: str, c: str, where: str) -> str:
    """Equal-count bin number of a numeric column by its deciles over the rows of the pair."""
    edges = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), CAST({j / 10} AS DOUBLE)) AS q{j}" for j in range(1, 10))
    return f"(SELECT {edges} FROM {table} WHERE {where})"


def nmi_sql(table: str, x: str, y: str, x_num: bool, y_num: bool) -> str:
    where = f"{x} IS NOT NULL AND {y} IS NOT NULL"

    def side(c, num, alias):
        if not num:
            return f"CAST({c} AS VARCHAR)"
        return "CAST(" + " + ".join(f"CASE WHEN {c} > {alias}.q{j} THEN 1 ELSE 0 END" for j in range(1, 10)) + " AS VARCHAR)"
    src = table + (f", {code_sql(table, x, where)} ex" if x_num else "") + (f", {code_sql(table, y, where)} ey" if y_num else "")
    return f"""SELECT '{x}' AS column_a, '{y}' AS column_b, {r6('''(SELECT sum(p * ln(p / (pa * pb))) / least(any_value(ha), any_value(hb)) FROM (
    SELECT p, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM cell),
    (SELECT -sum(p * ln(p)) AS ha FROM (SELECT sum(p) AS p FROM cell GROUP BY a)), (SELECT -sum(p * ln(p)) AS hb FROM (SELECT sum(p) AS p FROM cell GROUP BY b)))''')} AS nmi
FROM (SELECT 1)""".replace("cell", f"(SELECT a, b, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM (SELECT {side(x, x_num, 'ex')} AS a, {side(y, y_num, 'ey')} AS b FROM {src} WHERE {where}) GROUP BY 1, 2)")


@query("e5_nmi", union_all([f"SELECT * FROM ({nmi_sql('events', 'value', 'user_id', True, True)})", f"SELECT * FROM ({nmi_sql('events', 'value', 'event_type', True, False)})"]))
def _(t):
    return shown(A.nmi_table(t.events, [("value", "user_id"), ("value", "event_type")]), "nmi")


@query("e5_nmi_gaps", GAPS + union_all([f"SELECT * FROM ({nmi_sql('dirty_events', 'value', 'user_id', True, True)})", f"SELECT * FROM ({nmi_sql('dirty_events', 'value', 'props', True, False)})"]))
def _(t):
    return shown(A.nmi_table(t.view("dirty_events"), [("value", "user_id"), ("value", "props")]), "nmi")


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]


@query("e6_pearson", union_all([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS pearson, count(*) AS n FROM lineitem" for a, b in LINE_PAIRS]))
def _(t):
    return shown(correlation.pearson(t.lineitem, LINE), "pearson")


WIDE = [f"l_{c}" for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax")] + ["q2", "unit", "net"]


@query("e6_pearson_wide", "WITH w AS (SELECT *, l_quantity * l_quantity AS q2, l_extendedprice / l_quantity AS unit, l_extendedprice * (1 - l_discount) AS net FROM lineitem)\n"
       + union_all([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS pearson, count(*) AS n FROM w" for i, a in enumerate(WIDE) for b in WIDE[i + 1:]]))
def _(t):
    w = t.sql("SELECT *, l_quantity * l_quantity AS q2, l_extendedprice / l_quantity AS unit, l_extendedprice * (1 - l_discount) AS net FROM {lineitem}")
    return shown(correlation.pearson(w, WIDE), "pearson")


def rank_cte(table: str, cols: list[str]) -> str:
    """Average ranks per column as r_<column>."""
    inner = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS r_{c}" for c in cols)
    return f"(SELECT *, {inner} FROM {table})"


@query("e7_spearman", f"WITH r AS {rank_cte('lineitem', LINE)} " + union_all(
    [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr(r_{a}, r_{b})')} AS spearman, count(*) AS n FROM r" for a, b in LINE_PAIRS]))
def _(t):
    return shown(correlation.spearman(t.lineitem, LINE), "spearman")


@query("e7_spearman_gaps", GAPS + f", r AS {rank_cte('dirty_events', ['id', 'value', 'user_id'])} " + union_all(
    [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr(r_{a}, r_{b})')} AS spearman, count(r_{a} + r_{b}) AS n FROM r" for a, b in (("id", "user_id"), ("id", "value"), ("user_id", "value"))]))
def _(t):
    return shown(correlation.spearman(t.view("dirty_events"), ["id", "user_id", "value"]), "spearman")


def mixed_sql() -> str:
    return f"""WITH r AS {rank_cte('orders', ['o_totalprice', 'o_custkey'])} """ + union_all(
        [f"SELECT 'o_totalprice' AS column_a, 'o_custkey' AS column_b, {r6('abs(corr(r_o_totalprice, r_o_custkey))')} AS value, 'spearman' AS measure FROM r",
         "SELECT * FROM (" + chi_sql("orders", "o_orderstatus", "o_orderpriority", f"'o_orderstatus' AS column_a, 'o_orderpriority' AS column_b, {r6(V_FIX)} AS value, 'cramers_v' AS measure") + ")"]
        + [f"SELECT '{v}', '{g}', {r6(f'sqrt({eta_sql(ORDERS, g, v)})')}, 'eta'" for v in ("o_totalprice", "o_custkey") for g in ("o_orderstatus", "o_orderpriority")])


@query("e9_mixed_associations", mixed_sql())
def _(t):
    return shown(A.mixed_associations(t.orders, ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]), "value")


@query("e10_top_pairs", "SELECT * FROM (" + union_all([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({a}, {b})')} AS pearson, count(*) AS n FROM lineitem" for a, b in LINE_PAIRS])
       + ") ORDER BY abs(pearson) DESC, column_a, column_b LIMIT 3")
def _(t):
    return shown(A.top_pairs(correlation.pearson(t.lineitem, LINE), "pearson", 3), "pearson")


@query("e11_strength_words", union_all([f"""SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN abs(corr({a}, {b})) < 0.1 THEN 'very weak'
  WHEN abs(corr({a}, {b})) < 0.3 THEN 'weak' WHEN abs(corr({a}, {b})) < 0.5 THEN 'moderate' WHEN abs(corr({a}, {b})) < 0.8 THEN 'strong' ELSE 'very strong' END AS strength FROM lineitem""" for a, b in LINE_PAIRS]))
def _(t):
    return A.with_strength(correlation.pearson(t.lineitem, LINE), "pearson").select("column_a", "column_b", "strength")


PARABOLA = "(SELECT l_quantity - 25.5 AS x, power(l_quantity - 25.5, 2) + l_tax AS y, l_discount AS z FROM lineitem)"


@query("e12_nonlinear_candidates", f"WITH p AS {PARABOLA} SELECT m.column_a, m.column_b, {r6('c.pearson')} AS pearson, m.nmi FROM ("
       + nmi_sql("p", "x", "y", True, True) + ") m, (SELECT corr(x, y) AS pearson FROM p) c WHERE m.nmi >= 0.15 AND abs(c.pearson) < 0.3")
def _(t):
    p = t.sql("SELECT l_quantity - 25.5 AS x, power(l_quantity - 25.5, 2) + l_tax AS y, l_discount AS z FROM {lineitem}").withColumn("x", F.col("x").cast("double"))
    return shown(A.nonlinear_candidates(p, ["x", "y", "z"]), "pearson", "nmi")


@query("e13_vif", union_all([f"SELECT '{c}' AS \"column\", {r6('1 / (1 - power(corr(l_quantity, l_extendedprice), 2))')} AS vif FROM lineitem" for c in ("l_quantity", "l_extendedprice")]))
def _(t):
    return shown(A.vif_table(t.lineitem, ["l_quantity", "l_extendedprice"]), "vif")


@query("e13_vif_many")
def _(t):
    return shown(A.vif_table(t.lineitem, LINE), "vif")


@query("e14_pca_two_columns", f"""
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT 1::BIGINT AS component, {r6('(1 + r) * 50')} AS explained_pct, {r6('(1 + r) * 50')} AS cumulative_pct FROM c
UNION ALL SELECT 2, {r6('(1 - r) * 50')}, 100.0 FROM c""")
def _(t):
    return shown(A.pca_table(t.lineitem, ["l_quantity", "l_extendedprice"]), "explained_pct", "cumulative_pct")


@query("e14_pca_scores", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS a,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, {r6('(a + b) / sqrt(2)')} AS pc1 FROM s""")
def _(t):
    s = A.pca(t.lineitem, ["l_quantity", "l_extendedprice"])["scores"]
    return shown(s.select("l_orderkey", "l_linenumber", "pc1"), "pc1")


@query("e14_pca_loadings")
def _(t):
    return shown(A.pca_loadings(t.lineitem, LINE), "pc1", "pc2")


# --- missingness ---------------------------------------------------------------------------------------------------

ORDER_GAPS = {"price": "price IS NULL", "priority": r"(priority IS NULL OR regexp_replace(priority, '^\s+|\s+$', '', 'g') = '')",
              "cust_text": r"regexp_replace(cust_text, '^\s+|\s+$', '', 'g') = ''", "status": "status IS NULL", "sparse": "sparse IS NULL", "mostly_empty": "mostly_empty IS NULL"}


@query("e15_missing_per_column", DIRTY + union_all([f"""SELECT '{c}' AS "column", count(CASE WHEN {w} THEN 1 END) AS missing,
  {r6(f'count(CASE WHEN {w} THEN 1 END) * 100.0 / count(*)')} AS missing_pct FROM dirty_orders""" for c, w in ORDER_GAPS.items()]))
def _(t):
    return shown(missingness.missing_per_column(t.view("dirty_orders")), "missing_pct")


@query("e16_missing_patterns", DIRTY + f"""
SELECT coalesce(nullif(pattern, ''), 'complete rows') AS pattern, count(*) AS rows, {r6('count(*) * 100.0 / (SELECT count(*) FROM dirty_orders)')} AS share_pct
FROM (SELECT concat_ws(', ', {', '.join(f"CASE WHEN {w} THEN '{c}' END" for c, w in ORDER_GAPS.items())}) AS pattern FROM dirty_orders)
GROUP BY 1 ORDER BY 2 DESC, 1""")
def _(t):
    return shown(missingness.patterns(t.view("dirty_orders")), "share_pct")


def flag(c):
    return f"CAST(CASE WHEN {ORDER_GAPS[c]} THEN 1 ELSE 0 END AS DOUBLE)"


_GAP_NAMES = list(ORDER_GAPS)


@query("e17_co_missing", DIRTY + "SELECT * FROM (" + union_all([f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr({flag(a)}, {flag(b)})')} AS phi FROM dirty_orders"
                                                         for i, a in enumerate(_GAP_NAMES) for b in _GAP_NAMES[i + 1:]]) + ") WHERE abs(phi) >= 0.3")
def _(t):
    return shown(missingness.co_missing(t.view("dirty_orders")), "phi")


@query("e17_co_missing_labels", with_views("doc_labels") + """SELECT 'quality' AS column_a, 'toxic' AS column_b,
  round(corr(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END), 6) AS phi FROM doc_labels""")
def _(t):
    return shown(missingness.co_missing(t.view("doc_labels")), "phi")


def effect_sql(table: str, gap: str, cond: str, o: str) -> str:
    return f"""SELECT '{gap}' AS column_with_gaps, '{o}' AS related_column, 'Mann-Whitney' AS test,
  {r6('abs(2 * (sum(CASE WHEN g THEN r END) - count(CASE WHEN g THEN 1 END) * (count(CASE WHEN g THEN 1 END) + 1) / 2.0) / (CAST(count(CASE WHEN g THEN 1 END) AS DOUBLE) * count(CASE WHEN NOT g THEN 1 END)) - 1)')} AS effect
FROM (SELECT {cond} AS g, rank() OVER (ORDER BY {o}) + (count(*) OVER (PARTITION BY {o}) - 1) / 2.0 AS r FROM {table} WHERE {o} IS NOT NULL)"""


@query("e18_missing_relations", GAPS + union_all(
    [effect_sql("dirty_events", g, f"{g} IS NULL", o) for g in ("value", "props") for o in ("id", "user_id", "value") if g != o]
    + ["SELECT * FROM (" + chi_sql(f"(SELECT *, CASE WHEN {g} IS NULL THEN 1 ELSE 0 END AS gap FROM dirty_events WHERE {o} IS NOT NULL)", "gap", o,
                                   f"'{g}' AS column_with_gaps, '{o}' AS related_column, 'Chi-square' AS test, {r6(V_FIX)} AS effect") + ")"
       for g, o in (("value", "event_type"), ("props", "event_type"))]))
def _(t):
    return shown(missingness.relations(t.view("dirty_events"), max_values=30).drop("p_value", "suggests_dependence"), "effect")


# 2.69 is the normal point of the corrected level 0.05 / 7 for the seven tests of this table
@query("e19_missing_dependence", GAPS + """, r AS (SELECT value IS NULL AS g, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0 AS r FROM dirty_events),
c AS (SELECT count(*)::DOUBLE AS n, count(CASE WHEN g THEN 1 END)::DOUBLE AS na, sum(CASE WHEN g THEN r END) AS ra FROM r),
t AS (SELECT sum(power(k, 3) - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM dirty_events GROUP BY user_id)),
u AS (SELECT *, n - na AS nb, ra - na * (na + 1) / 2 AS u FROM c)
SELECT 'value' AS column_with_gaps, 'user_id' AS related_column, abs(2 * u / (na * nb) - 1) >= 0.1
  AND (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * ((n + 1) - t / (n * (n - 1)))) > 2.69 AS suggests_dependence FROM u, t""")
def _(t):
    r = missingness.relations(t.view("dirty_events"), max_values=30)
    return r.filter("column_with_gaps = 'value' and related_column = 'user_id'").select("column_with_gaps", "related_column", "suggests_dependence")


# --- quality -------------------------------------------------------------------------------------------------------

TRIMMED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
NUMBER = r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'"
MARKS = ", ".join(f"'{p}'" for p in X.PLACEHOLDERS)


def quality_sql(view: str, texts: list[str]) -> str:
    parts = []
    for c in texts:
        s = TRIMMED.format(c=c)
        parts += [f"SELECT 'warning' AS level, '{c}' AS \"column\", 'extra spaces' AS \"check\", count(CASE WHEN {c} <> {s} THEN 1 END) AS \"count\" FROM {view}",
                  f"SELECT 'error', '{c}', 'disguised missing values', count(CASE WHEN lower({s}) IN ({MARKS}) THEN 1 END) FROM {view}",
                  f"SELECT 'warning', '{c}', 'mixed types', CASE WHEN avg(CASE WHEN regexp_full_match({s}, {NUMBER}) THEN 1.0 ELSE 0 END) BETWEEN 0.0500001 AND 0.9499999 THEN count(CASE WHEN regexp_full_match({s}, {NUMBER}) THEN 1 END) ELSE 0 END FROM {view} WHERE {c} IS NOT NULL",
                  f"""SELECT 'warning', '{c}', 'inconsistent spelling', count(*) FROM (
                      SELECT regexp_replace(lower({c}), '[\\W_]+', '', 'g') AS k FROM {view} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {c}) > 1)""",
                  f"SELECT 'info', '{c}', 'many categories', CASE WHEN count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) < 0.5 * count({c}) THEN count(DISTINCT {c}) ELSE 0 END FROM {view}"]
    return union_all(parts)


@query("e20_quality_checks", DIRTY + "SELECT * FROM (" + quality_sql("dirty_orders", ["priority", "cust_text", "status"]) + f"""
UNION ALL SELECT 'error', 'price', 'infinite values', count(CASE WHEN isinf(price) THEN 1 END) FROM dirty_orders
UNION ALL SELECT 'warning', 'const_col', 'constant', count(*) FROM dirty_orders
UNION ALL SELECT 'warning', CAST(NULL AS VARCHAR), 'duplicate rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) FROM dirty_orders
) WHERE "count" > 0""")
def _(t):
    return quality.quality_checks(t.view("dirty_orders")).drop("message")


BROKEN = """
SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN -1 ELSE 20 END AS age, CAST(NULL AS DOUBLE) AS nothing,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '2024-01-05' WHEN c_custkey % 3 = 1 THEN '05/01/2024' ELSE '5.1.2024' END AS joined FROM {customer}"""


@query("e21_quality_broken", f"""
WITH b AS ({BROKEN.format(customer='customer')})
SELECT * FROM (
SELECT 'warning' AS level, CAST(NULL AS VARCHAR) AS "column", 'duplicate rows' AS "check", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS "count" FROM b
UNION ALL SELECT 'warning', NULL, 'empty rows', count(CASE WHEN nation IS NULL AND segment IS NULL AND age IS NULL AND joined IS NULL THEN 1 END) FROM b
UNION ALL SELECT 'error', 'nothing', 'empty column', count(*) FROM b
UNION ALL SELECT 'warning', 'age', 'implausible negatives', count(CASE WHEN age < 0 THEN 1 END) FROM b
UNION ALL SELECT 'warning', 'joined', 'date formats', count(DISTINCT regexp_replace(joined, '\\d', '9', 'g')) FROM b) WHERE "count" > 0""")
def _(t):
    return quality.quality_checks(t.sql(BROKEN)).drop("message")


@query("e26_date_shapes", f"""
WITH b AS ({BROKEN.format(customer='customer')}) SELECT count(*) AS shapes, max(n) AS top FROM (
SELECT regexp_replace(joined, '\\d', '9', 'g') AS s, count(*) AS n FROM b WHERE joined IS NOT NULL GROUP BY 1)""")
def _(t):
    r = quality.date_shapes(t.sql(BROKEN), "joined")
    return small_table(t.spark, [{"shapes": r["shapes"], "top": r["top"]}], "shapes long, top long")


LUHN = """len(regexp_replace({c}, '\\D', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace({c}, '\\D', '', 'g')) + 1),
  lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace({c}, '\\D', '', 'g'))[i] AS INT)
    ELSE CAST(reverse(regexp_replace({c}, '\\D', '', 'g'))[i] AS INT) * 2 - CASE WHEN CAST(reverse(regexp_replace({c}, '\\D', '', 'g'))[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""


def pii_sql(view: str, cols: list[str]) -> str:
    kinds = {"email": f"regexp_matches({{c}}, '{X.EMAIL}')",
             "phone number": f"regexp_matches({{c}}, '{X.PHONE}') AND NOT regexp_matches({{c}}, '{X.IPV4}') AND NOT regexp_matches({{c}}, '{X.DATE_LIKE}')",
             "IP address": f"regexp_matches({{c}}, '{X.IPV4}')", "IBAN": f"regexp_matches({{c}}, '{X.IBAN}')", "ID number (SSN style)": f"regexp_matches({{c}}, '{X.SSN}')",
             "card number": LUHN}
    parts = []
    for c in cols:
        for k, test in kinds.items():
            t = test.replace("{c}", c)
            parts.append(f"SELECT '{c}' AS \"column\", '{k}' AS looks_like, avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) AS s FROM {view}")
    return union_all(parts)


@query("e27_pii_scan", with_views("contacts") + 'SELECT "column", looks_like, round_even(s * 100, 1)::DOUBLE AS share_pct FROM ('
       + pii_sql("contacts", ["contact", "reach", "host", "tax_no", "payment", "account", "segment"])
       + ") WHERE s >= 0.2 UNION ALL SELECT 'first_name', 'column name suggests personal data', 100.0 FROM customer HAVING count(*) > 0")
def _(t):
    return quality.pii_scan(t.view("contacts"))


@query("e37_target_screen_class", "SELECT * FROM (" + union_all(
    [f"SELECT '{v}' AS \"column\", {r6(f'sqrt({eta_sql(ORDERS, STATUS, v)})')} AS strength, 'correlation ratio' AS measure" for v in ("o_totalprice", "o_custkey")]
    + ["SELECT * FROM (" + chi_sql("orders", "o_orderpriority", "o_orderstatus", f"'o_orderpriority' AS \"column\", {r6(V_PLAIN)} AS strength, 'cramers_v' AS measure") + ")"]) + ")")
def _(t):
    return shown(A.target_screen(t.orders.select("o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_orderstatus"), "strength")


@query("e37_target_screen_number", f"""
SELECT 'user_id' AS "column", {r6('abs(corr(user_id, value))')} AS strength, 'pearson' AS measure FROM events
UNION ALL SELECT 'event_type', {r6(f"sqrt({eta_sql('events', 'event_type', 'value')})")}, 'correlation ratio'""")
def _(t):
    return shown(A.target_screen(t.events.select("user_id", "event_type", "value"), "value"), "strength")


@query("e38_class_shares", """
WITH top AS (SELECT props FROM events GROUP BY 1 ORDER BY count(*) DESC, props LIMIT 15)
SELECT props AS feature, event_type AS class, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY props), 6) AS share
FROM events WHERE props IN (SELECT props FROM top) GROUP BY 1, 2""")
def _(t):
    return shown(A.class_shares(t.events, "props", "event_type"), "share")


@query("e38_five_numbers", f"""
SELECT event_type AS "group", {s9('min(value)')} AS low, {s9('quantile_cont(value, CAST(0.25 AS DOUBLE))')} AS q1, {s9('quantile_cont(value, CAST(0.5 AS DOUBLE))')} AS median,
  {s9('quantile_cont(value, CAST(0.75 AS DOUBLE))')} AS q3, {s9('max(value)')} AS high FROM events GROUP BY 1""")
def _(t):
    return shown(A.five_numbers(t.events, "event_type", "value"))


@query("e38_fit_line", f"SELECT {s9('regr_slope(l_extendedprice, l_quantity)')} AS slope, {s9('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, count(*) AS n FROM lineitem")
def _(t):
    return shown(A.fit_line(t.lineitem, "l_quantity", "l_extendedprice"))


@query("f5_kruskal_wallis", f"""
WITH r AS (SELECT event_type AS g, value AS v, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events),
s AS (SELECT count(*) AS n FROM r), t AS (SELECT sum(power(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v))
SELECT n, k AS "groups", {r6('(12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - t / (power(n, 3) - n))')} AS h
FROM s, t, (SELECT count(*) AS k, sum(x * x / c) AS q FROM (SELECT sum(r) AS x, count(*) AS c FROM r GROUP BY g))""")
def _(t):
    e = t.events
    k = A.kruskal(e, {"value": (F.col("event_type"), C.as_numeric(e, "value"))})["value"]
    return shown(small_table(t.spark, [k], "n long, groups long, h double"), "h")


@query("i1_redact", f"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '{X.REDACT_EMAIL}', '[email]', 'g'), '{X.REDACT_DIGITS}', '[number]', 'g'), '{X.REDACT_PHONE}', '[number]', 'g') AS text FROM conversations")
def _(t):
    return quality.redacted(t.conversations.select("conv_id", "turn", "text"), ["text"])


@query("i2_card_check", with_views("contacts") + "SELECT id, " + LUHN.replace("{c}", "payment") + " AS card FROM contacts")
def _(t):
    return t.view("contacts").select("id", X.luhn(F.col("payment")).alias("card"))


@query("i3_numeric_view", DIRTY + f"SELECT id, CASE WHEN regexp_full_match({TRIMMED.format(c='cust_text')}, {NUMBER}) THEN TRY_CAST(cust_text AS DOUBLE) END AS cust, CASE WHEN regexp_full_match({TRIMMED.format(c='priority')}, {NUMBER}) THEN 0.0 END::DOUBLE AS priority FROM dirty_orders")
def _(t):
    d = t.view("dirty_orders")
    return d.select("id", C.as_numeric(d, "cust_text").alias("cust"), C.as_numeric(d, "priority").alias("priority"))
