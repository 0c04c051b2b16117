"""Order, ranks and quantiles of numbers that doubles hold badly: signed zeros, 64-bit ids, decimals."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from millrace.catalog.base import query, r6, s9, shown, union_all, with_views
from millrace.catalog.checks import ks_sql
from millrace.catalog.profiles import SIX, profile_sql
from millrace.catalog.relations import effect_sql, rank_cte
from millrace.operators import correlation, drift, missingness, profile, quantiles, ranks
from millrace.operators.profile import small_table
from millrace.plans import steps as P
from millrace.sources.readers import pasted_table
from millrace.sources.synthetic import make_dataset

HARD = with_views("hard_numbers")
HALVES = HARD + ", a AS (SELECT * FROM hard_numbers WHERE id % 2 = 0), b AS (SELECT * FROM hard_numbers WHERE id % 2 = 1) "


def halves(t):
    d = t.view("hard_numbers")
    return d.filter("id % 2 = 0"), d.filter("id % 2 = 1")


@query("d1_numeric_profile_signed_zero", profile_sql("hard_numbers", ["signed", "gappy"], HARD))
def _(t):
    return shown(profile.numeric_profile(t.view("hard_numbers"), ["signed", "gappy"]).drop("normality_p", "shape"), *SIX)


@query("b7_impute_median_signed_zero", HARD + f"SELECT id, {s9('coalesce(gappy, (SELECT quantile_cont(gappy, CAST(0.5 AS DOUBLE)) FROM hard_numbers))')} AS gappy FROM hard_numbers")
def _(t):
    df = t.view("hard_numbers").select("id", "gappy")
    return shown(P.Imputer(num_missing="Median").fit(df).transform(df))


@query("e18_missing_relations_signed_zero", HARD + union_all([effect_sql("hard_numbers", "gappy", "gappy IS NULL", o) for o in ("signed", "wide", "fine")]))
def _(t):
    df = t.view("hard_numbers")
    found = missingness.rank_tests(df, ["signed", "wide", "fine"], ["gappy"], missingness.flags(df, ["gappy"]))
    rows = [{"column_with_gaps": g, "related_column": o, "test": "Mann-Whitney", "effect": v["effect"]} for (o, g), v in found.items()]
    return shown(small_table(t.spark, rows, "column_with_gaps string, related_column string, test string, effect double"), "effect")


@query("f1_average_ranks_wide_ids", HARD + "SELECT wide AS value, count(*) AS n, any_value(r) AS rank FROM (SELECT wide, rank() OVER (ORDER BY wide) + (count(*) OVER (PARTITION BY wide) - 1) / 2.0 AS r FROM hard_numbers) GROUP BY wide")
def _(t):
    return ranks.average_ranks(t.view("hard_numbers"), F.col("wide"))


@query("f4_signed_zero", HALVES + union_all([f"SELECT '{c}' AS \"column\", {r6(ks_sql(c))} AS ks" for c in ("signed", "wide", "fine")]))
def _(t):
    found = drift.ks_statistics(*halves(t), ["signed", "wide", "fine"])
    return shown(small_table(t.spark, [{"column": c, "ks": v} for c, v in found.items()], "column string, ks double"), "ks")


@query("d1_quantiles_wide_ids", HARD + union_all([
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS place, CAST(quantile_disc({c}, {p}) - CAST({base} AS {kind}) AS DOUBLE) AS above FROM hard_numbers"
    for c, base, kind in (("wide", 1152921504606846976, "BIGINT"), ("fine", 12345678901, "DECIMAL(20, 6)")) for i, p in enumerate((0.1, 0.5, 0.9))]))
def _(t):
    df = t.view("hard_numbers")
    n, rows = df.count(), []
    for c, base in (("wide", 1152921504606846976), ("fine", 12345678901)):
        places = [max(0, -(-n * p // 10) - 1) for p in (1, 5, 9)]
        at = quantiles.order_statistics(df, F.col(c), places)
        rows += [{"column": c, "place": i, "above": float(at[p] - base)} for i, p in enumerate(places)]
    return small_table(t.spark, rows, "column string, place long, above double")


@query("e7_spearman_hard_numbers", HARD + f", r AS {rank_cte('hard_numbers', ['signed', 'wide', 'fine'])} " + union_all(
    [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'corr(r_{a}, r_{b})')} AS spearman, count(*) AS n FROM r" for a, b in (("signed", "wide"), ("signed", "fine"), ("wide", "fine"))]))
def _(t):
    df = t.view("hard_numbers")
    found = correlation.spearman_pairs(df, ["signed", "wide", "fine"])
    rows = [{"column_a": a, "column_b": b, "spearman": r, "n": n} for (a, b), (r, n) in found.items()]
    return shown(small_table(t.spark, rows, "column_a string, column_b string, spearman double, n long"), "spearman")


@query("e8_kendall_signed_zero", HARD + f""", v AS (SELECT signed AS a, wide AS b, count(*) AS w FROM hard_numbers GROUP BY ALL),
s AS (SELECT sum(x.w * y.w * sign(x.a - y.a) * sign(x.b - y.b)) AS s, sum(x.w * y.w * abs(sign(x.a - y.a))) AS u, sum(x.w * y.w * abs(sign(x.b - y.b))) AS v FROM v x, v y)
SELECT 'signed' AS column_a, 'wide' AS column_b, {r6('s / sqrt(CAST(u AS DOUBLE) * v)')} AS kendall, (SELECT count(*) FROM hard_numbers) AS n FROM s""")
def _(t):
    return shown(correlation.kendall(t.view("hard_numbers"), ["signed", "wide"]), "kendall")


@query("c7_concordance_events", f"""
WITH d AS (SELECT event_id, value, user_id FROM events), p AS (SELECT x.value AS a, x.user_id AS b, y.value AS c, y.user_id AS d FROM d x JOIN d y ON x.event_id < y.event_id),
s AS (SELECT sum(sign(a - c) * sign(b - d)) AS s, count(CASE WHEN a <> c THEN 1 END) AS u, count(CASE WHEN b <> d THEN 1 END) AS v FROM p)
SELECT 'user_id' AS column_a, 'value' AS column_b, {r6('s / sqrt(CAST(u AS DOUBLE) * v)')} AS kendall, (SELECT count(*) FROM d) AS n FROM s""")
def _(t):
    return shown(correlation.kendall(t.events, ["user_id", "value"]), "kendall")


def drawn(what: str) -> str:
    """The uniform number of a draw, in SQL."""
    return f"((CAST(concat('0x', substr(md5(concat_ws('|', '7', '{what}', CAST(o_orderkey AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


TWO_PI = "6.283185307179586"


@query("a12_synthetic", f"""
WITH d AS (SELECT o_orderkey AS id, sqrt(-2 * ln({drawn('z0a')})) * cos({TWO_PI} * {drawn('z0b')}) AS z0, sqrt(-2 * ln({drawn('z1a')})) * cos({TWO_PI} * {drawn('z1b')}) AS z1,
  CAST(floor({drawn('k0')} * 3) AS INT) AS k0, {drawn('u')} AS u, {drawn('out0')} AS o0, {drawn('out1')} AS o1, {drawn('gap0')} AS g0, {drawn('gap1')} AS g1, {drawn('hole0')} AS h0 FROM orders)
SELECT id, {s9('CASE WHEN g0 >= 0.05 THEN (z0 * 1 - 100) * CASE WHEN o0 < 0.01 THEN 8 ELSE 1 END END')} AS num_0, {s9('CASE WHEN g1 >= 0.05 THEN (z1 * 8 - 63) * CASE WHEN o1 < 0.01 THEN 8 ELSE 1 END END')} AS num_1,
  CASE WHEN h0 >= 0.05 THEN concat('v', CAST(k0 AS VARCHAR)) END AS cat_0,
  CASE WHEN u < 1 / (1 + exp(-4 * (z0 + CASE WHEN k0 = 0 THEN 1.5 ELSE 0 END - {NormalDist(0.5, 1.22).inv_cdf(0.85)!r}))) THEN 'yes' ELSE 'no' END AS y FROM d""")
def _(t):
    return shown(make_dataset(t.spark, 0, cols=3, seed=7, ids=t.orders.select(F.col("o_orderkey").alias("id"))))


@query("a8_pasted_table", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def _(t):
    lines = [f'{r[0]}\t"{r[1]}"\t{r[2]}' for r in t.nation.select("n_nationkey", "n_name", "n_regionkey").collect()]
    return shown(pasted_table(t.spark, "\n".join(["n_nationkey\tn_name\tn_regionkey", *lines])))
