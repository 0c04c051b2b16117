"""What changed between two versions of a table."""
from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import Numbers, between
from millrace.operators import columns as C
from millrace.operators.correlation import pair_corr
from millrace.operators.counts import value_counts
from millrace.operators.profile import duplicate_rows, moments, small_table
from millrace.operators.ranks import totals_before
from millrace.session import stored


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, change, before, after): added, removed or retyped columns."""
    rows = [{"column": c, "change": "removed", "before": C.type_name(a, c)} for c in a.columns if c not in b.columns]
    rows += [{"column": c, "change": "added", "after": C.type_name(b, c)} for c in b.columns if c not in a.columns]
    rows += [{"column": c, "change": "retyped", "before": C.type_name(a, c), "after": C.type_name(b, c)}
             for c in a.columns if c in b.columns and C.type_name(a, c) != C.type_name(b, c)]
    return small_table(a.sparkSession, rows, "column string, change string, before string, after string")


def gap_shares(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict]:
    cols = cols or df.columns
    r = df.agg(F.count("*").alias("rows"), *[F.count(F.when(C.is_null(df, c), 1)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return r["rows"], {c: r[f"m{i}"] / r["rows"] * 100 if r["rows"] else 0.0 for i, c in enumerate(cols)}


def summary_diff(a: DataFrame, b: DataFrame, counted: tuple | None = None) -> DataFrame:
    """Rows, columns, repeated rows and missing cells of both tables. counted: gap_shares of both, if known."""
    facts = []
    for d, (rows, gaps) in zip((a, b), counted or (gap_shares(a), gap_shares(b))):
        facts.append({"rows": rows, "columns": len(d.columns), "duplicate rows": duplicate_rows(d), "missing cells %": sum(gaps.values()) / len(gaps)})
    rows = [{"metric": k, "before": float(facts[0][k]), "after": float(facts[1][k]), "change": float(facts[1][k] - facts[0][k])} for k in facts[0]]
    return small_table(a.sparkSession, rows, "metric string, before double, after double, change double")


def missing_diff(a: DataFrame, b: DataFrame, counted: tuple | None = None) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    x, y = (g for _, g in (counted or (gap_shares(a, shared), gap_shares(b, shared))))
    return small_table(a.sparkSession, [{"column": c, "before_pct": x[c], "after_pct": y[c], "change": y[c] - x[c]} for c in shared],
                       "column string, before_pct double, after_pct double, change double")


def level(psi: float | None) -> str:
    if psi is None:
        return "n/a"
    return "stable" if psi < 0.1 else "moderate" if psi < 0.25 else "large"


def psi_from_counts(edges: list[float], a: dict[int, int], b: dict[int, int], na: int, nb: int) -> float | None:
    if na < 20 or nb < 20 or len(edges) < 3:
        return None
    total = 0.0
    for i in range(len(edges) - 1):
        p, q = max(a.get(i, 0) / na, 1e-4), max(b.get(i, 0) / nb, 1e-4)
        total += (q - p) * math.log(q / p)
    return total


class Sides(NamedTuple):
    """The distinct values of both versions of some columns: table (k, key, na, nb, na_before, nb_before), in order of the
    values, and the rows with a value in each version by k."""
    numbers: Numbers
    table: DataFrame
    sizes: dict[int, tuple[int, int]]


def sides(a: DataFrame, b: DataFrame, cols: list[str]) -> Sides:
    """Counted, ordered and written once; medians, deciles, stability and KS distance are all read off it."""
    both = [d.select(F.lit(n).alias("side"), *[_comparable(a, b, d, c).alias(f"v{i}") for i, c in enumerate(cols)]) for n, d in enumerate((a, b))]
    numbers = Numbers(both[0].unionByName(both[1]), [F.col(f"v{i}") for i in range(len(cols))], [F.col("side")])
    counts = numbers.rows().groupBy("k", "key").agg(F.sum(1 - F.col("side")).alias("na"), F.sum("side").alias("nb"))
    table = stored(totals_before(counts, ["na", "nb"]), "sides")
    sizes = {r["k"]: (r["na"], r["nb"]) for r in table.groupBy("k").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).collect()}
    return Sides(numbers, table, sizes)


def _comparable(a: DataFrame, b: DataFrame, d: DataFrame, name: str) -> Column:
    """The column in its own type where both versions have it in the same one, else as doubles."""
    return C.exact_numeric(d, name) if a.schema[name].dataType == b.schema[name].dataType else C.as_numeric(d, name)


def side_quantiles(s: Sides, probs: dict[str, list[float]]) -> dict[tuple[int, str], list[float]]:
    """Interpolated quantiles by (k, side); probs: those wanted of side "a" and of side "b"."""
    places = {(k, side): [(n - 1) * p for p in probs[side]] for k, own in s.sizes.items() for side, n in zip("ab", own) if n}
    wanted = {(k, side, r) for (k, side), own in places.items() for h in own for r in (math.floor(h), math.ceil(h))}
    if not wanted:
        return {}
    small = F.broadcast(s.table.sparkSession.createDataFrame(sorted(wanted), "wk int, side string, rank long"))
    start, n = (F.when(F.col("side") == "a", F.col(f"na{x}")).otherwise(F.col(f"nb{x}")) for x in ("_before", ""))
    hit = s.table.join(small, (F.col("k") == F.col("wk")) & (F.col("rank") >= start) & (F.col("rank") < start + n))
    at = {(r["k"], r["side"], r["rank"]): s.numbers.number[r["k"]](r["key"]) for r in hit.select("k", "side", "rank", "key").collect()}
    return {(k, side): [between(at[k, side, math.floor(h)], at[k, side, math.ceil(h)], h - math.floor(h)) for h in own] for (k, side), own in places.items()}


def stability(a: DataFrame, b: DataFrame, cols: list[str], bins: int = 10, found: Sides | None = None) -> dict[str, float | None]:
    """Population stability index: bins [low, high) at the quantiles of a, both ends open to infinity."""
    s = found or sides(a, b, cols)
    q = side_quantiles(s, {"a": [i / bins for i in range(bins + 1)], "b": []})
    return _stability(s, cols, {k: v for (k, side), v in q.items() if side == "a"})


def _stability(s: Sides, cols: list[str], deciles: dict[int, list[float]]) -> dict[str, float | None]:
    edges = {k: sorted(set(v)) for k, v in deciles.items()}
    live = {k: [s.numbers.least_key(k, e) for e in own[1:-1]] for k, own in edges.items() if len(own) >= 3}
    counts: dict = {}
    if live:
        inner = F.broadcast(s.table.sparkSession.createDataFrame(list(live.items()), "k int, edges array<long>"))
        binned = s.table.join(inner, "k").withColumn("bin", F.expr("size(filter(edges, e -> e <= key))"))
        for r in binned.groupBy("k", "bin").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).collect():
            counts.setdefault(r["k"], ({}, {}))
            counts[r["k"]][0][r["bin"]], counts[r["k"]][1][r["bin"]] = r["na"], r["nb"]
    return {c: psi_from_counts(edges[k], *counts[k], *s.sizes[k]) if k in live else None for k, c in enumerate(cols)}


def ks_statistics(a: DataFrame, b: DataFrame, cols: list[str], found: Sides | None = None) -> dict[str, float | None]:
    """Two-sample Kolmogorov-Smirnov distance of all columns at once, from running totals over their distinct values."""
    if not cols:
        return {}
    s = found or sides(a, b, cols)
    size = s.table.sparkSession.createDataFrame([(k, ta, tb) for k, (ta, tb) in s.sizes.items()], "k int, ta long, tb long")
    gap = F.abs((F.col("na_before") + F.col("na")) / F.col("ta") - (F.col("nb_before") + F.col("nb")) / F.col("tb"))
    out = {r["k"]: r["ks"] for r in s.table.join(F.broadcast(size.filter("ta > 0 and tb > 0")), "k").groupBy("k").agg(F.max(gap).alias("ks")).collect()}
    return {c: out.get(i) for i, c in enumerate(cols)}


def paired_shapes(a: DataFrame, b: DataFrame, cols: list[str], bins: int = 10) -> dict[str, dict]:
    """Medians, KS distance and stability index per column, all from one ordered table of both versions."""
    if not cols:
        return {}
    s = sides(a, b, cols)
    q = side_quantiles(s, {"a": [i / bins for i in range(bins + 1)] + [0.5], "b": [0.5]})
    psi = _stability(s, cols, {k: v[:-1] for (k, side), v in q.items() if side == "a"})
    ks = ks_statistics(a, b, cols, s)
    both = {c for k, c in enumerate(cols) if (k, "a") in q and (k, "b") in q}
    return {c: {"median_before": q[k, "a"][-1] if c in both else None, "median_after": q[k, "b"][0] if c in both else None, "psi": psi[c], "ks": ks[c]} for k, c in enumerate(cols)}


NUMERIC = ("column string, mean_before double, mean_after double, median_before double, median_after double, mean_shift_sd double, "
           "ks double, psi double, drift string")


def numeric_drift(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or a.columns) if c in b.columns and C.kind(a, c) == C.kind(b, c) == "numeric"]
    ea, eb = {c: C.as_numeric(a, c) for c in cols}, {c: C.as_numeric(b, c) for c in cols}
    ma, mb = moments(a, ea), moments(b, eb)
    cols = [c for c in cols if ma[c]["n"] and mb[c]["n"]]
    shape = paired_shapes(a, b, cols)
    rows = [{"column": c, "mean_before": ma[c]["mean"], "mean_after": mb[c]["mean"],
             "mean_shift_sd": (mb[c]["mean"] - ma[c]["mean"]) / ma[c]["std"] if ma[c]["std"] else None,
             **shape[c], "drift": level(shape[c]["psi"])} for c in cols]
    return small_table(a.sparkSession, rows, NUMERIC)


def category_alignment(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n_a, n_b) of both versions, an absent value counting 0."""
    return (value_counts(a, cols).withColumnRenamed("n", "n_a").join(value_counts(b, cols).withColumnRenamed("n", "n_b"), ["column", "value"], "full_outer")
            .select("column", "value", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")))


def category_changes(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, change): values that only one version has, by anti joins on the distinct values."""
    va, vb = value_counts(a, cols).select("column", "value"), value_counts(b, cols).select("column", "value")
    return (vb.join(va, ["column", "value"], "left_anti").withColumn("change", F.lit("new"))
            .unionByName(va.join(vb, ["column", "value"], "left_anti").withColumn("change", F.lit("disappeared"))))


def categorical_drift(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """New and disappeared categories and the total variation distance of the shares."""
    cols = [c for c in (cols or a.columns) if c in b.columns and C.kind(a, c) in ("text", "boolean")]
    if not cols:
        return small_table(a.sparkSession, [], "column string, new_categories string, n_new long, disappeared long, tvd double")
    both = category_alignment(a, b, cols)
    size = both.groupBy("column").agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"))
    facts = both.join(F.broadcast(size), "column").groupBy("column").agg(
        F.count(F.when(F.col("n_a") == 0, 1)).alias("n_new"), F.count(F.when(F.col("n_b") == 0, 1)).alias("disappeared"),
        (F.lit(0.5) * F.sum(F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.abs(F.col("n_a") / F.col("ta") - F.col("n_b") / F.col("tb"))))).alias("tvd"))
    shard = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("value")
    final = Window.partitionBy("column").orderBy("value")
    names = (both.filter("n_a = 0").withColumn("r", F.row_number().over(shard)).filter("r <= 5").withColumn("r", F.row_number().over(final))
             .filter("r <= 5").groupBy("column").agg(F.concat_ws(", ", F.sort_array(F.collect_list("value"))).alias("new_categories")))
    return facts.join(names, "column", "left").select("column", F.coalesce("new_categories", F.lit("")).alias("new_categories"), "n_new", "disappeared", "tvd")


def correlation_change(a: DataFrame, b: DataFrame, at_least: float = 0.2, top: int | None = None) -> DataFrame:
    cols = [c for c in a.columns if c in b.columns and C.kind(a, c) == C.kind(b, c) == "numeric"]
    m = moments(a, {c: C.as_numeric(a, c) for c in cols})
    cols = sorted(cols, key=lambda c: -(m[c]["var"] or 0))
    pairs = list(itertools.combinations(cols, 2))
    ra, rb = (pair_corr(d, {c: C.as_numeric(d, c) for c in cols}, pairs) for d in (a, b))
    rows = []
    for p in pairs:
        x, y = ra[p][0], rb[p][0]
        if x is not None and y is not None and abs(y - x) >= at_least:
            rows.append({"column_a": p[0], "column_b": p[1], "before": x, "after": y, "change": y - x})
    rows.sort(key=lambda r: -abs(r["change"]))
    return small_table(a.sparkSession, rows[:top], "column_a string, column_b string, before double, after double, change double")


def drift_flags(a: DataFrame, b: DataFrame, numeric: DataFrame | None = None, categorical: DataFrame | None = None, schema: DataFrame | None = None) -> DataFrame:
    """(level, kind, column): the changes worth a look. Tables that are at hand are read instead of made again."""
    numeric, categorical, schema = numeric or numeric_drift(a, b), categorical or categorical_drift(a, b), schema or schema_diff(a, b)
    rows = [{"level": "warning", "kind": "numeric drift", "column": r["column"]} for r in numeric.filter("drift = 'large'").collect()]
    rows += [{"level": "warning", "kind": "new categories", "column": r["column"]} for r in categorical.filter("n_new > 0").collect()]
    for r in schema.collect():
        rows.append({"level": "info" if r["change"] == "added" else "warning", "kind": f"column {r['change']}", "column": r["column"]})
    return small_table(a.sparkSession, rows, "level string, kind string, column string")


def compare(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Every comparison table by name; each is made once, the flags are read off the others."""
    counted, schema, numeric = (gap_shares(a), gap_shares(b)), schema_diff(a, b), numeric_drift(a, b)
    categorical = stored(categorical_drift(a, b), "categorical")
    return {"summary": summary_diff(a, b, counted), "schema": schema, "missing": missing_diff(a, b, counted), "numeric": numeric, "categorical": categorical,
            "correlations": correlation_change(a, b), "flags": drift_flags(a, b, numeric, categorical, schema)}
