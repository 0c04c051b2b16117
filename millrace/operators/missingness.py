"""Where values are missing, which gaps go together, and what missingness depends on."""
from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import significance as S
from millrace.operators import columns as C
from millrace.operators.association import cramers
from millrace.operators.counts import distinct_counts
from millrace.operators.profile import small_table
from millrace.operators.ranks import value_counts_before
from millrace.session import stored


def flags(df: DataFrame, cols: list[str]) -> dict:
    return {c: F.coalesce(C.missing(df, c), F.lit(True)).cast("int") for c in cols}


class Lattice(NamedTuple):
    """The sets of missing columns that occur, each with its rows: `table` (gaps array of column positions, rows), read off
    one aggregation of the table; the total of rows; and the rows with a gap by column."""
    table: DataFrame
    rows: int
    missing: dict[str, int]


def lattice(df: DataFrame, cols: list[str] | None = None) -> Lattice:
    """One scan. Equal sets merge on the map side; the counts, patterns and phi below are all sums over the sets."""
    cols = cols or df.columns
    f = flags(df, cols)
    key = F.concat_ws(",", *[F.when(f[c] == 1, F.lit(str(i))) for i, c in enumerate(cols)])
    gaps = F.when(F.col("key") == "", F.array().cast("array<int>")).otherwise(F.split("key", ",").cast("array<int>"))
    table = stored(df.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).select(gaps.alias("gaps"), "rows"), "gaps")
    counts = table.select("rows", F.explode_outer("gaps").alias("i")).groupBy("i").agg(F.sum("rows").alias("n")).collect()
    total = table.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    found = {r["i"]: r["n"] for r in counts}
    return Lattice(table, total, {c: found.get(i, 0) for i, c in enumerate(cols)})


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    cols = cols or df.columns
    f = flags(df, cols)
    r = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f[c]), F.lit(0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return r["rows"], {c: r[f"m{i}"] for i, c in enumerate(cols)}


def missing_per_column(df: DataFrame, found: Lattice | None = None) -> DataFrame:
    """Columns with gaps, blank text included, most missing first."""
    rows, m = (found.rows, found.missing) if found else missing_counts(df)
    out = [{"column": c, "missing": k, "missing_pct": k / rows * 100} for c, k in m.items() if k]
    return small_table(df.sparkSession, out, "column string, missing long, missing_pct double").orderBy(F.desc("missing_pct"), "column")


def patterns(df: DataFrame, top: int | None = None, max_cols: int | None = None, found: Lattice | None = None) -> DataFrame:
    """Rows that share the same set of missing columns, the most common sets first; max_cols looks at the first columns with gaps."""
    found = found or lattice(df)
    live = [i for i, c in enumerate(df.columns) if found.missing[c]][:max_cols]
    if not live:
        return small_table(df.sparkSession, [], "pattern string, rows long, share_pct double")
    names = F.lit(df.columns)
    kept = F.array_intersect("gaps", F.lit(live))
    text = F.array_join(F.transform(kept, lambda i: F.get(names, i)), ", ")
    out = (found.table.select(F.when(F.size(kept) == 0, "complete rows").otherwise(text).alias("pattern"), "rows").groupBy("pattern").agg(F.sum("rows").alias("rows"))
           .withColumn("share_pct", F.col("rows") / F.lit(found.rows) * 100).orderBy(F.desc("rows"), "pattern"))
    return out if top is None else out.limit(top)


def co_missing(df: DataFrame, at_least: float = 0.3, max_cols: int | None = None, found: Lattice | None = None) -> DataFrame:
    """Phi between missing flags of two columns, from how often they are missing together."""
    found = found or lattice(df)
    live = [i for i, c in enumerate(df.columns) if found.missing[c]][:max_cols]
    pairs = F.expr("flatten(transform(gaps, (a, i) -> transform(slice(gaps, i + 2, size(gaps)), b -> struct(a, b))))")
    both = found.table.select("rows", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("rows").alias("n"))
    together = {(r["a"], r["b"]): r["n"] for r in both.collect()}
    rows, n = [], found.rows
    for a, b in itertools.combinations(live, 2):
        x, y = found.missing[df.columns[a]], found.missing[df.columns[b]]
        spread = math.sqrt(float(x) * (n - x) * y * (n - y))
        phi = (float(n) * together.get((a, b), 0) - float(x) * y) / spread if spread else None
        if phi is not None and abs(phi) >= at_least:
            rows.append({"column_a": df.columns[a], "column_b": df.columns[b], "phi": phi})
    return small_table(df.sparkSession, rows, "column_a string, column_b string, phi double").orderBy(F.desc(F.abs("phi")), "column_a", "column_b")


def rank_tests(df: DataFrame, others: list[str], gaps: list[str], flag: dict, rows: int | None = None) -> dict[tuple, dict]:
    """Mann-Whitney of every other column between rows with and without a gap, {(other, gap column): result}.

    One table of distinct values of all columns, with the rows and the flagged rows of each, serves every gap column,
    because the ranks of a column do not depend on where the gaps are.
    """
    marks = [f"k{i}" for i in range(len(gaps))]
    if not others or not gaps:
        return {}
    counts = value_counts_before(df, [C.exact_numeric(df, o) for o in others], {k: flag[g] for g, k in zip(gaps, marks)})
    ranked = counts.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    aggs = [F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties")]
    for k in marks:
        aggs += [F.sum(k).alias(f"n_{k}"), F.sum(F.col(k) * F.col("rank")).alias(f"r_{k}"), F.count(F.when(F.col(k) > 0, 1)).alias(f"a_{k}"),
                 F.count(F.when(F.col(k) < F.col("n"), 1)).alias(f"b_{k}")]
    out: dict = {}
    for r in ranked.groupBy(F.col("k").alias("col")).agg(*aggs).collect():
        out.update({(others[r["col"]], g): t for g, t in _mann_whitney(r, gaps, marks).items()})
    return out


def _mann_whitney(r, gaps: list[str], marks: list[str]) -> dict[str, dict]:
    out = {}
    for g, k in zip(gaps, marks):
        n, na = r["n"] or 0, r[f"n_{k}"] or 0
        nb = n - na
        if na <= 5 or nb <= 5 or (r[f"a_{k}"] < 2 and r[f"b_{k}"] < 2):
            continue
        u = r[f"r_{k}"] - na * (na + 1) / 2
        spread = na * nb / 12 * ((n + 1) - r["ties"] / (float(n) * (n - 1)))
        z = (max(u, na * nb - u) - na * nb / 2 - 0.5) / math.sqrt(spread) if spread > 0 else 0.0
        out[g] = {"u": u, "effect": abs(2 * u / (float(na) * nb) - 1), "p": min(1.0, 2 * S.normal_sf(z))}
    return out


RELATIONS = "column_with_gaps string, related_column string, test string, effect double, p_value double, suggests_dependence boolean"


def relations(df: DataFrame, max_cols: int | None = None, max_targets: int | None = None, top: int | None = None, max_values: int | None = None, found_gaps: Lattice | None = None) -> DataFrame:
    """Whether gaps depend on other columns: rank tests against numbers, chi-square against categories."""
    rows, m = (found_gaps.rows, found_gaps.missing) if found_gaps else missing_counts(df)
    flag = flags(df, df.columns)
    gaps = sorted([c for c in df.columns if rows and 0.02 <= m[c] / rows <= 0.98], key=lambda c: -m[c])[:max_targets]
    nums = C.numeric(df)[:max_cols]
    masked = df.select(*[F.when(flag[c] == 0, C.col(c)).alias(c) for c in df.columns])
    others = [c for c in df.columns if c not in C.numeric(df) and C.kind(df, c) != "nested"]
    u = distinct_counts(masked, others) if max_values is not None else {}
    cats = [c for c in others if max_values is None or u[c] <= max_values][:max_cols]
    found = []
    found += [{"column_with_gaps": g, "related_column": o, "test": "Mann-Whitney", "effect": t["effect"], "p_value": t["p"]}
              for (o, g), t in rank_tests(df, nums, gaps, flag, rows).items() if o != g]
    pairs = [(f"gap {g}", o) for g in gaps for o in cats if g != o]
    exprs = {f"gap {g}": flag[g].cast("string") for g in gaps} | {o: F.when(flag[o] == 0, C.col(o).cast("string")) for o in cats}
    for (g, o), d in cramers(df, pairs, exprs).items():
        if d["r"] == 2 and d["k"] >= 2:
            found.append({"column_with_gaps": g[4:], "related_column": o, "test": "Chi-square", "effect": d["v"], "p_value": d["p"]})
    for f in found:
        f["suggests_dependence"] = f["p_value"] < 0.01 / max(len(found), 1) * 5 and f["effect"] >= 0.1
    found.sort(key=lambda f: (-f["suggests_dependence"], -f["effect"]))
    return small_table(df.sparkSession, found[:top], RELATIONS)


def missing_analysis(df: DataFrame) -> dict[str, DataFrame]:
    """Every missingness table. Counts, patterns and phi are read off one lattice of gap sets."""
    found = lattice(df)
    return {"per_column": missing_per_column(df, found), "patterns": patterns(df, found=found),
            "co_missing": co_missing(df, found=found), "relations": relations(df, found_gaps=found)}
