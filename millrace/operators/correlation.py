"""Pearson, Spearman and Kendall between numeric columns, over all rows."""
from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.profile import small_table
from millrace.operators.ranks import row_ranks, totals_before
from millrace.session import stored

BUILTIN_PAIRS = 3
#: Bits of a rank that one level of the inversion count looks at.
LEVEL_BITS = 2


def pair_corr(df: DataFrame, exprs: dict[str, Column], pairs: list[tuple] | None = None) -> dict[tuple, tuple]:
    """{(a, b): (r, n)} over the rows where both are present; r is None when one side does not vary.

    Few pairs use the built-in aggregate. Many pairs use one matrix product per Arrow batch: a single scan whose
    shuffle is one k x k block per task.
    """
    pairs = list(itertools.combinations(exprs, 2)) if pairs is None else pairs
    if not pairs:
        return {}
    if len(pairs) <= BUILTIN_PAIRS:
        both = {p: (exprs[p[0]].isNotNull() & exprs[p[1]].isNotNull()) for p in pairs}
        r = df.agg(*[a for i, (x, y) in enumerate(pairs) for a in (
            F.try_divide(F.regr_sxy(exprs[x], exprs[y]), F.sqrt(F.regr_sxx(exprs[x], exprs[y]) * F.regr_syy(exprs[x], exprs[y]))).alias(f"r{i}"), F.count(F.when(both[(x, y)], 1)).alias(f"n{i}"))]).first()
        out = {}
        for i, p in enumerate(pairs):
            v = r[f"r{i}"]
            out[p] = (None if v is None or v != v else float(v), r[f"n{i}"])
        return out
    return _gram(df, exprs, pairs)


def _gram(df: DataFrame, exprs: dict[str, Column], pairs: list[tuple]) -> dict[tuple, tuple]:
    names = list(exprs)
    k = len(names)
    wide = df.select(*[exprs[c].cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    centre = wide.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(k)]).first()
    shift = np.array([centre[i] for i in range(k)])

    def partial(batches):
        total = np.zeros((5, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) - shift
            ok = ~np.isnan(x)
            x, m = np.where(ok, x, 0.0), ok.astype(float)
            x2 = x * x
            total += np.stack([m.T @ m, x.T @ m, x2.T @ m, m.T @ x2, x.T @ x])
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({"i": np.arange(5 * k * k), "s": total.reshape(-1)})

    sums = np.zeros(5 * k * k)
    for r in wide.mapInArrow(partial, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = r["s"]
    n, sx, sxx, syy, sxy = sums.reshape(5, k, k)
    out = {}
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        m = n[i, j]
        if m < 2:
            out[(a, b)] = (None, int(m))
            continue
        vx, vy = sxx[i, j] - sx[i, j] ** 2 / m, syy[i, j] - sx[j, i] ** 2 / m
        cov = sxy[i, j] - sx[i, j] * sx[j, i] / m
        flat = vx <= 1e-12 * sxx[i, j] or vy <= 1e-12 * syy[i, j]
        out[(a, b)] = (None if flat else float(np.clip(cov / np.sqrt(vx * vy), -1, 1)), int(m))
    return out


def _pairs_table(df, found: dict, name: str) -> DataFrame:
    rows = [{"column_a": a, "column_b": b, name: v[0], "n": v[1]} for (a, b), v in found.items()]
    return small_table(df.sparkSession, rows, f"column_a string, column_b string, {name} double, n long")


def pearson(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """(column_a, column_b, pearson, n) for every pair of the fullest columns."""
    cols = C.most_filled(df, cols or C.numeric(df), max_cols)
    return _pairs_table(df, pair_corr(df, {c: C.as_numeric(df, c) for c in cols}), "pearson")


def ranked(df: DataFrame, exprs: dict[str, Column], dense: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """A row for each row of df with a value, holding the ranks of its values, and the rank column of each name."""
    return row_ranks(df, list(exprs.values()), dense), {c: F.col(f"r{i}") for i, c in enumerate(exprs)}


def spearman(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Average ranks per column, then Pearson over the rows where both are present."""
    cols = C.most_filled(df, cols or C.numeric(df), max_cols)
    return _pairs_table(df, spearman_pairs(df, cols), "spearman")


def spearman_pairs(df: DataFrame, cols: list[str], pairs: list[tuple] | None = None) -> dict[tuple, tuple]:
    return pair_corr(*ranked(df, {c: C.exact_numeric(df, c) for c in cols}), pairs)


def spearman_complete(df: DataFrame, pairs: dict) -> dict:
    """{name: (rho, n)} of the expressions (x, y) under each name, ranks taken after removing the rows where either is missing.

    Both sides of every pair become columns of one folded table, so all pairs share its exchanges.
    """
    sides = {(name, i): F.when(pair[0].isNotNull() & pair[1].isNotNull(), pair[i]) for name, pair in pairs.items() for i in (0, 1)}
    if not sides:
        return {}
    found = pair_corr(*ranked(df, sides), [((name, 0), (name, 1)) for name in pairs])
    return {name: found[(name, 0), (name, 1)] for name in pairs}


def kendall(df: DataFrame, cols: list[str]) -> DataFrame:
    """Kendall tau-b of every pair over all rows that have both."""
    return _pairs_table(df, kendall_pairs(df, {c: C.exact_numeric(df, c) for c in cols}), "kendall")


def kendall_tau(df: DataFrame, x: Column, y: Column) -> tuple:
    """(tau-b, n)."""
    return kendall_pairs(df, {"x": x, "y": y})[("x", "y")]


def kendall_pairs(df: DataFrame, exprs: dict[str, Column]) -> dict[tuple, tuple]:
    """{(a, b): (tau-b, n)} without forming pairs of rows: the inversions of y's order in x's order are counted level by level.

    Every value becomes its dense rank. Two points with different y part ways at one level: the highest LEVEL_BITS bits in which
    their y ranks differ, below a common beginning. So points are sent once to each level, under the beginning they have
    there; each (level, beginning, x) keeps how many points go to which branch, running totals over x count the branches
    among points with a smaller x, and smaller branches there are concordant pairs, larger ones discordant. Equal x or
    equal y never meet. Totals run over range exchanges (ranks.totals_before), so no beginning, not even the empty one
    that holds all points, is a group in one task; all pairs of columns and all levels share them.
    """
    names = list(exprs)
    pairs = list(itertools.combinations(range(len(names)), 2))
    if not pairs:
        return {}
    ranks, _ = ranked(df, exprs, dense=True)
    points = F.array(*[F.when(F.col(f"r{a}").isNotNull() & F.col(f"r{b}").isNotNull(),
                              F.struct(F.lit(i).alias("pair"), F.col(f"r{a}").cast("long").alias("x"), F.col(f"r{b}").cast("long").alias("y"))) for i, (a, b) in enumerate(pairs)])
    points = stored(ranks.select(F.explode(points).alias("p")).filter("p is not null").select("p.*").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")), "points")
    ties = {}
    for v in ("x", "y"):
        w = F.col("w").cast("double")
        for r in points.groupBy("pair", v).agg(F.sum("w").alias("w")).groupBy("pair").agg(F.sum("w").alias("n"), F.sum(w * (w - 1) / 2).alias("t")).collect():
            ties[r["pair"], v] = r["n"], r["t"]
    top = points.agg(F.max("y")).first()[0] or 0
    levels = range(-(-int(top).bit_length() // LEVEL_BITS))
    branches = 1 << LEVEL_BITS
    score = {}
    if levels:
        at = [F.struct(F.lit(level).alias("level"), F.shiftright("y", (level + 1) * LEVEL_BITS).alias("beginning"),
                       F.shiftright("y", level * LEVEL_BITS).bitwiseAND(branches - 1).alias("branch")) for level in levels]
        sent = points.select("pair", "x", "w", F.explode(F.array(*at)).alias("p")).select("pair", "x", "w", "p.*")
        cells = sent.groupBy("pair", "level", "beginning", "x").agg(*[F.sum(F.when(F.col("branch") == b, F.col("w")).otherwise(0)).alias(f"w{b}") for b in range(branches)])
        before = totals_before(cells, [f"w{b}" for b in range(branches)], ("pair", "level", "beginning"), "x")
        smaller = [F.col(f"w{b}").cast("double") * F.col(f"w{a}_before") for b in range(branches) for a in range(b)]
        larger = [F.col(f"w{b}").cast("double") * F.col(f"w{a}_before") for b in range(branches) for a in range(b + 1, branches)]
        score = {r["pair"]: r["s"] for r in before.groupBy("pair").agg(F.sum(functools.reduce(operator.add, smaller) - functools.reduce(operator.add, larger)).alias("s")).collect()}
    out = {}
    for i, (a, b) in enumerate(pairs):
        n, tx = ties.get((i, "x"), (0, 0.0))
        ty = ties.get((i, "y"), (0, 0.0))[1]
        total = n * (n - 1) / 2
        out[names[a], names[b]] = (None if n < 2 or total in (tx, ty) else float(score.get(i, 0.0) / np.sqrt((total - tx) * (total - ty))), n)
    return out
