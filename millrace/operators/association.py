"""Association measures between columns of any kind, over all rows.

Pairs are tabulated together: one expand to (pair, a, b), one hash aggregation that merges on the map side, and
everything after that works on the cells.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import significance as S
from millrace.functions.keys import Numbers
from millrace.operators import columns as C
from millrace.operators.correlation import pair_corr, spearman_complete, spearman_pairs
from millrace.operators.counts import distinct_counts
from millrace.operators.profile import small_table, spread_about
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.ranks import join_often, totals_before
from millrace.session import stored


def _text(df: DataFrame, c: str) -> Column:
    return F.when(~C.is_null(df, c), C.col(c).cast("string"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of two columns, rows with a gap in either left out."""
    return (df.select(_text(df, a).alias("a"), _text(df, b).alias("b")).filter("a is not null and b is not null")
            .groupBy("a", "b").agg(F.count("*").alias("n")))


def contingencies(df: DataFrame, pairs: list[tuple], exprs: dict[str, Column]) -> DataFrame:
    """(pair, a, b, n) for many pairs in one pass; `exprs` are text expressions."""
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), exprs[x].alias("a"), exprs[y].alias("b")) for i, (x, y) in enumerate(pairs)])
    return (df.select(F.explode(cells).alias("x")).select("x.*").filter("a is not null and b is not null")
            .groupBy("pair", "a", "b").agg(F.count("*").alias("n")))


def cell_cube(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells (pair, a, b, n) as a table, and a table of their margins by grouping sets: (pair, a, b, n, cells, level), where
    level 1 sums over b, level 2 over a and level 3 over both. One plan at any size; nothing but sums per pair leaves the cluster."""
    cells = stored(cells, "cells")
    margins = (cells.groupingSets([["pair", "a"], ["pair", "b"], ["pair"]], "pair", "a", "b")
               .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.grouping_id().alias("level")))
    return cells, stored(margins.select("pair", "a", "b", "n", "cells", "level"), "margins")


def chi_square(cells: DataFrame) -> DataFrame:
    """Per pair: total, r, k and chi2 = n (sum of o^2 / (row * column) - 1), which also covers empty cells.

    Cells fetch the margin of a (frequent ones are broadcast); column totals come from the sum over each column itself.
    """
    cells, margins = cell_cube(cells)
    rows = margins.filter("level = 1").select("pair", "a", F.col("n").alias("ra"), "cells")
    columns = (join_often(cells, rows, ["pair", "a"], "cells", cells.count()).groupBy("pair", "b")
               .agg(F.sum(F.col("n").cast("double") * F.col("n") / F.col("ra")).alias("o"), F.sum("n").alias("cb")))
    s = columns.groupBy("pair").agg(F.sum(F.col("o") / F.col("cb")).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("cb").alias("total"))
    r = margins.filter("level = 1").groupBy("pair").agg(F.count(F.lit(1)).alias("r"))
    return s.join(r, "pair").select("pair", "total", "r", "k", F.greatest(F.lit(0.0), F.col("total") * (F.col("s") - 1)).alias("chi2"))


def cramers(df: DataFrame, pairs: list[tuple], exprs: dict[str, Column] | None = None) -> dict[tuple, dict]:
    """Per pair: n, r, k, chi2, p, V with bias correction and plain V."""
    if not pairs:
        return {}
    exprs = exprs or {c: _text(df, c) for c in {x for p in pairs for x in p}}
    out = {p: {"n": 0, "r": 0, "k": 0, "chi2": 0.0, "p": 1.0, "v": 0.0, "v_plain": 0.0} for p in pairs}
    for pair, n, r, k, chi2 in chi_square(contingencies(df, pairs, exprs)).collect():
        d = out[pairs[pair]]
        d.update(n=n, r=r, k=k)
        if r < 2 or k < 2:
            continue
        phi = max(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) if n > 1 else 0.0
        rc, kc = (r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)) if n > 1 else (1, 1)
        room = min(rc - 1, kc - 1)
        d.update(chi2=chi2, p=S.chi2_sf(chi2, (r - 1) * (k - 1)), v=math.sqrt(phi / room) if room > 0 else 0.0,
                 v_plain=math.sqrt(chi2 / n / (min(r, k) - 1)))
    return out


def chi_square_table(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    rows = [{"column_a": a, "column_b": b, "n": d["n"], "chi2": d["chi2"], "p_value": d["p"], "cramers_v": d["v"],
             "cramers_v_plain": d["v_plain"]} for (a, b), d in cramers(df, pairs).items()]
    return small_table(df.sparkSession, rows, "column_a string, column_b string, n long, chi2 double, p_value double, cramers_v double, cramers_v_plain double")


def cramers_matrix(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None, max_values: int | None = None) -> DataFrame:
    """Plain V between categorical columns of two values or more; limits only where asked for."""
    cols = C.categorical(df) if cols is None else cols
    u = distinct_counts(df, cols)
    cols = [c for c in cols if u[c] >= 2 and (max_values is None or u[c] <= max_values)][:max_cols]
    found = cramers(df, list(itertools.combinations(cols, 2)))
    return small_table(df.sparkSession, [{"column_a": a, "column_b": b, "value": d["v_plain"]} for (a, b), d in found.items()],
                       "column_a string, column_b string, value double")


def eta_squared(df: DataFrame, pairs: list[tuple], exprs: dict[str, Column] | None = None) -> dict[tuple, dict]:
    """Per (category, value) pair: n, groups and the share of the variation the groups explain."""
    if not pairs:
        return {}
    cats = exprs or {c: _text(df, c) for c, _ in pairs}
    cells = F.array(*[F.struct(F.lit(i).alias("pair"), cats[g].alias("g"), C.as_numeric(df, v).alias("v")) for i, (g, v) in enumerate(pairs)])
    long = df.select(F.explode(cells).alias("x")).select("x.*").filter("g is not null and v is not null")
    groups = stored(long.groupBy("pair", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")), "groups")
    means = groups.groupBy("pair").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    rows = groups.join(F.broadcast(means), "pair").groupBy("pair").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("s")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("mm")) ** 2).alias("between")).collect()
    out = {p: {"n": 0, "groups": 0, "eta2": 0.0} for p in pairs}
    for r in rows:
        total = r["within"] + r["between"]
        ok = r["k"] >= 2 and r["n"] >= 3 and total > 0
        out[pairs[r["pair"]]] = {"n": r["n"], "groups": r["k"], "eta2": max(0.0, 1 - r["within"] / total) if ok else 0.0}
    return out


def eta_table(df: DataFrame, pairs: list[tuple]) -> DataFrame:
    rows = [{"category": g, "value": v, "n": d["n"], "eta_squared": d["eta2"], "eta": math.sqrt(d["eta2"])}
            for (g, v), d in eta_squared(df, pairs).items()]
    return small_table(df.sparkSession, rows, "category string, value string, n long, eta_squared double, eta double")


def kruskal(df: DataFrame, pairs: dict) -> dict:
    """{name: Kruskal-Wallis H with tie correction, its p, n and groups} of the (group, value) expressions under each name,
    over groups of at least two rows. All pairs share one table of cells and one rank table."""
    names = list(pairs)
    if not names:
        return {}
    whole = stored(df.select(*[g.cast("string").alias(f"g{i}") for i, (g, _) in enumerate(pairs.values())], *[v.alias(f"v{i}") for i, (_, v) in enumerate(pairs.values())]), "groups")
    numbers = Numbers(whole, [F.when(F.col(f"g{i}").isNotNull(), F.col(f"v{i}")) for i in range(len(names))], [F.col(f"g{i}") for i in range(len(names))])
    own = F.coalesce(*[F.when(F.col("k") == i, F.col(f"g{i}")) for i in range(len(names))])
    cells = numbers.rows().groupBy("k", own.alias("g"), "key").agg(F.count(F.lit(1)).alias("n"))
    big = cells.groupBy("k", "g").agg(F.sum("n").alias("ng")).filter("ng > 1")
    cells = stored(cells.join(big, ["k", "g"]), "cells")
    values = cells.groupBy("k", "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    before = stored(totals_before(values, ["n"]), "ranked")
    ties = {r["k"]: (r["n"], r["t"]) for r in before.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t")).collect()}
    rank = before.select("k", "key", "groups", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))
    per = join_often(cells, rank, ["k", "key"], "groups", cells.count()).groupBy("k", "g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    sums = {r["k"]: (r["groups"], r["s"]) for r in per.groupBy("k").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).collect()}
    out = {}
    for i, name in enumerate(names):
        (n, t), (k, s) = ties.get(i, (0, 0.0)), sums.get(i, (0, 0.0))
        fix = 1 - t / (float(n) ** 3 - n) if k >= 2 and n >= 3 else 0
        h = (12.0 / (float(n) * (n + 1)) * s - 3 * (n + 1)) / fix if fix else None
        out[name] = {"n": n, "groups": k, "h": h, "p": None if h is None else S.chi2_sf(h, k - 1)}
    return out


def nmi(df: DataFrame, pairs: list[tuple], bins: int = 10) -> dict[tuple, float | None]:
    """Mutual information over the smaller entropy, 0 to 1; None below 30 complete rows.

    Numbers with more than `bins` values are cut at their quantiles over the complete rows of the pair. Columns
    without gaps share their cut points across pairs.
    """
    if not pairs:
        return {}
    names = sorted({c for p in pairs for c in p})
    numbers = [c for c in names if C.kind(df, c) == "numeric"]
    view = {c: C.as_numeric(df, c) if c in numbers else _text(df, c) for c in names}
    r = df.agg(F.count("*").alias("rows"), *[F.count(view[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
    gappy = {c for i, c in enumerate(names) if r[f"n{i}"] < r["rows"]}
    cut: dict[tuple, list[float]] = {}
    for p in pairs:
        for c, o in (p, p[::-1]):
            if c in numbers:
                cut[(c, o if o in gappy else None)] = []
    at = {k: F.when(view[k[1]].isNotNull(), view[k[0]]) if k[1] else view[k[0]] for k in cut}
    keys = list(at)
    if keys:
        few = df.agg(*[F.approx_count_distinct(at[k]).alias(f"u{i}") for i, k in enumerate(keys)]).first()
        unsure = [k for i, k in enumerate(keys) if few[i] <= 5 * bins]
        values = [sorted(set(v)) for v in df.agg(*[F.collect_set(at[k]) for k in unsure]).first()] if unsure else []
        low = {k: v for k, v in zip(unsure, values) if len(v) <= bins}
        cut.update({k: v[:-1] for k, v in low.items()})
        binned = {str(i): at[k] for i, k in enumerate(keys) if k not in low}
        for i, q in exact_quantiles(df, binned, [j / bins for j in range(bins + 1)]).items():
            cut[keys[int(i)]] = sorted({v for v in q if v is not None})[1:-1]
    sides = [[(c, cut.get((c, o if o in gappy else None))) for c, o in (p, p[::-1])] for p in pairs]
    out = {p: None for p in pairs}
    for pair, total, ha, hb, hab in entropies(coded_cells(df, view, sides)):
        if total < 30:
            continue
        mi, least = ha + hb - hab, min(ha, hb)
        out[pairs[pair]] = min(1.0, max(0.0, mi / least)) if least > 1e-9 else 0.0
    return out


def coded_cells(df: DataFrame, view: dict[str, Column], pairs: list) -> DataFrame:
    """(pair, a, b, n) over the complete rows of each pair of sides. A side is a column of `view` and its cut points: a number
    counts by how many of them lie below it, a text (no cut points, None) as it is.

    Codes are found and counted in each Arrow batch, so the plan stays the same whatever the number of cut points and pairs.
    """
    names = list(view)
    own = [[(names.index(c), None if edges is None else np.array(edges, float)) for c, edges in sides] for sides in pairs]
    dense = {i: (len(a[1]) + 1, len(b[1]) + 1) for i, (a, b) in enumerate(own) if a[1] is not None and b[1] is not None}

    def codes(c: pa.Array, edges: np.ndarray | None) -> tuple[np.ndarray, int, pa.Array | None]:
        if edges is not None:
            return np.searchsorted(edges, c.fill_null(0.0).to_numpy(zero_copy_only=False)), len(edges) + 1, None
        d = c.dictionary_encode()
        return d.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), len(d.dictionary), d.dictionary

    def labels(code: np.ndarray, texts: pa.Array | None) -> pa.Array:
        return (pa.array(code) if texts is None else texts.take(pa.array(code))).cast(pa.string())

    def rows(pair: int, cell: np.ndarray, n: np.ndarray, width: int, texts: tuple) -> pa.RecordBatch:
        a, b = labels(cell // width, texts[0]), labels(cell % width, texts[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), pair, np.int32)), a, b, pa.array(n.astype(np.int64))], ["pair", "a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(h * w, np.int64) for i, (h, w) in dense.items()}
        for batch in batches:
            here = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
            for i, ((x, ex), (y, ey)) in enumerate(own):
                (a, height, ta), (b, width, tb) = codes(batch.column(x), ex), codes(batch.column(y), ey)
                cell = (a * width + b)[here[x] & here[y]]
                if i in dense:
                    totals[i] += np.bincount(cell, minlength=height * width)
                elif len(cell):
                    yield rows(i, *np.unique(cell, return_counts=True), width, (ta, tb))
        for i, n in totals.items():
            cell = np.flatnonzero(n)
            yield rows(i, cell, n[cell], dense[i][1], (None, None))

    wide = df.select(*[view[c].alias(f"c{i}") for i, c in enumerate(names)])
    return wide.mapInArrow(count, "pair int, a string, b string, n long").groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))


def entropies(cells: DataFrame) -> list[tuple]:
    """(pair, n, entropy of a, of b, of both) from (pair, a, b, n): log n less the mean of log n over the rows of each level."""
    cells, margins = cell_cube(cells)
    levels = margins.select("pair", "n", "level").unionByName(cells.select("pair", "n", F.lit(0).cast("long").alias("level")))
    weighed = F.col("n") * F.log("n")
    sums = levels.groupBy("pair").agg(F.max("n").alias("total"), *[F.sum(F.when(F.col("level") == i, weighed)).alias(f"s{i}") for i in (0, 1, 2)])
    return [(r["pair"], r["total"], *(max(0.0, math.log(r["total"]) - r[f"s{i}"] / r["total"]) for i in (1, 2, 0))) for r in sums.collect()]


def nmi_table(df: DataFrame, pairs: list[tuple], bins: int = 10) -> DataFrame:
    return small_table(df.sparkSession, [{"column_a": a, "column_b": b, "nmi": v} for (a, b), v in nmi(df, pairs, bins).items()],
                       "column_a string, column_b string, nmi double")


def mixed_associations(df: DataFrame, num: list[str], cat: list[str], max_cols: int | None = None, max_values: int | None = None) -> DataFrame:
    """(column_a, column_b, value 0 to 1, measure): |Spearman|, Cramer's V or eta, whichever fits the pair."""
    u = distinct_counts(df, cat)
    num = C.most_filled(df, num, max_cols and (max_cols + 1) // 2)
    cat = C.most_filled(df, [c for c in cat if max_values is None or u[c] <= max_values], max_cols and max_cols // 2)
    rows = []
    numeric_pairs = list(itertools.combinations(num, 2))
    if numeric_pairs:
        r = df.agg(F.count("*"), *[F.count(C.as_numeric(df, c)) for c in num]).first()
        gappy = {c for c, n in zip(num, r[1:]) if n < r[0]}
        plain = [p for p in numeric_pairs if not gappy & set(p)]
        found = spearman_pairs(df, [c for c in num if c not in gappy], plain) if plain else {}
        found |= spearman_complete(df, {p: tuple(C.exact_numeric(df, c) for c in p) for p in numeric_pairs if p not in plain})
        for a, b in numeric_pairs:
            v = found[(a, b)][0]
            rows.append({"column_a": a, "column_b": b, "value": abs(v or 0.0), "measure": "spearman"})
    rows += [{"column_a": a, "column_b": b, "value": d["v"], "measure": "cramers_v"}
             for (a, b), d in cramers(df, list(itertools.combinations(cat, 2))).items()]
    rows += [{"column_a": v, "column_b": g, "value": math.sqrt(d["eta2"]), "measure": "eta"}
             for (g, v), d in eta_squared(df, [(g, v) for v in num for g in cat]).items()]
    return small_table(df.sparkSession, rows, "column_a string, column_b string, value double, measure string")


def top_pairs(pairs: DataFrame, value: str = "value", top: int = 15, at_least: float = 0.0) -> DataFrame:
    """The strongest pairs first."""
    return pairs.filter(F.abs(value) >= at_least).orderBy(F.desc(F.abs(value)), "column_a", "column_b").limit(top)


def with_strength(pairs: DataFrame, value: str) -> DataFrame:
    return pairs.withColumn("strength", N.strength_word(F.col(value)))


def nonlinear_candidates(df: DataFrame, num: list[str], max_cols: int | None = None, min_nmi: float = 0.15, max_pearson: float = 0.3) -> DataFrame:
    """Pairs with high mutual information and low Pearson correlation."""
    cols = C.most_filled(df, num, max_cols)
    pairs = list(itertools.combinations(cols, 2))
    r, m = pair_corr(df, {c: C.as_numeric(df, c) for c in cols}, pairs), nmi(df, pairs)
    rows = [{"column_a": a, "column_b": b, "pearson": r[(a, b)][0], "nmi": m[(a, b)]} for a, b in pairs
            if m[(a, b)] is not None and m[(a, b)] >= min_nmi and (r[(a, b)][0] is None or abs(r[(a, b)][0]) < max_pearson)]
    return small_table(df.sparkSession, rows, "column_a string, column_b string, pearson double, nmi double").orderBy(F.desc("nmi"))


def correlation_matrix(df: DataFrame, exprs: dict[str, Column]) -> np.ndarray:
    k, names = len(exprs), list(exprs)
    m = np.eye(k)
    for (a, b), (r, _) in pair_corr(df, exprs).items():
        i, j = names.index(a), names.index(b)
        m[i, j] = m[j, i] = np.nan if r is None else r
    return m


def vif_table(df: DataFrame, num: list[str], max_cols: int | None = None) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix over complete rows."""
    cols = C.most_filled(df, num, max_cols)
    exprs = {c: C.as_numeric(df, c) for c in cols}
    whole = df.select(*[exprs[c].alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    schema = "column string, vif double"
    if len(cols) < 2 or whole.count() <= len(cols) + 1:
        return small_table(df.sparkSession, [], schema)
    m = correlation_matrix(whole, {f"c{i}": F.col(f"c{i}") for i in range(len(cols))})
    if np.isnan(m).any():
        return small_table(df.sparkSession, [], schema)
    values, vectors = np.linalg.eigh(m)
    null = values < len(cols) * 1e-10
    v = (vectors[:, ~null] ** 2 / values[~null]).sum(1)
    # a column that takes part in an exact linear dependence is fully predicted by the others
    v = np.where((vectors[:, null] ** 2).sum(1) > 1e-9, np.inf, v)
    return small_table(df.sparkSession, [{"column": c, "vif": float(x)} for c, x in zip(cols, v)], schema).orderBy(F.desc("vif"))


def pca(df: DataFrame, cols: list[str]) -> dict:
    """Principal components of the standardised, median-filled columns.

    The matrix is k x k from one aggregation and solved on the driver; scores are a projection of the table.
    Each component is turned so that its largest loading is positive.
    """
    exprs = {c: C.as_numeric(df, c) for c in cols}
    medians = {c: q[0] for c, q in exact_quantiles(df, exprs, [0.5]).items()}
    filled = {c: F.coalesce(exprs[c], F.lit(medians[c])) for c in cols if medians[c] is not None}
    m = spread_about(df, filled, medians)
    cols = [c for c in filled if m[c][1]]
    if len(cols) < 2:
        return {"columns": cols, "explained": [], "loadings": None, "scores": None, "components_90": 0}
    values, vectors = np.linalg.eigh(correlation_matrix(df, {c: filled[c] for c in cols}))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    for j in range(len(cols)):
        vectors[:, j] *= 1 if vectors[np.argmax(np.abs(vectors[:, j])), j] >= 0 else -1
    share = values / values.sum()
    z = [(filled[c] - medians[c] - m[c][0]) / m[c][1] for c in cols]
    scores = [sum((z[i] * float(vectors[i, j]) for i in range(1, len(cols))), z[0] * float(vectors[0, j])).alias(f"pc{j + 1}") for j in (0, 1)]
    return {"columns": cols, "explained": (share * 100).tolist(), "loadings": vectors[:, :2],
            "scores": df.select("*", *scores), "components_90": int(np.searchsorted(np.cumsum(share), 0.9 - 1e-12) + 1)}


def pca_table(df: DataFrame, cols: list[str], found: dict | None = None) -> DataFrame:
    e = (found or pca(df, cols))["explained"]
    rows = [{"component": i + 1, "explained_pct": x, "cumulative_pct": sum(e[: i + 1])} for i, x in enumerate(e)]
    return small_table(df.sparkSession, rows, "component long, explained_pct double, cumulative_pct double")


def pca_loadings(df: DataFrame, cols: list[str]) -> DataFrame:
    """The ten columns that weigh most in the first component."""
    p = pca(df, cols)
    rows = [{"column": c, "pc1": float(a), "pc2": float(b)} for c, (a, b) in zip(p["columns"], p["loadings"])]
    rows.sort(key=lambda r: -abs(r["pc1"]))
    return small_table(df.sparkSession, rows, "column string, pc1 double, pc2 double")


def target_screen(df: DataFrame, target: str) -> DataFrame:
    """Quick strength of every column against the target: |Pearson|, correlation ratio or plain V."""
    cols = [c for c in df.columns if c != target and C.kind(df, c) != "nested"]
    num = [c for c in cols if C.kind(df, c) == "numeric"]
    other = [c for c in cols if c not in num]
    rows = []

    def add(c, value, measure, n):
        if n >= 5:
            rows.append({"column": c, "strength": 0.0 if value is None or value != value else value, "measure": measure})

    if C.kind(df, target) == "numeric":
        found = pair_corr(df, {c: C.as_numeric(df, c) for c in [*num, target]}, [(c, target) for c in num])
        for (c, _), (r, n) in found.items():
            add(c, None if r is None else abs(r), "pearson", n)
        for (g, _), d in eta_squared(df, [(c, target) for c in other]).items():
            add(g, math.sqrt(d["eta2"]), "correlation ratio", d["n"])
    else:
        for (_, v), d in eta_squared(df, [(target, c) for c in num]).items():
            add(v, math.sqrt(d["eta2"]), "correlation ratio", d["n"])
        for (c, _), d in cramers(df, [(c, target) for c in other]).items():
            add(c, d["v_plain"], "cramers_v", d["n"])
    return small_table(df.sparkSession, rows, "column string, strength double, measure string").orderBy(F.desc("strength"), "column")


def class_shares(df: DataFrame, feature: str, target: str, top: int = 15) -> DataFrame:
    """(feature, class, n, share): class mix within the most frequent categories."""
    cells = contingency(df, feature, target)
    size = cells.groupBy("a").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "a").limit(top)
    return cells.join(F.broadcast(size), "a").select(F.col("a").alias("feature"), F.col("b").alias("class"), "n", (F.col("n") / F.col("total")).alias("share"))


def five_numbers(df: DataFrame, group: str, value: str, groups: int = 15) -> DataFrame:
    """Minimum, quartiles and maximum of a value within the most frequent groups."""
    g, v = _text(df, group), C.as_numeric(df, value)
    d = df.select(g.alias("g"), v.alias("v")).filter("g is not null and v is not null")
    top = [r["g"] for r in d.groupBy("g").count().orderBy(F.desc("count"), "g").limit(groups).collect()]
    q = exact_quantiles(d, {x: F.when(F.col("g") == x, F.col("v")) for x in top}, [0.0, 0.25, 0.5, 0.75, 1.0])
    rows = [{"group": x, "low": q[x][0], "q1": q[x][1], "median": q[x][2], "q3": q[x][3], "high": q[x][4]} for x in top]
    return small_table(df.sparkSession, rows, "group string, low double, q1 double, median double, q3 double, high double")


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.select(C.as_numeric(df, x).alias("x"), C.as_numeric(df, y).alias("y"))
    return d.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_count("y", "x").alias("n"))
