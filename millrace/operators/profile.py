"""Univariate profiles. Each pass over the table is one aggregation for all columns together."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numeric as N
from millrace.functions import significance as S
from millrace.operators import columns as C
from millrace.operators.counts import distinct_counts, value_counts
from millrace.operators.quantiles import exact_quantiles, folded


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A report of a few rows (bounded by columns or pairs of columns) as a DataFrame."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def _plain(v):
    if v is None:
        return None
    v = float(v)
    return None if math.isnan(v) else v


def moments(df: DataFrame, exprs: dict[str, Column]) -> dict[str, dict]:
    """n, mean, std, var, min, max, adjusted skew and kurtosis, zeros and negatives, all in one pass.

    The columns are folded to (column number, value) first: one small set of aggregate buffers per column instead of
    one very wide one, so generated code stays compact for any number of columns.
    """
    if not exprs:
        return {}
    v = F.col("v")
    found = {r["k"]: r for r in folded(df, exprs, nulls=True).groupBy("k").agg(
        F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.count(F.when(v == 0, 1)).alias("zeros"),
        F.count(F.when(v < 0, 1)).alias("negatives")).collect()}
    out = {}
    for i, k in enumerate(exprs):
        r = found[i].asDict() if i in found else {"rows": 0, "n": 0, "zeros": 0, "negatives": 0}
        n, g1, g2 = r["n"], _plain(r.get("g1")), _plain(r.get("g2"))
        d = {"rows": r["rows"], "n": n, "zeros": r["zeros"], "negatives": r["negatives"], "g1": g1, "g2": g2,
             **{m: _plain(r.get(m)) for m in ("mean", "std", "min", "max")}}
        d["var"] = None if d["std"] is None else d["std"] ** 2
        d["skew"] = None if n < 3 else (g1 or 0.0) * math.sqrt(n * (n - 1)) / (n - 2)
        d["kurt"] = None if n < 4 else 0.0 if g2 is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        out[k] = d
    return out


def spread_about(df: DataFrame, exprs: dict[str, Column], centre: dict[str, float]) -> dict[str, tuple]:
    """{name: (mean less the centre, standard deviation or None)} of expressions without gaps, for scores of single rows.

    A running sum over millions of rows loses digits that rounded scores still show. Distances from a value among the
    rows (the median lies within one deviation of the mean) are summed pairwise, within Arrow batches and over them.
    """
    if not exprs:
        return {}
    far = df.select(*[(x.cast("double") - F.lit(centre[c])).alias(f"c{i}") for i, (c, x) in enumerate(exprs.items())])
    k = len(exprs)

    def partial(batches):
        n, sums = 0, [[] for _ in range(2 * k)]
        for b in batches:
            n += b.num_rows
            for i, c in enumerate(b.columns):
                d = c.to_numpy(zero_copy_only=False)
                sums[i].append(float(d.sum()))
                sums[k + i].append(float((d * d).sum()))
        s = [float(np.sum(x)) for x in sums]
        yield pa.RecordBatch.from_pydict({"i": list(range(k)), "n": [n] * k, "s": s[:k], "s2": s[k:]})

    found = far.mapInArrow(partial, "i long, n long, s double, s2 double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2")).collect()
    names, out = list(exprs), {c: (None, None) for c in exprs}
    for r in found:
        n = r["n"]
        if n:
            off = r["s"] / n
            out[names[r["i"]]] = (off, math.sqrt(max(0.0, r["s2"] - r["s"] * off) / (n - 1)) if n > 1 else None)
    return out


def fences(df: DataFrame, exprs: dict[str, Column]) -> dict[str, dict]:
    """Quartiles and the 1.5 IQR bounds per column."""
    out = {}
    for k, (q1, q2, q3) in exact_quantiles(df, exprs, [0.25, 0.5, 0.75]).items():
        if q1 is None:
            out[k] = {"q1": None, "median": None, "q3": None, "iqr": None, "low": None, "high": None}
        else:
            iqr = q3 - q1
            out[k] = {"q1": q1, "median": q2, "q3": q3, "iqr": iqr, "low": q1 - 1.5 * iqr, "high": q3 + 1.5 * iqr}
    return out


def count_outside(df: DataFrame, exprs: dict[str, Column], bounds: dict[str, tuple]) -> tuple[dict, int]:
    """Values outside their bounds per column, and rows with at least one, in one pass."""
    if not bounds:
        return {}, 0
    names = list(bounds)
    outside = {k: F.coalesce((exprs[k] < bounds[k][0]) | (exprs[k] > bounds[k][1]), F.lit(False)) for k in names}
    anyone = outside[names[0]]
    for k in names[1:]:
        anyone = anyone | outside[k]
    r = df.agg(*[F.count(F.when(outside[k], 1)).alias(f"o{i}") for i, k in enumerate(names)],
               F.count(F.when(anyone, 1)).alias("rows")).first()
    return {k: r[f"o{i}"] for i, k in enumerate(names)}, r["rows"]


def moments_count(df: DataFrame, exprs: dict[str, Column]) -> dict[str, int]:
    if not exprs:
        return {}
    r = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(exprs.values())]).first()
    return {k: r[i] for i, k in enumerate(exprs)}


def shapes(df: DataFrame, exprs: dict[str, Column], rows: int | None = None) -> dict[str, dict]:
    """Per column: n, different values (of the stored type where the name is a column), quartiles, the 1.5 IQR bounds and
    the values outside them; a pass per measure for all columns."""
    if not exprs:
        return {}
    f, n = fences(df, {c: stored_values(df, c, x) for c, x in exprs.items()}), moments_count(df, exprs)
    u = distinct_counts(df, {c: stored_values(df, c, x) for c, x in exprs.items()})
    out, _ = count_outside(df, exprs, {c: (f[c]["low"], f[c]["high"]) for c in exprs if f[c]["iqr"]})
    return {c: {**f[c], "n": n[c], "unique": u[c], "outliers": out.get(c, 0)} for c in exprs}


def stored_values(df: DataFrame, name: str, view: Column) -> Column:
    """The column in its own type where its numeric view has a value: 64-bit and decimal values that a double cannot
    tell apart stay different. Text and derived expressions keep the view."""
    plain = name in df.columns and isinstance(df.schema[name].dataType, (T.IntegralType, T.DecimalType))
    return F.when(view.isNotNull(), C.col(name)) if plain else view


def iqr_outliers(df: DataFrame, cols: list[str], at_least: int = 4, rows: int | None = None) -> dict[str, dict]:
    """Per column: fences, n and outliers; columns with too few values or no spread count none."""
    out = {}
    for c, s in shapes(df, {c: C.as_numeric(df, c) for c in cols}, rows).items():
        checked = s["n"] >= at_least and bool(s["iqr"]) and s["iqr"] > 0
        out[c] = {**s, "checked": checked, "outliers": s["outliers"] if checked else 0}
    return out


NUMERIC_PROFILE = ("column string, count long, missing_pct double, unique long, mean double, median double, std double, "
                   "variance double, min double, q1 double, q3 double, max double, iqr double, skew double, "
                   "kurtosis double, outliers long, outliers_pct double, zeros_pct double, normality_p double, shape string")


def numeric_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column with counts, moments, quartiles, IQR outliers and a normality verdict."""
    cols = C.numeric(df) if cols is None else cols
    exprs = {c: C.as_numeric(df, c) for c in cols}
    m = moments(df, exprs)
    f, rows = shapes(df, exprs, m[cols[0]]["rows"] if cols else 0), []
    for c in cols:
        s, n = m[c], m[c]["n"]
        row = {"column": c, "count": n, "missing_pct": (s["rows"] - n) / s["rows"] * 100 if s["rows"] else None,
               "unique": f[c]["unique"]}
        if n:
            row.update(mean=s["mean"], median=f[c]["median"], std=s["std"], variance=s["var"], min=s["min"],
                       q1=f[c]["q1"], q3=f[c]["q3"], max=s["max"], iqr=f[c]["iqr"], skew=s["skew"], kurtosis=s["kurt"],
                       outliers=f[c]["outliers"], outliers_pct=f[c]["outliers"] / n * 100, zeros_pct=s["zeros"] / n * 100)
            if n >= 20 and row["unique"] > 3 and s["std"]:
                p = S.dagostino_k2(n, s["g1"], s["g2"])[1]
                row.update(normality_p=p, shape="no clear departure from normal" if p > 0.05 else "not normal")
        rows.append(row)
    return small_table(df.sparkSession, rows, NUMERIC_PROFILE)


def normality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D'Agostino K2 over all rows: statistic, p and verdict for columns that qualify."""
    cols = C.numeric(df) if cols is None else cols
    exprs = {c: C.as_numeric(df, c) for c in cols}
    m, rows = moments(df, exprs), []
    few = {c for c, u in distinct_counts(df, {c: stored_values(df, c, x) for c, x in exprs.items()}).items() if u <= 3}
    for c in cols:
        if m[c]["n"] >= 20 and c not in few and m[c]["std"]:
            k2, p = S.dagostino_k2(m[c]["n"], m[c]["g1"], m[c]["g2"])
            rows.append({"column": c, "n": m[c]["n"], "k2": k2, "p_value": p,
                         "shape": "no clear departure from normal" if p > 0.05 else "not normal"})
    return small_table(df.sparkSession, rows, "column string, n long, k2 double, p_value double, shape string")


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = C.numeric(df) if cols is None else cols
    exprs = {c: C.as_numeric(df, c) for c in cols}
    m, f = moments(df, exprs), fences(df, exprs)
    rows = [{"column": c, "count": m[c]["n"], "mean": m[c]["mean"], "std": m[c]["std"], "min": m[c]["min"],
             "q25": f[c]["q1"], "q50": f[c]["median"], "q75": f[c]["q3"], "max": m[c]["max"]} for c in cols]
    return small_table(df.sparkSession, rows, "column string, count long, mean double, std double, min double, "
                                              "q25 double, q50 double, q75 double, max double")


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, unique, top and freq of text columns; equal counts resolve to the smallest text."""
    cols = C.categorical(df) if cols is None else cols
    return (value_counts(df, cols).groupBy("column")
            .agg(F.sum("n").alias("count"), F.count("*").alias("unique"),
                 F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("best"))
            .select("column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.k")).alias("freq")))


def column_preview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Type, missing share, distinct values, and the mean (numbers) or the most common value (others)."""
    cols = [c for c in (cols or df.columns) if C.kind(df, c) != "nested"]
    nums = [c for c in cols if C.kind(df, c) == "numeric"]
    r = df.agg(F.count("*").alias("rows"), *[F.sum(C.is_null(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.avg(C.as_numeric(df, c)).alias(f"a{i}") for i, c in enumerate(nums)]).first()
    means = {c: _plain(r[f"a{i}"]) for i, c in enumerate(nums)}
    best = {x["column"]: x for x in value_counts(df, cols).groupBy("column").agg(
        F.count("*").alias("u"), F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("best")).collect()}
    rows = [{"column": c, "type": C.type_name(df, c), "missing_pct": (r[f"m{i}"] or 0) / max(r["rows"], 1) * 100,
             "unique": best[c]["u"] if c in best else 0, "mean": means.get(c),
             "most_common": best[c]["best"]["value"] if c in best and c not in nums else None} for i, c in enumerate(cols)]
    return small_table(df.sparkSession, rows, "column string, type string, missing_pct double, unique long, mean double, most_common string")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed."""
    x = C.as_numeric(df, col)
    r = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).first()
    spark = df.sparkSession
    low, high = r["low"], r["high"]
    if low is None:
        return small_table(spark, [], "bin long, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    bin_no = F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counted = df.select(bin_no.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return (spark.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left")
            .select("bin", (F.lit(low) + F.col("bin") * width).alias("low"),
                    (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n")))


def outlier_table(df: DataFrame, cols: list[str] | None = None, method: str = "IQR") -> tuple[DataFrame, int]:
    """Outliers by IQR fences, three standard deviations, or 3.5 robust deviations; also rows with any."""
    cols = C.numeric(df) if cols is None else cols
    exprs = {c: C.as_numeric(df, c) for c in cols}
    m = moments(df, exprs)
    cols = [c for c in cols if m[c]["n"] >= 4]
    exprs = {c: exprs[c] for c in cols}
    if method.startswith("IQR"):
        bounds = {c: (b["low"], b["high"]) for c, b in fences(df, exprs).items()}
    elif method.startswith("Z"):
        bounds = {c: (m[c]["mean"] - 3 * m[c]["std"], m[c]["mean"] + 3 * m[c]["std"]) for c in cols}
    else:
        mid = {c: q[0] for c, q in exact_quantiles(df, exprs, [0.5]).items()}
        mad = {c: q[0] for c, q in exact_quantiles(df, {c: F.abs(exprs[c] - mid[c]) for c in cols}, [0.5]).items()}
        bounds = {c: (mid[c] - 3.5 * mad[c] / 0.6745, mid[c] + 3.5 * mad[c] / 0.6745) for c in cols}
    found, with_any = count_outside(df, exprs, bounds)
    rows = [{"column": c, "outliers": found[c], "outliers_pct": found[c] / m[c]["n"] * 100,
             "lower_bound": bounds[c][0], "upper_bound": bounds[c][1]} for c in cols]
    return small_table(df.sparkSession, rows, "column string, outliers long, outliers_pct double, lower_bound double, upper_bound double"), with_any


def duplicate_rows(df: DataFrame) -> int:
    """Rows that repeat an earlier row: all rows minus the different ones.

    Rows are compared by two independent 64-bit hashes with null flags, so the shuffle carries 16 bytes a row
    instead of the row, and copies are merged before it.
    """
    r = df.groupBy(*row_hash(df)).count().agg(F.sum("count").alias("rows"), F.count("*").alias("different")).first()
    return (r["rows"] or 0) - r["different"]


def row_hash(df: DataFrame, cols: list[str] | None = None) -> list[Column]:
    """128 bits that identify the row content; null flags keep (1, NULL) and (NULL, 1) apart."""
    cols = cols or df.columns
    flags = F.concat(*[F.when(C.col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(flags, *[C.col(c) for c in cols]).alias("h1"),
            F.xxhash64(F.lit("second"), *[C.col(c) for c in reversed(cols)], flags).alias("h2")]


def row_gaps(df: DataFrame) -> DataFrame:
    """Share of rows with any gap, rows missing more than half their cells, complete rows."""
    gaps = sum((C.is_null(df, c).cast("int") for c in df.columns[1:]), C.is_null(df, df.columns[0]).cast("int"))
    return df.select(gaps.alias("g")).agg(
        F.count("*").alias("rows"), (F.avg((F.col("g") > 0).cast("double")) * 100).alias("rows_with_gap_pct"),
        F.count(F.when(F.col("g") > len(df.columns) / 2, 1)).alias("rows_over_half_missing"),
        F.count(F.when(F.col("g") == 0, 1)).alias("complete_rows"))


def health(df: DataFrame) -> dict:
    """Headline facts of a table: size, gaps, copies, constants, outliers, text columns, high cardinality."""
    cols = [c for c in df.columns if C.kind(df, c) != "nested"]
    nums, cats = C.numeric(df), C.categorical(df)
    r = df.agg(F.count("*").alias("rows"), *[F.sum(C.is_null(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    rows = r["rows"]
    missing = {c: r[f"m{i}"] or 0 for i, c in enumerate(cols)}
    unique = distinct_counts(df, cols)
    outliers = iqr_outliers(df, nums, rows=rows)
    total = sum(o["outliers"] for o in outliers.values())
    return {"rows": rows, "columns": len(df.columns), "missing_cells": sum(missing.values()),
            "missing_pct": sum(missing.values()) / max(rows * len(df.columns), 1) * 100,
            "duplicates": duplicate_rows(df), "constant": sum(unique[c] <= 1 for c in cols), "outliers": total,
            "outliers_ok": total <= 0.01 * max(rows * len(nums), 1), "unencoded": len(cats),
            "high_cardinality": sum(unique[c] > 20 and unique[c] / max(rows, 1) > 0.5 for c in cats),
            "numeric_columns": len(nums), "categorical_columns": len(cats),
            "missing": missing, "unique": unique, "outlier_detail": outliers}


def health_table(df: DataFrame) -> DataFrame:
    h = health(df)
    keys = ["rows", "columns", "missing_cells", "duplicates", "constant", "outliers", "unencoded", "high_cardinality",
            "numeric_columns", "categorical_columns"]
    return small_table(df.sparkSession, [{"metric": k, "value": float(h[k])} for k in keys], "metric string, value double")


def file_summary(df: DataFrame) -> DataFrame:
    """Type, extremes, approximate distinct count, mean, std, quartiles, count and gaps per column."""
    cols = [c for c in df.columns if C.kind(df, c) != "nested"]
    nums = [c for c in cols if C.kind(df, c) == "numeric"]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        aggs += [F.min(C.col(c)).cast("string").alias(f"lo{i}"), F.max(C.col(c)).cast("string").alias(f"hi{i}"),
                 F.approx_count_distinct(C.col(c)).alias(f"u{i}"), F.sum(C.is_null(df, c).cast("long")).alias(f"m{i}")]
    r = df.agg(*aggs).first()
    exprs = {c: C.as_numeric(df, c) for c in nums}
    m, f = moments(df, exprs), fences(df, exprs)
    rows = []
    for i, c in enumerate(cols):
        row = {"column": c, "type": C.type_name(df, c), "min": r[f"lo{i}"], "max": r[f"hi{i}"], "approx_unique": r[f"u{i}"],
               "count": r["rows"], "null_pct": (r[f"m{i}"] or 0) / max(r["rows"], 1) * 100}
        if c in m:
            row.update(avg=m[c]["mean"], std=m[c]["std"], q25=f[c]["q1"], q50=f[c]["median"], q75=f[c]["q3"])
        rows.append(row)
    return small_table(df.sparkSession, rows, "column string, type string, min string, max string, approx_unique long, "
                                              "avg double, std double, q25 double, q50 double, q75 double, count long, null_pct double")


def compare_numeric(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean, std and missing of the numeric columns two tables share."""
    shared = [c for c in C.numeric(after) if c in C.numeric(before)]
    a = moments(before, {c: C.as_numeric(before, c) for c in shared})
    b = moments(after, {c: C.as_numeric(after, c) for c in shared})
    rows = [{"column": c, "mean_before": a[c]["mean"], "mean_after": b[c]["mean"], "std_before": a[c]["std"],
             "std_after": b[c]["std"], "missing_before": a[c]["rows"] - a[c]["n"], "missing_after": b[c]["rows"] - b[c]["n"]}
            for c in shared]
    return small_table(before.sparkSession, rows, "column string, mean_before double, mean_after double, std_before double, "
                                                  "std_after double, missing_before long, missing_after long")
