"""Analysis that fits the target: classes, a number, a series, or none. Everything runs over all rows."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import significance as S
from millrace.operators import association as A
from millrace.operators import columns as C
from millrace.operators import timeline as TL
from millrace.operators.correlation import pair_corr, spearman_complete, spearman_pairs
from millrace.operators.counts import distinct_counts, value_counts
from millrace.operators.drift import psi_from_counts
from millrace.operators.profile import count_outside, fences, moments, small_table
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.sampling import robust_extremes, sample_rows

FEATURES = ("feature string, type string, measure string, strength double, pearson double, spearman double, nmi double, p_value double, "
            "rows_used long, reliable boolean")


def guess_kind(df: DataFrame, target: str | None) -> str:
    if target not in df.columns:
        return "Unsupervised"
    if C.kind(df, target) not in ("numeric", "boolean"):
        return "Classification"
    few = df.filter(~C.is_null(df, target)).select(C.col(target)).distinct().limit(16).count() <= 15
    return "Classification" if few else "Regression"


def _finished(df: DataFrame, rows: list[dict]) -> DataFrame:
    total = df.count()
    for r in rows:
        r["reliable"] = r["rows_used"] >= 30 and r["rows_used"] >= 0.05 * total
    rows.sort(key=lambda r: (-r["reliable"], -(r["strength"] or 0.0)))
    return small_table(df.sparkSession, rows, FEATURES)


def within_limit(df: DataFrame, cat: list[str], max_values: int | None) -> tuple[list[str], dict[str, int]]:
    """The categorical features that a caller's limit on distinct values leaves in, and those it leaves out with their values."""
    if max_values is None:
        return cat, {}
    u = distinct_counts(df, cat)
    return [c for c in cat if u[c] <= max_values], {c: u[c] for c in cat if u[c] > max_values}


def class_features(df: DataFrame, target: str, num: list[str], cat: list[str]) -> DataFrame:
    """Strength of every feature against a target with classes: eta with Kruskal p, or V with chi-square p, and NMI."""
    label = df.withColumn("_label", F.when(~C.is_null(df, target), C.col(target).cast("string")))
    eta = A.eta_squared(label, [("_label", c) for c in num])
    v = A.cramers(label, [(c, "_label") for c in cat])
    mutual = A.nmi(label, [(c, "_label") for c in num + cat])
    rows = []
    varies = _varies(label, num, F.col("_label").isNotNull())
    ranked = A.kruskal(label, {c: (F.col("_label"), C.exact_numeric(label, c)) for c in num if c in varies})
    for c in num:
        e = eta[("_label", c)]
        if e["groups"] >= 2 and c in varies:
            rows.append({"feature": c, "type": "numeric", "measure": "eta", "strength": math.sqrt(e["eta2"]), "nmi": mutual[(c, "_label")],
                         "p_value": ranked[c]["p"], "rows_used": e["n"]})
    for c in cat:
        d = v[(c, "_label")]
        if d["r"] >= 2 and d["k"] >= 2:
            rows.append({"feature": c, "type": "categorical", "measure": "cramers_v", "strength": d["v"], "nmi": mutual[(c, "_label")],
                         "p_value": d["p"], "rows_used": d["n"]})
    return _finished(df, rows)


def _varies(df: DataFrame, cols: list[str], where) -> set:
    if not cols:
        return set()
    x = {c: F.when(where, C.as_numeric(df, c)) for c in cols}
    r = df.agg(*[(F.min(x[c]) < F.max(x[c])) for c in cols]).first()
    return {c for c, ok in zip(cols, r) if ok}


def number_features(df: DataFrame, target: str, num: list[str], cat: list[str]) -> DataFrame:
    """Strength against a numeric target: Pearson and Spearman, or eta with Kruskal p, and NMI."""
    y = C.as_numeric(df, target)
    varies = _varies(df, num, y.isNotNull())
    num = [c for c in num if c in varies]
    exprs = {c: C.as_numeric(df, c) for c in [*num, target]}
    pearson = pair_corr(df, exprs, [(c, target) for c in num])
    r = df.agg(F.count("*"), *[F.count(exprs[c]) for c in [*num, target]]).first()
    whole = {c for c, n in zip([*num, target], r[1:]) if n == r[0]}
    share = [c for c in num if {c, target} <= whole]
    ranks = spearman_pairs(df, [*share, target], [(c, target) for c in share]) if share else {}
    eta = A.eta_squared(df, [(c, target) for c in cat])
    mutual = A.nmi(df, [(c, target) for c in num + cat])
    ranks |= spearman_complete(df, {(c, target): (C.exact_numeric(df, c), C.exact_numeric(df, target)) for c in num if c not in share})
    groups = A.kruskal(df, {c: (C.col(c), C.exact_numeric(df, target)) for c in cat})
    rows = []
    for c in num:
        p, n = pearson[(c, target)]
        if n < 10:
            continue
        s = ranks[(c, target)][0]
        rows.append({"feature": c, "type": "numeric", "measure": "correlation", "pearson": p, "spearman": s, "nmi": mutual[(c, target)],
                     "strength": max(abs(p or 0.0), abs(s or 0.0)), "p_value": S.correlation_p(s, n) if s is not None else None, "rows_used": n})
    for c in cat:
        e = eta[(c, target)]
        if e["groups"] >= 2:
            rows.append({"feature": c, "type": "categorical", "measure": "eta", "strength": math.sqrt(e["eta2"]), "nmi": mutual[(c, target)],
                         "p_value": groups[c]["p"], "rows_used": e["n"]})
    return _finished(df, rows)


def flag_table(spark, flags: list[tuple]) -> DataFrame:
    return small_table(spark, [{"level": a, "flag": b, "item": c, "value": float(v)} for a, b, c, v in flags], "level string, flag string, item string, value double")


def split_shares(splits: dict[str, DataFrame], target: str) -> DataFrame:
    """Class share in percent per split, a class absent from a split counting 0."""
    parts = [d.select(F.lit(k).alias("part"), C.col(target).cast("string").alias("class")).filter("class is not null") for k, d in splits.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    n = both.groupBy("part", "class").agg(F.count("*").alias("n"))
    total = n.groupBy("part").agg(F.sum("n").alias("t"))
    return (n.join(F.broadcast(total), "part").groupBy("class").pivot("part", list(splits)).agg(F.first(F.col("n") / F.col("t") * 100)).fillna(0.0))


def classification(df: DataFrame, target: str, roles: dict | None = None, splits: dict | None = None, max_values: int | None = None) -> dict:
    """Every feature whatever its number of values; what `max_values` leaves out is flagged."""
    num, cat, _ = C.by_role(df, target, roles)
    cat, left_out = within_limit(df, cat, max_values)
    vc = value_counts(df, [target])
    facts = vc.agg(F.sum("n").alias("n"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("k"), F.count(F.when(F.col("n") < 30, 1)).alias("small")).first()
    share = vc.select(F.col("value").alias("class"), F.col("n").alias("rows"), (F.col("n") / F.lit(facts["n"]) * 100).alias("share_pct")).orderBy(F.desc("rows"), "class")
    ratio = facts["hi"] / facts["lo"] if facts["k"] > 1 else math.inf
    features, flags = class_features(df, target, num, cat), [("info", "left out, many values", c, u) for c, u in left_out.items()]
    if facts["k"] < 2:
        flags.append(("error", "single class", target, facts["k"]))
    if ratio >= 3:
        flags.append(("warning", "imbalanced", target, ratio))
    if facts["small"]:
        flags.append(("warning", "small classes", target, facts["small"]))
    flags += [("info", "almost constant", c, s) for c, s in top_shares(df, num + cat).items() if s > 0.99]
    for r in features.collect():
        if not r["reliable"]:
            flags.append(("info", "unreliable", r["feature"], r["rows_used"]))
        elif r["strength"] >= 0.9:
            flags.append(("warning", "possible leakage", r["feature"], r["strength"]))
    table = None
    if splits and len(splits) >= 2:
        table = split_shares(splits, target)
        parts = [F.col(k) for k in splits]
        worst = table.agg(F.max(F.greatest(*parts) - F.least(*parts))).first()[0]
        if worst and worst > 5:
            flags.append(("warning", "class shares differ between splits", target, worst))
    return {"kind": "Classification", "distribution": share, "imbalance_ratio": ratio, "features": features, "flags": flag_table(df.sparkSession, flags), "splits": table}


def top_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Share of the most frequent value; 1.0 for a column without two values."""
    if not cols:
        return {}
    rows = value_counts(df, cols).groupBy("column").agg(F.max("n").alias("m"), F.sum("n").alias("t")).collect()
    found = {r["column"]: r["m"] / r["t"] for r in rows}
    return {c: found.get(c, 1.0) for c in cols}


def target_summary(df: DataFrame, target: str) -> DataFrame:
    x = {target: C.as_numeric(df, target)}
    m, f = moments(df, x)[target], fences(df, x)[target]
    out = count_outside(df, x, {target: (f["low"], f["high"])})[0][target] if f["iqr"] else 0
    n = max(m["n"], 1)
    return small_table(df.sparkSession, [{"rows": m["n"], "mean": m["mean"], "median": f["median"], "std": m["std"], "min": m["min"], "max": m["max"],
                                          "skew": m["skew"], "kurtosis": m["kurt"], "zeros_pct": m["zeros"] / n * 100, "negative_pct": m["negatives"] / n * 100, "outliers": out}],
                       "rows long, mean double, median double, std double, min double, max double, skew double, kurtosis double, zeros_pct double, "
                       "negative_pct double, outliers long")


def leverage(df: DataFrame, cols: list[str], keep: list[str], top: int = 10) -> DataFrame:
    """Rows whose feature combination is extreme: hat diagonal above 3 p / n.

    The p x p inverse comes from one correlation aggregation; the diagonal itself is an expression over the row.
    """
    d = df.select(*[C.col(k) for k in keep], *[C.as_numeric(df, c).alias(f"_x{i}") for i, c in enumerate(cols)]).dropna(subset=[f"_x{i}" for i in range(len(cols))])
    exprs = {f"_x{i}": F.col(f"_x{i}") for i in range(len(cols))}
    m = moments(d, exprs)
    n, live = m["_x0"]["n"], [x for x in exprs if m[x]["std"]]
    schema = d.select(*keep).withColumn("leverage", F.lit(0.0))
    if n <= len(cols) + 2 or len(live) < 2:
        return schema.limit(0)
    inv = np.linalg.pinv(A.correlation_matrix(d, {x: exprs[x] for x in live})) / (n - 1)
    z = [(F.col(x) - m[x]["mean"]) / m[x]["std"] for x in live]
    h = F.lit(1.0 / n)
    for i in range(len(live)):
        for j in range(i, len(live)):
            h = h + z[i] * z[j] * float(inv[i, j] * (1 if i == j else 2))
    limit = 3 * (len(cols) + 1) / n
    return d.select(*[C.col(k) for k in keep], h.alias("leverage")).filter(F.col("leverage") > limit).orderBy(F.desc("leverage"), *keep).limit(top)


def regression(df: DataFrame, target: str, roles: dict | None = None, key: str | None = None, max_values: int | None = None) -> dict:
    """Every feature whatever its number of values; what `max_values` leaves out is flagged."""
    num, cat, _ = C.by_role(df, target, roles)
    cat, left_out = within_limit(df, cat, max_values)
    summary, features = target_summary(df, target), number_features(df, target, num, cat)
    flags = [("info", "left out, many values", c, u) for c, u in left_out.items()]
    s = summary.first()
    if s["skew"] is not None and abs(s["skew"]) > 1:
        flags.append(("info", "skewed target", target, s["skew"]))
    if s["outliers"] / max(s["rows"], 1) > 0.05:
        flags.append(("warning", "target outliers", target, s["outliers"] / s["rows"] * 100))
    for r in features.collect():
        if not r["reliable"]:
            flags.append(("info", "unreliable", r["feature"], r["rows_used"]))
            continue
        if r["type"] == "numeric" and (r["nmi"] or 0) >= 0.15 and abs(r["pearson"] or 0) < 0.3:
            flags.append(("info", "related but not linearly", r["feature"], r["nmi"]))
        if r["pearson"] is not None and abs(r["pearson"]) >= 0.98:
            flags.append(("warning", "possible leakage", r["feature"], r["pearson"]))
    keep = [c for c in (key, target) if c]
    varied = [c for c, u in distinct_counts(df, num).items() if u > 2]
    far = leverage(df, varied, [key] if key else [target]) if len(varied) >= 2 else None
    if far is not None and not far.isEmpty():
        flags.append(("info", "high leverage rows", target, far.count()))
    return {"kind": "Regression", "summary": summary, "features": features, "flags": flag_table(df.sparkSession, flags),
            "extreme_targets": robust_extremes(df, target, keep), "high_leverage": far}


SERIES = ("rows long, first double, last double, median_step double, irregular_gaps long, duplicates long, trend double, trend_p double, "
          "half_shift_sd double, psi_halves double, seasonal_lags string")


def timeseries(df: DataFrame, target: str, time_col: str, tie: str, max_lag: int = 60) -> dict:
    """Step, gaps, trend, half-to-half shift and seasonality of a numeric series; equal times are ordered by `tie`."""
    t, y = TL.as_seconds(df, time_col), C.as_numeric(df, target)
    d = df.select(t.alias("t"), y.alias("y"), C.col(tie).alias("tie")).filter("t is not null and y is not null")
    spark = df.sparkSession
    if d.count() < 20:
        return {"kind": "Time-series forecasting", "flags": flag_table(spark, [("error", "too few dated rows", target, 20)])}
    f = TL.time_facts(d, "t", F.col("t"))
    series = TL.in_time_order(d, F.col("t"), F.col("y"), F.col("tie"))
    rho, n = spearman_complete(series, {"trend": (F.col("i"), F.col("y"))})["trend"]
    half = n // 2
    first, second = F.when(F.col("i") < half, F.col("y")), F.when(F.col("i") >= half, F.col("y"))
    m = moments(series, {"a": first, "b": second})
    shift = (m["b"]["mean"] - m["a"]["mean"]) / (m["a"]["std"] or 1)
    edges = sorted({v for v in exact_quantiles(series, {"a": first}, [i / 10 for i in range(11)])["a"] if v is not None})
    bin_no = sum((F.when(F.col("y") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts: dict = {True: {}, False: {}}
    for r in series.groupBy((F.col("i") < half).alias("early"), bin_no.alias("bin")).count().collect():
        counts[r["early"]][r["bin"]] = r["count"]
    psi = psi_from_counts(edges, counts[True], counts[False], half, n - half)
    acf = TL.autocorrelation(series, max_lag)
    seasonal = TL.seasonal_lags(acf.collect())
    p = S.correlation_p(rho, n) if rho is not None else None
    flags = []
    if f["irregular"]:
        flags.append(("warning", "irregular gaps", target, f["irregular"]))
    if f["duplicates"]:
        flags.append(("warning", "repeated timestamps", target, f["duplicates"]))
    if rho is not None and p < 0.01 and abs(rho) > 0.2:
        flags.append(("info", "trend", target, rho))
    if abs(shift) > 0.5:
        flags.append(("warning", "not stationary", target, shift))
    if psi is not None and psi > 0.25:
        flags.append(("warning", "distribution shifted", target, psi))
    row = {"rows": n, "first": f["first"], "last": f["last"], "median_step": f["median_gap"], "irregular_gaps": f["irregular"], "duplicates": f["duplicates"],
           "trend": rho, "trend_p": p, "half_shift_sd": shift, "psi_halves": psi, "seasonal_lags": ",".join(map(str, seasonal))}
    return {"kind": "Time-series forecasting", "summary": small_table(spark, [row], SERIES), "acf": acf, "seasonal_lags": seasonal,
            "flags": flag_table(spark, flags), "series": series}


def unsupervised(df: DataFrame, roles: dict | None = None) -> dict:
    num, cat, _ = C.by_role(df, None, roles)
    cols = [c for c, u in distinct_counts(df, num).items() if u > 2]
    flags, table = [], None
    whole = df.select(*[C.as_numeric(df, c).alias(c) for c in cols]).dropna() if cols else None
    if len(cols) >= 2 and whole.count() > len(cols):
        spread = [v["std"] for v in moments(whole, {c: C.col(c) for c in cols}).values() if v["std"]]
        if max(spread) / max(min(spread), 1e-12) > 10:
            flags.append(("warning", "very different scales", "", max(spread) / min(spread)))
        p = A.pca(whole, cols)
        table = A.pca_table(whole, cols, p)
        flags.append(("info", "components for 90 %", "", p["components_90"]))
        twins = sum(r is not None and abs(r) >= 0.9 for r, _ in pair_corr(whole, {c: C.col(c) for c in cols}).values())
        if twins:
            flags.append(("info", "almost duplicate pairs", "", twins))
    if cat:
        flags.append(("info", "columns to encode", "", len(cat)))
    return {"kind": "Unsupervised", "flags": flag_table(df.sparkSession, flags), "pca": table}


def analyze_target(df: DataFrame, target: str | None, kind: str | None = None, time_col: str | None = None, tie: str | None = None,
                   roles: dict | None = None, splits: dict | None = None, sample: int | None = None, key: str | None = None,
                   max_values: int | None = None) -> dict:
    """The analysis for the kind of problem. All rows by default; `sample` takes that many rows by hash first, `max_values` leaves out
    (and flags) categorical features of more values."""
    d = df if sample is None else sample_rows(df, sample, key=key)
    kind = kind or guess_kind(df, target)
    if kind == "Classification":
        return classification(d, target, roles, splits, max_values)
    if kind == "Regression":
        return regression(d, target, roles, key, max_values)
    if kind.startswith("Time"):
        return timeseries(d, target, time_col, tie or time_col)
    return unsupervised(d, roles)
