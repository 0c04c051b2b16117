"""Leakage between sets: rows they share, and features that copy the target."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.correlation import pair_corr
from millrace.operators.profile import row_hash, small_table


def row_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of b equal a row of a in all shared columns.

    Copies are merged on both sides first, so the join sees each content once whatever its number of copies.
    """
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        return small_table(a.sparkSession, [{"overlap_rows": 0}], "overlap_rows long")
    left = b.groupBy(*row_hash(b.select(*[C.col(c) for c in shared]), shared)).agg(F.count("*").alias("n"))
    right = a.select(*row_hash(a, shared)).distinct()
    return left.join(right, ["h1", "h2"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("overlap_rows"))


def suspicious_features(train: DataFrame, target: str, limit: float = 0.98) -> list[tuple[str, float]]:
    """Numeric columns whose correlation with a numeric target reaches the limit."""
    if target not in train.columns or C.kind(train, target) != "numeric":
        return []
    cols = C.numeric(train, but=(target,))
    exprs = {c: C.as_numeric(train, c) for c in [*cols, target]}
    found = pair_corr(train, exprs, [(c, target) for c in cols])
    return [(c, found[(c, target)][0]) for c in cols if found[(c, target)][0] is not None and abs(found[(c, target)][0]) >= limit]


def leakage_report(train: DataFrame, val: DataFrame | None, test: DataFrame | None, target: str | None,
                   prepared_train: DataFrame | None = None) -> DataFrame:
    """(level, item, value): certain problems are errors, suspicions are warnings."""
    rows = []
    for name, other in (("validation", val), ("test", test)):
        if other is not None:
            k = row_overlap(train, other).first()[0]
            if k:
                rows.append({"level": "error", "item": name, "value": float(k),
                             "message": f"{k} {name} row(s) are identical to training rows"})
    probe = prepared_train if prepared_train is not None else train
    if target:
        for c, r in suspicious_features(probe, target):
            rows.append({"level": "warning", "item": c, "value": r,
                         "message": f"`{c}` is almost perfectly related to the target (correlation {r:+.3f})"})
    return small_table(train.sparkSession, rows, "level string, item string, value double, message string")
