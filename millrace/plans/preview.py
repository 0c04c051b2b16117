"""What a settings change would do, before it is applied."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.profile import small_table
from millrace.operators.sampling import sample_rows
from millrace.plans.pipeline import build_pipeline
from millrace.plans.settings import merged


def _shape(df: DataFrame) -> tuple[int, int, int]:
    r = df.agg(F.count("*").alias("rows"), *[F.count(F.when(C.is_null(df, c), 1)) for c in df.columns]).first()
    return r[0], len(df.columns), sum(r[1:])


def preview(train: DataFrame, cfg: dict, patch: dict, target: str | None = None, sample: int | None = None, key=None) -> DataFrame:
    """Rows, columns and missing cells before and after the patch, and which columns come and go."""
    d = train if sample is None else sample_rows(train, sample, key=key)
    pipes = [build_pipeline(c, target) for c in (cfg, merged(cfg, patch))]
    now, after = (p.fit_transform(d) for p in pipes)
    a, b = _shape(now), _shape(after)
    rows = [{"metric": m, "before": float(x), "after": float(y)} for m, x, y in zip(("rows", "columns", "missing cells"), a, b)]
    rows += [{"metric": f"removed: {c}", "before": 1.0, "after": 0.0} for c in now.columns if c not in after.columns]
    rows += [{"metric": f"added: {c}", "before": 0.0, "after": 1.0} for c in after.columns if c not in now.columns]
    for p in pipes:
        p.release()
    return small_table(train.sparkSession, rows, "metric string, before double, after double")
