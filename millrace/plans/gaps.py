"""How gaps in prepared columns reach a model. Everything is learned on the training rows of one fold.

`indicator` (linear models, forests): a gap takes the training median, and a column that has gaps in training gets a second
column that says so. `branch` (boosted trees): such a column is given twice, once with its gaps below and once above all
training values, so each split of a tree learns the side that gaps go to. In columns without gaps in training a later
gap takes the mean; a column without values takes 0. NULL and NaN are gaps.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from millrace.operators import columns as C
from millrace.operators.quantiles import exact_quantiles

WAYS = ("indicator", "branch")


def present(df: DataFrame, name: str) -> Column:
    """The value as a double, NULL where it is a gap."""
    x = C.col(name)
    return F.when(~F.isnan(x), x) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else x.cast("double")


def beyond(low: float | None, high: float | None) -> tuple[float, float]:
    """Two finite numbers clearly outside low .. high."""
    if low is None:
        return 0.0, 0.0
    room = max(high - low, abs(low), abs(high), 1.0)
    limit = sys.float_info.max / 4
    return max(low - room, -limit), min(high + room, limit)


@dataclass
class Gaps:
    """fills: column -> the values that its gaps take, one for each column made of it; flags: columns with an indicator."""
    fills: dict = field(default_factory=dict)
    flags: list = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], how: str) -> Gaps:
        if how not in WAYS:
            raise ValueError(f"gaps are treated by {' or '.join(WAYS)}, not {how}")
        if not features:
            return cls()
        x = {c: present(df, c) for c in features}
        facts = df.agg(F.count("*"), *[f(x[c]) for c in features for f in (F.count, F.min, F.max, F.avg)]).first()
        seen = {c: facts[1 + 4 * i:5 + 4 * i] for i, c in enumerate(features)}
        gapped = [c for c in features if seen[c][0] < facts[0]]
        fills = {c: [seen[c][3] or 0.0] for c in features}
        if how == "branch":
            return cls({**fills, **{c: list(beyond(seen[c][1], seen[c][2])) for c in gapped}})
        middle = exact_quantiles(df, {c: x[c] for c in gapped}, [0.5])
        return cls({**fills, **{c: [middle[c][0] or 0.0] for c in gapped}}, gapped)

    def columns(self, df: DataFrame) -> list[Column]:
        """The columns that the model sees: no gaps, doubles, named by position."""
        filled = [F.coalesce(present(df, c), F.lit(v)) for c, values in self.fills.items() for v in values]
        said = [present(df, c).isNull().cast("double") for c in self.flags]
        return [x.cast("double").alias(f"_x{i}") for i, x in enumerate(filled + said)]
