"""Numeric expressions shared by the profiles."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL (NaN sorts above infinity, so two comparisons do it)."""
    d = c.cast("double")
    return F.when((d < INF) & (d > -INF), d)


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness; 0 for a constant column, NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.coalesce(F.nanvl(F.skewness(x), F.lit(None).cast("double")), F.lit(0.0))
                  * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; 0 for a constant column, NULL below four values."""
    n = F.count(x).cast("double")
    g2 = F.nanvl(F.kurtosis(x), F.lit(None).cast("double"))
    return F.when(n > 3, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0)))


def strength_word(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(a < 0.1, "very weak").when(a < 0.3, "weak").when(a < 0.5, "moderate")
            .when(a < 0.8, "strong").otherwise("very strong"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def sig(c: Column, digits: int = 9) -> Column:
    """Rounded to significant digits, for measures of any magnitude in printed reports."""
    return F.format_string(f"%.{digits}e", c.cast("double")).cast("double")
