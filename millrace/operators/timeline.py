"""Date columns and series: gaps, periods, trends, autocorrelation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import significance as S
from millrace.functions import text as X
from millrace.operators import columns as C
from millrace.operators.correlation import spearman_complete
from millrace.operators.profile import small_table
from millrace.operators.quantiles import exact_quantiles
from millrace.operators.ranks import previous_values, row_index


def as_seconds(df: DataFrame, name: str) -> Column:
    """Timestamp, date or date text as epoch seconds (double), NULL when it is no date."""
    when = C.col(name) if C.kind(df, name) == "datetime" else X.to_timestamp(C.col(name).cast("string"))
    return F.unix_micros(when.cast("timestamp")).cast("double") / 1e6


def stamps(df: DataFrame, t: Column) -> DataFrame:
    """(value, n, previous): each distinct time, its rows and the time before it."""
    counts = df.select(t.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return previous_values(counts, "value")


def gaps(df: DataFrame, t: Column) -> DataFrame:
    """(gap, w): gaps between consecutive rows in time order; rows sharing a time are 0 apart."""
    pieces = F.array(F.struct((F.col("value") - F.col("previous")).alias("gap"), F.lit(1).cast("long").alias("w")),
                     F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("w")))
    return stamps(df, t).select(F.explode(pieces).alias("x")).select("x.*").filter("gap is not null and w > 0")


def time_facts(df: DataFrame, name: str, t: Column | None = None) -> dict:
    t = as_seconds(df, name) if t is None else t
    r = df.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(t).alias("rows"),
               F.count(F.when(~C.is_null(df, name) & t.isNull(), 1)).alias("unparseable")).first()
    out = {"column": name, "first": r["first"], "last": r["last"], "rows": r["rows"], "unparseable": r["unparseable"]}
    if r["rows"] < 3:
        return out
    g = gaps(df, t)
    med = exact_quantiles(g, {"gap": F.col("gap")}, [0.5], weight="w")["gap"][0]
    s = g.agg(F.sum(F.when(F.col("gap") == 0, F.col("w"))).alias("same"), F.sum(F.when(F.col("gap") > 3 * med, F.col("w"))).alias("wide")).first()
    out.update(median_gap=med, duplicates=s["same"] or 0, irregular=(s["wide"] or 0) if med > 0 else 0)
    out["period"] = "D" if med <= 86400 else "W" if med <= 8 * 86400 else "M"
    return out


def time_profile(df: DataFrame, name: str) -> DataFrame:
    """One row: span, median gap in seconds, repeated and irregular steps, period and empty periods."""
    f = time_facts(df, name)
    if f["rows"] < 3:
        f["note"] = "Too few dates to profile."
    else:
        f["empty_periods"] = empty_periods(df, name, f["period"])
    return small_table(df.sparkSession, [f], "column string, first double, last double, rows long, unparseable long, median_gap double, "
                                             "duplicates long, irregular long, period string, empty_periods long, note string")


def period_start(df: DataFrame, name: str, period: str) -> Column:
    when = (C.col(name) if C.kind(df, name) == "datetime" else X.to_timestamp(C.col(name).cast("string"))).cast("timestamp")
    return F.to_date(F.date_trunc({"D": "day", "W": "week", "M": "month"}[period], when))


def period_counts(df: DataFrame, name: str, period: str) -> DataFrame:
    """(period_start as yyyy-MM-dd, n) for days, weeks from Monday or months that hold rows."""
    p = period_start(df, name, period)
    return (df.select(p.alias("p")).filter("p is not null").groupBy("p").agg(F.count("*").alias("n"))
            .select(F.date_format("p", "yyyy-MM-dd").alias("period_start"), "n"))


def empty_periods(df: DataFrame, name: str, period: str) -> int:
    p = period_start(df, name, period)
    r = df.select(p.alias("p")).filter("p is not null").distinct().agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("k")).first()
    if r["a"] is None:
        return 0
    span = ((r["b"].year - r["a"].year) * 12 + r["b"].month - r["a"].month + 1 if period == "M"
            else (r["b"] - r["a"]).days // (7 if period == "W" else 1) + 1)
    return span - r["k"]


def in_time_order(df: DataFrame, t: Column, y: Column, tie: Column) -> DataFrame:
    """(t, y, i): dated rows with their position in time; equal times are ordered by the tie column."""
    d = df.select(t.alias("t"), y.alias("y"), tie.cast("double").alias("tie")).filter("t is not null")
    return row_index(d, F.col("t"), F.col("tie"), "i").select("t", "y", F.col("i").cast("double").alias("i"))


def trends(df: DataFrame, name: str, value_cols: list[str], tie: str) -> DataFrame:
    """Spearman of each value column against its position in time, all columns in one folded rank table.

    The position among the rows that have a value is in the order of the position among all rows, so one index serves.
    """
    d = df.select(as_seconds(df, name).alias("t"), C.col(tie).cast("double").alias("tie"), *[C.exact_numeric(df, c).alias(f"y{i}") for i, c in enumerate(value_cols)]).filter("t is not null")
    placed = row_index(d, F.col("t"), F.col("tie"), "i")
    found = spearman_complete(placed, {c: (F.col("i"), F.col(f"y{i}")) for i, c in enumerate(value_cols)})
    rows = [{"column": c, "trend": rho, "p_value": S.correlation_p(rho, n)} for c, (rho, n) in found.items() if n > 10 and rho is not None]
    return small_table(df.sparkSession, rows, "column string, trend double, p_value double")


def autocorrelation(series: DataFrame, max_lag: int = 60) -> DataFrame:
    """(lag, autocorrelation) of the linearly detrended series (y by position i).

    Every row meets the rows 1..max_lag positions later. Positions are grouped in blocks; a row is sent to its own
    block and, where it is close enough to the border, to the next, so one shuffle of a little more than the table
    suffices and no block holds more than its width plus max_lag rows.
    """
    import numpy as np
    import pandas as pd
    line = series.agg(F.regr_slope("y", "i").alias("b"), F.regr_intercept("y", "i").alias("a"), F.count("*").alias("n")).first()
    lags = min(line["n"] // 2, max_lag)
    flat = series.select(F.col("i").cast("long").alias("i"), (F.col("y") - (F.lit(line["a"]) + F.lit(line["b"]) * F.col("i"))).alias("e"))
    block = 65_536
    home = F.floor(F.col("i") / block)
    sent = flat.withColumn("block", F.explode(F.array_distinct(F.array(home, F.floor((F.col("i") + lags) / block)))))

    def products(key, p):
        # a pair belongs to the block of its later row
        p = p.sort_values("i")
        e, first = p["e"].to_numpy(), int((p["i"] < key[0] * block).sum())
        out = [float((e[first:] ** 2).sum())]
        for k in range(1, lags + 1):
            start = max(first, k)
            out.append(float((e[start:] * e[start - k:len(e) - k]).sum()) if start < len(e) else 0.0)
        return pd.DataFrame({"lag": np.arange(lags + 1), "s": out})

    sums = sent.groupBy("block").applyInPandas(products, "lag long, s double").groupBy("lag").agg(F.sum("s").alias("s"))
    whole = {r["lag"]: r["s"] for r in sums.collect()}
    rows = [{"lag": k, "autocorrelation": whole[k] / whole[0] if whole[0] else None} for k in range(1, lags + 1)]
    return small_table(series.sparkSession, rows, "lag long, autocorrelation double")


def seasonal_lags(acf: list) -> list[int]:
    """Lags above 0.3 that are no lower than both neighbours; the first lag has no left neighbour and never counts."""
    v = [r["autocorrelation"] for r in sorted(acf, key=lambda r: r["lag"])]
    return [i + 1 for i in range(1, len(v)) if v[i] > 0.3 and v[i] >= v[i - 1] and (i + 1 == len(v) or v[i] >= v[i + 1])]
