"""A profile that merges: partial results of batches or partitions combine to the profile of the whole."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import columns as C


def number_partials(df: DataFrame, cols: list[str], chunk=None) -> DataFrame:
    """(chunk, column, rows, n, mean, m2, low, high): one row per column and chunk."""
    exprs = {c: C.as_numeric(df, c) for c in cols}
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.lit(c))])
    part = df.withColumn("_chunk", chunk if chunk is not None else F.lit("all"))
    cells = F.array(*[F.struct(F.lit(i).alias("k"), x.alias("v")) for i, x in enumerate(exprs.values())])
    v = F.col("v")
    return (part.select("_chunk", F.explode(cells).alias("x")).select("_chunk", "x.k", "x.v").groupBy(F.col("_chunk").alias("chunk"), "k")
            .agg(F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
                 F.min(v).alias("low"), F.max(v).alias("high"))
            .select("chunk", names[F.col("k")].alias("column"), "rows", "n", "mean", "m2", "low", "high"))


def merged_numbers(partials: DataFrame) -> DataFrame:
    """Counts add, means weigh, and the squared deviations add with the distance of each mean from the common one."""
    whole = partials.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("gm"))
    return (partials.join(F.broadcast(whole), "column").groupBy("column").agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("n")).alias("missing"), F.sum("n").alias("n"), F.first("gm").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("gm")) ** 2).alias("m2"), F.min("low").alias("min"), F.max("high").alias("max"))
        .select("column", "rows", "missing", (F.col("missing") / F.col("rows") * 100).alias("missing_pct"), "mean",
                F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), "min", "max"))


def text_partials(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) with the gaps as a NULL value."""
    from millrace.operators.counts import value_counts
    return value_counts(df, cols, strip_missing=False)


def merged_texts(partials: DataFrame) -> DataFrame:
    """Distinct values, most frequent value and its share, gaps."""
    vc = partials.groupBy("column", "value").agg(F.sum("n").alias("n"))
    here = F.col("value").isNotNull()
    best = F.min(F.when(here, F.struct((-F.col("n")).alias("k"), "value")))
    return (vc.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("missing"),
                                     F.count("value").alias("unique"), best.alias("best"))
            .select("column", "rows", "missing", (F.col("missing") / F.col("rows") * 100).alias("missing_pct"), "unique",
                    F.col("best.value").alias("top_value"), (-F.col("best.k") / (F.col("rows") - F.col("missing")) * 100).alias("top_share_pct")))


