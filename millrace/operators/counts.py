"""Value counts in long form: the table behind distinct counts, modes, shares, entropy and ranks.

One expand plus one hash aggregation serves every column. Copies of a value are merged on the map side,
so a value that fills a third of the table costs one row per task in the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import columns as C


def value_counts(df: DataFrame, cols: list[str], strip_missing: bool = True) -> DataFrame:
    """(column, value as text, n). Nulls are left out unless asked for."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               F.when(~C.is_null(df, c), C.col(c).cast("string")).alias("value")) for c in cols])
    long = df.select(F.explode(cells).alias("x")).select("x.column", "x.value")
    if strip_missing:
        long = long.filter("value is not null")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, cols) -> dict[str, int]:
    """Exact number of different non-null values per column name or named expression.

    Values travel as two independent 64-bit hashes, so the shuffle has one narrow row per distinct value.
    """
    exprs = cols if isinstance(cols, dict) else {c: F.when(~C.is_null(df, c), C.col(c)) for c in cols}
    if not exprs:
        return {}
    names = list(exprs)
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.when(exprs[c].isNotNull(), F.xxhash64(exprs[c])).alias("h1"),
                               F.xxhash64(F.lit("second"), exprs[c]).alias("h2")) for i, c in enumerate(names)])
    rows = (df.select(F.explode(cells).alias("x")).select("x.*").filter("h1 is not null").groupBy("k", "h1", "h2").agg(F.lit(1))
            .groupBy("k").agg(F.count("*").alias("u")).collect())
    found = {r["k"]: int(r["u"]) for r in rows}
    return {c: found.get(i, 0) for i, c in enumerate(names)}


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values with their share of the non-missing rows."""
    vc = value_counts(df, [col])
    total = vc.groupBy("column").agg(F.sum("n").alias("total"))
    return (vc.join(F.broadcast(total), "column")
            .select("value", "n", (F.col("n") / F.col("total") * 100).alias("share_pct"))
            .orderBy(F.desc("n"), "value").limit(k))


def category_profile(df: DataFrame, cols: list[str], rare_pct: float = 1.0) -> DataFrame:
    """Count, missing share, distinct values, top value, normalised entropy, rare and single values."""
    rows = df.agg(F.count("*").alias("rows"),
                  *[F.sum(C.is_null(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"m{i}").alias("missing"))
                      for i, c in enumerate(cols)])
    per_col = rows.select(F.explode(names).alias("x")).select("x.*")
    vc = value_counts(df, cols)
    totals = vc.groupBy("column").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    best = F.struct(-F.col("n"), F.col("value"))
    stats = (vc.join(F.broadcast(totals), "column").groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min(best).alias("best"),
        (-F.sum(p * F.log(p))).alias("h"),
        F.sum((p * 100 < rare_pct).cast("long")).alias("rare"),
        F.sum((F.col("n") == 1).cast("long")).alias("singletons")))
    return (per_col.join(stats, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"),
        (F.col("missing") / F.col("rows") * 100).alias("missing_pct"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        F.col("best.value").alias("top_value"),
        (-F.col("best.col1") / F.col("count") * 100).alias("top_share_pct"),
        F.when(F.col("unique") > 1, F.col("h") / F.log(F.col("unique").cast("double")))
        .when(F.col("unique") == 1, F.lit(0.0)).alias("entropy"),
        F.col("rare").alias("rare_categories"), F.col("singletons")))


def spelling_variants(df: DataFrame, cols: list[str], groups: int | None = None, top: int | None = None) -> DataFrame:
    """Spellings that agree once case and punctuation are ignored. A group is one key with all its spellings, numbered by
    the rank of its most frequent one. Limits only where asked for: `top` values of each column, `groups` of each column."""
    from millrace.functions.text import spelling_key
    counted = value_counts(df, cols) if top is None else frequent_values(value_counts(df, cols), top)
    grouped = (counted.groupBy("column", spelling_key(F.col("value")).alias("key"))
               .agg(F.count("*").alias("spellings"), F.sort_array(F.collect_list("value")).alias("values"),
                    F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("first")).filter("spellings > 1"))
    numbered = grouped.withColumn("group", F.row_number().over(Window.partitionBy("column").orderBy("first")))
    out = numbered if groups is None else numbered.filter(F.col("group") <= groups)
    return out.select("column", "group", "key", "spellings", "values")


def frequent_values(vc: DataFrame, top: int) -> DataFrame:
    """The `top` most frequent values of each column, numbered by frequency then text.

    Each task first keeps only its own best candidates, so a column with very many values never meets in one task.
    """
    shards = 64
    local = Window.partitionBy("column", F.pmod(F.xxhash64("value"), F.lit(shards))).orderBy(F.desc("n"), "value")
    final = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (vc.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= top).drop("r")
            .withColumn("place", F.row_number().over(final)).filter(F.col("place") <= top))
