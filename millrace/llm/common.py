"""Tables, scratch tables in the shared folder, and joins that a single frequent key cannot slow down."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir

#: A key is hot when it holds more than one row in so many; so there are never more hot keys than this.
HOT_SHARE = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read often, computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def all_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: str = "text") -> Column:
    """With doc_id it tells rows apart, also where a doc_id is repeated; repeated whole rows share it and their result."""
    return F.xxhash64(text)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], sizes: str, rows: int) -> DataFrame:
    """Left join with a table of one row for each key, in which `sizes` counts the rows of `left` with that key.

    Keys with over a 500th of all `rows` are at most 500, so their part of `right` is broadcast, and their rows are dealt out by
    a hash of the whole row instead of the key: none of them meets in one task. The others are joined by a shuffle.
    """
    bound = max(1, rows // HOT_SHARE)
    some, key = [c for c in right.columns if c not in keys], keys[0]
    hot = right.filter(F.col(sizes) > bound).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in some], F.lit(True).alias("_hot"))
    rest = right.filter(F.col(sizes) <= bound).withColumnRenamed(key, "_key")
    dealt = F.when(F.col("_hot"), F.xxhash64(*left.columns).cast(left.schema[key].dataType)).otherwise(F.col(key))
    both = left.join(F.broadcast(hot), keys, "left").withColumn("_key", dealt).join(rest, ["_key", *keys[1:]], "left")
    return both.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in some])


def semi_hot(left: DataFrame, right: DataFrame, keys: list[str], sizes: str, rows: int, parts: int = 64) -> DataFrame:
    """The rows of left whose keys are in `right` (one row for each key, `sizes` counting the rows of left with it).

    Keys with over a 500th of all `rows` are at most 500: they are dealt out over `parts` pieces, to each of which the key is
    sent, so none of them meets in one task, and rows without a partner leave the plan at the join.
    """
    hot = [r[0] for r in right.filter(F.col(sizes) > max(1, rows // HOT_SHARE)).select(keys[0]).collect()]
    piece = fresh(left, "_piece")
    often = F.col(keys[0]).isin(hot)
    pieces = F.explode(F.when(often, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.withColumn(piece, F.when(often, F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(0).cast("int"))
    return dealt.join(right.select(*keys, pieces.alias(piece)), [*keys, piece], "left_semi").select(*left.columns)
