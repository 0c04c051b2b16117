"""A labelled table with known structure, generated in parallel, for benchmarks and tests.

Every cell is a function of (seed, draw, row id) alone: a digest of the three is a uniform number, two of them a normal one.
So the table is the same at any partitioning and after any lost task, and rows can be made for ids that a table already has.
"""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, draw: str, key: str = "id") -> Column:
    """A number of (0, 1): the first 13 hex digits of md5(seed|draw|id), moved off zero by half a step."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(draw), F.col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2.0 ** 52


def normal(seed: int, draw: str, key: str = "id") -> Column:
    """A standard normal number by the Box-Muller transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, draw + "a", key))) * F.cos(2 * math.pi * uniform(seed, draw + "b", key))


def make_dataset(spark: SparkSession, rows: int, cols: int = 20, missing: float = 0.05, outliers: float = 0.01,
                 imbalance: float = 0.15, cat_share: float = 0.3, seed: int = 0, partitions: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Normal columns of different scale, a few of them eight times too large, categories of 3 to 40 values, gaps,
    and a yes/no target driven by num_0 and cat_0 with about the wanted share of yes.

    ids: a table with a column id whose rows take the place of 0 .. rows - 1 and which then is the first column.
    """
    n_cat = max(1, int(cols * cat_share))
    n_num = max(1, cols - n_cat)
    sizes = [3, 5, 12, 40]
    base = ids.select("id") if ids is not None else spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism)
    drawn = [normal(seed, f"z{i}").alias(f"z{i}") for i in range(n_num)]
    drawn += [F.floor(uniform(seed, f"k{j}") * sizes[j % 4]).cast("int").alias(f"k{j}") for j in range(n_cat)]
    d = base.select("id", *drawn, uniform(seed, "u").alias("u"))
    # the signal is nearly normal with mean 0.5, so its upper quantile is known without looking at the data
    top = NormalDist(0.5, 1.22).inv_cdf(1 - imbalance)
    logit = 4 * (F.col("z0") + F.when(F.col("k0") == 0, 1.5).otherwise(0.0) - F.lit(top))
    label = F.when(F.col("u") < 1 / (1 + F.exp(-logit)), "yes").otherwise("no")
    out = [F.col("id")] if ids is not None else []
    for i in range(n_num):
        x = F.col(f"z{i}") * (1 + 7 * i % 49) + (37 * i % 200 - 100)
        x = F.when(uniform(seed, f"out{i}") < outliers, x * 8).otherwise(x)
        out.append(F.when(uniform(seed, f"gap{i}") >= missing, x).alias(f"num_{i}"))
    for j in range(n_cat):
        v = F.concat(F.lit("v"), F.col(f"k{j}").cast("string"))
        out.append(F.when(uniform(seed, f"hole{j}") >= missing, v).alias(f"cat_{j}"))
    return d.select(*out, label.alias("y"))
