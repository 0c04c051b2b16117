"""Connected components of a link table: least labels with pointer jumping, one stored table for each round."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node in links (a long, b long)."""
    both = common.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        step = common.stored(hooked.join(up, "low").select("node", F.least("low", "top").alias("label"), (F.least("low", "top") != F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.filter("moved").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
