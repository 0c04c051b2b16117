"""Structured Streaming jobs: a saved pipeline, a contract and a running profile over a stream of files.

Applying a pipeline and checking rows are stateless, so they run as they are in append mode. The profile keeps no
operator state either: every micro-batch writes its partial rows under its batch id, which makes a replayed batch
overwrite itself, and the profile is the merge of all partials.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import running
from millrace.operators.contract import with_broken_rules
from millrace.plans.spec import transform_saved
from millrace.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, pattern: str, schema, max_files: int = 1_000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder))


def write_available(stream: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Processes what is there and stops; exactly once thanks to the checkpoint beside the output."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint or path + "-checkpoint").trigger(availableNow=True).start().awaitTermination())


def apply_stream(spec: dict, stream: DataFrame) -> DataFrame:
    """The saved pipeline over a stream."""
    return transform_saved(spec, stream)


def split_by_contract(stream: DataFrame, contract: dict) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; bad rows carry the rules they break. The unique rule needs the whole table and stays in batch."""
    marked = with_broken_rules(stream, contract, unique=False)
    return marked.filter(F.size("broken_rules") == 0).drop("broken_rules"), marked.filter(F.size("broken_rules") > 0)


def profile_stream(stream: DataFrame, numbers: list[str], texts: list[str], path: str) -> None:
    """Writes the partial profile of every micro-batch under path."""
    def store(batch: DataFrame, batch_id: int) -> None:
        if numbers:
            running.number_partials(batch, numbers).write.mode("overwrite").parquet(f"{path}/numbers/batch={batch_id}")
        if texts:
            running.text_partials(batch, texts).write.mode("overwrite").parquet(f"{path}/texts/batch={batch_id}")

    (stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def stream_profile(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The merged profile of all batches so far: (numbers, texts)."""
    return (running.merged_numbers(spark.read.parquet(f"{path}/numbers")), running.merged_texts(spark.read.parquet(f"{path}/texts")))
