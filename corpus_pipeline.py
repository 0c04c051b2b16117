"""From documents to a training mixture: five stages, each over all that the one before has kept.

toxicity       rejects documents that the factorization machine predicts as toxic
exact_dedup    leaves one document of each normalised text (sort-merge against a fresh digest index)
near_dedup     leaves one document of each component of 3-gram Jaccard similarity 0.9
decontaminate  removes documents that hold a 10-word window of a benchmark item
mix            gives every remaining document its slot in the Pfair mixture of the sources

All but the last return the columns of documents; the last returns doc_id, source, block, slot and place, ordered by slot
and place when the mixture is written out. Every stage accepts empty tables, null columns, repeated rows and further columns
as its operator does; their results are those of the operators' docstrings.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, decontaminate, exact_dedup, jaccard_join, mixing, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, common.table(spark, folder, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", buckets=exact_dedup.buckets_for(docs.count()))
    return exact_dedup.keep_rows(docs, exact_dedup.deduplicate(docs, index))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return jaccard_join.keep_one(docs, jaccard_join.similar_components(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, common.table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_benchmark), ("mix", mix_sources)]
#: The first stage learns and the third follows links, so SQL cannot state the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
