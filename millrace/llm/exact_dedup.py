"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest: one row for each distinct text seen so far, with the doc_id that
stays. A batch is digested (SHA-256 of the text after each run of white space has become one space), grouped by digest
with partial aggregation, compared with the index by a sort-merge anti-join on the bucketed key, and what is new is
appended. Only digests are shuffled, never texts. Everything is DataFrame operations.

Defined results: a null text counts as empty; rows that repeat a doc_id count as rows of their own; a null doc_id is
kept only if no row of equal text has an id, and then each such row is marked; empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Buckets of a new index at least, and the texts that one bucket is meant for (about 500 MB). The number of buckets is a
#: property of an index for its lifetime: take it from the rows that the whole corpus will have.
BUCKETS, BUCKET_ROWS = 16, 10_000_000
INDEX_COLUMNS = "digest string, keep_id bigint, batch string"


def normalised(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digested(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised().cast("binary"), 256).alias("digest"))


def buckets_for(rows: int) -> int:
    """Buckets for an index of so many rows."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """The index at `path` in shared storage; without a path, in the session's warehouse. Opening a path that holds an
    index continues it."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS {where}")
        self.buckets = buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests that the index lacks. Repeating a batch appends nothing, so a job may be run again."""
        new = groups.hint("merge").join(self.rows(), "digest", "left_anti")
        (new.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
         .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.name))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id among equal texts of the batch, or the one that an earlier batch has put into the
    index. group_size counts the rows of the batch with that text. Of rows that repeat the staying doc_id and its text
    each is marked as kept; `keep_rows` leaves one of them.
    """
    rows = common.stored(digested(docs), "digests")
    groups = common.stored(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    index.add(groups, batch or uuid.uuid4().hex)
    known = groups.drop("keep_id").hint("merge").join(index.rows().select("digest", "keep_id"), "digest")
    out = common.join_hot(rows, known, ["digest"], "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: one for each distinct text of the batch that no earlier batch has."""
    i, d, own = (common.fresh(docs, c) for c in ("_id", "_sha", "_digest"))
    ids = verdict.filter("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(d)).distinct()
    sha = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    once = docs.withColumn(own, sha).join(ids, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(d)), "left_semi")
    repeated = verdict.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count()
    return (once.dropDuplicates(["doc_id", own]) if repeated else once).select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}", buckets=buckets_for(docs.count()))
    return deduplicate(docs, index)


OP8_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.h AS text_sha256
FROM n JOIN g ON n.h = g.h"""
