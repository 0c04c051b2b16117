"""Substring deduplication over words by seed and extend.

Seeds are winnowed anchors of 10 words: every window of 50 words chooses one of its own, so documents that share a window
share its anchor. Documents are joined on anchors with partial aggregation, never pair by pair:

* An anchor found in one document only is dropped.
* A seed is extended both ways over all windows that it answers for (its context). If all its occurrences have the same
  context, all these windows match, and the document with the smallest id is their first.
* Where contexts differ, the match ends inside: the seed is extended by one window after the other, addressed by 128 bits of
  their words, and the smallest id of each window is found by aggregation.

Windows whose first document has a smaller id are joined to maximal repeats of at least 50 words and cut out. A copied
passage costs rows in proportion to its copies; a frequent anchor or window is aggregated before it is shuffled, and
the joins back spread its rows over all tasks.

Words are maximal runs of bytes other than white space, unchanged. Defined results: null and empty texts have no words; a
null doc_id counts as the largest; rows that repeat a doc_id are judged each and are not smaller than each other;
repeats inside a document stay; other columns do not matter.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, seeds
from millrace.llm.arrays import FIRST, SECOND, SPACES, Words, chunks, signed

WINDOW, GRAM = 50, 10


def word_units(column: pa.Array) -> seeds.Units:
    w = Words(column, SPACES, False)
    return seeds.Units(w.hash(FIRST), w.hash(SECOND), w.first)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The keyed documents and their repeated windows: id, rk, cuts (list of first window start and number of windows)."""
    rows = seeds.keyed(docs)
    anchors = seeds.anchor_rows(rows, word_units, gram, window)
    shared = common.stored(anchors.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("context").alias("c1"), F.max("context").alias("c2"), F.count(F.lit(1)).alias("times"))
                           .filter("least < most").select("anchor", "least", "times", (F.col("c1") != F.col("c2")).alias("mixed")), "shared-anchors")
    all_hits = common.join_hot(anchors.drop("context"), shared, ["anchor"], "times", shared.agg(F.sum("times")).first()[0] or 0)
    hits = common.stored(all_hits.filter("mixed or id > least").select("id", "rk", "low", "n", "mixed"), "seed-hits")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            row, low, n = seeds.stretches(b.column(3))
            u = word_units(b.column(2))
            own = np.repeat(np.arange(len(row)), n)
            start = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            one, two = u.windows(u.ends[row[own]] + start, window)
            text = pa.array(row[own])
            yield pa.RecordBatch.from_arrays([b.column(0).take(text), b.column(1).take(text), pa.array(start, pa.int32()), signed(one), signed(two)], ["id", "rk", "low", "w1", "w2"])

    open_ = hits.filter("mixed").groupBy("id", "rk").agg(F.collect_list(F.struct("low", "n")).alias("seeds"))
    windows = common.stored(rows.join(open_, ["id", "rk"]).select("id", "rk", "text", "seeds").mapInArrow(extend, "id long, rk long, low int, w1 long, w2 long"), "seed-windows")
    first = common.stored(windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("times"))
                          .filter("least < most").drop("most"), "first-windows")
    late = common.join_hot(windows, first, ["w1", "w2"], "times", windows.count()).filter("id > least").select("id", "rk", "low", F.lit(1).alias("n"))
    cuts = (hits.filter("not mixed").select("id", "rk", "low", "n").unionByName(late)
            .groupBy("id", "rk").agg(F.collect_list(F.struct("low", "n")).alias("cuts")))
    return rows, cuts


def kept_digests(rows: DataFrame, cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            w = Words(b.column(1), SPACES, False)
            gone = seeds.covered(w.first, *seeds.stretches(b.column(2)), window)
            total, sha = np.concatenate([[0], np.cumsum(gone)]), []
            raw = w.data.tobytes()
            for i in range(b.num_rows):
                a, z = int(w.first[i]), int(w.first[i + 1])
                if total[a] == total[z]:
                    kept = raw[w.offsets[i]:w.offsets[i + 1]].split()
                else:
                    stay = a + np.flatnonzero(~gone[a:z])
                    kept = [raw[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())]
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(np.diff(total[w.first]), pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return (rows.join(cuts, ["id", "rk"], "left").select(F.nullif("id", F.lit(seeds.NO_ID)).alias("doc_id"), "text", "cuts")
            .mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return kept_digests(*repeats(common.table(spark, folder, "documents")))
