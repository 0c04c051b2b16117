"""Suffix-array deduplication over bytes: maximal repeats by common-prefix intervals.

A string of 200 bytes is removed wherever it starts if it starts more than once. Each such window is answered for by a
winnowed anchor of 32 bytes; anchors that occur once are dropped before any text moves. For the others:

* Anchors whose occurrences all have the same context (all bytes of their windows) repeat as a whole.
* Equal contexts of an anchor collapse to one row with a weight, wherever they come from.
* The differing contexts of an anchor go to one shard with those of many other anchors. The shard's text gets an enhanced
  suffix array to a depth of one window: the order by packed ranks, the common prefixes of neighbours, the scan of
  intervals of common prefixes of a window or more, and the test whether their occurrences differ on the left. Every
  occurrence of an interval counts, not just neighbours in the order.
* An anchor with more than `SHARD_ROWS` occurrences would make a shard too large, so its windows are counted by their 128-bit
  hashes in an aggregation that no single task has to hold. The result is the same.

Windows are bytes of UTF-8; they never cross texts. Defined results: null and empty texts have no bytes; repeated rows are
rows of their own, so they repeat each other; a null doc_id is an id; other columns do not matter.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common, seeds
from millrace.llm.arrays import FIRST, SECOND, chunks, flat, signed

WINDOW, GRAM, SHARD_ROWS, SHARD_BYTES = 200, 32, 8000, 1 << 20


def byte_units(column: pa.Array) -> seeds.Units:
    data, offsets = flat(column)
    return seeds.Units(FIRST.bytes[data], SECOND.bytes[data], offsets)


class SuffixArray:
    """Suffixes of a shard that begin a window, in order to the depth of a window.

    data, ends: the snippets of the shard; each but its last window-1 bytes begins windows. `common` has the length of the
    prefix that a suffix shares with the one before it, at most a window.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, window: int):
        self.data, self.ends, self.window = data, ends, window
        n = len(data)
        wide = np.zeros(n + 8, np.uint64)
        wide[:n] = data
        key = np.zeros(n, np.uint64)
        for i in range(min(8, window)):
            key = (key << np.uint64(8)) | wide[i:n + i]
        self.levels = [(1, wide[:n]), (min(8, window), self.ranks(key))]
        bits = np.uint64(max(1, n.bit_length()))
        parts = max(2, 63 // int(bits))
        while (depth := self.levels[-1][0]) < window:
            rank, reach = self.levels[-1][1], min(window, depth * parts)
            key = rank
            for p in range(1, parts):
                key = (key << bits) | self.later(rank, min(p * depth, reach - depth))
            self.levels.append((reach, self.ranks(key)))
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        begins = np.arange(n) + window <= ends[of + 1]
        starts = np.flatnonzero(begins)
        self.order = starts[np.argsort(self.levels[-1][1][starts], kind="stable")]
        self.of = of
        self.common = self.prefixes()

    @staticmethod
    def ranks(key: np.ndarray) -> np.ndarray:
        return np.unique(key, return_inverse=True)[1].astype(np.uint64)

    @staticmethod
    def later(rank: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(rank)
        out[:max(0, len(rank) - k)] = rank[k:]
        return out

    def prefixes(self) -> np.ndarray:
        """Common prefix with the suffix before, by descending through the levels; 0 for the first."""
        a, b = self.order[:-1], self.order[1:]
        got = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            for _ in range(self.window // depth):
                fits = got + depth <= self.window
                same = fits & (rank[np.where(fits, a + got, a)] == rank[np.where(fits, b + got, b)])
                if not same.any():
                    break
                got[same] += depth
        return np.concatenate([np.zeros(min(1, len(self.order)), np.int64), got])

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in `order` of each interval whose suffixes share `least` bytes or more: the outermost nodes
        of the interval tree at that depth, single suffixes included."""
        opens = np.flatnonzero(self.common < least)
        return opens, np.append(opens[1:], len(self.order)) - 1

    def left_diverse(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the occurrences of an interval have different bytes on their left. The edge of a snippet differs from all."""
        at_edge = self.order == self.ends[self.of[self.order]]
        left = np.where(at_edge, -1 - self.order, self.data[np.maximum(self.order - 1, 0)].astype(np.int64))
        if not len(first):
            return np.zeros(0, bool)
        return np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)


def repeat_groups(data: np.ndarray, ends: np.ndarray, weight: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """All occurrences of the repeats of a window or more in a shard of snippets with weights.

    group, start (in data), maximal (the occurrences differ on the left, so the repeat cannot be extended there): a
    snippet of weight over 1 repeats by itself.
    """
    sa = SuffixArray(data, ends, window)
    first, last = sa.intervals(window)
    group = np.repeat(np.arange(len(first)), last - first + 1)
    total = np.bincount(group, weight[sa.of[sa.order]], len(first)) if len(first) else np.zeros(0)
    repeated = total[group] > 1
    return {"group": group[repeated], "start": sa.order[repeated], "maximal": sa.left_diverse(first, last)[group[repeated]], "snippet": sa.of[sa.order][repeated]}


def runs(snippet: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of a snippet joined: snippet, first start, number of starts."""
    o = np.argsort(start, kind="stable")
    snippet, start = snippet[o], start[o]
    new = np.ones(len(o), bool)
    new[1:] = (snippet[1:] != snippet[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return snippet[head], start[head], np.append(head[1:], len(o)) - head


PART = "anchor long, context long, low int, n int"


def shard_runs(batches: Iterator[pa.RecordBatch], window: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Input sorted by anchor: anchor, context, weight, snippet. Output: repeated stretches of each context's windows.
    Anchors are gathered into shards of about shard_bytes; an anchor is never split."""
    held: list[pa.RecordBatch] = []

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        data, ends = flat(b.column(3))
        g = repeat_groups(data, ends, b.column(2).to_numpy(), window)
        snippet, start, n = runs(g["snippet"], g["start"])
        at = pa.array(snippet)
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start - ends[snippet], pa.int32()), pa.array(n, pa.int32())], ["anchor", "context", "low", "n"])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += flat(b.column(3))[1][-1]
        if size < shard_bytes:
            continue
        whole = joined(held)
        anchor = whole.column(0).to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        bytes_at = flat(whole.column(3))[1]
        at = 0
        for e, z in zip(edges[1:-1], edges[2:]):
            if bytes_at[z] - bytes_at[at] > shard_bytes:
                yield work(whole.slice(at, e - at))
                at = e
        held, size = [whole.slice(at)], bytes_at[-1] - bytes_at[at]
    if held:
        yield work(joined(held))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The keyed documents and their repeated windows: id, rk, cuts (list of first window start and number of windows)."""
    rows = seeds.keyed(docs)
    anchors = seeds.anchor_rows(rows, byte_units, gram, window)
    shared = common.stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.min("context").alias("c1"), F.max("context").alias("c2"))
                           .filter("times > 1").select("anchor", "times", (F.col("c1") != F.col("c2")).alias("mixed"), (F.col("times") > shard_rows).alias("frequent")), "shared-anchors")
    hits = common.stored(common.join_hot(anchors, shared, ["anchor"], "times", shared.agg(F.sum("times")).first()[0] or 0).filter("times is not null").drop("times"), "anchor-hits")
    open_ = hits.filter("mixed").groupBy("id", "rk").agg(F.collect_list(F.struct("low", "n", "anchor", "context", "frequent")).alias("seeds"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(0))
            row, low, n = seeds.stretches(b.column(1))
            fields = b.column(1).flatten()
            start, size = offsets[row] + low, n - 1 + window
            ends = np.concatenate([[0], np.cumsum(size)])
            index = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
            snippet = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([fields.field(2), fields.field(3), fields.field(4), fields.field(1), snippet], ["anchor", "context", "frequent", "n", "snippet"])

    snippets = rows.join(open_, ["id", "rk"]).select("text", "seeds").mapInArrow(cut_out, "anchor long, context long, frequent boolean, n int, snippet binary")
    distinct = common.stored(snippets.groupBy("anchor", "context", "frequent", "n").agg(F.count(F.lit(1)).alias("weight"), F.first("snippet").alias("snippet")), "snippets")
    shards = distinct.filter("not frequent").select("anchor", "context", "weight", "snippet").repartition(common.all_parts(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "context")
    by_array = shards.mapInArrow(lambda batches: shard_runs(batches, window, shard_bytes), PART)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "snippet"):
            u = byte_units(b.column(3))
            n = np.diff(u.ends) - window + 1
            own = np.repeat(np.arange(len(n)), n)
            low = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            one, two = u.windows(u.ends[own] + low, window)
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(low, pa.int32()), signed(one), signed(two)], ["anchor", "context", "weight", "low", "w1", "w2"])

    # a frequent anchor's contexts of weight over 1 repeat as a whole: one run each. The windows of all its contexts are counted,
    # those of the others are joined to runs where they occur again.
    many = distinct.filter("frequent")
    counted = many.select("anchor", "context", "weight", "snippet").mapInArrow(windows, "anchor long, context long, weight long, low int, w1 long, w2 long")
    often = counted.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).filter("times > 1")
    single = counted.filter("weight = 1").select("anchor", "context", "low", "w1", "w2")
    often = common.stored(often, "repeated-windows")
    again = common.semi_hot(single, often, ["w1", "w2"], "times", often.agg(F.sum("times")).first()[0] or 0)
    place = F.row_number().over(Window.partitionBy("anchor", "context").orderBy("low"))
    by_count = (again.select("anchor", "context", "low", (F.col("low") - place).alias("run")).groupBy("anchor", "context", "run")
                .agg(F.min("low").alias("low"), F.count(F.lit(1)).cast("int").alias("n")).drop("run"))
    whole = many.filter("weight > 1").select("anchor", "context", F.lit(0).alias("low"), "n")
    parts = by_array.unionByName(by_count).unionByName(whole).groupBy("anchor", "context").agg(F.collect_list(F.struct(F.col("low").alias("from"), F.col("n").alias("many"))).alias("parts"))
    weights = distinct.groupBy("anchor", "context").agg(F.sum("weight").alias("weight"))
    found = common.stored(parts.join(weights, ["anchor", "context"]), "repeated-contexts")
    mixed = hits.filter("mixed").select("id", "rk", "anchor", "context", "low")
    inside = common.join_hot(mixed, found, ["anchor", "context"], "weight", mixed.count()).filter("parts is not null")
    inside = inside.select("id", "rk", F.transform("parts", lambda p: F.struct((F.col("low") + p["from"]).alias("low"), p["many"].alias("n"))).alias("own"))
    cuts = (hits.filter("not mixed").select("id", "rk", F.array(F.struct("low", "n")).alias("own")).unionByName(inside)
            .groupBy("id", "rk").agg(F.flatten(F.collect_list("own")).alias("cuts")))
    return rows, cuts


def kept_digests(rows: DataFrame, cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. Rows that repeat whole share their cuts."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(1))
            gone = seeds.covered(offsets, *seeds.stretches(b.column(2)), window)
            steps = np.diff(np.concatenate([[0], gone.view(np.int8)])) > 0
            steps[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
            total, spans, sha = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(steps)]), []
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                sha.append(hashlib.sha256(data[a:z] if total[a] == total[z] else data[a:z][~gone[a:z]]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(total[offsets]), pa.int64()), pa.array(np.diff(spans[offsets]), pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (rows.join(cuts, ["id", "rk"], "left").select(F.nullif("id", F.lit(seeds.NO_ID)).alias("doc_id"), "text", "cuts")
            .mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return kept_digests(*repeats(common.table(spark, folder, "documents")))
