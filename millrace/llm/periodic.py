"""Runs of periodic repetition in the words of a text, caught online by dyadic blocks.

Words are appended to a `Catchers` object. Once 2**k words at a multiple of 2**k are complete, their block becomes a
catcher of level k: a square of period q, 2 * 2**k <= q < 4 * 2**k, has a whole block of that level in its first half,
which comes again q words later. So each appended word ends one window of each level, and that window is compared with
the two blocks in reach (level 0 also serves period 1). Blocks that follow each other and match at the same distance
form a streak. When a streak ends it is shorter than its run by less than a block at each end, so suffixes of halved
lengths find the rest; if the result holds the square asked for, it is a run. A stretch is caught once for each multiple
of its smallest period, with the same bounds, and kept for the smallest.

Work and memory are n log n in the words, whatever repeats. Texts of a batch are appended behind each other with a word
between them that equals no other, so that runs stay inside texts and a task's work is a few array steps for each level.
Words are compared by 64-bit hashes, stretches of 2**k words by hashes of their halves. A document is one row in and one
row out, no shuffle.

Defined results: null and empty texts have no words and no runs; repeated rows are answered each; a null doc_id stays null
(and has no planted loop in the query); no rows give no rows; other columns of the table are left aside.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import SPACES, U64, Words, chunks, mix, union_length

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
RUN_SCHEMA = "array<struct<start:long,length:long,period:long>>"


class Level:
    """Windows and catchers of 2**k words. hash[p] covers the words p .. p + 2**k - 1; streaks are open by period."""

    def __init__(self, size: int):
        self.size = size
        self.hash = np.zeros(0, U64)
        self.open: dict[int, tuple[int, int]] = {}

    def periods(self) -> tuple[int, int]:
        return (1 if self.size == 1 else 2 * self.size), 4 * self.size


class Catchers:
    """Squares of at least `exponent` periods and `least` words among the words appended so far."""

    def __init__(self, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH, longest: int | None = None):
        """longest: no run longer than so many words can occur (the longest text); bounds the levels."""
        self.exponent, self.least, self.longest = exponent, least, longest
        self.levels = [Level(1)]
        self.n = 0
        self.found: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        """words: hashes of the next words, one or many."""
        self.n += len(words)
        self.levels[0].hash = np.concatenate([self.levels[0].hash, words])
        k = 0
        while True:
            level = self.levels[k]
            seen = len(level.hash) - len(words) if k == 0 else self.grow(k)
            self.advance(level, seen)
            size = 2 * level.size
            if size * 2 * self.exponent > min(self.n, self.longest or self.n) or len(level.hash) <= level.size:
                return
            k += 1
            if k == len(self.levels):
                self.levels.append(Level(size))

    def grow(self, k: int) -> int:
        """Hashes of the windows of level k that the last words completed, from the level below; how many there were."""
        half, level = self.levels[k - 1], self.levels[k]
        seen = len(level.hash)
        new = mix(half.hash[seen:-half.size] * U64(0x9E3779B97F4A7C15) + half.hash[seen + half.size:] + U64(k))
        level.hash = np.concatenate([level.hash, new])
        return seen

    def advance(self, level: Level, seen: int) -> None:
        """Compare the new windows with the catchers in reach; carry streaks on and close those that ended."""
        b, h = level.size, level.hash
        at = np.arange(seen, len(h))
        reach = [(at - 2 * b) // b * b, (at - 3 * b) // b * b] + ([at - 1] if b == 1 else [])
        window, block = [], []
        for i in reach:
            ok = i >= 0
            hit = at[ok][h[i[ok]] == h[at[ok]]]
            window.append(hit)
            block.append(i[hit - seen])
        block, period = np.concatenate(block), np.concatenate(window) - np.concatenate(block)
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        first = np.ones(len(block), bool)
        first[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + b)
        head = np.flatnonzero(first)
        start, last, q = block[head], block[np.append(head[1:], len(block)) - 1] if len(head) else block[:0], period[head]
        # a streak of before goes on, or has met a window that does not match
        ended = []
        for i in np.flatnonzero(np.isin(q, list(level.open))) if level.open else ():
            if level.open.get(int(q[i]), (0, -2 * b))[1] + b == start[i]:
                start[i] = level.open.pop(int(q[i]))[0]
        for p in [p for p, (_, end) in level.open.items() if end + b + p < len(h)]:
            ended.append((*level.open.pop(p), p))
        going = last + b + q >= len(h)
        level.open.update({int(p): (int(s), int(e)) for s, e, p in zip(start[going], last[going], q[going])})
        done = np.stack([start[~going], last[~going], q[~going]], axis=1)
        self.close(level, np.concatenate([done, np.array(ended, np.int64).reshape(-1, 3)]))

    def close(self, level: Level, streaks: np.ndarray) -> None:
        """Runs of streaks (first block, last block, period) that are over."""
        b = level.size
        most = streaks[:, 1] - streaks[:, 0] + b + 2 * (b - 1) + streaks[:, 2]
        streaks = streaks[most >= np.maximum(self.least, self.exponent * streaks[:, 2])]
        if not len(streaks):
            return
        start, end, q = streaks[:, 0].copy(), streaks[:, 1] + b, streaks[:, 2]
        for below in reversed(self.levels[:self.levels.index(level)]):
            s, h = below.size, below.hash
            left = start >= s
            left[left] = h[start[left] - s] == h[start[left] - s + q[left]]
            start[left] -= s
            right = end + q + s <= self.n
            right[right] = h[end[right]] == h[end[right] + q[right]]
            end[right] += s
        length = end + q - start
        ok = length >= np.maximum(self.least, self.exponent * q)
        self.found.append(np.stack([start, length, q], axis=1)[ok])

    def runs(self) -> np.ndarray:
        """(start, length, smallest period) of every run among the words so far, by start and period."""
        before = len(self.found)
        for level in self.levels:
            self.close(level, np.array([(s, e, p) for p, (s, e) in level.open.items()], np.int64).reshape(-1, 3))
        found = np.concatenate([np.zeros((0, 3), np.int64), *self.found])
        del self.found[before:]
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[new]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(hashes: np.ndarray, first: np.ndarray, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Text and (start in the text, length, period) of the runs of several texts; first: offsets of the texts in words."""
    texts = len(first) - 1
    own = np.repeat(np.arange(texts), np.diff(first))
    longest = int(np.diff(first).max(initial=0))
    if longest < least:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    row = np.full(len(hashes) + texts, U64(0))
    row[np.arange(len(hashes)) + own] = hashes
    row[first[1:] + np.arange(texts)] = mix(np.arange(1, texts + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    catchers = Catchers(exponent, least, longest)
    catchers.append(row)
    runs = catchers.runs()
    base = first[:-1] + np.arange(texts)
    text = np.searchsorted(base, runs[:, 0], "right") - 1
    runs[:, 0] -= base[text]
    return text, runs


def periodic_runs(docs: DataFrame, exponent: int = LEAST_EXPONENT, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the words left when each run keeps
    its first period only, joined by a space."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            words = Words(b.column(1), SPACES, False)
            text, runs = runs_of(words.hash(), words.first, exponent, least)
            at = words.first[text] + runs[:, 0]
            gone = union_length(at + runs[:, 2], at + runs[:, 1], len(words.starts))
            sizes = np.searchsorted(text, np.arange(b.num_rows + 1))
            cells = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), cells), joined(words, ~gone)],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUN_SCHEMA}, collapsed string")


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """For each text its kept words, joined by one space."""
    at = np.flatnonzero(keep)
    sizes = words.ends[at] - words.starts[at]
    count = np.searchsorted(at, words.first)
    last = np.zeros(len(at), bool)
    last[count[1:][np.diff(count) > 0] - 1] = True
    step = sizes + ~last
    to = np.concatenate([[0], np.cumsum(step)])
    out = np.full(to[-1], 0x20, np.uint8)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to[:-1], sizes) + within] = words.data[np.repeat(words.starts[at], sizes) + within]
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(to[count]), pa.py_buffer(out)).cast(pa.string())


def looped(docs: DataFrame) -> DataFrame:
    """The query's input: documents chosen by their id's crc32 h (h % 10 = 0) repeat p words from word a on to their end."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    chosen = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long"))
    g, n = F.floor(h / 10), F.col("_n")
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.when(n > 0, 1 + F.floor((n - F.col("_a")) / (3 + g % 8))))
    a, p = F.col("_a"), F.col("_p")
    text = F.array_join(F.transform("_w", lambda w, i: F.get("_w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    return chosen.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def strongest(runs: str) -> Column:
    """The run of the greatest length / period; ties: smallest start, then period (the order of the list)."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(looped(common.table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    top = F.col("top")
    return found.withColumn("top", strongest("runs")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
