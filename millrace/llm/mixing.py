"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put into a random but repeatable order and cut into blocks. While all sources have blocks left,
a source with weight w (a share of all slots) may start its block k (from 1) at slot floor((k - 1) / w) and has to be done
with it by slot ceil(k / w). When a source runs out, the others go on at their weights relative to each other: the due
share of a source after t slots is min(weight * v, blocks) with v such that all due shares add up to t, and release and
deadline are the slots in which that due share passes k - 1 and k. Slots are filled earliest deadline first among the
released blocks, which meets every deadline on one track: after any number of slots a source has had its due share, less or
more by under one block.

Weights are not rounded to a cycle: releases and deadlines are worked out in whole numbers of any size, so no error grows
with the number of slots. The schedule is a simulation on the driver, a step for each
block; it holds the sources, not the slots, and is written to the shared folder piece by piece. Each row is used exactly
once. Rows are numbered by DataFrame functions: by ranges of their hash within the source, so that a source with a third of
all rows is spread over many tasks.

Defined results: a null source is a source; rows with equal source and doc_id are alike and follow each other; null
doc_id is an id; texts and other columns do not matter; an empty table gives no rows.
"""
from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

BLOCK_ROWS, CYCLE, BUCKET_ROWS, PIECE, SEED = 32, 1000, 4000, 1 << 20, 7


def shares(weights: list[float], cycle: int) -> list[int]:
    """Whole slots of a cycle for each weight by largest remainder, one at least."""
    total = math.fsum(weights)
    exact = [w / total * cycle for w in weights]
    out = [max(1, math.floor(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    while sum(out) < cycle:
        for i in order[:cycle - sum(out)]:
            out[i] += 1
    while sum(out) > cycle:
        i = max(range(len(out)), key=lambda i: (out[i] - exact[i] if out[i] > 1 else -math.inf, i))
        out[i] -= 1
    return out


def simplest(w: float) -> Fraction:
    """The fraction of the smallest denominator among those that w stands for, so that 1 / 3 is a third."""
    low, high = ((Fraction(w) + Fraction(math.nextafter(w, to))) / 2 for to in (0, math.inf))
    whole_parts = []
    while (n := math.ceil(low)) > high:
        whole_parts.append(n - 1)
        low, high = 1 / (high - n + 1), 1 / (low - n + 1)
    out = Fraction(n)
    for n in reversed(whole_parts):
        out = n + 1 / out
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in the same proportions; weights without a handy common denominator count as they are written."""
    exact, scale = {}, 1
    for w in set(weights):
        exact[w] = simplest(float(w))
        if (scale := math.lcm(scale, exact[w].denominator)).bit_length() > 256:
            exact = {w: Fraction(repr(float(w))) for w in set(weights)}
            scale = math.lcm(*{x.denominator for x in exact.values()})
            break
    return [exact[w].numerator * (scale // exact[w].denominator) for w in weights]


def schedule(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of slot 0, 1, ...: earliest deadline first, of equal deadlines the first source."""
    # A source is through at v = blocks / weight; before the p-th of these, the due shares add up to done[p] + v * left[p].
    order = sorted((i for i, n in enumerate(blocks) if n), key=cmp_to_key(lambda i, j: blocks[i] * weights[j] - blocks[j] * weights[i]))
    through, done, left = [blocks[i] / weights[i] for i in order], [0], [sum(weights[i] for i in order)]
    for i in order:
        done.append(done[-1] + blocks[i])
        left.append(left[-1] - weights[i])

    def window_end(i: int, k: int) -> tuple[int, int]:
        """Slots in which the due share of source i passes k: release of the block after it, deadline of the one before."""
        w = weights[i]
        p = at[i]
        if blocks[order[p]] * w < k * weights[order[p]]:
            p = min(bisect_right(through, k / w), len(order) - 1)
            while p and blocks[order[p - 1]] * w >= k * weights[order[p - 1]]:
                p -= 1
            while blocks[order[p]] * w < k * weights[order[p]]:
                p += 1
            at[i] = p
        q, r = divmod(left[p] * k, w)
        return done[p] + q, done[p] + q + (r > 0)

    at, served, after = [0] * len(blocks), [0] * len(blocks), [0] * len(blocks)
    ready: list[tuple[int, int]] = []
    later: list[tuple[int, int, int]] = []
    for i in sorted(order):
        after[i], due = window_end(i, 1)
        ready.append((due, i))
    heapq.heapify(ready)
    for slot in range(done[-1]):
        while later and later[0][0] <= slot:
            _, due, i = heapq.heappop(later)
            heapq.heappush(ready, (due, i))
        due, i = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError(f"source {i} misses its deadline {due}")
        k = served[i]
        yield i, k
        served[i] = k = k + 1
        if k < blocks[i]:
            release = after[i]
            after[i], due = window_end(i, k + 1)
            if release <= slot + 1:
                heapq.heappush(ready, (due, i))
            else:
                heapq.heappush(later, (release, due, i))


def pfair_cycle(slots_due: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks in one cycle of sum(slots_due) slots, earliest deadline first."""
    out: list[list[int]] = [[] for _ in slots_due]
    for slot, (i, _) in enumerate(schedule(slots_due, slots_due)):
        out[i].append(slot)
    return out


def written(spark: SparkSession, slots: Iterator[tuple[int, int]], numbers: np.ndarray) -> DataFrame:
    """_number (of the source), _block, _slot: the slots as a table in the shared folder."""
    kind, path, slot, mode = "_number long, _block long, _slot long", common.scratch(spark, "slots"), 0, "overwrite"
    while True:
        piece = np.fromiter((x for pair in itertools.islice(slots, PIECE) for x in pair), np.int64).reshape(-1, 2)
        if slot and not len(piece):
            break
        table = pa.table({"_number": numbers[piece[:, 0]], "_block": piece[:, 1], "_slot": np.arange(slot, slot + len(piece))})
        spark.createDataFrame(table, kind).write.mode(mode).parquet(path)
        slot, mode = slot + len(piece), "append"
        if len(piece) < PIECE:
            break
    return spark.read.schema(kind).parquet(path)


def bucket_of(h: Column, buckets: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(buckets), 31)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, block_rows: int = BLOCK_ROWS,
        cycle: int = CYCLE, seed: int = SEED) -> DataFrame:
    """doc_id, source, block (of its source), slot (of the schedule), place (in the block): sorted by slot and place the
    rows are the mixture. Without weights a source weighs its number of rows to the power `temperature`. A source
    that `weights` lacks is an error; any number of sources. The schedule is exact over all slots: `cycle`, the slots
    after which it once repeated, has no effect any more."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    # Numbers grow with the source's name, so ties of deadlines end alike at any partitioning; only numbers and sizes are collected.
    sizes = common.stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.asc_nulls_first("source"))
                          .select(F.col("source").alias("_source"), F.monotonically_increasing_id().alias("_of"), "_rows"), "sources")
    if weights is None:
        facts = sizes.select("_of", "_rows").toArrow().sort_by("_of")
        shares_due = [n ** temperature for n in facts["_rows"].to_pylist()]
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_name string, _weight double")
        weighed = sizes.join(given, F.col("_source").eqNullSafe(F.col("_name")), "left")
        if bad := weighed.filter(F.coalesce(F.isnan("_weight") | (F.col("_weight") <= 0), F.lit(True))).orderBy("_of").limit(5).collect():
            raise ValueError(f"no positive weight for {[r['_source'] for r in bad]}")
        facts = weighed.select("_of", "_rows", "_weight").toArrow().sort_by("_of")
        shares_due = facts["_weight"].to_pylist()
    numbers, counts = facts["_of"].to_numpy(), facts["_rows"].to_pylist()
    slots = written(spark, schedule([-(-n // block_rows) for n in counts], whole(shares_due)), numbers)

    buckets = max(1, sum(counts) // BUCKET_ROWS)
    alike = (rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", bucket_of(F.col("h"), buckets)))
    before = (alike.groupBy("source", "bucket").agg(F.sum("n").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("_n"))
              .join(sizes, F.col("source").eqNullSafe(F.col("_source")))
              .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "_before", "_of"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    numbered = (alike.withColumn("_in", F.sum("n").over(inside) - F.col("n"))
                .join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
                .withColumn("_first", F.col("_before") + F.col("_in"))
                .withColumn("_at", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)))
                .withColumn("block", F.floor(F.col("_at") / block_rows)))
    return (numbered.join(slots, (F.col("_of") == F.col("_number")) & (F.col("block") == F.col("_block")))
            .select("doc_id", "source", F.col("block").cast("long").alias("block"), F.col("_slot").alias("slot"), (F.col("_at") % block_rows).cast("long").alias("place")))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(common.table(spark, folder, "documents"))
