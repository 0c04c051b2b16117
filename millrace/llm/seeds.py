"""Winnowed anchors as Spark rows: the part that both substring operators share.

A text is a row of units (words or bytes). Each window of `window` units is answered for by one anchor, a short gram that
the window's own content chooses, so equal windows have equal anchors. An anchor row has the anchor's hash, the hash of
its context (all units of the windows that it answers for, and where the anchor lies in it), and those windows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.arrays import FIRST, SECOND, U64, chunks, mix, signed, text_of, winnow

#: Stands for a null doc_id: the largest of all.
NO_ID = (1 << 63) - 1


class Units:
    """Hashes over the units of a chunk of texts. ends: offsets of the texts in units."""

    def __init__(self, one: np.ndarray, two: np.ndarray, ends: np.ndarray):
        self.one, self.two, self.ends = FIRST.sums(one), SECOND.sums(two), ends

    def anchors(self, gram: int, window: int):
        n = int(self.ends[-1])
        if n < window:
            return None
        at = np.arange(n - gram + 1)
        grams = FIRST.span(self.one, at, at + gram)
        text, place, low, high = winnow(grams, self.ends, gram, window)
        context = SECOND.span(self.two, low, high + window) ^ mix((place - low).astype(U64) + U64(1))
        return text, grams[place], context, low - self.ends[text], high - low + 1

    def windows(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the window at each start (counted over the chunk)."""
        return FIRST.span(self.one, starts, starts + window), SECOND.span(self.two, starts, starts + window)


def keyed(docs: DataFrame) -> DataFrame:
    """id, rk, text. rk tells rows with equal ids apart; it is 0 where ids are unique, which keeps rows small."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d")).first()
    return rows.select("id", (F.lit(0).cast("long") if counts["n"] == counts["d"] else common.row_key()).alias("rk"), "text")


ANCHOR_SCHEMA = "id long, rk long, anchor long, context long, low int, n int"


def anchor_rows(rows: DataFrame, units: Callable[[pa.Array], Units], gram: int, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            found = units(b.column(2)).anchors(gram, window)
            FIRST.trim(), SECOND.trim()
            if found is not None and len(found[0]):
                text, anchor, context, low, n = found
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), b.column(1).take(pa.array(text)), signed(anchor), signed(context), pa.array(low, pa.int32()), pa.array(n, pa.int32())],
                                                 ["id", "rk", "anchor", "context", "low", "n"])

    return rows.mapInArrow(find, ANCHOR_SCHEMA)


def stretches(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and values of the fields `low` and `n`, of a column of lists of (low, n); null counts as an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)


def covered(ends: np.ndarray, row: np.ndarray, low: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which units of the chunk are in one of the windows that begin at low .. low + n - 1 of their text."""
    steps = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(steps, ends[row] + low, 1)
    np.add.at(steps, ends[row] + low + n - 1 + window, -1)
    return np.cumsum(steps[:-1]) > 0


def units_of(ends: np.ndarray, n: int) -> np.ndarray:
    return text_of(ends, np.arange(n)) if n else np.zeros(0, np.int64)
