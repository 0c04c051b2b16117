"""Exact quantiles of many columns together, by one plan at any size.

Values are taken as sortable longs (functions.keys). The first round counts them by their leading bits, for all columns in
one map-side aggregation; each cell also brings its smallest and largest key. Only cells that hold a wanted rank stay
open, and the next round cuts them by their next bits, finely enough that all cells together stay below CELLS. A cell
whose smallest and largest keys agree is settled, so a repeated value ends its own search, and the bits of a long run out:
a round always narrows what is open. Once the open cells hold few rows the last round counts whole keys.
"""
from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import Number, Numbers, between

#: Bits of a long that the first round leaves aside (sign, exponent and four bits of the fraction count), and the number of
#: cells that a round may bring to the driver over all columns.
FIRST_SHIFT, CELLS = 48, 50_000


def folded(df: DataFrame, exprs: dict[str, Column], nulls: bool = False, weight: str | None = None) -> DataFrame:
    """(k, v[, w]): one row per column and row, k being the position of the column."""
    extra = [F.col(weight).alias("w")] if weight else []
    cells = F.array(*[F.struct(F.lit(i).alias("k"), x.cast("double").alias("v")) for i, x in enumerate(exprs.values())])
    long = df.select(F.explode(cells).alias("x"), *extra).select("x.k", "x.v", *(["w"] if weight else []))
    return long if nulls else long.filter("v is not null")


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float], weight: str | None = None) -> dict[str, list]:
    """Linearly interpolated quantiles per named numeric expression; None where the expression is all NULL."""
    if not exprs:
        return {}
    numbers = _numbers(df, list(exprs.values()), weight)
    found = _search(numbers, {i: probs for i in range(len(exprs))})
    out: dict[str, list] = {}
    for i, c in enumerate(exprs):
        total, values = found.get(i, (0, {}))
        places = [(total - 1) * p for p in probs] if total else []
        out[c] = [between(values[math.floor(h)], values[math.ceil(h)], h - math.floor(h)) for h in places] or [None] * len(probs)
    return out


def order_statistics(df: DataFrame, expr: Column, ranks: list[int], weight: str | None = None) -> dict[int, Number]:
    """Values at 0-based ranks of the sorted non-null values."""
    return _search(_numbers(df, [expr], weight), {}, {0: set(ranks)})[0][1] if ranks else {}


def _numbers(df: DataFrame, exprs: list[Column], weight: str | None) -> Numbers:
    """Infinite values stay, NaN and rows without weight do not count."""
    if weight:
        return Numbers(df.filter(F.col(weight) > 0), exprs, [F.col(weight).cast("long").alias("w")])
    return Numbers(df, exprs)


class Open(NamedTuple):
    """Keys low .. high hold `n` values, of which the first has the rank `start`; `wanted` are ranks among them."""
    low: int
    high: int
    start: int
    n: int
    wanted: list[int]


def _counts(numbers: Numbers, shifts: dict[int, int], within: dict[int, list[tuple[int, int]]] | None) -> dict[int, list[tuple[int, int, int]]]:
    """For each column its cells (smallest key, largest key, weight), in order."""
    rows = numbers.rows(within)
    cut = F.coalesce(*[F.when(F.col("k").isin([i for i, s in shifts.items() if s == shift]), F.shiftright("key", shift)) for shift in sorted(set(shifts.values()))])
    weight = F.sum("w") if "w" in numbers.extra else F.count(F.lit(1))
    cells = rows.groupBy("k", cut.alias("cell")).agg(weight.alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    out: dict[int, list[tuple[int, int, int]]] = {}
    for r in cells:
        out.setdefault(r["k"], []).append((r["a"], r["b"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def _search(numbers: Numbers, probs: dict[int, list[float]], ranks: dict[int, set[int]] | None = None) -> dict[int, tuple[int, dict[int, Number]]]:
    """For each column with values: their weight, and the values at the wanted ranks (those around each probability)."""
    first = _counts(numbers, {i: FIRST_SHIFT for i in range(len(numbers.number))}, None)
    out: dict[int, tuple[int, dict[int, Number]]] = {}
    open_: dict[int, list[Open]] = {}
    for i, cells in first.items():
        total = sum(n for *_, n in cells)
        out[i] = (total, {})
        wanted = ranks[i] if ranks else {r for p in probs[i] for r in (math.floor((total - 1) * p), math.ceil((total - 1) * p))}
        _settle(out[i][1], open_.setdefault(i, []), cells, 0, sorted(wanted), numbers.number[i])
    while open_ := {i: pieces for i, pieces in open_.items() if pieces}:
        pieces = sum(map(len, open_.values()))
        few = sum(p.n for own in open_.values() for p in own) <= CELLS
        bits = max(1, int(math.log2(max(2, CELLS // pieces))))
        shifts = {i: 0 if few else max(0, max((p.high - p.low).bit_length() for p in own) - bits) for i, own in open_.items()}
        found = _counts(numbers, shifts, {i: [(p.low, p.high) for p in own] for i, own in open_.items()})
        left: dict[int, list[Open]] = {}
        for i, own in open_.items():
            for piece in own:
                cells = [c for c in found[i] if piece.low <= c[0] <= piece.high]
                _settle(out[i][1], left.setdefault(i, []), cells, piece.start, piece.wanted, numbers.number[i])
        open_ = left
    return out


def _settle(found: dict[int, Number], left: list[Open], cells: Iterable[tuple[int, int, int]], start: int, wanted: list[int], number) -> None:
    """Ranks in cells of a single key, and the first and last rank of any cell, are found; others stay open."""
    for a, b, n in cells:
        inside = [r for r in wanted if start <= r < start + n]
        found.update({r: number(a) for r in inside if a == b or r == start})
        found.update({r: number(b) for r in inside if r == start + n - 1})
        rest = [r for r in inside if r not in found]
        if rest:
            left.append(Open(a, b, start, n, rest))
        start += n
