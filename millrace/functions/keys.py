"""One sortable 64-bit number for every numeric value.

Equal values have equal keys and smaller values smaller keys, so ranges, histograms and ties can be decided on longs:
the two zeros are one value, whole numbers beyond 2**53 stay apart, and decimals are not rounded to doubles.
"""
from __future__ import annotations

import functools
import math
import struct
from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of a decimal that surely fit a long.
LONG_DIGITS = 18
#: Ranges, over all expressions, up to which values are compared with each by an expression.
FEW_RANGES = 12
Number = int | float | Fraction


def with_double_keys(df: DataFrame, names: list[str]) -> DataFrame:
    """Each of the named double columns replaced by its bits, as a long in the order of the values; null for null and NaN.

    Sign aside, the order of doubles is that of (exponent, fraction); negative values take the negative of that number, so
    both zeros are 0. The power of two below a value comes from a logarithm, put right where that falls beside it. One
    projection for each step, so nothing is computed twice.
    """
    if not names:
        return df
    rest = [c for c in df.columns if c not in names]
    x, a, p = ({n: F.col(f"{kind}_{n}") for n in names} for kind in "xap")
    steps = df.select(*rest, *[F.col(n).alias(f"x_{n}") for n in names], *[F.abs(n).alias(f"a_{n}") for n in names])
    clipped = {n: F.least(F.greatest(a[n], F.lit(2.0 ** -1022)), F.lit(2.0 ** 1023)) for n in names}
    steps = steps.select(*rest, *x.values(), *a.values(), *[F.pow(F.lit(2.0), F.floor(F.log2(clipped[n])).cast("double")).alias(f"p_{n}") for n in names])
    right = {n: F.when(a[n] < p[n], F.when(p[n] > 2.0 ** -1022, p[n] / 2).otherwise(p[n])).when(a[n] >= p[n] * 2, p[n] * 2).otherwise(p[n]) for n in names}
    steps = steps.select(*rest, *x.values(), *a.values(), *[right[n].alias(f"p_{n}") for n in names])

    def bits(n: str) -> Column:
        # below the smallest normal number a double is a multiple of 2**-1074
        small = (a[n] * (2.0 ** 537) * (2.0 ** 537)).cast("long")
        whole = F.shiftleft((F.round(F.log2(p[n])) + 1023).cast("long"), 52) + ((a[n] / p[n] - 1) * (2.0 ** 52)).cast("long")
        size = F.when(a[n] < 2.0 ** -1022, small).when(a[n] == float("inf"), F.lit(0x7FF << 52)).otherwise(whole)
        return F.when(~F.isnan(x[n]), F.when(x[n] < 0, -size).otherwise(size)).alias(n)

    return steps.select(*[bits(n) if n in names else F.col(n) for n in df.columns])


def double_of(key: int) -> float:
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


class Numbers:
    """Numeric expressions of a table, folded to rows (k, key, extra columns): k is the position of the expression.

    Whole numbers, booleans and decimals keep their exact value, floats count by their bits. Decimals of more than 18 digits
    count from the smallest value of their column; a column whose values lie more than 18 digits apart, or use all 38, is
    taken as doubles. number[k] turns a key of column k back into a value.
    """

    def __init__(self, df: DataFrame, exprs: list[Column], extra: list[Column] = ()):
        self.plain = df.select(*extra, *[x.alias(f"c{i}") for i, x in enumerate(exprs)])
        self.extra = self.plain.columns[:len(self.plain.columns) - len(exprs)]
        kinds = [self.plain.schema[f"c{i}"].dataType for i in range(len(exprs))]
        wide = [i for i, t in enumerate(kinds) if isinstance(t, T.DecimalType) and t.precision > LONG_DIGITS]
        ends = self.plain.agg(*[f(f"c{i}").alias(f"{f.__name__}{i}") for i in wide for f in (F.min, F.max)]).first() if wide else None
        self.cells: list[tuple[Column, Column]] = []
        self.number: list[Callable[[int], Number]] = []
        for i, t in enumerate(kinds):
            c = F.col(f"c{i}")
            exact: tuple[Column, Callable] | None = None
            if isinstance(t, (T.IntegralType, T.BooleanType)):
                exact = c.cast("long"), int
            elif isinstance(t, T.DecimalType):
                exact = _units(c, t, *((ends[f"min{i}"], ends[f"max{i}"]) if i in wide else (None, None)))
            self.cells.append((exact[0], F.lit(None).cast("double")) if exact else (F.lit(None).cast("long"), F.nanvl(c.cast("double"), F.lit(None).cast("double"))))
            self.number.append(exact[1] if exact else double_of)
        self.exact = [n is not double_of for n in self.number]

    def least_key(self, k: int, value: float) -> int:
        """The smallest key of column k whose value is not below `value`."""
        if not self.exact[k]:
            bits = struct.unpack("<q", struct.pack("<d", abs(value)))[0]
            return -bits if value < 0 else bits
        start, step = Fraction(self.number[k](0)), Fraction(self.number[k](1)) - Fraction(self.number[k](0))
        return math.ceil((Fraction(value) - start) / step)

    def wide(self) -> DataFrame:
        """The extra columns and the key of each expression as c0, c1, ..., null where there is no value."""
        keyed = self.plain.select(*self.extra, *[(whole if exact else real).alias(f"c{i}") for i, ((whole, real), exact) in enumerate(zip(self.cells, self.exact))])
        return with_double_keys(keyed, [f"c{i}" for i, exact in enumerate(self.exact) if not exact])

    def rows(self, within: dict[int, list[tuple[int, int]]] | None = None) -> DataFrame:
        """One row for each value; `within` keeps only the named columns, and of those the keys in the given ranges (both
        ends belong to a range). Values outside are dropped before anything is unfolded."""
        merged = {i: _merged(ranges) for i, ranges in (within or {}).items()}
        if sum(map(len, merged.values())) <= FEW_RANGES:
            structs = []
            for i, (whole, real) in enumerate(self.cells):
                x, at = (whole, int) if self.exact[i] else (real, double_of)
                here = x.isNotNull()
                if within is not None:
                    if i not in within:
                        continue
                    here &= functools.reduce(lambda p, q: p | q, [(x >= at(a)) & (x <= at(b)) for a, b in merged[i]])
                structs.append(F.when(here, F.struct(F.lit(i).alias("k"), whole.alias("whole"), real.alias("real"))))
            long = self.plain.select(*self.extra, F.explode(F.array(*structs)).alias("x")).filter("x is not null").select(*self.extra, "x.k", "x.whole", "x.real")
        else:
            long = self._inside(merged)
        if not all(self.exact):
            long = with_double_keys(long, ["real"])
        return long.select(*self.extra, "k", F.coalesce("whole", F.col("real").cast("long")).alias("key"))

    def _inside(self, within: dict[int, list[tuple[int, int]]]) -> DataFrame:
        """(extra columns, k, whole, real) of the values in the given ranges, none of which touch. They are searched in each
        Arrow batch: as an expression, some dozens of comparisons are too much code to be compiled."""
        ends = {}
        for i, ranges in within.items():
            at, kind = (int, np.int64) if self.exact[i] else (double_of, float)
            ends[i] = tuple(np.array([at(end) for end in side], kind) for side in zip(*ranges))
        exact, names = self.exact, [*self.extra, "k", "whole", "real"]
        wide = self.plain.select(*self.extra, *[(self.cells[i][0] if exact[i] else self.cells[i][1]).alias(f"c{i}") for i in ends])
        first = len(self.extra)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for c, (i, (low, high)) in zip(b.columns[first:], ends.items()):
                    x = c.fill_null(0).to_numpy(zero_copy_only=False)
                    place = np.searchsorted(low, x, side="right") - 1
                    inside = (place >= 0) & (x <= high[place]) & c.is_valid().to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(inside)
                    if len(rows):
                        none = pa.nulls(len(rows), pa.float64() if exact[i] else pa.int64())
                        both = (pa.array(x[rows]), none) if exact[i] else (none, pa.array(x[rows]))
                        yield pa.RecordBatch.from_arrays([*[e.take(pa.array(rows)) for e in b.columns[:first]], pa.array(np.full(len(rows), i, np.int32)), *both], names)

        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.plain.select(*self.extra).schema]
        return wide.mapInArrow(search, ", ".join([*kept, "k int", "whole long", "real double"]))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _units(c: Column, t: T.DecimalType, low: Decimal | None, high: Decimal | None) -> tuple[Column, Callable[[int], Number]] | None:
    """A decimal in units of its last digit, counted from `low`; None where that does not fit a long."""
    unit = Fraction(1, 10 ** t.scale)
    if low is not None:
        digits = len(str(int(max(abs(low), abs(high))))) + t.scale
        if digits > 37 or (Fraction(high) - Fraction(low)) / unit >= 10 ** LONG_DIGITS:
            return None
        own = f"decimal({digits},{t.scale})"
        c = c.cast(own) - F.lit(str(low)).cast(own)
    start = Fraction(low or 0)
    return (c * F.lit(str(10 ** t.scale)).cast(f"decimal({t.scale + 1},0)")).cast("long"), lambda key: start + unit * key


def between(a: Number, b: Number, share: float) -> float:
    """a + (b - a) * share, without rounding before the end where a and b are exact."""
    if isinstance(a, float):
        return a + (b - a) * share
    return float(a + (b - a) * Fraction(share))
