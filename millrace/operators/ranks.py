"""Order over a whole table without an un-partitioned window.

Rows are dealt out by one range exchange on their order (Spark samples the borders) and written to the shared folder with
the number of their range, so that every later plan, and every recomputed task, sees the same ranges. Running totals inside
a range come from a window over it, totals of the ranges before from a small table of one row for each range. Numbers are
compared by their sortable keys (functions.keys): the two zeros are equal, and whole numbers and decimals exact.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.keys import Numbers
from millrace.session import stored

#: A key is hot when it holds more than one row in so many; so there are never more hot keys than this.
HOT_SHARE = 500
#: Ranks that are broadcast, over all columns, and columns of more values that rows may fetch one after the other.
FEW_RANKS, ALONE = 100_000, 2


def placed(table: DataFrame, order: list[str], name: str = "ordered") -> DataFrame:
    """The table in ranges of `order`, numbered by `part`. Rows that agree in all of `order` share a range."""
    return stored(table.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def totals_before(table: DataFrame, totals: list[str], by: tuple[str, ...] = ("k",), value: str = "key") -> DataFrame:
    """Adds `<t>_before` to a table of one row for each (by, value): the sum of t over smaller values within `by`."""
    ranges = placed(table, [*by, value])
    inside = Window.partitionBy("part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranges.groupBy("part", *by).agg(*[F.sum(t).alias(f"{t}_sum") for t in totals])
               .select("part", *by, *[F.coalesce(F.sum(f"{t}_sum").over(earlier), F.lit(0)).alias(f"{t}_off") for t in totals]))
    out = ranges.select("*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"{t}_in") for t in totals]).join(offsets, ["part", *by])
    return out.select(*table.columns, *[(F.col(f"{t}_in") + F.col(f"{t}_off")).alias(f"{t}_before") for t in totals])


def join_often(left: DataFrame, right: DataFrame, keys: list[str], often: str, rows: int) -> DataFrame:
    """Inner join of many rows with a table of one row for each key, `often` being the rows of `left` with that key.

    Keys of over a 500th of all `rows` are at most 500: that part of `right` is broadcast, so their rows stay where they are.
    The other keys are joined by a shuffle, in which none is large.
    """
    hot = F.col(often) > max(1, rows // HOT_SHARE)
    common = right.filter(hot).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in right.columns if c not in keys], F.lit(True).alias("hot"))
    marked = left.join(F.broadcast(common), keys, "left")
    names = [c for c in right.columns if c not in keys]
    here = marked.filter("hot").select(*left.columns, *[F.col(f"hot_{c}").alias(c) for c in names])
    return here.unionByName(marked.filter("hot is null").select(*left.columns).join(right.filter(~hot), keys))


def average_ranks(df: DataFrame, expr: Column) -> DataFrame:
    """(value, n, rank): 1-based rank of every distinct value, ties sharing their average."""
    numbers = Numbers(df, [expr], [expr.alias("value")])
    counts = numbers.rows().groupBy("k", "key").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    ranked = totals_before(counts, ["n"])
    value = F.col("value") + 0.0 if dict(counts.dtypes)["value"] in ("double", "float") else F.col("value")
    return ranked.select(value.alias("value"), "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def value_counts_before(df: DataFrame, exprs: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """(k, key, n, sums, n_before): the distinct values of all columns with their rows, the sums of the named expressions
    over them, and the rows of smaller values. Three exchanges, whatever the number of columns."""
    sums = sums or {}
    numbers = Numbers(df, exprs, [x.alias(c) for c, x in sums.items()])
    counts = numbers.rows().groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return totals_before(counts, ["n"])


def row_ranks(df: DataFrame, exprs: list[Column], dense: bool = False) -> DataFrame:
    """(row, r0, r1, ...) with the average rank (or the dense rank, from 0) of each value in its column; null where there is none.

    The distinct keys of all columns are ranked in one range exchange. Columns of few values look theirs up in a broadcast, all in one
    step, so their rows stay where they are; up to ALONE columns of more values in a join each, in which frequent keys stay in place. Beyond
    that all are folded to (row, column, key), fetch their ranks in one join and are put together by row again, so the
    number of exchanges does not follow the number of columns.
    """
    cols = range(len(exprs))
    wide = stored(Numbers(df, exprs).wide().withColumn("row", F.monotonically_increasing_id()), "rows")
    wide = wide.filter(F.coalesce(*[F.col(f"c{i}") for i in cols]).isNotNull())
    folded = wide.select("row", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"c{i}").alias("key")) for i in cols])).alias("x")).select("row", "x.*").filter("key is not null")
    counts = folded.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    if dense:
        ranked = totals_before(counts, ["one"]).select("k", "key", "n", F.col("one_before").cast("double").alias("rank"))
    else:
        ranked = totals_before(counts, ["n"]).select("k", "key", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))
    ranked = stored(ranked, "ranked")
    sizes = {r["k"]: (r["values"], r["rows"]) for r in ranked.groupBy("k").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).collect()}
    few, room = [], FEW_RANKS
    for i in sorted(cols, key=lambda i: sizes.get(i, (0, 0))):
        room -= sizes.get(i, (0, 0))[0]
        if room >= 0:
            few.append(i)
    many = [i for i in cols if i not in few]
    if len(many) > ALONE:
        found = join_often(folded, ranked, ["k", "key"], "n", sum(n for _, n in sizes.values()))
        return found.groupBy("row").agg(*[F.max(F.when(F.col("k") == i, F.col("rank"))).alias(f"r{i}") for i in cols])
    rows = ranked.filter(F.col("k").isin(few)).select("k", "key", "rank").collect()
    found = np.array([r["k"] for r in rows], int), np.array([r["key"] for r in rows], np.int64), np.array([r["rank"] for r in rows], float)
    out, kept = wide, wide.columns
    for i in many:
        own, kept = ranked.filter(F.col("k") == i).select(F.col("key").alias(f"c{i}"), F.col("rank").alias(f"r{i}"), "n"), [*kept, f"r{i}"]
        here = join_often(out.filter(F.col(f"c{i}").isNotNull()), own, [f"c{i}"], "n", sizes[i][1]).select(*kept)
        out = here.unionByName(out.filter(F.col(f"c{i}").isNull()).withColumn(f"r{i}", F.lit(None).cast("double")))
    if few:
        out = look_up(out, {i: tuple(x[found[0] == i] for x in found[1:]) for i in few})
    return out.select("row", *[f"r{i}" for i in cols])


def look_up(wide: DataFrame, ranks: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds r<i>, the rank of the key in c<i>, for each column number of `ranks`: its keys and their ranks, all in memory."""
    ordered = {i: (keys[at], rank[at]) for i, (keys, rank) in ranks.items() for at in [np.argsort(keys)]}
    sent = wide.sparkSession.sparkContext.broadcast(ordered)
    names = [*wide.columns, *[f"r{i}" for i in ranks]]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for i, (keys, rank) in sent.value.items():
                c = b.column(b.schema.get_field_index(f"c{i}"))
                if not len(keys):
                    new.append(pa.nulls(len(c), pa.float64()))
                    continue
                at = np.searchsorted(keys, c.fill_null(int(keys[0])).to_numpy(zero_copy_only=False))
                new.append(pa.array(rank[at], pa.float64(), mask=c.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names)

    return wide.mapInArrow(fetch, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in wide.schema], *[f"r{i} double" for i in ranks]]))


def previous_values(table: DataFrame, value: str) -> DataFrame:
    """Adds `previous`: the next smaller value of a table of distinct values, across range borders."""
    ranges = placed(table, [value])
    out = ranges.withColumn("previous", F.lag(value).over(Window.partitionBy("part").orderBy(value)))
    tops = ranges.groupBy("part").agg(F.max(value).alias("top"))
    tops = tops.select("part", F.lag("top").over(Window.orderBy("part")).alias("before"))
    return out.join(tops, "part").select(*table.columns, F.coalesce("previous", "before").alias("previous"))


def row_index(df: DataFrame, order: Column, tie: Column, out: str = "row_index") -> DataFrame:
    """0-based position of every row by (order, tie); `order` and `tie` are together unique. A value of `order` that many
    rows share is split over ranges by `tie`."""
    keyed = df.select("*", order.alias("_o"), tie.alias("_t"))
    keyed = keyed.withColumns({c: F.col(c) + 0.0 for c in ("_o", "_t") if dict(keyed.dtypes)[c] in ("double", "float")})
    ranges = placed(keyed, ["_o", "_t"])
    local = Window.partitionBy("part").orderBy("_o", "_t")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_off"))
    ranked = ranges.withColumn(out, F.row_number().over(local) - 1).join(sizes, "part")
    return ranked.select(*df.columns, (F.col(out) + F.col("_off")).cast("long").alias(out))
