"""Splits, samples, folds and balancing of exact sizes, the same at any partitioning.

Rows are ordered by md5(seed|key). A histogram over the first four hex digits finds the bucket that holds each wanted
rank; buckets of over BUCKET_ROWS rows are counted by their next four digits, and so on; only the rows of the last bucket
are sorted to read the exact hash at the cut. Membership is then a comparison with
the cut, so splitting the table itself needs no shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.profile import row_hash

CLASS_BOUND = 10_000
BUCKET_ROWS, DIGITS, HASH_DIGITS = 100_000, 4, 32
COPY_CHUNK = 50_000


def is_classification(df: DataFrame, target: str) -> bool:
    """Not a number, or at most 20 different values."""
    if C.kind(df, target) not in ("numeric", "boolean"):
        return True
    values = df.filter(~C.is_null(df, target)).select(C.col(target)).distinct()
    return values.limit(21).count() <= 20


def hash_order(key: str | list[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[C.col(k).cast("string") for k in keys]))


def repeat_rows(df: DataFrame, copies: Column, number: str) -> DataFrame:
    """Every row `copies` times, numbered from 0. A row with very many copies is spread over tasks in chunks."""
    d = df.withColumn("_copies", copies.cast("long")).filter("_copies > 0")
    few = d.filter(F.col("_copies") <= COPY_CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    many = (d.filter(F.col("_copies") > COPY_CHUNK)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPY_CHUNK)))))
    many = many.repartition(F.col("_chunk")).withColumn(number, F.explode(F.sequence(
        F.col("_chunk") * COPY_CHUNK, F.least((F.col("_chunk") + 1) * COPY_CHUNK, F.col("_copies")) - 1))).drop("_chunk")
    return few.unionByName(many).drop("_copies")


def with_row_key(df: DataFrame, name: str = "_key") -> DataFrame:
    """A unique key from the row content; exact copies are merged, counted and numbered, so each keeps its own key."""
    counted = df.groupBy(*[C.col(c) for c in df.columns]).agg(F.count("*").alias("_m"))
    h1, h2 = row_hash(df)
    keyed = counted.withColumn("_id", F.concat(F.hex(h1), F.hex(h2)))
    numbered = repeat_rows(keyed, F.col("_m"), "_copy")
    return numbered.select(*[C.col(c) for c in df.columns], F.concat_ws("|", "_id", "_copy").alias(name))


def narrowed(keyed: DataFrame, marks: DataFrame, digits: int) -> DataFrame:
    """The marks within buckets of DIGITS more digits; a bucket has at most 16**DIGITS of these."""
    inner = keyed.select("_c", F.substring("_h", 1, digits).alias("_p"), F.substring("_h", 1, digits + DIGITS).alias("_q"))
    cells = inner.join(marks.select("_c", "_p").distinct(), ["_c", "_p"], "left_semi").groupBy("_c", "_p", "_q").agg(F.count("*").alias("_k"))
    start = F.sum("_k").over(Window.partitionBy("_c", "_p").orderBy("_q")) - F.col("_k")
    return (cells.withColumn("_start", start).join(marks.select("_c", "_p", "_i", "_want"), ["_c", "_p"])
            .filter((F.col("_want") > F.col("_start")) & (F.col("_want") <= F.col("_start") + F.col("_k")))
            .select("_c", F.col("_q").alias("_p"), "_i", (F.col("_want") - F.col("_start")).alias("_want"), "_k"))


def bands(df: DataFrame, key, seed: int, by: str | None, ranks: list) -> DataFrame:
    """Adds `_band` (how many of the wanted ranks lie below the row) and `_n` (rows of its class).

    `ranks` are functions of the class size that give non-decreasing row counts. The key must be unique.
    """
    keyed = df.withColumn("_h", hash_order(key, seed)).withColumn("_c", C.col(by).cast("string") if by else F.lit("all"))
    cells = keyed.groupBy("_c", F.substring("_h", 1, DIGITS).alias("_p")).agg(F.count("*").alias("_k")).persist()
    sizes = cells.groupBy("_c").agg(F.sum("_k").alias("_n"))
    bounded = sizes.limit(CLASS_BOUND + 1).count() <= CLASS_BOUND
    w = Window.partitionBy("_c").orderBy("_p")
    placed = (cells.withColumn("_start", F.sum("_k").over(w) - F.col("_k"))
              .withColumn("_n", F.sum("_k").over(Window.partitionBy("_c"))))
    marks = (placed.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(F.col("_n")).cast("long").alias("r"))
                                                    for i, f in enumerate(ranks)])).alias("m"))
             .filter((F.col("m.r") > F.col("_start")) & (F.col("m.r") <= F.col("_start") + F.col("_k")))
             .select("_c", "_p", F.col("m.i").alias("_i"), (F.col("m.r") - F.col("_start")).alias("_want"), "_k"))
    spark, digits = df.sparkSession, DIGITS

    def settled(found: DataFrame) -> tuple[DataFrame, bool]:
        """The marks, in the plan if they are few, and whether a bucket is still too large."""
        if not bounded:
            found = found.persist()
            return found, found.filter(F.col("_k") > BUCKET_ROWS).limit(1).count() > 0
        rows = found.collect()
        return F.broadcast(spark.createDataFrame(rows, "_c string, _p string, _i int, _want long, _k long")), any(r["_k"] > BUCKET_ROWS for r in rows)

    marks, large = settled(marks)
    while large and digits < HASH_DIGITS:
        marks, large = settled(narrowed(keyed, marks, digits))
        digits += DIGITS
    marks = marks.drop("_k")
    if bounded:
        sizes = spark.createDataFrame(sizes.collect(), "_c string, _n long")
        cells.unpersist()
    at = (keyed.select("_c", "_h", F.substring("_h", 1, digits).alias("_p")).join(F.broadcast(marks) if bounded else marks, ["_c", "_p"])
          .withColumn("_r", F.row_number().over(Window.partitionBy("_c", "_p", "_i").orderBy("_h"))).filter("_r = _want")
          .groupBy("_c").agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_cut{i}") for i in range(len(ranks))]))
    if bounded:
        at = spark.createDataFrame(at.collect(), at.schema)
    info = sizes.join(at, "_c", "left")
    out = keyed.join(F.broadcast(info) if bounded else info, "_c")
    band = sum((F.when(F.col("_h") > F.coalesce(F.col(f"_cut{i}"), F.lit("")), 1).otherwise(0) for i in range(1, len(ranks))),
               F.when(F.col("_h") > F.coalesce(F.col("_cut0"), F.lit("")), 1).otherwise(0))
    return out.select(*[C.col(c) for c in df.columns], band.alias("_band"), F.col("_n"))


@dataclass
class Split:
    train: DataFrame
    val: DataFrame | None
    test: DataFrame
    notes: list = field(default_factory=list)


def assign_split(df: DataFrame, target: str | None = None, test_pct: float = 20, val_pct: float = 0, seed: int = 42,
                 stratify: bool = True, key=None) -> DataFrame:
    """Adds `_split` (test, val or train); rows without a target are left out. Sizes per class are round(n * pct / 100)."""
    if target in df.columns:
        df = df.filter(~C.is_null(df, target))
    cols, work = df.columns, df
    if key is None:
        work, key = with_row_key(df), "_key"
    by = target if stratify and target in cols and is_classification(df, target) else None
    test = lambda n: F.bround(n * float(test_pct) / 100.0)
    both = lambda n: test(n) + F.bround(n * float(val_pct) / 100.0)
    placed = bands(work, key, seed, by, [test, both])
    name = F.when(F.col("_band") == 0, "test").when(F.col("_band") == 1, "val").otherwise("train")
    return placed.select(*[C.col(c) for c in cols], name.alias("_split"))


def split_frame(df: DataFrame, target: str | None = None, test_pct: float = 20, val_pct: float = 0, seed: int = 42,
                stratify: bool = True, key=None) -> Split:
    """Disjoint train, validation (None when empty) and test sets; raises when train or test would be empty."""
    notes = []
    if target in df.columns:
        gaps = df.filter(C.is_null(df, target)).count()
        if gaps:
            notes.append(f"removed {gaps} row(s) with a missing target before splitting")
    placed = assign_split(df, target, test_pct, val_pct, seed, stratify, key)
    sizes = {r["_split"]: r["count"] for r in placed.groupBy("_split").count().collect()}
    if not sizes.get("train") or not sizes.get("test"):
        raise ValueError("the split left an empty train or test set; use smaller percentages or more rows")
    part = {n: placed.filter(F.col("_split") == n).drop("_split") for n in ("train", "val", "test")}
    notes.append(f"train {sizes['train']:,} / " + (f"validation {sizes['val']:,} / " if "val" in sizes else "") + f"test {sizes['test']:,}")
    return Split(part["train"], part["val"] if "val" in sizes else None, part["test"], notes)


def balance_train(train: DataFrame, target: str, how: str, seed: int = 42, key=None) -> DataFrame:
    """Oversample to the largest class or undersample to the smallest. For TRAIN only.

    Oversampling repeats every row of a class equally often, and the first rows by hash once more.
    """
    if how == "None" or target not in train.columns:
        return train
    cols, work = train.columns, train.filter(~C.is_null(train, target))
    if key is None:
        work, key = with_row_key(work), "_key"
    r = work.groupBy(C.col(target)).count().agg(F.max("count").alias("hi"), F.min("count").alias("lo")).first()
    if how.startswith("Over"):
        high = r["hi"]
        placed = bands(work, key, seed, target, [lambda n: F.lit(high) % n])
        copies = F.floor(F.lit(high) / F.col("_n")) + F.when(F.col("_band") == 0, 1).otherwise(0)
        return repeat_rows(placed, copies, "_copy").select(*[C.col(c) for c in cols])
    placed = bands(work, key, seed, target, [lambda n: F.lit(r["lo"])])
    return placed.filter("_band = 0").select(*[C.col(c) for c in cols])


def sample_rows(df: DataFrame, n: int, seed: int = 0, key=None) -> DataFrame:
    """Exactly min(n, rows) rows, the first by hash."""
    cols, work = df.columns, df
    if key is None:
        work, key = with_row_key(df), "_key"
    return bands(work, key, seed, None, [lambda size: F.lit(n)]).filter(
        (F.col("_band") == 0) | (F.col("_n") <= n)).select(*[C.col(c) for c in cols])


def class_sample(df: DataFrame, n: int, target: str | None = None, seed: int = 0, key=None) -> DataFrame:
    """About n rows that keep the class mix; small classes keep at least 50 rows. A second cut applies above 1.1 n."""
    rows = df.count()
    if rows <= n:
        return df
    if target not in df.columns or not is_classification(df, target):
        return sample_rows(df, n, seed, key)
    cols, work = df.columns, df.filter(~C.is_null(df, target))
    if key is None:
        work, key = with_row_key(work), "_key"
    take = lambda size: F.least(size, F.greatest(F.least(size, F.lit(50)), F.bround(size * float(n) / rows)))
    kept = bands(work, key, seed, target, [take]).filter("_band = 0").select(*[C.col(c) for c in work.columns])
    total = work.groupBy(C.col(target)).count().agg(F.sum(take(F.col("count")))).first()[0]
    if total > n * 1.1:
        kept = sample_rows(kept, n, seed, key)
    return kept.select(*[C.col(c) for c in cols])


def folds(df: DataFrame, k: int, seed: int = 42, target: str | None = None, key=None) -> DataFrame:
    """Adds `_fold` 0..k-1, even in size; within each class when the target has classes."""
    cols, work = df.columns, df
    if key is None:
        work, key = with_row_key(df), "_key"
    by = target if target in cols and is_classification(df, target) else None
    cuts = [(lambda n, i=i: F.floor(n * i / k)) for i in range(1, k)]
    return bands(work, key, seed, by, cuts).select(*[C.col(c) for c in cols], F.col("_band").alias("_fold"))


def robust_extremes(df: DataFrame, target: str, keep: list[str], top: int = 10) -> DataFrame:
    """Rows whose target lies more than 3.5 robust deviations from the median, the furthest first."""
    from millrace.operators.quantiles import exact_quantiles
    y = C.as_numeric(df, target)
    mid = exact_quantiles(df, {"y": y}, [0.5])["y"][0]
    mad = exact_quantiles(df, {"d": F.abs(y - F.lit(mid))}, [0.5])["d"][0] if mid is not None else None
    z = F.lit(0.6745) * (y - F.lit(mid)) / F.lit(mad) if mad else F.lit(0.0)
    return (df.select(*[C.col(c) for c in keep], z.alias("robust_z")).filter(F.abs("robust_z") > 3.5)
            .orderBy(F.desc(F.abs("robust_z")), *keep).limit(top))
