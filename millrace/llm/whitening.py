"""Embedding whitening (PCA) with MLlib block matrices.

Distinct vectors are numbered, centred and laid out as a BlockMatrix of `block_rows` rows a block. Its transpose times
itself is the scatter matrix, a table of width x width numbers that the driver decomposes (numpy eigh); a second block
product with the whitening matrix projects every distinct vector. Rows then fetch the projection of their vector.

Both products run over the blocks' own partitions: the inner dimension of the scatter product is split, so its blocks
are multiplied where they are dealt to and only width x width partial sums meet. Distinct vectors are numbered by
ranges of their hash, copies of a vector are counted before anything is shuffled, and rows of a very frequent vector are
dealt out over all tasks when they fetch their projection. The driver holds the sums and the scatter matrix: their size
follows the vectors' width, not the rows.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped; so are rows of another
length than the most frequent one (ties: the longest), and empty vectors; repeated rows and null vec_ids are kept, each
with the results of its vector; entries times 256 outside 64 bits are held at the nearest long; a deviation beyond 64
bits is null; components without variance (eigenvalue of at most width * 2**-52 of the largest) do not exist, so one
distinct vector gives no rows, and neither does an empty table; equal eigenvalues share their space in any orthonormal
basis, the same for all rows. Other columns of the table are left aside.
"""
from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

#: Rows of a block, columns of a block, distinct vectors of one number range, blocks that one task multiplies.
BLOCK_ROWS, BLOCK_COLS, RANGE_ROWS, TASK_BLOCKS = 2048, 1024, 10_000, 8
OUT_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
EXACT = "decimal(38,0)"


class Whitening(NamedTuple):
    """n vectors with exact sums; columns of `vectors` are unit eigenvectors, by falling eigenvalue; trace of the covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, h, x: the vectors as whole numbers floor(256 c), without those that cannot be used."""
    cells = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    cells = cells.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)))
    size = cells.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    cells = cells.filter(F.size("v") == (size["width"] if size else 0))
    x = cells.select("vec_id", F.transform("v", lambda c: F.floor(c * 256) + F.lit(0).cast("long")).alias("x"))
    return x.select("vec_id", F.xxhash64("x").alias("h"), "x")


def numbered(rows: DataFrame) -> DataFrame:
    """index, h, x, copies: each distinct vector once, numbered without gaps."""
    ranges = max(1, rows.count() // RANGE_ROWS)
    once = rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("part", F.pmod("h", F.lit(ranges)))
    once = common.stored(once, "whitening-distinct")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = once.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("h", "x")
    placed = once.withColumn("place", F.row_number().over(inside) - 1).join(offsets, "part")
    return common.stored(placed.select((F.col("place") + F.col("before")).cast("long").alias("index"), "h", "x", "copies"), "whitening-fit")


def exact_sums(fit: DataFrame) -> list[int]:
    cells = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(EXACT)).alias("s"))
    return [int(r["s"]) for r in cells.orderBy("at").collect()]


def blocks_of(rows: DataFrame, count: int, width: int, block_rows: int) -> BlockMatrix:
    """A block matrix of the rows (index long, row array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, count, width).toBlockMatrix(block_rows, BLOCK_COLS)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(index long, row array<double>), made from the blocks without a detour over Python workers."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    index, vector = rows.columns
    return MLUtils.convertVectorColumnsToML(rows, vector).select(F.col(index).cast("long").alias("index"), vector_to_array(F.col(vector)).alias("row"))


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left * right; the inner dimension is cut in `splits` parts that are multiplied apart and then added."""
    wrapped = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(wrapped, left.rowsPerBlock, right.colsPerBlock)


def fit_whitening(blocks: BlockMatrix, n: int, sums: list[int], block_rows: int) -> Whitening:
    parts = -(-n // block_rows)
    scatter = product(blocks.transpose(), blocks, max(1, parts // TASK_BLOCKS)).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(values[0], 0.0) * len(values) * 2.0 ** -52
    return Whitening(n, sums, values[real], vectors[:, real], float(np.trace(covariance)))


def whiten(rows: DataFrame, components: int | None = 4, vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Whitening | None, float | None]:
    """(vec_id, n, deviation, whitened array, one value a component) for every usable row, the fitted whitening, and the
    largest absolute entry of the whitened covariance minus the identity. components None: all that have variance."""
    spark = rows.sparkSession
    rows = usable(rows, vector)
    fit = numbered(rows)
    n = fit.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>"), None, None
    sums = exact_sums(fit)
    width = len(sums)
    exact = F.expr("array(" + ", ".join(f"CAST('{s}' AS {EXACT})" for s in sums) + ")")
    means = F.lit([float(Fraction(s, n)) for s in sums])
    centred = fit.select("index", F.zip_with("x", means, lambda a, m: a - m).alias("row"))
    blocks = blocks_of(centred, n, width, block_rows)
    found = fit_whitening(blocks, n, sums, block_rows)
    kept = len(found.values) if components is None else min(components, len(found.values))
    if not kept:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, whitened array<double>"), found, None
    matrix = found.vectors[:, :kept] / np.sqrt(found.values[:kept])
    weights = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(matrix)], "index long, row array<double>")
    projected = common.stored(rows_of(product(blocks, blocks_of(weights, width, kept, BLOCK_COLS))), "whitening-projected")
    p = [F.col("row")[i] for i in range(kept)]
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    seen = projected.agg(*[F.covar_pop(p[i], p[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    times = F.lit(str(n)).cast(EXACT)
    apart = F.zip_with("x", exact, lambda a, s: F.try_subtract(F.try_multiply(times, a.cast(EXACT)), s).cast(EXACT))
    deviation = F.aggregate(apart, F.lit(0).cast(EXACT), lambda total, v: F.try_add(total, F.try_multiply(v, v).cast(EXACT)).cast(EXACT))
    each = fit.join(projected, "index").select("h", "x", "copies", deviation.try_cast("long").alias("deviation"), F.col("row").alias("whitened"))
    out = common.join_hot(rows, common.stored(each, "whitening-values"), ["h", "x"], "copies", rows.count())
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened"), found, error


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, found, error = whiten(common.table(spark, folder, "embeddings"))
    if error is None:
        return spark.createDataFrame([], OUT_SCHEMA)
    shares = F.lit([float(e / found.trace) for e in found.values[:4]])
    cells = rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return cells.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
