"""Fingerprints of a table's content, and narrower numeric types without loss."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.counts import distinct_counts
from millrace.operators.profile import row_hash, small_table


def _schema_text(df: DataFrame) -> str:
    return "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def fingerprint(df: DataFrame, rows: int = 500) -> str:
    """Identity from size, schema and the rows with the smallest hashes; the row order does not matter."""
    least = df.select(row_hash(df)[0]).orderBy("h1").limit(rows).collect()
    text = f"{df.count()}|{_schema_text(df)}|" + ",".join(str(r["h1"]) for r in least)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def content_fingerprint(df: DataFrame) -> str:
    """Changes with any cell: order-free sum and xor of two 64-bit hashes of every row, in one pass."""
    r = df.select(*row_hash(df)).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(("h1", "h2")) for n, f in (
        ("x", F.bit_xor), ("s", lambda c: F.sum(F.col(c).cast("decimal(38,0)"))))]).first()
    return hashlib.sha256(f"{_schema_text(df)}|{'|'.join(map(str, r))}".encode()).hexdigest()


def narrow_types(df: DataFrame, float32: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with the narrowest integer types that hold its values (float on request), and the changes."""
    ints = [c for c in df.columns if C.is_integer(df, c)]
    doubles = [c for c in df.columns if C.type_name(df, c) == "double"] if float32 else []
    aggs = [F.min(C.col(c)).alias(f"a{i}") for i, c in enumerate(ints)] + [F.max(C.col(c)).alias(f"b{i}") for i, c in enumerate(ints)]
    aggs += [F.max((F.abs(C.col(c) - C.col(c).cast("float")) > F.abs(C.col(c)) * 1e-6).cast("int")).alias(f"d{i}") for i, c in enumerate(doubles)]
    if not aggs:
        return df, small_table(df.sparkSession, [], "column string, before string, after string")
    r, new = df.agg(*aggs).first(), {}
    for i, c in enumerate(ints):
        if r[f"a{i}"] is None:
            continue
        fit = next(t for t, bits in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))
                   if -(2 ** (bits - 1)) <= r[f"a{i}"] and r[f"b{i}"] < 2 ** (bits - 1))
        if fit != C.type_name(df, c):
            new[c] = fit
    new.update({c: "float" for i, c in enumerate(doubles) if r[f"d{i}"] == 0})
    out = df.select(*[C.col(c).cast(new[c]).alias(c) if c in new else C.col(c) for c in df.columns])
    rows = [{"column": c, "before": C.type_name(df, c), "after": t} for c, t in new.items()]
    return out, small_table(df.sparkSession, rows, "column string, before string, after string")


def category_candidates(df: DataFrame, max_values: int = 5_000, max_ratio: float = 0.5) -> DataFrame:
    """Text columns with few enough values to be worth a dictionary."""
    texts, rows = C.categorical(df), df.count()
    u = distinct_counts(df, texts)
    return small_table(df.sparkSession, [{"column": c, "unique": u[c], "suggested": u[c] <= max_values and u[c] / max(rows, 1) <= max_ratio} for c in texts],
                       "column string, unique long, suggested boolean")
