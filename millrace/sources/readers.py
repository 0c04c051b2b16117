"""Reading tables: CSV with encoding and separator detection, TSV, JSON, Parquet, pasted text and typed rows."""
from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators import columns as C

# Extensions, separators and the encoding tried when a file is not UTF-8.
KINDS = {"csv": "csv", "tsv": "table", "txt": "table", "json": "json", "jsonl": "json", "parquet": "parquet"}
SEPARATORS = [",", ";", "\t", "|"]
FALLBACK_ENCODING = "windows-1256"


def tidy_names(names: list[str]) -> list[str]:
    """Stripped headers; blank ones are numbered and repeats get a suffix."""
    out, seen = [], {}
    for i, n in enumerate(names, 1):
        n = n.lstrip("﻿").strip() or f"column_{i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def tidy(df: DataFrame) -> DataFrame:
    return df.toDF(*tidy_names(df.columns))


def sniff_separator(lines: DataFrame) -> str:
    """The separator that splits most lines (column `value`) into the same number of fields, more than one if possible.

    All lines count: they are folded to (separator, separators in the line) and counted in one aggregation.
    """
    seen = F.array(*[F.struct(F.lit(i).alias("sep"), ((F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))) / len(s)).cast("long").alias("fields"))
                     for i, s in enumerate(SEPARATORS)])
    counts = lines.filter(X.strip(F.col("value")) != "").select(F.explode(seen).alias("x")).groupBy("x.sep", "x.fields").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("sep").agg(F.max(F.struct("n", "fields")).alias("usual"), F.sum("n").alias("all")).collect()
    score = {r["sep"]: ((r["usual"]["fields"] > 0) * r["usual"]["n"] / r["all"], r["usual"]["fields"]) for r in best}
    return SEPARATORS[max(range(len(SEPARATORS)), key=lambda i: score.get(i, (0, 0)))]


def decodes_as_utf8(spark: SparkSession, path: str) -> bool:
    """Every line is valid UTF-8; the search stops at the first that is not."""
    return spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count() == 0


def read_csv(spark: SparkSession, path: str, sep: str | None = ",", header: bool = True, encoding: str | None = None,
             schema: T.StructType | None = None) -> DataFrame:
    """CSV; without an encoding a file that is not UTF-8 is read as Windows-1256, which maps every byte."""
    if encoding is None:
        encoding = "UTF-8" if decodes_as_utf8(spark, path) else FALLBACK_ENCODING
    if encoding.upper().replace("_", "-") not in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    sep = sep or sniff_separator(spark.read.text(path))
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """One record per line (splits into tasks), or one array or record over several lines (one task for each file).

    Without `multi_line` all lines are looked at: if each is a record, it is the first layout; if the first line is none, the
    second. A file whose first line is a record and others are not is refused with their number.
    """
    if multi_line is None:
        lines = spark.read.text(path).filter(X.strip(F.col("value")) != "")
        record = X.strip(F.col("value")).startswith("{") & F.try_parse_json("value").isNotNull()
        r = lines.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~record, 1)).alias("other")).first()
        head = lines.select(record.alias("record")).limit(1).collect()
        multi_line = bool(head) and not head[0]["record"]
        if r["other"] and not multi_line:
            raise ValueError(f"{r['other']} of {r['n']} lines are no JSON records")
    return spark.read.option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str, kind: str | None = None, sep: str | None = None, header: bool = True,
               encoding: str | None = None) -> DataFrame:
    """Reads by extension, cleans the headers and refuses unknown kinds and empty data."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "csv"
    kind = kind or KINDS.get(ext)
    if kind is None:
        raise ValueError(f"unsupported file type .{ext}")
    if kind == "csv":
        df = read_csv(spark, path, sep or ",", header, encoding)
        if sep is None and len(df.columns) == 1:
            guess = sniff_separator(spark.read.text(path))
            df = read_csv(spark, path, guess, header, encoding) if guess != "," else df
    elif kind == "table":
        df = read_csv(spark, path, sep, header, encoding)
    else:
        df = read_json(spark, path) if kind == "json" else spark.read.parquet(path)
    if not df.columns or df.isEmpty():
        raise ValueError("the file has no rows or no columns")
    return tidy(df)


def csv_head(spark: SparkSession, path: str, n: int = 100_000) -> DataFrame:
    """The first rows of a large CSV without inferring types over the whole file."""
    text = spark.read.option("header", True).csv(path)
    return tidy(typed(text.limit(n)))


def typed(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers become numbers; empty text becomes NULL and empty rows go."""
    texts = [c for c in df.columns if C.kind(df, c) == "text"]
    blank = df.select(*[F.when(C.col(c) != "", C.col(c)).alias(c) if c in texts else C.col(c) for c in df.columns]).dropna("all")
    if not texts:
        return blank
    r = blank.agg(*[a for i, c in enumerate(texts) for a in (F.count(C.col(c)).alias(f"n{i}"), F.count(X.to_number(C.col(c))).alias(f"x{i}"))]).first()
    digits = {c for i, c in enumerate(texts) if r[f"n{i}"] == r[f"x{i}"]}
    return blank.select(*[X.to_number(C.col(c)).alias(c) if c in digits else C.col(c) for c in df.columns])


def pasted_table(spark: SparkSession, text: str, sep: str | None = None, header: bool = True) -> DataFrame:
    """A table pasted as CSV or tab-separated text."""
    lines = [line for line in text.splitlines() if line.strip()]
    if not lines:
        raise ValueError("there is no text to read")
    sep = sep or sniff_separator(spark.createDataFrame([(line,) for line in lines], "value string"))
    first = next(csv.reader(lines[:1], delimiter=sep))
    names = tidy_names(first if header else [f"_c{i}" for i in range(len(first))])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.createDataFrame([(line,) for line in lines[1 if header else 0:]], "value string")
    cells = raw.select(F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"sep": sep}).alias("r"))
    return tidy(typed(cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])))


def typed_rows(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """A table typed in by hand, all cells as text at first."""
    data = [tuple(None if v is None else str(v) for v in r) for r in rows]
    names = tidy_names(columns)
    return typed(spark.createDataFrame(data, T.StructType([T.StructField(n, T.StringType()) for n in names])))
