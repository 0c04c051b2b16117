"""Writing prepared tables and step logs. Output is a folder of part files, one per task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import columns as C
from millrace.operators.profile import small_table
from millrace.operators.ranks import row_index


def write_table(df: DataFrame, path: str, kind: str = "parquet", index_by: str | None = None, mode: str = "errorifexists") -> None:
    """CSV, JSON lines or Parquet; `index_by` adds a row number in the order of a numeric or date column without repeats."""
    if index_by:
        from millrace.operators.roles import order_number
        df = row_index(df, order_number(df, index_by), F.lit(0), "index")
        df = df.select("index", *[C.col(c) for c in df.columns if c != "index"])
    w = df.write.mode(mode)
    if kind == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported output type {kind}")


def log_deltas(log: DataFrame) -> DataFrame:
    """Row and column change of every log entry against the one before. A log has tens of entries, hence one window."""
    w = Window.orderBy("position")
    return log.withColumn("row_change", F.col("rows") - F.lag("rows").over(w)).withColumn("col_change", F.col("cols") - F.lag("cols").over(w))


def log_from_pipeline(spark, log: list[dict]) -> DataFrame:
    rows = [{"position": i, "step": e["step"], "rows": e["rows_out"], "cols": e["cols_out"], "detail": "; ".join(e["notes"])} for i, e in enumerate(log, 1)]
    return log_deltas(small_table(spark, rows, "position long, step string, rows long, cols long, detail string"))


def log_text(log: DataFrame) -> DataFrame:
    """One printable line per entry."""
    line = F.format_string("%d. %s: %d rows x %d columns", "position", "step", "rows", "cols")
    detail = F.when(F.col("detail") != "", F.concat(F.lit(" - "), F.col("detail"))).otherwise("")
    return log.select("position", F.concat(line, detail).alias("value"))


def write_log(log: DataFrame, path: str, kind: str = "json") -> None:
    one = log.coalesce(1)
    if kind == "text":
        log_text(log).orderBy("position").select("value").coalesce(1).write.text(path)
    elif kind == "csv":
        one.write.option("header", True).csv(path)
    else:
        one.write.json(path)
