"""Registry, table access and the rounding shared by queries and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}

# Views with injected faults, written so that Spark and DuckDB see the same rows.
VIEWS = {
    "dirty_orders": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 29 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END AS price,
               CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice * 8 ELSE o_totalprice END AS amount,
               CASE WHEN o_orderkey % 11 = 0 THEN concat('  ', o_orderpriority, ' ')
                    WHEN o_orderkey % 13 = 0 THEN '   '
                    WHEN o_orderkey % 17 = 0 THEN 'N/A'
                    WHEN o_orderkey % 31 = 0 THEN lower(o_orderpriority)
                    ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS cust_text,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS sparse,
               CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_custkey END AS mostly_empty,
               o_orderdate AS odate, 1 AS const_col
        FROM {orders}""",
    "dirty_events": """
        SELECT event_id AS id, user_id, event_type,
               CASE WHEN event_id % 3 = 0 AND user_id > 50 THEN NULL
                    WHEN event_id % 40 = 0 THEN NULL ELSE value END AS value,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE props END AS props, ts
        FROM {events}""",
    "doc_labels": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "clean_orders": """
        SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price,
               o_orderpriority AS priority, o_orderdate AS odate FROM {orders}""",
    "repeated_customers": """
        SELECT c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS positive
        FROM {customer}""",
    "hard_numbers": """
        SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id,
               CASE WHEN l_partkey % 3 = 0 THEN CAST('-0.0' AS DOUBLE) WHEN l_partkey % 3 = 1 THEN CAST(0 AS DOUBLE) ELSE l_discount - 0.05 END AS signed,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN CAST('-0.0' AS DOUBLE) WHEN l_suppkey % 4 = 2 THEN CAST(0 AS DOUBLE)
                    ELSE l_tax - 0.04 END AS gappy,
               CAST(1152921504606846976 AS BIGINT) + CAST(l_partkey AS BIGINT) % 97 AS wide,
               CAST(CAST(l_suppkey AS DECIMAL(12, 0)) / CAST(1000 AS DECIMAL(4, 0)) AS DECIMAL(20, 6)) + CAST(12345678901 AS DECIMAL(20, 6)) AS fine
        FROM {lineitem}""",
    "contacts": """
        SELECT c_custkey AS id,
               concat('user', CAST(c_custkey AS STRING), '@mail.example.com') AS contact,
               concat('+49 30 ', CAST(10000000 + c_custkey AS STRING)) AS reach,
               concat('10.0.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 250 AS STRING)) AS host,
               concat(CAST(100 + c_nationkey AS STRING), '-', '45', '-', CAST(1000 + c_custkey % 9000 AS STRING)) AS tax_no,
               CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '4111 1111 1111 1112' END AS payment,
               concat('DE89', CAST(100000000000 + c_custkey AS STRING)) AS account,
               c_name AS first_name, c_mktsegment AS segment
        FROM {customer}""",
}


class Tables:
    """Tables of one data folder by attribute, fault views by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        used = {n: getattr(self, n) for n in ("orders", "events", "documents", "labels", "customer", "lineitem", "part",
                                              "supplier", "nation", "region", "pages", "conversations", "benchmark",
                                              "embeddings") if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


def with_views(*names: str) -> str:
    """The same views as common table expressions."""
    plain = {n: n for n in ("orders", "events", "documents", "labels", "customer", "lineitem", "part")}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)


def query(name: str, sql: str | None = None):
    """Registers fn(Tables) -> DataFrame under a name, with its SQL when there is one."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))
        run.__name__ = name
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def shown(df: DataFrame, *six: str, digits: int = 9) -> DataFrame:
    """Report rounding: the named doubles to six decimals, other doubles to significant digits, integers as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            d = c.cast("double")
            d = F.nanvl(d, F.lit(None).cast("double"))
            if f.name in six:
                d = F.round(d, 6)
            else:
                d = F.when(d.isNotNull(), F.format_string(f"%.{digits}e", d)).cast("double") + F.lit(0.0)
            out.append(d.alias(f.name))
        elif isinstance(t, T.IntegralType):
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def s9(expr: str) -> str:
    """SQL for the significant-digit rounding of shown()."""
    return f"(CAST(printf('%.9e', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0)"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
