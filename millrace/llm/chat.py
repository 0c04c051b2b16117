"""Chat formatting by perspective rotation.

Every speaker of a conversation is the assistant once: its turns become `assistant` turns that are trained on, those of
the others become `user` turns that carry the speaker's name, and instructions of the `system` role stay what they are.
The result has the rendered dialogue, the character spans that the loss covers, and the counts.

A dialogue is rendered whole. Where a model reads only so many turns, `page_turns` cuts it by the position of its turns,
and every page is headed by all turns of the `system` role that come before it. Only DataFrame functions are used.

Defined results: null text is an empty turn; a null role speaks as `unknown`; turns without number come first, turns
with equal numbers in the order of role and text; repeated rows stay repeated; a conversation of system turns alone
has no speaker and no row; a null conv_id is a conversation of its own; `<|` in texts and names is written `<_|`, so that
content cannot forge the marks.
A dialogue, or a page of one, is one row, as whoever reads it needs it; conversations that do not fit into a row need
`page_turns`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common

HEAD, STOP = "<|", "<|end|>\n"


def safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<_|"))


def paged(rows: DataFrame, page_turns: int, system: str) -> DataFrame:
    """The rows with their page; a turn of the system is repeated at the head of every later page.

    Turns are numbered by a window over the conversation, which sorts on disk where it must."""
    if page_turns < 1:
        raise ValueError("a page has at least one turn")
    whole = Window.partitionBy("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    own = rows.withColumn("page", F.floor((F.row_number().over(whole.orderBy(*order)) - 1) / page_turns)).withColumn("_last", F.max("page").over(whole))
    lasts = F.when(F.col("role") == safe(F.lit(system)), F.sequence(F.col("page"), F.col("_last"))).otherwise(F.array("page"))
    return own.select("conv_id", F.explode(lasts).alias("page"), "turn", "role", "text")


def rotate(turns: DataFrame, page_turns: int | None = None, system: str = "system") -> DataFrame:
    """conv_id, page, speaker, n_turns, n_trained, rendered, spans (start and end of each trained stretch, characters)."""
    rows = turns.select(
        "conv_id", F.lit(0).cast("long").alias("page"), F.col("turn").cast("long").alias("turn"),
        safe(F.coalesce("role", F.lit("unknown"))).alias("role"), safe(F.coalesce("text", F.lit(""))).alias("text"))
    if page_turns is not None:
        rows = paged(rows, page_turns, system)
    speaks = F.when(F.col("role") != safe(F.lit(system)), F.col("role"))
    pages = rows.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.collect_set(speaks).alias("here"))
    pages = pages.withColumn("turns", F.concat(F.filter("turns", lambda t: t["turn"].isNull()), F.filter("turns", lambda t: t["turn"].isNotNull())))
    if page_turns is None:
        views = pages.select("conv_id", "page", "turns", F.explode("here").alias("speaker"))
    else:
        speakers = rows.groupBy("conv_id").agg(F.collect_set(speaks).alias("speakers")).withColumnRenamed("conv_id", "_conv")
        views = (pages.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
                 .select("conv_id", "page", "turns", F.explode("speakers").alias("speaker")))

    def head(t, me):
        return (F.when(t["role"] == me, F.lit("<|assistant|>\n"))
                .when(t["role"] == safe(F.lit(system)), F.lit("<|system|>\n"))
                .otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n"))))

    parts = F.transform("turns", lambda t: F.struct(head(t, F.col("speaker")).alias("head"), F.concat(t["text"], F.lit(STOP)).alias("body"), (t["role"] == F.col("speaker")).alias("mine")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct(end.alias("at"), F.when(p["mine"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return views.withColumn("parts", parts).select(
        "conv_id", "page", "speaker", F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["mine"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("parts", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"].alias("spans"))


def op3_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    out = rotate(common.table(spark, folder, "conversations"))
    return out.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, 0 AS page, turn, replace(coalesce(role, 'unknown'), '<|', '<_|') AS role,
                  replace(coalesce(text, ''), '<|', '<_|') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
v AS (SELECT t.conv_id, t.page, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS mine,
             CASE WHEN t.role = s.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
                  ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head, t.text || '<|end|>' || chr(10) AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, page, speaker
             ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM v)
SELECT conv_id, CAST(page AS BIGINT) AS page, speaker, count(*) AS n_turns, count(*) FILTER (mine) AS n_trained,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (mine), '') AS spans
FROM o GROUP BY conv_id, page, speaker"""
