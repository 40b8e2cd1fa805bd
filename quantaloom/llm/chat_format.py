"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time with more turns. A rolling hash over each conversation's turns
names every prefix of it. Of equal conversations the one with the smallest conv_id is taken; a conversation whose whole hash
is a proper prefix's hash of a longer one is left out by an anti-join; what remains is rendered with role marks, and the
character spans of the assistant's turns, on which a loss may be taken, are listed. Hashes, places and spans are running
totals over a conversation's ordered turns, so the work is linear in them, however many one conversation has.

Defined results: turns are ordered by turn, then role, then text (nulls first); a null role or text counts as
empty, a null turn comes first. Rows equal in all columns are separate turns. Rows with a null conv_id belong to no
conversation and are left out. Empty texts are rendered as turns without text; texts are taken whole, and a conversation
is rendered to one row, so its turns must fit in one. An empty table gives no rows. Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaloom.llm._common import cut, table

#: Marks around a turn; {role} and {text} are filled in.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), n (turns of the conversation), role, text, h1, h2 (hash of the turns up to here), at (where the
    rendered turn begins, in characters)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"i": F.row_number().over(by), "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    # A turn's hash has its place and the digests of both parts, so no two lists of turns are cut to the same bytes.
    parts = (F.md5(F.col("role").cast("binary")), F.md5(F.col("text").cast("binary")))
    size = F.length("role") + F.length("text") + F.lit(len(BEGIN) + len(MIDDLE) + len(END))
    rows = rows.withColumns({"t1": F.xxhash64(F.lit(1), "i", *parts), "t2": F.xxhash64(F.lit(2), *parts, "i"), "size": size})
    rows = rows.withColumns({"h1": F.bit_xor("t1").over(so_far), "h2": F.bit_xor("t2").over(so_far), "at": F.sum("size").over(so_far) - F.col("size")})
    return rows.select("conv_id", "i", "n", "role", "text", "h1", "h2", "at")


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that stay, from a table of ordered turns: no copies, no prefixes."""
    whole = rows.where("i = n").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    shorter = rows.where("i < n").select("h1", "h2").distinct()
    return whole.join(shorter, ["h1", "h2"], "left_anti").select("conv_id", "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text, reply_spans (first and end character of each assistant turn's text, from 0) of each
    conversation that no other holds whole."""
    rows = cut(ordered_turns(turns))
    rendered = F.concat(F.lit(BEGIN), F.col("role"), F.lit(MIDDLE), F.col("text"), F.lit(END))
    first = F.col("at") + F.length("role") + F.lit(len(BEGIN) + len(MIDDLE))
    span = F.struct(first.cast("int").alias("first"), (first + F.length("text")).cast("int").alias("end"))
    found = rows.join(maximal(rows), "conv_id").groupBy("conv_id", "copies").agg(
        F.array_sort(F.collect_list(F.struct("i", rendered.alias("text")))).alias("turns"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("reply_spans")
    )
    text = F.array_join(F.transform("turns", lambda t: t["text"]), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", text.alias("text"), "reply_spans")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("reply_spans", lambda s: F.concat_ws(":", s["first"], s["end"])), ",").alias("reply_spans")
    return format_chats(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "copies", "text", spans)


QUERIES = {"op4_chat_format": op4_chat_format}

ORACLE = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(md5(md5(role) || md5(text)), '' ) OVER (PARTITION BY conv_id ORDER BY i) AS prefix,
             count(*) OVER (PARTITION BY conv_id) AS n,
             coalesce(sum(12 + length(role) + 1 + length(text) + 11) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE i = n GROUP BY prefix),
stay AS (SELECT conv_id, copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE i < n))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, CAST(any_value(copies) AS BIGINT) AS copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS text,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(pos + 13 + length(role) AS BIGINT) || ':' || CAST(pos + 13 + length(role) + length(text) AS BIGINT) END, ',' ORDER BY i), '') AS reply_spans
FROM p JOIN stay USING (conv_id) GROUP BY conv_id"""
}
