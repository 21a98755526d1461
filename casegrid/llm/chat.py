"""Chat formatting (operator 8), DataFrame functions only.

Method: cumulative-snapshot collapse.  Turns are numbered within their conversation and
every turn prefix gets a rolling hash: the sum over its turns of a hash of (position,
role, text), in two lanes of 60 bits.  A conversation whose whole hash is the proper
prefix of a longer one is anti-joined away; of equal conversations the one with the
smallest conv_id stays.  What is left is rendered with a chat template.

Defined results: repeated rows (same conv_id, turn, role and text) count once; turns that
tie in number are ordered by role, then text, nulls first; a null role or text counts as
empty; a row with a null conv_id is a conversation of its own, before all others; very long texts are kept whole; an empty
table gives none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.llm.common import table


def _lane(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv (conv_id and, for rows without, a hash of the row), pos, role, text, h1, h2 (rolling hash of the turns up to pos),
    last (whether the conversation ends here)."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    alone = F.when(F.col("id").isNull(), F.sha2(F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.length("role").cast("string"), "role", "text"), 256))
    turns = turns.select(F.struct("id", alone.alias("alone")).alias("conv"), "turn", "role", "text")
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    digest = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    return (
        turns.select("conv", "role", "text", F.row_number().over(order).alias("pos"), F.lead(F.lit(1)).over(order).isNull().alias("last"), "turn")
        .withColumn("digest", digest)
        .select(
            "conv", "pos", "role", "text", "last",
            F.sum(_lane(F.col("digest"), 1)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("h1"),
            F.sum(_lane(F.col("digest"), 16)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("h2"),
        )
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """Turns (conv, pos, role, text) of the conversations that are not the prefix of another."""
    rows = prefixes(conversations)
    whole = rows.filter("last").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"))
    proper = rows.filter("not last").select("pos", "h1", "h2").distinct()
    kept = whole.join(proper, ["pos", "h1", "h2"], "left_anti").select(F.col("conv").alias("k"))
    return rows.select("conv", "pos", "role", "text").join(kept, F.col("conv").eqNullSafe(F.col("k")), "left_semi")


def render(turns: DataFrame, before: str = "<|im_start|>", middle: str = "\n", after: str = "<|im_end|>\n") -> DataFrame:
    """conv_id, n_turns and chat (the turns in order, each as before + role + middle + text + after)."""
    one = F.concat(F.lit(before), "role", F.lit(middle), "text", F.lit(after))
    return (
        turns.groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))).alias("turns"))
        .select(F.col("conv.id").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("chat"))
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal(table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), k AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN concat('-', row_number() OVER (ORDER BY turn, role, text)) ELSE CAST(conv_id AS VARCHAR) END AS k FROM t
), n AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY k) AS n
  FROM k WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT k, conv_id, pos, n, role, text,
    string_agg(CAST(length(role) AS VARCHAR) || ':' || role || CAST(length(text) AS VARCHAR) || ':' || text, ',' ORDER BY pos)
      OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM n
), whole AS (
  SELECT k FROM p WHERE pos = n AND prefix NOT IN (SELECT prefix FROM p WHERE pos < n)
  QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY conv_id NULLS FIRST, k) = 1
)
SELECT any_value(conv_id) AS conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM p WHERE k IN (SELECT k FROM whole) GROUP BY k
"""
