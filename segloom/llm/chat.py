"""Chat formatting in Spark expressions only: turns are collected as structs, sorted, merged and concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What surrounds a role, what ends a turn, what joins merged turns.
OPEN, CLOSE, END, JOIN = "<|", "|>\n", "<|end|>\n", "\n"


def merged_turns(turns: Column) -> Column:
    """Array of (role, text) from a sorted array of (turn, role, text): neighbours of the same role become one."""
    start = F.struct(
        F.array().cast("array<struct<role:string,text:string>>").alias("done"),
        F.lit(None).cast("string").alias("role"),
        F.array().cast("array<string>").alias("parts"),
    )

    def closed(acc: Column) -> Column:
        last = F.struct(acc["role"].alias("role"), F.array_join(acc["parts"], JOIN).alias("text"))
        return F.when(acc["role"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))

    def step(acc: Column, turn: Column) -> Column:
        same = F.coalesce(acc["role"] == turn["role"], F.lit(False))
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
            turn["role"].alias("role"),
            F.when(same, F.concat(acc["parts"], F.array(turn["text"]))).otherwise(F.array(turn["text"])).alias("parts"),
        )

    return F.aggregate(turns, start, step, closed)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_rows, n_turns, n_chars, formatted), one row a conversation.

    Turns are ordered by turn (nulls first), then role, then text; repeated rows are each kept, so they merge
    as neighbours. Roles are trimmed and lower-cased, a null or blank one is "unknown"; a null text is empty;
    the marker that opens a role is broken up inside texts, and what marks or ends a role is replaced by "_" inside
    roles, so that neither can pretend to be a turn. Rows whose conv_id is null form one conversation of their own. Only conv_id, turn, role and text are read.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.when(role == "", "unknown").otherwise(F.regexp_replace(role, "[<|>\\r\\n]", "_")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |")).alias("text"),
    )
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_rows"), merged_turns(F.col("turns")).alias("merged"))
    one = lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(CLOSE), m["text"], F.lit(END))
    chats = chats.select("conv_id", "n_rows", F.size("merged").cast("long").alias("n_turns"), F.array_join(F.transform("merged", one), "").alias("formatted"))
    return chats.select("conv_id", "n_rows", "n_turns", F.length("formatted").cast("long").alias("n_chars"), "formatted")


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN lower(trim(coalesce(role, ''))) = '' THEN 'unknown' ELSE regexp_replace(lower(trim(role)), '[<|>\\r\\n]', '_', 'g') END AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
g AS (SELECT *, k - row_number() OVER (PARTITION BY conv_id, role ORDER BY k) AS run FROM n),
m AS (
  SELECT conv_id, min(k) AS k, count(*) AS rows_, '<|' || role || '|>' || chr(10) || string_agg(text, chr(10) ORDER BY k) || '<|end|>' || chr(10) AS piece
  FROM g GROUP BY conv_id, role, run),
f AS (
  SELECT conv_id, CAST(sum(rows_) AS BIGINT) AS n_rows, count(*) AS n_turns, string_agg(piece, '' ORDER BY k) AS formatted
  FROM m GROUP BY conv_id)
SELECT conv_id, n_rows, n_turns, length(formatted) AS n_chars, formatted FROM f
"""
