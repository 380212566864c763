"""Chat formatting: collapse cumulative snapshots, then render what is left.

Turns are put in order inside each conversation, and a rolling hash is chained over them: the hash of
the first k turns is that of the first k - 1 with turn k. A conversation whose last hash is some longer
conversation's inner hash is a snapshot of it and goes by an anti-join. Of equal conversations the one
with the smallest id stays. Both sides of the joins are cut to distinct hashes first, so a conversation
that was logged a million times is one row there.

Rows with a null conv_id are left out; null roles and texts count as empty. Turns are ordered by turn
(null first), role and text, so ties and repeated rows have one order. A conversation of empty turns
counts as any other. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def _turn_hash(before: Column, turn: Column) -> Column:
    """Hash of a prefix and the next turn; the role's length keeps role and text apart."""
    return F.md5(F.concat_ws(":", before, F.length(turn["role"]).cast("string"), turn["role"], turn["text"]))


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its turns in order, and the hash of every prefix."""
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chain = F.aggregate(
        "turns", F.array().cast("array<string>"),
        lambda acc, t: F.concat(acc, F.array(_turn_hash(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), t))),
    )
    return whole.withColumn("hashes", chain)


def collapse(found: DataFrame) -> DataFrame:
    """The maximal conversations of ``conversations``; ``n_copies`` counts the equal ones a row stands for."""
    rows = found.withColumn("last", F.element_at("hashes", -1))
    inner = rows.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("last")).distinct()
    firsts = rows.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    keep = firsts.join(inner, "last", "left_anti").select("conv_id", "n_copies")
    return found.join(keep, "conv_id")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    ), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, number of turns and of equal conversations, and the rendered text of each maximal conversation."""
    return collapse(conversations(turns)).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("chat")
    )


#: The same rows as SQL.
SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t
), p AS (
  SELECT conv_id, k, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER w AS chat,
    string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '/') OVER w AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat
FROM p WHERE k = n_turns AND prefix NOT IN (SELECT prefix FROM p WHERE k < n_turns)
GROUP BY prefix, n_turns, chat
"""
