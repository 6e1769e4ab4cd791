"""Chat formatting by cumulative-snapshot collapse.

A chat log often stores a growing conversation again after each turn.  A rolling hash over
the turns gives every prefix of a conversation an identity; a conversation whose whole hash
is a proper prefix of another one is a snapshot of it and goes.  Anti-joins on the hashes do
that; conversations are never compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.llm.common import materialize, table


def turn_key(role: str, text: str) -> Column:
    """The digest of a turn; the length of the role parts it from the text."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, a, b, last): each prefix of a conversation as the number of its turns and two running sums of
    hashes of place and turn; ``last`` marks the whole.  Only role and text count, in the order of
    (turn, digest of role and text); a null role or text counts as empty; rows that repeat a turn whole count
    each.  Rows with a null conv_id are one conversation.

    The sums run over sorted rows, so a conversation of any length passes through a task row by row."""
    w = Window.partitionBy("conv_id").orderBy("turn", "h")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "turn", turn_key("role", "text").alias("h")).withColumn("n", F.row_number().over(w).cast("long"))
    wide = lambda seed: F.xxhash64("n", "h", F.lit(seed)).cast("decimal(38,0)")
    return placed.select(
        "conv_id",
        "n",
        F.sum(wide(1)).over(running).alias("a"),
        F.sum(wide(2)).over(running).alias("b"),
        F.lead(F.lit(True), 1, False).over(w).alias("more"),
    ).select("conv_id", "n", "a", "b", (~F.col("more")).alias("last"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the maximal conversations.  Of equal ones the smallest
    conv_id stays (a null one only if it is alone); n_copies counts them.

    Equal conversations meet in a partial aggregate and prefixes in a distinct one, so a first
    turn that many share costs a row per task."""
    hashed = materialize(prefix_hashes(turns), "prefixes")
    whole = hashed.where("last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = hashed.where("NOT last").select("n", "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """Renders the conversations of ``keep``: a header line with the role, the text and an end
    mark for each turn."""
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    kept = keep.select(F.col("conv_id").alias("_keep"), "n_turns", "n_copies")
    return (
        turns.select("conv_id", "turn", turn_key("role", "text").alias("h"), piece.alias("piece"))
        .join(kept, F.col("conv_id").eqNullSafe(F.col("_keep")), "inner")
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "h", "piece"))).alias("p"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("p", lambda s: s["piece"]), "").alias("rendered"))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Collapses snapshots and renders what is left: (conv_id, n_turns, n_copies, rendered).

    Empty table: no rows.  Ties of ``turn`` are ordered by the hash of role and text.  A conversation is one
    row of the result, so its turns must fit into one row; the rolling hash itself takes them one by one."""
    rows = turns.select("conv_id", "turn", "role", "text")
    return render(rows, collapse(rows))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: Another way to the same rows: whole prefixes as strings instead of hashes.
OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k
  FROM conversations
), p AS (
  SELECT conv_id, turn, k, text, role,
         string_agg(k, chr(30)) OVER (PARTITION BY conv_id ORDER BY turn, sha256(k) ROWS UNBOUNDED PRECEDING) || chr(30) AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, sha256(k)) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies FROM p WHERE i = n GROUP BY prefix
), kept AS (
  SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.prefix = w.prefix)
)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies,
       string_agg('<|' || p.role || '|>' || chr(10) || p.text || '<|end|>' || chr(10), '' ORDER BY p.i) AS rendered
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
