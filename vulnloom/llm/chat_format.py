"""Chat formatting of logged conversations, with cumulative snapshots collapsed.

Logs often hold a conversation once after every turn, so that each log is a prefix of the next. A
rolling hash of the turns is compared between conversations: one whose full hash is the hash of a
proper prefix of another is a snapshot and goes; of conversations that are equal the one with the
smallest id stays. What is left is rendered.

A conversation may be very long: its turns are numbered and hashed in blocks, then over blocks, and
it is rendered in parts of a fixed number of turns, so that no task holds a whole conversation.

Exactly repeated rows count once. Turns are ordered by number (null first), then role, then text. A
null role is `unknown`, a null text is empty, and rows without an id are one conversation. The hash
is 128 bits wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vulnloom.llm.common import cut

BLOCK_TURNS = 256
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, k, n, role, text, x, y): turn `k` of `n` and the hash (x, y) of all turns up to it."""
    turns = df.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("r", F.row_number().over(inside).cast("bigint"))
    blocks = turns.groupBy("id", "block").agg(F.count(F.lit(1)).alias("size"))
    over = Window.partitionBy("id").orderBy(F.asc_nulls_first("block"))
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    blocks = blocks.select(
        F.col("id").alias("b_id"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(whole).alias("n"),
    )
    same = turns["id"].eqNullSafe(blocks["b_id"]) & turns["block"].eqNullSafe(blocks["b_block"])
    placed = turns.join(blocks, same).select(
        "id", "block", (F.col("offset") + F.col("r")).alias("k"), "n", "role", "text"
    )
    hashed = placed.withColumn("hx", F.xxhash64("k", "role", "text")).withColumn("hy", F.xxhash64("text", "k", "role", F.lit(1)))
    sums = hashed.groupBy("id", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    sums = sums.select(
        F.col("id").alias("b_id"),
        F.col("block").alias("b_block"),
        F.coalesce(F.bit_xor("bx").over(before), F.lit(0).cast("bigint")).alias("px"),
        F.coalesce(F.bit_xor("by").over(before), F.lit(0).cast("bigint")).alias("py"),
    )
    running = Window.partitionBy("id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hashed = hashed.withColumn("rx", F.bit_xor("hx").over(running)).withColumn("ry", F.bit_xor("hy").over(running))
    same = hashed["id"].eqNullSafe(sums["b_id"]) & hashed["block"].eqNullSafe(sums["b_block"])
    return hashed.join(sums, same).select(
        "id", "k", "n", "role", "text", F.col("rx").bitwiseXOR(F.col("px")).alias("x"), F.col("ry").bitwiseXOR(F.col("py")).alias("y")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(id, n_copies) of the conversations that are no proper prefix of another; equal ones count as one."""
    full = turns.where("k = n").groupBy("n", "x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"))
    proper = turns.where("k < n").select(F.col("k").alias("n"), "x", "y").distinct()
    return full.join(proper, ["n", "x", "y"], "left_anti").select("id", "n_copies")


def render(
    df: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """(id_col, part, n_turns, n_copies, chat): maximal conversations as chat markup.

    Part `p` holds the turns from p * part_turns on; markers inside a text are broken up so that
    they cannot open or close a turn.
    """
    turns = cut(prefixes(df, id_col, turn_col, role_col, text_col))
    kept = maximal(turns).withColumnRenamed("id", "kept_id")
    rows = turns.join(kept, turns["id"].eqNullSafe(kept["kept_id"]))
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    shown = F.concat(F.lit(OPEN), plain("role"), F.lit("\n"), plain("text"), F.lit(CLOSE + "\n"))
    parts = rows.groupBy("id", F.floor((F.col("k") - 1) / part_turns).alias("part"), "n", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("k", shown.alias("shown")))).alias("turns")
    )
    return parts.select(
        F.col("id").alias(id_col),
        "part",
        F.col("n").alias("n_turns"),
        "n_copies",
        F.array_join(F.col("turns.shown"), "").alias("chat"),
    )
