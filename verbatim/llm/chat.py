"""Chat formatting with cumulative-snapshot collapse.

A service that logs a conversation after every turn leaves many prefixes of the
final one. Each prefix of a conversation gets a rolling hash of its turns; a
conversation whose last hash is an inner hash of another one is a snapshot and
goes. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The marks around a rendered turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: str) -> Column:
    """Hash of a turn at its place: order matters although the hashes are combined by xor."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return F.xxhash64(F.lit(seed), F.col("pos"), part("_role"), part("_text"))


def turns_with_hashes(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct turns with place, rolling prefix hash (two 64-bit halves) and whether it is the last one.

    Rows equal in all four columns count once. Turns are ordered by number, then
    role, then text, nulls first. A row without conversation id is a conversation
    of one turn.
    """
    own = F.when(F.col(conversation).isNull(), F.xxhash64(F.col(turn), F.col(role), F.col(text), F.lit("alone")))
    rows = df.select(
        F.col(conversation).alias("_conv"), own.alias("_own"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text")
    ).distinct()
    ordered = Window.partitionBy("_conv", "_own").orderBy("_turn", "_role", "_text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("pos", F.row_number().over(ordered))
        .withColumn("_more", F.lead(F.lit(True)).over(ordered).isNotNull())
        .withColumn("h1", F.bit_xor(_turn_hash("a")).over(so_far))
        .withColumn("h2", F.bit_xor(_turn_hash("b")).over(so_far))
    )


def format_chats(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One rendered text per maximal conversation.

    Equal conversations give one row with the smallest id and the number of
    copies; a proper prefix of another conversation gives none. Null role or
    text renders as empty but differs from an empty one in comparison. An empty
    table gives no rows.

    Returns the conversation id, n_turns, n_copies, chat_hash and rendered.
    """
    turns = turns_with_hashes(df, conversation, turn, role, text)
    wholes = turns.where(~F.col("_more")).groupBy("pos", "h1", "h2").agg(
        F.min(F.struct("_conv", "_own")).alias("_first"), F.count(F.lit(1)).alias("n_copies")
    )
    inner = turns.where("_more").select("pos", "h1", "h2").distinct()
    kept = wholes.join(inner, ["pos", "h1", "h2"], "left_anti").select(
        F.col("_first._conv").alias("_kc"), F.col("_first._own").alias("_ko"), F.col("pos").alias("n_turns"), "n_copies", "h1", "h2"
    )
    line = F.concat(F.lit(TURN_START), F.coalesce("_role", F.lit("")), F.lit("\n"), F.coalesce("_text", F.lit("")), F.lit(TURN_END))
    rendered = (
        turns.select("_conv", "_own", "pos", line.alias("_line"))
        .groupBy("_conv", "_own")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_line"))), lambda t: t["_line"]), "\n").alias("rendered"))
    )
    same = F.col("_conv").eqNullSafe(F.col("_kc")) & F.col("_own").eqNullSafe(F.col("_ko"))
    return kept.join(rendered, same).select(
        F.col("_conv").alias(conversation), "n_turns", "n_copies", F.hex("h1").alias("chat_hash"), "rendered"
    )
