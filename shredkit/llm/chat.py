"""Chat formatting with collapse of cumulative snapshots (native).

Chat logs often hold a conversation several times, each time with more turns.
Every conversation gets rolling hashes of its turn prefixes: the hash of the
first k turns is the XOR of the hashes of (position, role, text) of these
turns, two independent 64-bit hashes side by side. A conversation whose whole
hash is a prefix hash of a longer conversation is a snapshot of it. Anti-joins
keep the maximal conversations, which are then rendered.

No task ever holds a whole conversation: turns are counted and hashed in
blocks of ``block`` turn numbers, and a rendered conversation has one row per
``block`` positions (``part`` 0, 1, ...), so almost every one has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shredkit.llm.frames import saved

BLOCK = 1024

#: Fixed values of the chat markup.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def positions(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct turns with their position (0, 1, ...) and the rolling prefix hashes.

    Returns conv, pos, role, text, p1, p2 (hashes of turns 0 .. pos).
    """
    t = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), F.col("role").alias("role"),
        F.col("text").alias("text"), F.floor(F.col("turn") / block).alias("block"),
    ).where(F.col("conv").isNotNull()).distinct()
    t = saved(t, "chat-turns")
    of = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("conv", "block", F.coalesce(F.sum("n").over(of), F.lit(0)).alias("base"))
    base = saved(base, "chat-blocks")
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    ranked = t.withColumn("rank", F.row_number().over(inside) - 1).alias("t").join(
        base.alias("b"),
        (F.col("t.conv") == F.col("b.conv")) & F.col("t.block").eqNullSafe(F.col("b.block")),
    ).select("t.conv", "t.block", (F.col("base") + F.col("rank")).alias("pos"), "role", "text")
    hashed = saved(
        ranked.withColumns({"x1": _turn_hash("a"), "x2": _turn_hash("b")}), "chat-positions"
    )
    sums = hashed.groupBy("conv", "block").agg(F.expr("bit_xor(x1)").alias("b1"),
                                               F.expr("bit_xor(x2)").alias("b2"))
    sums = saved(sums.select(
        "conv", "block",
        *[F.coalesce(F.expr(f"bit_xor(b{i})").over(of), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
    ), "chat-prefixes")
    upto = Window.partitionBy("conv", "block").orderBy("pos")
    return hashed.alias("t").withColumns(
        {f"r{i}": F.expr(f"bit_xor(x{i})").over(upto) for i in (1, 2)}
    ).alias("t").join(
        sums.alias("b"),
        (F.col("t.conv") == F.col("b.conv")) & F.col("t.block").eqNullSafe(F.col("b.block")),
    ).select("t.conv", "pos", "role", "text",
             *[F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)])


def _turn_hash(salt: str) -> Column:
    null = F.lit("\0null")
    return F.xxhash64(F.lit(salt), F.col("pos").cast("long"), F.coalesce("role", null), F.coalesce("text", null))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv, n): conversations that are no prefix of a longer one; of equal
    ones the smallest conv. ``turns`` is what :func:`positions` returns."""
    whole = turns.groupBy("conv").agg(
        F.max(F.struct("pos", "p1", "p2")).alias("last")
    ).select("conv", (F.col("last.pos") + 1).alias("n"), "last.p1", "last.p2")
    distinct = whole.groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"))
    ends = whole.select("conv", F.col("n").alias("end"))
    prefixes = turns.select("conv", (F.col("pos") + 1).alias("n"), "p1", "p2").join(
        ends, "conv"
    ).where(F.col("n") < F.col("end")).select("n", "p1", "p2").distinct()
    return distinct.join(prefixes, ["n", "p1", "p2"], "left_anti").select("conv", "n")


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns (of the whole
    conversation) and text.

    A turn is rendered as ``<|im_start|>role`` newline text ``<|im_end|>``
    newline; a null role is ``user``, a null text is empty. Rows without a
    conv_id belong to no conversation and take no part. Repeated rows count
    once; turns with one number follow role, then text; null turn numbers
    come first. An empty table gives no rows; extra columns are ignored.
    """
    turns = saved(positions(conversations, block), "chat-hashed")
    kept = saved(maximal_conversations(turns), "chat-maximal")
    rows = kept.select(
        F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("part"),
    )
    turn = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("user")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit(TURN_END), F.lit("\n"))
    said = turns.select(F.col("conv").alias("conv_id"), F.floor(F.col("pos") / block).alias("part"),
                        "pos", turn.alias("turn"))
    joined = rows.join(said, ["conv_id", "part"])
    parts = joined.groupBy("conv_id", "part", "n_turns").agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("turns")
    )
    return parts.select("conv_id", F.col("part").cast("int").alias("part"), F.col("n_turns").cast("long").alias("n_turns"),
                        F.array_join(F.col("turns.turn"), "").alias("text"))
