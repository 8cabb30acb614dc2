"""Chat formatting with cumulative-snapshot collapse (operator 9).

Logs often hold a conversation again after every turn, so that one is a
prefix of the next. Every turn gets a rolling hash of its conversation so far;
a conversation whose last rolling hash is met inside a longer one is a
snapshot and goes (anti-join), as do all but the smallest id of equal
conversations. What is left is rendered.

The rolling hash is an md5 over the digests of the turns so far: first within
blocks of ``BLOCK`` turns, then over the digests of the blocks before within
groups of ``BLOCK`` blocks, and so on up. So one very long conversation is dealt
over tasks by block, a task meets at most ``BLOCK`` digests at once, and every
row is of fixed size. Turns get their places by a sort over range partitions,
so many turns of one number are dealt over tasks too. Hashes that very many
conversations share (a common first turn) are pre-aggregated to one row each
before the anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import saved

#: turns in a block
BLOCK = 256


def turn_digest() -> Column:
    """Digest of role and text; a null differs from an empty string."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("-"))
    return F.md5(F.concat(part("role"), F.lit("/"), part("text")).cast("binary"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): distinct turns with their place from 0 on,
    by turn number, role, text (nulls first)."""
    rows = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct())
    # sorted over range partitions and written, each row with its partition and place there
    row = F.monotonically_increasing_id()
    rows = saved(rows.sort(*[F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]).withColumn("row", row), "turns")
    rows = rows.withColumn("part", F.shiftrightunsigned("row", 33))
    # a conversation's rows in a partition are neighbours: few rows tell where they begin
    pieces = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    return rows.join(pieces, on).select("conv_id", (F.col("row") + F.col("shift")).alias("at"), "role", "text")


def _grouped(digests: DataFrame) -> DataFrame:
    """(conv_id, up, ds): digests d of up to ``BLOCK`` neighbours, in order."""
    return (digests.select("conv_id", F.floor(F.col("at") / BLOCK).alias("up"), F.struct("at", "d").alias("t"))
            .groupBy("conv_id", "up").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("conv_id", "up", F.col("ts.d").alias("ds")))


def _heads(blocks: DataFrame) -> DataFrame:
    """(c, b, head): digest of all before each block (conv_id, at, d) of its
    conversation, '' for a first one. A call for each power of ``BLOCK`` that the
    longest conversation has."""
    groups = saved(_grouped(blocks), "groups")
    before = F.transform(F.sequence(F.lit(0), F.size("ds") - 1), lambda k: F.struct(
        (F.col("up") * BLOCK + k).alias("at"), F.concat_ws("", F.slice("ds", F.lit(1), k)).alias("ds")))
    rows = groups.select("conv_id", "up", F.explode(before).alias("x")).select(
        F.col("conv_id").alias("c"), F.col("x.at").alias("b"), "up", F.when(F.col("x.ds") != "", F.md5(F.col("x.ds").cast("binary"))).otherwise(F.lit("")).alias("head"))
    if not (groups.agg(F.max("up")).first()[0] or 0):
        return rows.select("c", "b", "head")
    above = _heads(groups.select("conv_id", F.col("up").alias("at"), F.md5(F.concat_ws("", "ds").cast("binary")).alias("d")))
    above = above.select(F.col("c").alias("c2"), F.col("b").alias("up2"), F.col("head").alias("head2"))
    whole = F.when(F.col("head2") == "", F.col("head")).otherwise(F.md5(F.concat("head2", F.lit("/"), "head").cast("binary")))
    return (rows.join(above, F.col("c").eqNullSafe(F.col("c2")) & (F.col("up") == F.col("up2")))
            .select("c", "b", whole.alias("head")))


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, len, hash) of every prefix of every conversation."""
    blocks = saved(_grouped(turns.select("conv_id", "at", turn_digest().alias("d"))), "blocks")
    heads = _heads(blocks.select("conv_id", F.col("up").alias("at"), F.md5(F.concat_ws("", "ds").cast("binary")).alias("d")))
    prefix = F.transform(F.sequence(F.lit(1), F.size("ds")), lambda k: F.struct(
        (F.col("up") * BLOCK + k).alias("len"),
        F.md5(F.concat("head", F.lit("/"), F.concat_ws("", F.slice("ds", F.lit(1), k))).cast("binary")).alias("hash")))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("b"))
    return blocks.join(heads, on).select("conv_id", F.explode(prefix).alias("p")).select("conv_id", "p.len", "p.hash")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that are a prefix of no
    longer one; of equal ones the smallest id, and how many they are."""
    prefixes = saved(rolling_hashes(turns), "prefixes")
    lengths = prefixes.groupBy(F.col("conv_id").alias("c")).agg(F.max("len").alias("n_turns"))
    last = prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("len") == F.col("n_turns"))).select("conv_id", "n_turns", "hash")
    equal = last.groupBy("n_turns", "hash").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    # a proper prefix: some conversation goes on after these turns
    inner = (prefixes.join(lengths, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("len") < F.col("n_turns")))
             .select(F.col("len").alias("n_turns"), "hash").distinct())
    return equal.join(inner, ["n_turns", "hash"], "left_anti").select("conv_id", "n_turns", "n_equal")


def rendered_turn() -> Column:
    """One turn in ChatML; the marker's opening in a text is broken up."""
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), clean("role"), F.lit("\n"), clean("text"), F.lit("<|im_end|>\n"))


def chat_documents(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_equal, rendered) of the maximal
    conversations of ``conversations`` (conv_id, turn, role, text).

    A segment holds up to ``BLOCK`` turns in order, so a usual conversation is
    one row and a very long one several. Repeated rows count once; a turn
    number with several texts holds them all, by role and text. Only the order
    of turn numbers counts, not their values. Rows with null conv_id are one
    conversation with that id; null roles and texts render as empty ones but
    are not equal to them. Other columns are not looked at; no rows, no result."""
    turns = saved(ordered_turns(conversations), "ordered")
    best = saved(maximal_conversations(turns), "maximal")
    mine = best.select(F.col("conv_id").alias("c"), "n_turns", "n_equal")
    return (turns.join(mine, F.col("conv_id").eqNullSafe(F.col("c")))
            .groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("segment"), "n_turns", "n_equal")
            .agg(F.sort_array(F.collect_list(F.struct("at", rendered_turn().alias("r")))).alias("x"))
            .select("conv_id", "segment", "n_turns", "n_equal", F.concat_ws("", "x.r").alias("rendered")))
