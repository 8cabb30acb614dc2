"""Conversation prefix trie by bursting (operator 11).

A turn is known by 24 bytes (md5 of role and text, then its bytes of text), a
run of turns by those bytes in a row: a path. Conversations are cut every
``SEGMENT`` turns. A segment is a path below a trie head (the hash of the turns
before it), and equal segments below a head are one row with a count and the
smallest id, so that copies cost one row, however many they are.

The rows below a head are its container. As long as a container holds more
than ``LIMIT`` turns it bursts: its rows move on by their next turn and become
the containers of new heads. As a path has at most ``SEGMENT`` turns, there are
at most that many rounds, and a container that has used up its turns is a
single row. What is left is sorted by head and path and swept into nodes, with
a stack of one path.

Containers form a tree (a burst one and its children, a segment's end and the
container below it). Sums of whole subtrees (leaves, saved tokens) are gathered
along it by doubling: in a round every container adds what the containers 2^k
steps below it have gathered, so the rounds are the logarithm of its depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.llm.common import is_empty, saved

#: turns in a segment
SEGMENT = 256
#: turns in a container that is swept
LIMIT = 4096
#: digests in a block of the hash of a long conversation's earlier segments
BLOCK = 256
#: bytes of a turn in a path
UNIT = 24
#: turns of a conversation that meet its plan at one key
STRETCH = 1 << 16
#: bytes of ids that are hashed in one piece
PIECE = 1 << 16


def turn_unit(role: str = "role", text: str = "text") -> Column:
    """48 hexadecimal digits: md5 of a turn's role and text, and the text's bytes."""
    size = F.octet_length(text).cast("long")
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text))
    return F.concat(F.md5(both.cast("binary")), F.lpad(F.hex(size), 16, "0"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, unit): turns of each conversation numbered from 0 on by
    turn (null first), role, text.

    Rows are range-partitioned by that order and by a number of the row, so the
    turns of a long conversation, or very many equal ones, spread over tasks; a
    turn's place is its place in the partition and the conversation's rows in
    the partitions before."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    blank("role").alias("role"), blank("text").alias("text")))
    rows = saved(rows.select("conv_id", "turn", F.struct(F.col("role"), F.md5(F.col("text").cast("binary"))).alias("tie"), turn_unit().alias("unit"),
                             F.monotonically_increasing_id().alias("row")), "turns")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("tie"), F.col("row")]
    parts = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = saved(parts.select("conv_id", "turn", "tie", "unit", "row", "part"), "ranges")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    placed = parts.withColumn("k", F.row_number().over(inside) - 1)
    return (placed.join(sizes, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")))
            .select("conv_id", (F.col("first") + F.col("k")).alias("at"), "unit"))


def rebuilt(turns: DataFrame, family: Column, head: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): each conversation c becomes the first
    ``head`` turns of conversation ``family`` (both expressions over conv_id,
    head at most ``longest``), then its own from its turn ``head`` on."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = saved(convs.select("conv_id", "n", family.cast("long").alias("base"), head.cast("long").alias("h")), "conversations")
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    plan = saved(plan, "plan")
    # a long conversation meets its plan once a stretch of turns
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH).cast("long"))).alias("s")
    spread = plan.join(convs.select("conv_id", "n"), "conv_id").select(F.col("conv_id").alias("c"), stretches, "h", "taken")
    own = turns.join(spread, (F.col("conv_id") == F.col("c")) & (F.floor(F.col("at") / STRETCH) == F.col("s")))
    own = own.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "unit")
    firsts = turns.where(F.col("at") < longest).select(F.col("conv_id").alias("base"), "at", "unit")
    shared = plan.join(firsts, "base").where("at < h").select("conv_id", "at", "unit")
    return convs.select("conv_id"), own.unionByName(shared)


def _heads(blocks: DataFrame) -> DataFrame:
    """(conv, seg, head): of each segment (conv, seg, digest) a hash of those
    before it, of digests in blocks of ``BLOCK``, blocks of blocks and so on."""
    groups = (blocks.groupBy("conv", F.floor(F.col("seg") / BLOCK).cast("long").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("seg", "digest"))).alias("x")).select("conv", "block", F.col("x.digest").alias("x")))
    inner = groups.select("conv", "block", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda k: F.md5(
        F.concat_ws("", F.slice("x", F.lit(1), k)).cast("binary")))).alias("k", "inner"))
    inner = inner.select("conv", "block", (F.col("block") * BLOCK + F.col("k")).alias("seg"), "inner")
    if is_empty(groups.where("block > 0")):
        return inner.select("conv", "seg", F.col("inner").alias("head"))
    upper = _heads(saved(groups.select("conv", F.col("block").alias("seg"), F.md5(F.concat_ws("", "x").cast("binary")).alias("digest")), "blocks"))
    return inner.join(upper.withColumnRenamed("seg", "block"), ["conv", "block"]).select(
        "conv", "seg", F.md5(F.concat("head", F.lit("/"), "inner").cast("binary")).alias("head"))


ROOT = "root"


def segments(turns: DataFrame) -> DataFrame:
    """(conv, seg, top, path, below): every segment of every conversation, its
    head, and the head of the one that follows it (null at the end)."""
    cut = (turns.groupBy(F.col("conv_id").alias("conv"), F.floor(F.col("at") / SEGMENT).cast("long").alias("seg"))
           .agg(F.sort_array(F.collect_list(F.struct("at", "unit"))).alias("x"))
           .select("conv", "seg", F.unhex(F.concat_ws("", "x.unit")).alias("path")))
    cut = saved(cut, "segments")
    # only conversations that go on beyond a segment need hashes of them
    later = cut.where("seg > 0")
    first = cut.where("seg = 0").join(later.where("seg = 1").select("conv"), "conv", "left_semi")
    heads = saved(_heads(first.unionByName(later).select("conv", "seg", F.md5("path").alias("digest"))), "heads")
    nxt = heads.where("seg > 0").select("conv", (F.col("seg") - 1).alias("seg"), F.col("head").alias("below"))
    top = F.when(F.col("seg") == 0, F.lit(ROOT)).otherwise(F.col("head"))
    return cut.join(heads, ["conv", "seg"], "left").join(nxt, ["conv", "seg"], "left").select("conv", "seg", top.alias("top"), "path", "below")


def ends_hash(ends: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of each node, rising, joined by commas.

    Ids are range-partitioned and written in pieces of ``PIECE`` bytes, which
    one task a node reads in order, so many ids are never held at once."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, text, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first], pa.int64()), pa.array([",".join(text)])], ["node", "first", "ids"])

        for b in batches:
            for n, c in zip(b.column("node").to_pylist(), b.column("conv").to_pylist()):
                if n != node or size >= PIECE:
                    if text:
                        yield piece()
                    node, first, text, size = n, c, [], 0
                text.append(str(c))
                size += 21
        if text:
            yield piece()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            done = []
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if n != node:
                    if sha:
                        done.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done]) for i in (0, 1)], ["node", "ends"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], ["node", "ends"])

    cut = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node string, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(joined, "node string, ends string")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_SWEPT = f"top string, {_NODE}"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes below the heads of rows that come sorted by head and path, and for
    each head a row with depth -1: its children, leaves and saved tokens."""
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    types = [pa.string(), *[pa.int64()] * 7, pa.string()]
    out: list[tuple] = []

    # a node on the stack: [convs, smallest id, children, leaves, saved, bytes, ends, finished children]
    def close(stack: list, depth: int) -> None:
        node = stack.pop()
        convs, conv, children, leaves, kept, size, ends, below = node
        leaves = leaves or 1
        kept += (convs - 1) * size
        for x in below:
            out.append((top, x[0], depth + 1, conv, *x[1:]))
        up = stack[-1]
        up[0] += convs
        up[1] = conv if up[1] is None else min(up[1], conv)
        up[2] += 1
        up[3] += leaves
        up[4] += kept
        up[7].append((conv, convs, children, leaves, kept, ends))

    def finish() -> None:
        while len(stack) > 1:
            close(stack, first + len(stack) - 1)
        head = stack[0]
        for x in head[7]:
            out.append((top, x[0], first + 1, top_conv, *x[1:]))
        out.append((top, None, -1, None, None, head[2], head[3], head[4], None))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        out.clear()
        return batch

    top, stack, last, first, top_conv = None, [], b"", 0, None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("top", "depth", "top_conv", "path", "w", "conv", "ends", "b_children", "b_leaves", "b_saved")]
        for t, depth, tc, path, w, conv, ends, b_children, b_leaves, b_saved in zip(*cols):
            if t != top:
                if top is not None:
                    finish()
                top, first, top_conv, last = t, depth, tc, b""
                stack = [[0, None, 0, 0, 0, 0, None, []]]
            same, most = 0, min(len(path), len(last))
            while same < most and path[same:same + UNIT] == last[same:same + UNIT]:
                same += UNIT
            while len(stack) > same // UNIT + 1:
                close(stack, first + len(stack) - 1)
            for k in range(same, len(path), UNIT):
                stack.append([0, None, 0, 0, 0, int.from_bytes(path[k + 16:k + 24], "big"), None, []])
            node = stack[-1]
            node[0] += w
            node[1] = conv if node[1] is None else min(node[1], conv)
            node[2] += b_children
            node[3] += b_leaves
            node[4] += b_saved
            node[6] = ends if node[6] is None else node[6]
            last = path
            if len(out) > 20_000:
                yield flush()
    if top is not None:
        finish()
    if out:
        yield flush()


def _swept(rows: DataFrame) -> DataFrame:
    return rows.repartition("top").sortWithinPartitions("top", "path").mapInArrow(_sweep, _SWEPT)


def _subtree_sums(tree: DataFrame) -> DataFrame:
    """(top, leaves, saved) summed over the containers below and including each
    one, of (top, up, leaves, saved) with ``up`` the container above or null."""
    tree = saved(tree, "containers")
    while True:
        lower = tree.where("up is not null")
        if is_empty(lower):
            return tree.select("top", "leaves", "saved")
        more = lower.groupBy(F.col("up").alias("k")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = tree.select(F.col("top").alias("a"), F.col("up").alias("up2"))
        step = tree.join(more, F.col("top") == F.col("k"), "left").join(above, F.col("up") == F.col("a"), "left")
        tree = saved(step.select("top", F.col("up2").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                                 (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "containers")


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the containers that are left, heads that bursting made): rows
    (top, depth, top_conv, path, w, conv, ends, below); a head has top, up (the
    container that burst), depth, conv, up_conv, n (its conversations), size
    (bytes of its last turn), ends. Stops when no container holds more than
    ``limit`` turns."""
    heads, done = None, None
    while True:
        big = (rows.groupBy(F.col("top").alias("t")).agg(F.sum(F.octet_length("path") / UNIT + 1).alias("turns"), F.count(F.lit(1)).alias("n_rows"))
               .where((F.col("turns") > limit) & (F.col("n_rows") > 1)).select("t"))
        big = saved(big, "large")
        if is_empty(big):
            done = rows if done is None else done.unionByName(rows)
            return done, heads
        calm = rows.join(big, F.col("top") == F.col("t"), "left_anti")
        done = calm if done is None else done.unionByName(calm)
        moving = rows.join(big, F.col("top") == F.col("t"), "left_semi").where(F.octet_length("path") > 0)
        unit = F.expr(f"substring(path, 1, {UNIT})")
        moved = moving.select(F.md5(F.concat(F.col("top").cast("binary"), unit)).alias("top"), F.col("top").alias("up"), F.col("top_conv").alias("up_conv"),
                              (F.col("depth") + 1).alias("depth"), F.conv(F.hex(F.expr(f"substring(path, 17, {UNIT - 16})")), 16, 10).cast("long").alias("size"),
                              F.expr(f"substring(path, {UNIT + 1})").alias("path"), "w", "conv", "ends", "below")
        moved = saved(moved, "burst")
        # rows that end at the new head carry its ends; there is at most one
        made = saved(moved.groupBy("top", "up", "up_conv", "depth", "size").agg(
            F.sum("w").alias("n"), F.min("conv").alias("conv"), F.max(F.when(F.octet_length("path") == 0, F.col("ends"))).alias("ends")), "heads")
        heads = made if heads is None else heads.unionByName(made)
        rows = saved(moved.join(made.select(F.col("top").alias("t"), F.col("conv").alias("top_conv")), F.col("top") == F.col("t"))
                     .select("top", "depth", "top_conv", "path", "w", "conv", "ends", "below"), "rows")


def prefix_trie(convs: DataFrame, turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of conversations: conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    ``convs`` (conv_id) names all conversations, also those without turns;
    ``turns`` (conv_id, at, unit) has theirs, numbered without gaps from 0 on.
    Without conversations there are no nodes, not even the root. The result
    doesn't depend on ``limit``."""
    cut = saved(segments(turns), "cut")
    mark = F.concat("top", F.lit("/"), F.md5("path"))
    ends = cut.where("below is null").select(mark.alias("node"), "conv")
    bare = convs.select(F.col("conv_id").alias("conv")).join(turns.select(F.col("conv_id").alias("conv")).distinct(), "conv", "left_anti")
    hashes = saved(ends_hash(ends.unionByName(bare.select(F.lit(ROOT).alias("node"), "conv"))), "ends")

    rows = saved(cut.groupBy("top", "seg", "path").agg(F.count(F.lit(1)).alias("w"), F.min("conv").alias("conv"), F.max("below").alias("below")), "distinct")
    whole = convs.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return _digest(convs.sparkSession.createDataFrame([], _NODE))
    tops = rows.where("below is not null").select(F.col("below").alias("t"), F.col("conv").alias("top_conv"))
    rows = (rows.withColumn("mark", mark).join(hashes.withColumnRenamed("node", "mark"), "mark", "left")
            .join(tops, F.col("top") == F.col("t"), "left")
            .select("top", (F.col("seg") * SEGMENT).alias("depth"), F.coalesce("top_conv", F.lit(whole["conv"])).alias("top_conv"),
                    "path", "w", "conv", "ends", "below"))
    rows, heads = burst(saved(rows, "rows"), limit)
    rows = saved(rows, "containers")

    def with_below(sums: DataFrame | None) -> DataFrame:
        if sums is None:
            return rows.select("*", *[F.lit(0).cast("long").alias(x) for x in ("b_children", "b_leaves", "b_saved")])
        b = sums.select(F.col("top").alias("t"), *[F.col(x).alias(f"b_{x}") for x in ("children", "leaves", "saved")])
        return rows.join(b, F.col("below") == F.col("t"), "left").select(
            *rows.columns, *[F.coalesce(f"b_{x}", F.lit(0).cast("long")).alias(f"b_{x}") for x in ("children", "leaves", "saved")])

    # what each container holds by itself; a segment that goes on gives no leaf there
    swept = saved(_swept(with_below(None)), "swept")
    own = swept.where("depth = -1").select("top", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    down = rows.where("below is not null").select(F.col("below").alias("t"), F.col("top").alias("up"), (F.octet_length("path") > 0).alias("counted"))
    goes_on = not is_empty(down)
    if heads is None and not goes_on:
        nodes, sums = swept.where("depth >= 0"), saved(own, "sums")
    else:
        # the tree of containers: burst ones, those left, and where each hangs
        none = F.lit(None).cast("string")
        tree = own.join(down, F.col("top") == F.col("t"), "left").select("top", "up", "children", "leaves", "saved")
        # sweeping took a path that goes on for a leaf of its container, unless it was used up
        fewer = down.where("counted").groupBy(F.col("up").alias("k")).agg(F.count(F.lit(1)).alias("less"))
        tree = tree.join(fewer, F.col("top") == F.col("k"), "left").select(
            "top", "up", "children", (F.col("leaves") - F.coalesce("less", F.lit(0))).alias("leaves"), "saved")
        if heads is not None:
            # burst containers have as many children as they made heads
            bursts = heads.groupBy(F.col("up").alias("top")).agg(F.count(F.lit(1)).alias("children")).select(
                "top", none.alias("up"), "children", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
            # a burst container may itself hang below a segment
            bursts = bursts.drop("up").join(down, F.col("top") == F.col("t"), "left").select("top", "up", "children", "leaves", "saved")
            tree = tree.unionByName(bursts)
            mine = heads.select(F.col("top").alias("t"), F.col("up").alias("head_up"), ((F.col("n") - 1) * F.col("size")).alias("more"))
            # a segment may end just at a head: the container below it then gives the children
            at_end = down.where("not counted").select(F.col("up").alias("e"))
            tree = (tree.join(mine, F.col("top") == F.col("t"), "left").join(at_end, F.col("top") == F.col("e"), "left")
                    .select("top", F.coalesce("head_up", "up").alias("up"), "children",
                            (F.col("leaves") + F.when(F.col("head_up").isNotNull() & (F.col("children") == 0) & F.col("e").isNull(), 1).otherwise(0)).alias("leaves"),
                            (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved")))
        tree = saved(tree, "tree")
        total = _subtree_sums(tree.select("top", "up", "leaves", "saved"))
        sums = saved(total.join(tree.select("top", "children"), "top"), "sums")
        if goes_on:
            swept = saved(_swept(with_below(sums)), "swept")
        nodes = swept.where("depth >= 0")
        if heads is not None:
            passed = down.where("not counted").select(F.col("up").alias("e"), F.col("t").alias("lower"))
            lower = sums.select(F.col("top").alias("lower"), F.col("children").alias("lower_children"))
            top = (heads.join(sums.select(F.col("top").alias("t"), "children", "leaves", "saved"), F.col("top") == F.col("t"))
                   .join(passed.join(lower, "lower"), F.col("top") == F.col("e"), "left"))
            nodes = nodes.drop("top").unionByName(top.select(
                F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                (F.col("children") + F.coalesce("lower_children", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"),
                F.col("saved").alias("saved_tokens"), "ends"))
    top = sums.where(F.col("top") == ROOT).first()  # null without turns
    turnless = hashes.where(F.col("node") == ROOT).first()
    root = convs.sparkSession.createDataFrame([(whole["conv"], 0, None, whole["n"], *((top["children"], top["leaves"], top["saved"]) if top else (0, 1, 0)),
                                                turnless["ends"] if turnless else None)], _NODE)
    return _digest(nodes.select(*root.columns).unionByName(root))


def _digest(nodes: DataFrame) -> DataFrame:
    nothing = hashlib.sha256().hexdigest()
    return nodes.select(*[c for c in nodes.columns if c != "ends"], F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def family_trie(conversations: DataFrame, family: int = 5, heads: int = 9, limit: int = LIMIT) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text), each
    rebuilt with the first h turns of conversation c - c % ``family``, h the
    crc32 of its id as text modulo ``heads``.

    Turns go by turn number (null first; equal numbers by role, then by a hash
    of the text); a null role or text is an empty one; repeated rows are
    repeated turns. Rows without conv_id belong to no conversation and are left
    out. Other columns are not looked at."""
    turns = saved(ordered_turns(conversations), "ordered")
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % heads
    convs, own = rebuilt(turns, c - c % family, head, heads)
    return prefix_trie(convs, saved(own, "rebuilt"), limit)
