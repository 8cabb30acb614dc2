"""SimHash near-duplicates by multi-index hashing (operator 6).

Fingerprint: A-Z are lower-cased, words are runs of anything but ASCII white
space, shingles are ``shingle`` consecutive words joined by a space, repeats
included (fewer words: the whole sequence; none, or a null text: fingerprint
zero). A bit is 1 when it is set in over half of the shingles' XXH64 (seed 42).

Links: fingerprints are split into three segments of 21 or 22 bits. If two
fingerprints differ in at most four bits, then the first or the second
segment differs in at most one, or the third not at all (else 2 + 2 + 1 = 5
bits differ), so it is enough to enumerate the ball of radius one in two
segments and to look the third up as it is. In general segment radii r_i find
all pairs within distance sum(r_i + 1) - 1. Every pair found is verified on
all 64 bits, so the result is exact.

Scale: equal fingerprints are one node, so groups of copies cost one row. A
first pass links each fingerprint to the most frequent one among those that
share a whole segment; the components that gives take most of a group of near
copies together, and the second pass looks only for pairs between different
components. So a group of near copies never becomes all of its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import saved
from reviewlab.llm.components import components

BITS = 64


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of one text."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stop = ends[k - 1:].tolist()
    begin = [0, *(ends[:len(stop) - 1] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(begin, stop)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 255 * 64):  # uint8 sums of 255 rows at most
        part = np.unpackbits(hashes[i:i + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        if whole:
            counts += part[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += part[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of each row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").cast(pa.large_binary())
            fps = [fingerprint(x.as_py() or b"", shingle) for x in column]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def segment_radii(max_bits: int, segments: int) -> list[int]:
    """Radii r_i, as equal as may be, with sum(r_i + 1) = max_bits + 1."""
    left = max_bits + 1 - segments
    if left < 0:
        return [0] * (max_bits + 1)  # fewer segments would do: these all match exactly
    return [left // segments + (i < left % segments) for i in range(segments)]


def segment_keys(fp: Column, widths: list[int]) -> list[Column]:
    keys, at = [], 0
    for w in widths:
        keys.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)))
        at += w
    return keys


def segment_widths(n: int) -> list[int]:
    return [BITS // n + (i < BITS % n) for i in range(n)]


def ball(width: int, radius: int) -> list[int]:
    """Masks of the ball around a key: all sets of at most ``radius`` bits."""
    masks, ring = [0], [(0, 0)]
    for _ in range(radius):
        ring = [(m | 1 << i, i + 1) for m, low in ring for i in range(low, width)]
        masks += [m for m, _ in ring]
    return masks


def near_links(fps: DataFrame, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """Edges (u, v) between fingerprints that join all of ``fps`` (fp, n) that
    are linked by steps of at most ``max_bits`` bits; not every pair is there,
    but no two linked fingerprints are left apart."""
    radii = segment_radii(max_bits, segments)
    widths = segment_widths(len(radii))
    keys = segment_keys(F.col("fp"), widths)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    own = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), k.alias("key")) for i, k in enumerate(keys)]))
    index = saved(fps.select("fp", "n", own.alias("s")).select("s.seg", "s.key", "fp", "n"), "segments")
    leader = (index.groupBy("seg", "key")
              .agg(F.max(F.struct("n", "fp"))["fp"].alias("top"), F.count(F.lit(1)).alias("size"))
              .where("size > 1").select("seg", "key", "top"))
    first = saved(index.join(leader, ["seg", "key"]).where("fp <> top").where(near("fp", "top"))
                  .select(F.col("fp").alias("u"), F.col("top").alias("v")).distinct(), "leaders")
    class_of = components(first).withColumnRenamed("node", "fp")
    known = saved(fps.select("fp").join(class_of, "fp", "left")
                  .select("fp", F.coalesce("root", "fp").alias("root")), "classes")

    probes = []
    for i, (k, w, r) in enumerate(zip(keys, widths, radii)):
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(w, r)])).alias("mask")
        probes.append(known.select("fp", "root", masks).select(F.lit(i).alias("seg"), k.bitwiseXOR(F.col("mask")).alias("key"),
                                                               F.col("fp").alias("u"), F.col("root").alias("ru")))
    probe = probes[0]
    for p in probes[1:]:
        probe = probe.unionByName(p)
    entry = known.select(F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), k.alias("key")) for i, k in enumerate(keys)])).alias("s"),
                         F.col("fp").alias("v"), F.col("root").alias("rv")).select("s.seg", "s.key", "v", "rv")
    # each pair is found from its smaller fingerprint alone: balls are symmetric
    second = (probe.join(entry, ["seg", "key"]).where("u < v and ru <> rv").where(near("u", "v")).select("u", "v"))
    return first.unionByName(second)


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id of the documents reachable over links.
    Null doc_id: the row is kept, counts for links and gets its group's
    smallest id (null when the group has none). Repeated rows give repeated
    rows. An empty table gives none. Other columns are not looked at."""
    fps = saved(fingerprints(docs, shingle), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(near_links(nodes, max_bits, segments)).withColumnRenamed("node", "fp")
    rooted = saved(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = saved(rooted.join(low, "root").select("fp", "component_id"), "named")
    return (fps.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each group of ``simhash_groups``: that whose doc_id is
    the component_id, once where rows with that id repeat (any one of them).
    Rows without a doc_id can't be named as copies and all stay. Columns are
    those of ``docs``."""
    keep = (simhash_groups(docs, shingle, max_bits).where("doc_id = component_id")
            .select(F.col("doc_id").alias("_kept")).distinct())
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    named = once.join(keep, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))
