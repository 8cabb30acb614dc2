"""Benchmark decontamination by SimHash windows (operator 5).

Words are runs of letters and digits (A-Z as a-z), shingles five words; a
shingle weighs the share of its words that differ. For each benchmark item of
m shingles, windows of m shingles of a document are compared with it:

1. A window's SimHash (weighted sums over its shingles) is cut into seven
   blocks; two fingerprints within ``RADIUS`` = 20 bits have a block that
   differs in at most two bits (else 7 * 3 = 21 bits differ), so tables of the
   balls of radius two around the items' blocks give all items within the
   radius. Every find is held against the full distance.
2. What remains is verified by exact weighted Jaccard similarity of the two
   bags of shingles, ``threshold`` or more.

Only windows that hold some shingle of an item of their size are fingerprinted:
any other has similarity 0. Shingles are looked up for every position of every
text, on arrays; fingerprints are made near the hits only.

The benchmark goes to the tasks in blocks of at most ``BLOCK_ITEMS`` items and
about ``BLOCK_BYTES`` of text, one pass over the documents for each block, so
what is broadcast is bounded however large the benchmark is."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import Words, mix, word_chunks

SHINGLE = 5
BITS, BLOCKS, BLOCK_RADIUS = 64, 7, 2
#: what the blocks guarantee to find
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
FOUND = ("doc_id long, item_id long, similarity double, distance int, first_word long, last_word long, "
         "first_byte long, last_byte long")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of an array of word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _STEP + words[i:n + i]
    return mix(h)


def shingle_weights(words: np.ndarray, k: int) -> np.ndarray:
    """Share of the words of each shingle that differ."""
    n = len(words) - k + 1
    seen = np.ones(max(n, 0))
    for i in range(1, k):
        new = np.ones(max(n, 0), bool)
        for j in range(i):
            new &= words[i:n + i] != words[j:n + j]
        seen += new
    return seen / k


def window_prints(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash (uint64) of each window begin..end of a run of shingles."""
    out = np.zeros(len(begin), np.uint64)
    if not len(begin):
        return out
    base = int(begin.min())
    top = int(end.max())
    bits = np.unpackbits(hashes[base:top].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((top - base + 1, BITS))
    np.cumsum((2.0 * bits - 1.0) * weights[base:top, None], axis=0, out=total[1:])
    for k in range(0, len(begin), 1 << 14):
        s = total[end[k:k + (1 << 14)] - base] - total[begin[k:k + (1 << 14)] - base]
        out[k:k + (1 << 14)] = np.packbits(s > 1e-9, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    names = np.concatenate([a, b])
    u, at = np.unique(names, return_inverse=True)
    weight = np.zeros(len(u))
    weight[at] = np.concatenate([wa, wb])
    ca, cb = np.bincount(at[:len(a)], minlength=len(u)), np.bincount(at[len(a):], minlength=len(u))
    most = (weight * np.maximum(ca, cb)).sum()
    return float((weight * np.minimum(ca, cb)).sum() / most) if most else 0.0


class Item(NamedTuple):
    id: int | None
    hashes: np.ndarray
    weights: np.ndarray


class Bench:
    """Items of one shingle length with their tables."""

    def __init__(self, k: int, items: list[Item]) -> None:
        self.k, self.items = k, items
        self.size = np.array([len(i.hashes) for i in items])
        self.prints = np.array([window_prints(i.hashes, i.weights, np.zeros(1, int), np.array([len(i.hashes)]))[0] for i in items], np.uint64)
        self.sizes, self.size_of = np.unique(self.size, return_inverse=True)
        # sizes of the items that hold each shingle, as runs
        pairs = np.unique(np.concatenate([np.stack([i.hashes, np.full(len(i.hashes), s, np.uint64)], 1) for i, s in zip(items, self.size_of)]), axis=0)
        self.names, self.at = np.unique(pairs[:, 0], return_index=True)
        self.n_at = np.diff(np.append(self.at, len(pairs)))
        self.held = pairs[:, 1].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.names >> np.uint64(44)] = True
        self.tables = []
        width = [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]
        low = 0
        for w in width:
            masks = np.array([sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in _subsets(w, r)], np.uint64)
            block = (self.prints >> np.uint64(low)) & np.uint64((1 << w) - 1)
            value = ((self.size_of.astype(np.uint64) << np.uint64(w))[:, None] | (block[:, None] ^ masks)).ravel()
            item = np.repeat(np.arange(len(items)), len(masks))
            order = np.argsort(value, kind="stable")
            begin = np.searchsorted(value[order], np.arange((len(self.sizes) << w) + 1, dtype=np.uint64))
            self.tables.append((low, w, begin, item[order]))
            low += w

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, size number) of every shingle that items hold."""
        pos = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.names, hashes[pos]), len(self.names) - 1)
        ok = self.names[at] == hashes[pos]
        pos, at = pos[ok], at[ok]
        n = self.n_at[at]
        run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(pos, n), self.held[np.repeat(self.at[at], n) + run]

    def near(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) for all items of the windows' sizes within
        RADIUS bits."""
        out = []
        for low, w, begin, item in self.tables:
            v = (size << w) | ((prints >> np.uint64(low)) & np.uint64((1 << w) - 1)).astype(np.int64)
            n = begin[v + 1] - begin[v]
            window = np.repeat(np.arange(len(prints)), n)
            run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack([window, item[np.repeat(begin[v], n) + run]], 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        d = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]])
        ok = d <= RADIUS
        return pairs[ok, 0], pairs[ok, 1], d[ok]


def _subsets(n: int, r: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), r))


def benches(item_ids: list[int | None], texts: list[str | None]) -> list[Bench]:
    """Items by shingle length: five words, or all words of a shorter item.
    Items without a word match nothing."""
    by: dict[int, list[Item]] = {}
    column = pa.array(texts, pa.large_string())
    for w in word_chunks(column, letters_only=True):
        for t in range(len(w.bounds) - 1):
            words = w.hash[w.bounds[t]:w.bounds[t + 1]]
            if len(words):
                k = min(SHINGLE, len(words))
                by.setdefault(k, []).append(Item(item_ids[w.first + t], shingle_hashes(words, k), shingle_weights(words, k)))
    return [Bench(k, items) for k, items in sorted(by.items())]


def _found(w: Words, bench: Bench, threshold: float) -> Iterator[tuple]:
    """(text, item, similarity, distance, first word, last word) of verified
    windows of the texts of a chunk: the best window of each text and item."""
    k = bench.k
    n_words = np.diff(w.bounds)
    n_sh = np.maximum(n_words - k + 1, 0)
    all_hashes = shingle_hashes(w.hash, k)
    if not len(all_hashes):
        return
    # position in the chunk's words; shingles across two texts don't count
    text_of = np.repeat(np.arange(len(n_words)), n_words)[:len(all_hashes)]
    first, stop = w.bounds[:-1], w.bounds[:-1] + n_sh
    pos, size = bench.hits(all_hashes)
    ok = pos < stop[text_of[pos]]
    pos, size = pos[ok], size[ok]
    if not len(pos):
        return
    best: dict[tuple[int, int], tuple] = {}
    weights = shingle_weights(w.hash, k)
    # windows that hold the hit, as (size, begin); a short text is one window
    m = bench.sizes[size]
    t = text_of[pos]
    low = np.maximum(pos - m + 1, first[t])
    high = np.minimum(pos, np.maximum(stop[t] - m, first[t]))
    low = np.minimum(low, high)
    for a in range(0, len(pos), 2000):  # bounded memory
        r = slice(a, a + 2000)
        n = high[r] - low[r] + 1
        run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        windows = np.unique(np.stack([np.repeat(low[r], n) + run, np.repeat(size[r], n)], 1), axis=0)
        begin, s = windows[:, 0], windows[:, 1]
        end = np.minimum(begin + bench.sizes[s], stop[text_of[begin]])
        # runs of windows that overlap are summed together
        cut = np.flatnonzero(np.append(True, begin[1:] > np.maximum.accumulate(end)[:-1]))
        prints = np.concatenate([window_prints(all_hashes, weights, begin[x:y], end[x:y]) for x, y in zip(cut, np.append(cut[1:], len(begin)))])
        which, item, distance = bench.near(prints, s)
        for x, i, d in zip(which.tolist(), item.tolist(), distance.tolist()):
            b, e = int(begin[x]), int(end[x])
            it = bench.items[i]
            sim = similarity(all_hashes[b:e], weights[b:e], it.hashes, it.weights)
            if sim >= threshold:
                key, new = (int(text_of[b]), i), (-sim, b, e, d)
                if key not in best or new < best[key]:
                    best[key] = new
    for (text, i), (sim, b, e, d) in best.items():
        yield text, i, -sim, d, b, e + k - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, distance, first_word, last_word,
    first_byte, last_byte): for each row of ``docs`` (doc_id, text) and each
    item of ``benchmark`` (item_id, text) that it holds a passage of, the most
    similar window (the first of equal ones), as words and bytes of the text,
    last ones not included.

    Null or empty texts and items match nothing; items of fewer than five words
    are one shingle of all their words. Repeated documents give repeated rows;
    repeated items one row each. No rows on either side: no result."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BLOCK_ITEMS), math.ceil(size["b"] / BLOCK_BYTES))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about a block's bound
        block = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            tables = benches(*block.value)
            for b in batches:
                for w in word_chunks(b.column("text"), letters_only=True):
                    out = []
                    for bench in tables:
                        for text, i, sim, d, x, y in _found(w, bench, threshold):
                            at = int(w.offsets[text])
                            out.append((b.column("doc_id")[w.first + text].as_py(), bench.items[i].id, sim, d, x - int(w.bounds[text]), y - int(w.bounds[text]),
                                        int(w.start[x]) - at, int(w.end[y - 1]) - at))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

        part = narrow.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


_NAMES = [f.split()[0] for f in FOUND.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int32()] + [pa.int64()] * 4


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that hold no passage of a benchmark item, with their
    columns. Rows without doc_id can't be named by ``contaminated`` and stay."""
    leaks = contaminated(docs, benchmark, threshold).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col("doc_id").cast("long") == F.col("_leak"), "left_anti")
