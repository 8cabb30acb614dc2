"""Toxicity by class-conditional Kneser-Ney models (operator 3).

Words are runs of letters and digits (A-Z as a-z). For each class c, toxic and
ordinary, an interpolated bigram model with modified discounts:

    P_c(w|h) = (n_c(hw) - D(n_c(hw))) / n_c(h) + sum_v D(n_c(hv)) / n_c(h) * P_c(w)
    P_c(w)   = (N_c(.w) - E(N_c(.w))) / N_c(..) + sum_v E(N_c(.v)) / N_c(..) * P(w)
    P(w)     = (n(w) + 1) / (n + words)

n counts occurrences, N(.w) distinct words before w. P(w) is the shared
backoff: word counts of the whole corpus, all documents and not only labelled
ones, so that a rare word costs both classes the same until one class knows it.
The discounts D and E of counts 1, 2, and 3 or more are estimated for each
class from counts of counts (Chen and Goodman); D(0) = E(0) = 0. As a class has
millions of rare words that only chance gave it, the same counts are also read
with the larger discounts of ``SMOOTHER``, under which a word or bigram speaks
for a class once the class has it more often.

A text's score compares its log-likelihoods under the two models, normalised by
length: the mean log ratio of its words (each at most ``CLIP`` either way), and
how many of its words clearly favour the toxic model (over ``CLEAR``), as
counts, as a share and as their sum over the root of the length. A logistic
function of these, fitted on labelled documents that the models have not seen,
gives the score. It takes the estimated discounts and, of the larger ones,
none, one pair or all, whichever predicts best there.

The class models are counted over all labelled documents that don't fit the
logistic function, and the shared backoff counts over all words of all documents,
by the whole 64-bit hash, in tables that grow with the input. P(w) cancels out of
the ratio of a word that neither class knows, so only the words of the class
models are looked up in it. A table of up to ``SENT_ROWS`` words and bigrams goes
to all tasks, and texts are scored where they are read. With a larger one texts
are dealt by a hash of id and text to chunks of about ``CHUNK`` bytes, and the
distinct words and bigrams of a chunk are joined with the table; copies or a hot
source meet nowhere. The chunks go in ``ROUNDS`` of about equal size, each saved
before the next, so that a share of the texts and answers is on disk at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import labelled_sample, saved, sums, word_chunks

#: one labelled document in CALIBRATE fits the logistic function (of those at
#: most about SAMPLE / CALIBRATE of each class), the others make the models
SAMPLE, CALIBRATE = 20_000, 4
#: rows of the models' table that are sent to all tasks; a larger one is joined
SENT_ROWS = 1_000_000
#: bytes of text in a chunk, whose distinct words and bigrams are looked up together
CHUNK = 8 << 20
#: jobs that share out the chunks, whose shuffles are on disk one after the other
ROUNDS = 8
#: bits that a chunk asks by beyond those that number the table's rows
SPARE_BITS = 5
#: larger discounts of bigrams and words
SMOOTHER = ((2.0, 1.0), (5.0, 2.0), (20.0, 5.0))
CLIP, CLEAR = 6.0, 3.0
_FIRST = np.uint64(0x5851F42D4C957F2D)  # stands before the first word of a text
FEATURES = 5


#: multipliers of Spark's xxhash64 (public algorithm), so that arrays and
#: DataFrames agree on a bigram's key
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Distinct numbers in ascending order, by sorting (np.unique hashes them, at
    some ten times the cost)."""
    numbers = np.sort(numbers)
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


def xxhash64_longs(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of some columns of longs."""
    rotate = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    seed = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        h = (seed + _P5 + np.uint64(8)) ^ (rotate(x * _P2, 31) * _P1)
        h = rotate(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        seed = h ^ (h >> np.uint64(32))
    return seed


def bigram_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word before, hash of the bigram) for each word."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    before[starts] = _FIRST
    return before, xxhash64_longs(before, words)


# ------------------------------------------------------------------ counting

def _summed(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(held), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of the words of ``docs`` (text): whole hashes, occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for b in batches:
            for w in word_chunks(b.column("text"), letters_only=True):
                key, n = np.unique(w.hash, return_counts=True)
                held.append(key), counts.append(n)
                size += len(key)
            if size > 4_000_000:  # bounded memory; the rest is summed by Spark
                key, n = _summed(held, counts)
                held, counts, size = [key], [n], len(key)
                if size > 2_000_000:
                    yield _counted(key, n)
                    held, counts, size = [], [], 0
        if held:
            yield _counted(*_summed(held, counts))

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(h, w, n0, n1) of the bigrams of ``docs`` (text, y): hashes of the word
    before and of the word; occurrences in each class."""
    names = ["h", "w", "n0", "n1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            for x in word_chunks(b.column("text"), letters_only=True):
                before, key = bigram_hashes(x.hash, x.bounds)
                label = np.repeat(y[x.first:x.first + len(x.bounds) - 1], np.diff(x.bounds))
                bigrams, at, inverse = np.unique(key, return_index=True, return_inverse=True)
                n = [np.bincount(inverse, label == c, len(bigrams)).astype(np.int64) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (before[at].view(np.int64), x.hash[at].view(np.int64), *n)], names)

    return (docs.select("text", "y").mapInArrow(run, "h long, w long, n0 long, n1 long").groupBy("h", "w")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def discounts(counts: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from how many things were
    counted 1, 2, 3 and 4 times; where those are too few, 0.75 of one each."""
    t1, t2, t3, t4 = counts
    if not t1 or not t2:
        return 0.75, 0.75, 0.75
    y = t1 / (t1 + 2 * t2)
    raw = 1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t3 else 0.75
    return tuple(min(max(d, 0.1), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


def _estimated(counted: DataFrame, columns: tuple[str, str]) -> list[tuple[float, float, float]]:
    row = counted.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in columns for k in (1, 2, 3, 4)]).first()
    return [discounts(tuple(row[f"{c}_{k}"] for k in (1, 2, 3, 4))) for c in columns]


#: discounts of counts 1, 2, and 3 or more; or the most that is taken of any
Discounts = tuple[float, float, float] | float


def _discount(n: Column, d: Discounts) -> Column:
    if isinstance(d, float):
        return F.least(n.cast("double"), F.lit(d))
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


class Shared(NamedTuple):
    """Numbers of the models that don't depend on a word: of class 0 and 1,
    and of the estimated and each of the larger discounts."""
    contexts: list[float]          # N_c(..)
    bigram: list[list[Discounts]]  # D
    word: list[list[Discounts]]    # E
    backoff: list[list[float]]     # weight of P(w)


READINGS = 1 + len(SMOOTHER)
#: numbers of a word: as a context (occurrences, discounts), contexts, P(w)
WIDTH = 2 + 2 * READINGS + 3


def bounded_texts(docs: DataFrame, labelled: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, y) of the documents of ``labelled`` (doc_id, y) that have
    a text, those of a class with more than ``bound`` bytes thinned by a hash of
    the id. Ids whose texts together exceed the bound are left out. No query
    uses it: the class models are of all labelled texts.

    Only ids and sizes are shuffled. The chosen ids, of at least a byte of text
    each, are broadcast: at most about ``bound`` a class."""
    size = F.octet_length("text")
    sizes = docs.where(size > 0).groupBy("doc_id").agg(F.sum(size).alias("n")).where(F.col("n") <= bound)
    sizes = saved(labelled.join(sizes, "doc_id"), "sizes")
    totals = {r["y"]: r["n"] for r in sizes.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("model"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(1.0)
    for y, total in totals.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, bound / total))).otherwise(share)
    return docs.where(size > 0).join(F.broadcast(sizes.where(draw < share).select("doc_id", "y")), "doc_id")


def model(docs: DataFrame, for_model: DataFrame) -> tuple[DataFrame, Shared]:
    """The table (key, width, v) of the models and their shared numbers, counted
    over all texts of ``for_model`` (doc_id, y). v, of ``width`` numbers, of a bigram
    is its occurrences in class 0 and 1; of a word, the same as a context, the sums
    of discounts there, its contexts and its P(w)."""
    ids = F.broadcast(for_model) if for_model.limit(SENT_ROWS + 1).count() <= SENT_ROWS else for_model
    bigrams = saved(bigram_counts(docs.join(ids, "doc_id")), "bigrams")
    d = [_estimated(bigrams, ("n0", "n1")), *[[x, x] for x, _ in SMOOTHER]]
    over = {f"o{i}{c}": _discount(F.col(f"n{c}"), d[i][c]) for i in range(READINGS) for c in (0, 1)}
    no, zero = F.lit(0).cast("long"), F.lit(0.0)
    # a word as context, as word, and in the corpus
    as_context = bigrams.select(F.col("h").alias("key"), F.col("n0").alias("t0"), F.col("n1").alias("t1"), *[x.alias(o) for o, x in over.items()], no.alias("c0"), no.alias("c1"), no.alias("n"))
    as_word = bigrams.select(F.col("w").alias("key"), no.alias("t0"), no.alias("t1"), *[zero.alias(o) for o in over],
                             (F.col("n0") > 0).cast("long").alias("c0"), (F.col("n1") > 0).cast("long").alias("c1"), no.alias("n"))
    corpus = saved(word_counts(docs), "words")
    whole = corpus.agg(F.coalesce(F.sum("n"), no).alias("n"), F.count(F.lit(1)).alias("words")).first()
    both = as_context.unionByName(as_word).unionByName(corpus.select("key", no.alias("t0"), no.alias("t1"), *[zero.alias(o) for o in over], no.alias("c0"), no.alias("c1"), "n"))
    words = saved(both.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", *over, "c0", "c1", "n")]).where("t0 + t1 + c0 + c1 > 0"), "model")
    e = [_estimated(words, ("c0", "c1")), *[[x, x] for _, x in SMOOTHER]]
    total = words.agg(*[F.sum(c).alias(c) for c in ("c0", "c1")],
                      *[F.sum(_discount(F.col(f"c{c}"), e[i][c])).alias(f"e{i}{c}") for i in range(READINGS) for c in (0, 1)]).first()
    n = [float(total[f"c{c}"] or 0) for c in (0, 1)]
    shared = Shared(n, d, e, [[(total[f"e{i}{c}"] or 0) / n[c] if n[c] else 1.0 for c in (0, 1)] for i in range(READINGS)])
    p = ((F.col("n") + 1) / F.lit(float(whole["n"] + whole["words"] or 1))).cast("float")
    v = lambda *cols: F.array(*[F.col(c).cast("float") for c in cols])
    return (bigrams.select(F.xxhash64("h", "w").alias("key"), F.lit(2).alias("width"), v("n0", "n1").alias("v")).unionByName(
        words.select("key", F.lit(WIDTH).alias("width"), F.array(*[F.col(c).cast("float") for c in ("t0", "t1", *over, "c0", "c1")], p).alias("v"))), shared)


# ------------------------------------------------------------------- scoring

def _discounted(n: np.ndarray, d: Discounts) -> np.ndarray:
    if isinstance(d, float):
        return np.maximum(n - d, 0)
    return n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.uint8)]


class Answers:
    """The models' rows of words and bigrams, and what follows from them for
    any text: for each reading and class, backoff by context and word."""

    def __init__(self, key: np.ndarray, size: np.ndarray, values: np.ndarray, shared: Shared) -> None:
        begin = np.cumsum(size) - size
        known = []
        for width in (2, WIDTH):
            rows = np.flatnonzero(size == width)
            rows = rows[np.argsort(key[rows], kind="stable")]
            known.append((key[rows], values[(begin[rows][:, None] + np.arange(width)).ravel()].reshape(-1, width)))
        self._set(known, shared)

    @classmethod
    def of_rows(cls, known: list[tuple[np.ndarray, np.ndarray]], shared: Shared) -> Answers:
        """From rows of bigrams and of words in ascending order of key."""
        answers = cls.__new__(cls)
        answers._set(known, shared)
        return answers

    def _set(self, known: list[tuple[np.ndarray, np.ndarray]], shared: Shared) -> None:
        (self.bigrams, self.counts), (self.words, v) = known
        self.shared = shared
        v = np.concatenate([v.astype(np.float64), np.zeros((1, WIDTH))])  # the last row stands for what isn't known
        p = np.where(v[:, -1] > 0, v[:, -1], 1.0)  # cancels out where no class knows the word
        self.total = np.where(v[:, :2] > 0, v[:, :2], 1.0)
        self.word, self.backoff = np.empty((len(v), READINGS, 2)), np.empty((len(v), READINGS, 2))
        for i in range(READINGS):
            for c in (0, 1):
                n = shared.contexts[c]
                self.word[:, i, c] = (_discounted(v[:, c - 3], shared.word[i][c]) / n if n else 0.0) + shared.backoff[i][c] * p
                self.backoff[:, i, c] = np.where(v[:, c] > 0, v[:, 2 + 2 * i + c] / self.total[:, c], 1.0)
        # of a word after a context that no class knows before it, the ratio is a product of both
        self.log_word, self.log_backoff = (np.log(x[:, :, 1] / x[:, :, 0]) for x in (self.word, self.backoff))

    @staticmethod
    def places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where ``keys`` stand in ``known``; len(known) if nowhere."""
        if not len(known):
            return np.zeros(len(keys), np.int64)
        order = np.argsort(keys)  # neighbours are found near each other
        keys = keys[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        out = np.empty(len(keys), np.int64)
        out[order] = np.where(known[at] == keys, at, len(known))
        return out

    def log_ratios(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(READINGS, words): log P_toxic(w|h) - log P_ordinary(w|h) of each
        word, for the estimated and for each of the larger discounts."""
        before, key = bigram_hashes(words, bounds)
        word = self.places(self.words, words)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        starts = bounds[:-1][np.diff(bounds) > 0]
        context[starts] = self.places(self.words, before[starts])
        ratio = self.log_backoff.take(context, 0)  # rows are taken some times faster than indexed
        ratio += self.log_word.take(word, 0)
        bigram = self.places(self.bigrams, key)
        at = np.flatnonzero(bigram < len(self.bigrams))
        n, word, context = self.counts.take(bigram[at], 0).astype(np.float64), word[at], context[at]
        p = self.backoff.take(context, 0)
        p *= self.word.take(word, 0)
        total = self.total.take(context, 0)
        for i in range(READINGS):
            for c in (0, 1):
                p[:, i, c] += _discounted(n[:, c], self.shared.bigram[i][c]) / total[:, c]
        ratio[at] = np.log(p[:, :, 1] / p[:, :, 0])
        return np.ascontiguousarray(ratio.T)


def text_features(answers: Answers, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, READINGS * FEATURES): length-normalised log ratios of texts."""
    n = np.maximum(np.diff(bounds), 1)
    out = []
    for r in np.clip(answers.log_ratios(words, bounds), -CLIP, CLIP):
        at = np.flatnonzero(r > CLEAR)  # few
        text = np.searchsorted(bounds, at, "right") - 1
        clear, over = np.bincount(text, minlength=len(n)), np.bincount(text, r[at] - CLEAR, len(n))
        out += [sums(r, bounds) / n, np.log1p(clear), np.minimum(clear, 3) / 3, 10 * clear / n, over / np.sqrt(n)]
    return np.stack(out, 1)


def answers_of(table: DataFrame, shared: Shared) -> Answers:
    """A models' table of up to ``SENT_ROWS`` rows, at the driver."""
    found = table.toArrow()
    return Answers(found.column("key").to_numpy().view(np.uint64), *_of_lists(found.column("v")), shared)


def _packed(sorted_numbers: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their gaps, equal bytes of the gaps side by side."""
    gaps = np.diff(sorted_numbers, prepend=np.uint64(0))
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


#: some of the table's rows, of bigrams (width 2) or words: keys in ascending order and values
ROWS = "width int, n int, keys binary, v binary"


def _packed_rows(keys: np.ndarray, v: np.ndarray) -> tuple[int, int, bytes, bytes]:
    planes = np.ascontiguousarray(v.T, np.float32).view(np.uint8).reshape(-1, 4).T
    return v.shape[1], len(keys), _packed(keys), pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked_rows(width: int, n: int, keys: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(v, 4 * n * width, "zstd", asbytes=True), np.uint8).reshape(4, n * width)
    return _unpacked(keys, n), np.ascontiguousarray(planes.T).view(np.float32).reshape(width, n).T


def _of_lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of a column of lists."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return (np.concatenate([np.zeros(0, np.int64), *[np.diff(p.offsets.to_numpy()) for p in parts]]),
            np.concatenate([np.zeros(0, np.float32), *[p.flatten().to_numpy() for p in parts]]))


def _table_rows(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unpacked rows of bigrams and of words, each in ascending order of key."""
    found = {2: [], WIDTH: []}
    for r in zip(*[t.column(c).to_pylist() for c in ("width", "n", "keys", "v")]):
        found[r[0]].append(_unpacked_rows(*r))
    out = []
    for width, parts in found.items():
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]])
        v = np.concatenate([np.zeros((0, width), np.float32), *[x for _, x in parts]])
        order = np.argsort(keys, kind="stable")
        out.append((keys[order], v[order]))
    return out


def _joined_features(docs: DataFrame, table: DataFrame, rows: int, shared: Shared) -> DataFrame:
    """``features`` by a table of any size: texts are dealt to chunks, and the
    distinct words and bigrams of a chunk are looked up in the table.

    A chunk asks by the first bits of its keys, some more than tell the table's
    rows apart; what it gets are whole keys, so that a few rows too many come
    and none counts for another. Keys and values go packed, a row for each
    chunk and range of keys. The table is packed once and met in every round."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1 + size // CHUNK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(rows.bit_length() + SPARE_BITS, 40)
    shift = np.uint64(64 - bits)
    rounds = min(ROUNDS, 1 + size // CHUNK)
    chunks = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))

    def part_of(keys: np.ndarray) -> np.ndarray:
        return ((keys >> shift) * np.uint64(n)) >> np.uint64(bits)

    def asked(chunk: pa.Table) -> pa.Table:
        kind = np.uint32 if bits <= 32 else np.uint64
        first = [(np.array([_FIRST]) >> shift).astype(kind)]
        for b in chunk.to_batches():
            for w in word_chunks(b.column("text"), letters_only=True):
                first += [distinct((h >> shift).astype(kind)) for h in (w.hash, bigram_hashes(w.hash, w.bounds)[1])]
        first = distinct(np.concatenate(first)).astype(np.uint64)
        part, begin = np.unique((first * np.uint64(n)) >> np.uint64(bits), return_index=True)
        pieces = np.split(first, begin[1:])
        return pa.table({"part": pa.array(part.astype(np.int64)), "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(part), pa.int64()),
                         "n": pa.array([len(x) for x in pieces], pa.int32()), "first": pa.array([_packed(x) for x in pieces], pa.binary())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            key, v = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key, v = key[order], v.take(order, 0)
            names, at = np.unique(part_of(key), return_index=True)
            out = [(int(p), *_packed_rows(*x)) for p, *x in zip(names, np.split(key, at[1:]), np.split(v, at[1:]))]
            return pa.RecordBatch.from_pylist([dict(zip(("part", "width", "n", "keys", "v"), r)) for r in out], schema=schema)

        schema = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("v", pa.binary())])
        for b in batches:
            held.append((b.column("key").to_numpy().view(np.uint64), np.stack([c.to_numpy() for c in b.columns[1:]], 1)))
            count += b.num_rows
            if count >= 1_000_000:  # bounded memory
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def answered(asks: pa.Table, known: pa.Table) -> pa.Table:
        tables = [(k >> shift, k, v) for k, v in _table_rows(known)]
        out = []
        for chunk, many, data in zip(*[asks.column(c).to_pylist() for c in ("chunk", "n", "first")]):
            first = _unpacked(data, many)
            for known_first, keys, v in tables:
                begin = np.searchsorted(known_first, first)
                begin = begin[known_first[np.minimum(begin, len(known_first) - 1)] == first] if len(known_first) else begin[:0]
                count = np.searchsorted(known_first, known_first[begin], "right") - begin
                rows = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                if len(rows):
                    out.append((chunk, *_packed_rows(keys[rows], v[rows])))
        names = ("chunk", "width", "n", "keys", "v")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, types))})

    def scored(chunk: pa.Table, found: pa.Table) -> pa.Table:
        answers = Answers.of_rows(_table_rows(found), shared)
        ids, out = [], [np.zeros((0, READINGS * FEATURES))]
        for b in chunk.to_batches():
            ids.append(b.column("doc_id"))
            out += [text_features(answers, w.hash, w.bounds) for w in word_chunks(b.column("text"), letters_only=True)]
        x = np.concatenate(out)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "x": flat})

    # numbers go to Python as columns, which takes Spark less time than lists
    wide = [table.where(F.col("width") == k).select("key", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(k)]) for k in (2, WIDTH)]
    known = saved(reduce(DataFrame.unionByName, [x.mapInArrow(parts, f"part long, {ROWS}") for x in wide]), "packed")
    done = []
    for k in range(rounds):
        dealt = chunks.where(F.expr(f"chunk * {rounds} div {n}") == k)
        asks = dealt.groupBy("chunk").applyInArrow(asked, "part long, chunk long, n int, first binary")
        answers = asks.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(answered, f"chunk long, {ROWS}")
        done.append(saved(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, "doc_id long, x array<double>"), "features"))
    return reduce(DataFrame.unionByName, done)


def features(docs: DataFrame, table: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, x) of each row of ``docs`` (doc_id, text), saved: in one narrow pass
    if the table has up to ``SENT_ROWS`` rows, else by joins."""
    rows = table.count()
    if rows > SENT_ROWS:
        return _joined_features(docs, table, rows, shared)
    sent = docs.sparkSession.sparkContext.broadcast(answers_of(table, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_chunks(b.column("text"), letters_only=True):
                x = text_features(sent.value, w.hash, w.bounds)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.first, len(x)), flat], ["doc_id", "x"])

    return saved(docs.mapInArrow(run, "doc_id long, x array<double>"), "features")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _probabilities(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, mean, scale = fit
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def _loss(x: np.ndarray, y: np.ndarray, folds: int = 4) -> float:
    """Cross-validated logarithmic loss; classes are dealt evenly to folds."""
    fold = np.empty(len(y), int)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) % folds
    loss = 0.0
    for k in range(folds):
        if len(set(y[fold != k])) == 2:
            p = _probabilities(x[fold == k], fit_logistic(x[fold != k], y[fold != k]))
            loss -= np.log(np.clip(np.where(y[fold == k] > 0, p, 1 - p), 1e-6, 1)).sum()
    return loss


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text), learnt from the
    rows of ``labels`` (doc_id, toxic) for which ``learn`` holds.

    Score is in 0..1, higher for toxic. Null and empty texts are scored as
    texts without words. Repeated rows are scored each; a null doc_id is scored
    too. Without learnable labels of both classes the score is 1, 0 or 0.5 (only
    toxic, only ordinary, none). Columns other than doc_id and text are not
    looked at. No rows: no result."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = saved(labelled_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "toxic", learn), "labelled")
    classes = sorted(r["y"] for r in chosen.select("y").distinct().collect())
    if len(classes) < 2:
        return narrow.select("doc_id", F.lit(float(classes[0]) if classes else 0.5).alias("score"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(CALIBRATE))
    scored = features(narrow, *model(narrow, chosen.where(part != 0)))
    some = labelled_sample(chosen, "y", F.lit(True), sample)  # small by its bound

    def labelled(which: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = scored.join(F.broadcast(which), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("x", "y").collect()  # of the sample
        return np.array([r["x"] for r in rows]).reshape(len(rows), READINGS, FEATURES), np.array([r["y"] for r in rows], float)

    x, y = labelled(some.where(part == 0))
    if len(set(y)) < 2:  # very few labels: what the models have seen must do
        x, y = labelled(some)
    if len(set(y)) < 2:
        return scored.select("doc_id", F.lit(0.5).alias("score"))
    more = [(i,) for i in range(1, READINGS)]
    best = min([(0,), *[(0, *m) for m in more], tuple(range(READINGS))], key=lambda which: _loss(x[:, which].reshape(len(y), -1), y))
    w, mean, scale = fit_logistic(x[:, best].reshape(len(y), -1), y)
    z = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
    for i in range(len(w) - 1):
        z = z + F.lit(float(w[i] / scale[i])) * F.col("x")[best[i // FEATURES] * FEATURES + i % FEATURES]
    return scored.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
