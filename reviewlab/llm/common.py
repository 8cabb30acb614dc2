"""Helpers shared by the operators: tables saved in the shared folder, folds,
and whole-column text arithmetic on Arrow buffers.

Text arithmetic works on the UTF-8 bytes of an Arrow string column, a few
megabytes at a time, with numpy: words are byte ranges between ASCII white
space and are known by a 64-bit polynomial hash of their bytes. A null text
counts as an empty one everywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.session import ensure_checkpoint_dir

#: bytes of text that are turned into numpy arrays at once
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(path: str | None = None) -> str:
    """Contents of a tokenizer file, by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_model(path: str | None = None) -> bytes:
    """Contents of a sentencepiece model, by default the public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Spark's setting that the shuffle files of a job go when it ends, not when the
#: driver happens to collect its garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files, so
    that a lost executor costs a reread and not the whole lineage. The write is a
    plan of its own; what it shuffled is removed when it ends. ``settings``
    hold for it alone."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    own = {_CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(labels: DataFrame, column: str, keep: Column, bound: int | None = None) -> DataFrame:
    """Labelled rows to learn from: (doc_id, y), all of them or at most about
    ``bound`` of each class, chosen by a hash of the id. One row per id: where
    an id has several labels the largest counts. Rows without id or label are
    not used.

    With a bound the result is small and may be broadcast."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & keep)
            .groupBy("doc_id").agg(F.max(column).cast("int").alias("y")))
    if bound is None:
        return rows
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.where(draw < share)


# ---------------------------------------------------------------- text bytes

def _under(buf: np.ndarray, first: int, n: int) -> np.ndarray:
    """Which bytes are first, ..., first + n - 1."""
    return (buf - np.uint8(first)) < np.uint8(n)


def _is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 0x20) | _under(buf, 9, 5)


def _is_letter(buf: np.ndarray) -> np.ndarray:
    """Letters and digits of ASCII and every byte of a longer UTF-8 sequence."""
    return _under(buf | np.uint8(32), 97, 26) | _under(buf, 48, 10) | (buf >= 128)


def _lower(buf: np.ndarray) -> np.ndarray:
    return buf | (_under(buf, 65, 26).view(np.uint8) << np.uint8(5))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        m = -(-n // 65536) * 65536  # a worker keeps them: no more than a little over n
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a hash can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words(NamedTuple):
    """Words of some consecutive texts of a batch."""
    first: int           # row of the first text in the batch
    buf: np.ndarray      # bytes of the texts
    offsets: np.ndarray  # of each text in buf, one more than texts
    start: np.ndarray    # of each word in buf
    end: np.ndarray
    hash: np.ndarray     # uint64 of the lower-cased word
    bounds: np.ndarray   # of each text's words, one more than texts


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, offsets) of runs of texts of about
    CHUNK_BYTES each; one long text is a run of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, raw[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_chunks(column: pa.Array, letters_only: bool = False) -> Iterator[Words]:
    """Words of a column of texts. A word is a run of bytes other than ASCII
    white space, or with ``letters_only`` a run of letters and digits (every
    non-ASCII character counts as a letter). A-Z count as a-z."""
    for first, buf, off in text_chunks(column):
        sep = ~_is_letter(buf) if letters_only else _is_space(buf)
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True  # a text's start ends the word before
        before = np.ones(n, bool)
        before[1:] = sep[:-1]
        before |= edge[:n]
        start = np.flatnonzero(~sep & before)
        after = np.ones(n, bool)
        after[:-1] = sep[1:]
        after |= edge[1:]
        end = np.flatnonzero(~sep & after) + 1
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        total[1:] = _lower(buf)
        total[1:] += np.uint64(1)
        total[1:] *= p[:n]
        np.cumsum(total[1:], out=total[1:])
        h = mix((total[end] - total[start]) * inv[start])
        yield Words(first, buf, off, start, end, h, np.searchsorted(start, off))


def per_text(bounds: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, 0 for a text without any."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
