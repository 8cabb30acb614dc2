"""Lexical retrieval packing (operator 8).

Documents become token ids once and are saved. A document's full windows are
sequences of their own; what is left over is packed with lexical neighbours:
documents are dealt by two min-hashes of their tokens, so that similar ones
come to lie together, and every ``SHARD`` leftovers in that order are a shard
with a BM25 inverted index over token ids (weights with document frequencies
and lengths of the whole corpus). Each seed fills its window with the unused
neighbours that the index ranks highest; the last one is cut to fit and its
rest is the next seed. What a shard can't fill goes on to the next shard of the
task, and the last window of a task is cut into powers of two, so no sequence
is padded.

Token ids are those of the tokenizer file. Text is cut before a space that a
non-space follows, where the file's pattern always starts a new token, and the
ids of such pieces are remembered in a bounded table; the others are merged by
the byte-pair ranks of the same file. Tokens that the file adds (its special ones)
are cut out of a text first. The first pieces of each task are held against the
tokenizers library."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import mix, saved

#: leftovers in a shard of the index
SHARD = 256
#: BM25 parameters
K1, B = 1.2, 0.75
#: pieces of text whose ids a task remembers
REMEMBERED = 900_000
#: the pattern that byte-level BPE files of this kind split text by (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_UNSAFE = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens as bytes, from the printable characters that stand for bytes in
    byte-level files: printable Latin-1 for itself, the others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}


class Encoder(dict):
    """Ids (as bytes) of a space and a piece of text, by piece."""

    def __init__(self, file: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("the file's added tokens are not of the expected kind")
        special = {t["content"]: t["id"] for t in added}
        ranks = byte_ranks({t: i for t, i in spec["model"]["vocab"].items() if t not in special})
        self.kind = "H" if max([*spec["model"]["vocab"].values(), *special.values()]) < 1 << 16 else "I"
        self.special = {t: array(self.kind, [i]).tobytes() for t, i in special.items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.slow = Tokenizer.from_str(file)
        self.checked = 0

    def ids(self, text: str) -> bytes:
        out = self.fast(text)
        if self.checked < 1000:
            self.checked += 1
            if out != self.slow.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"the file's tokenizer is not of the expected kind: {text!r}")
            if self.checked == 1000:
                self.slow = None  # its memory isn't needed any more
        return array(self.kind, out).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.ids(" " + piece)
        if len(self) < REMEMBERED and len(piece) <= 64:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return b"".join(self.special[t] if t in self.special else self.plain(t) for t in self.added.split(text) if t)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        pieces = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        first = self.ids(pieces[0]) if pieces[0] else b""
        if len(pieces) > 1 and not pieces[0]:  # the text starts with a space and a word
            return b"".join(map(self.__getitem__, pieces[1:]))
        return first + b"".join(map(self.__getitem__, pieces[1:]))


_encoders: dict[str, Encoder] = {}


def encoder_of(file: str) -> Encoder:
    """The encoder of this Python worker, kept between tasks without the pieces
    that it remembers."""
    if file not in _encoders:
        _encoders.clear()
        _encoders[file] = Encoder(file)
    return _encoders[file]


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids, m1, m2) of ``docs`` (doc_id, text): the ids as 4-byte
    little-endian numbers with ``end_id`` after them, and two min-hashes. Null
    text counts as empty."""
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_file)  # one vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file.value)
        size = np.uint16 if encoder.kind == "H" else np.uint32
        n = 1 << 16 if encoder.kind == "H" else 0
        high = lambda x, s: (mix(x.astype(np.uint64) + np.uint64(s << 32)) >> np.uint64(32)).astype(np.uint32)
        ranks = [high(np.arange(n), s) for s in (1, 2)]
        end = size(end_id).tobytes()
        try:
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    ids = [encoder.encode(t or "") + end for t in part.column("text").to_pylist()]
                    x = np.frombuffer(b"".join(ids), size)
                    begin = np.cumsum([0, *map(len, ids[:-1])]) // size().itemsize
                    low = [np.minimum.reduceat(r[x] if n else high(x, s), begin) for r, s in zip(ranks, (1, 2))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([size().itemsize] * len(ids), pa.int32()),
                                                      *[pa.array(m.astype(np.int64)) for m in low]], ["doc_id", "ids", "width", "m1", "m2"])
        finally:
            encoder.clear()  # the worker outlives this task and goes on with other operators

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, width int, m1 long, m2 long")


def _numbers(row_ids: pa.Scalar, width: int) -> np.ndarray:
    return np.frombuffer(row_ids.as_buffer(), np.uint16 if width == 2 else np.uint32)


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df, docs, tokens): documents that hold each token id, and in the
    row of term -1 how many documents and ids there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(1 << 16, np.int64), 0, 0
        held, used = np.zeros((64, 1 << 16), np.uint8), 0  # terms of some documents
        for b in batches:
            for ids, width in zip(b.column("ids"), b.column("width").to_pylist()):
                x = _numbers(ids, width)
                if width == 2:
                    held[used][x] = 1
                    used, docs, total = used + 1, docs + 1, total + len(x)
                    if used == len(held):
                        df[:1 << 16] += held.sum(0, np.uint8)
                        held[:], used = 0, 0
                    continue
                terms = np.unique(x)
                if len(terms) and terms[-1] >= len(df):
                    df = np.append(df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64))
                df[terms] += 1
                docs, total = docs + 1, total + len(x)
        df[:1 << 16] += held.sum(0, np.uint8)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs)), pa.array(np.append(np.zeros(len(at), np.int64), total))],
                                         ["term", "df", "total"])
    return (tokens.select("ids", "width").mapInArrow(run, "term long, df long, total long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))


class Unit(NamedTuple):
    """What is left over of a document."""
    doc: int | None
    ids: np.ndarray      # all of the document
    start: int           # of what is left
    terms: np.ndarray
    weights: np.ndarray  # BM25, of the whole document


class Index:
    """BM25 inverted index of some units."""

    def __init__(self, units: list[Unit]) -> None:
        sizes = [len(u.terms) for u in units]
        terms = np.concatenate([u.terms for u in units])
        owner = np.repeat(np.arange(len(units)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs = owner[order]
        self.weights = np.concatenate([u.weights for u in units])[order]
        names, begin = np.unique(terms[order], return_index=True)
        self.begin = begin
        self.count = np.diff(np.append(begin, len(terms)))
        self.names, self.n = names, len(units)

    def scores(self, unit: Unit) -> np.ndarray:
        """BM25 of every unit for the distinct tokens of ``unit`` (all of its
        tokens are in the index)."""
        at = np.searchsorted(self.names, unit.terms)
        count, begin = self.count[at], self.begin[at]
        total = int(count.sum())
        if not total:
            return np.zeros(self.n)
        postings = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(total)
        return np.bincount(self.docs[postings], self.weights[postings], self.n)


class Packer:
    """Turns units into sequences of one task, in the order that they come."""

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id = window, first_id
        self.rows: list[tuple] = []

    def sequence(self, parts: list[tuple[int | None, np.ndarray, int, int]]) -> None:
        offset = 0
        for doc, ids, start, length in parts:
            crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
            self.rows.append((doc, start, length, crc, len(ids), self.next_id, offset))
            offset += length
        self.next_id += 1

    def shard(self, units: list[Unit]) -> list[Unit]:
        """Pack full windows; the units that are left fill no window."""
        index = Index(units)
        left = np.array([len(u.ids) - u.start for u in units])
        seed, rest = 0, int(left.sum())
        while rest >= self.window:
            while left[seed] == 0:
                seed = int(np.flatnonzero(left)[0])
            parts, room = [], self.window
            ranked: list[int] = [seed]
            if left[seed] < room:
                score = np.where(left > 0, index.scores(units[seed]), -1.0)
                score[seed] = np.inf
                ranked = np.argsort(-score, kind="stable").tolist()
            for k in ranked:
                u, take = units[k], min(room, int(left[k]))
                if take:
                    parts.append((u.doc, u.ids, len(u.ids) - int(left[k]), take))
                    left[k] -= take
                    room -= take
                if not room:
                    seed = k if left[k] else seed  # what was cut goes on
                    break
            self.sequence(parts)
            rest -= self.window
        return [u._replace(start=len(u.ids) - int(n)) for u, n in zip(units, left) if n]

    def finish(self, units: list[Unit]) -> None:
        """Cut the last units into sequences of powers of two."""
        rest = sum(len(u.ids) - u.start for u in units)
        parts: list[tuple] = []
        size = room = _power(rest, self.window)
        for u in units:
            at = u.start
            while at < len(u.ids):
                take = min(room, len(u.ids) - at)
                parts.append((u.doc, u.ids, at, take))
                at, room = at + take, room - take
                if not room:
                    self.sequence(parts)
                    rest, parts = rest - size, []
                    size = room = _power(rest, self.window)


def _power(rest: int, window: int) -> int:
    """Largest power of two up to ``rest``, or the window."""
    return window if rest >= window else 1 << (rest.bit_length() - 1) if rest else 0


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces (schema ``PIECES``) of sequences of at most ``window`` ids.

    Every id of every row of ``docs`` (doc_id, text) and the ``end_id`` after
    it lies in exactly one piece. Null or empty text: the end id alone. Rows
    with null or repeated doc_id are documents of their own. A text longer
    than the window has sequences to itself. No rows: no pieces."""
    tokens = saved(token_ids(docs, tokenizer_file, end_id), "tokens")
    counts = term_frequencies(tokens).collect()  # a row for each id of the vocabulary at most
    total = {r["term"]: r for r in counts}.get(-1)
    n, mean = (total["df"], total["total"] / max(1, total["df"])) if total else (0, 1.0)
    idf = np.zeros(max([r["term"] for r in counts], default=0) + 1, np.float32)
    for r in counts:
        if r["term"] >= 0:  # tokens of over half of the documents weigh nothing
            idf[r["term"]] = max(0.0, np.log((n - r["df"] + 0.5) / (r["df"] + 0.5)))
    weight = docs.sparkSession.sparkContext.broadcast(idf)

    def unit(doc: int | None, ids: np.ndarray, start: int) -> Unit:
        terms, tf = np.unique(ids, return_counts=True)
        w = weight.value[terms]
        terms, tf, w = terms[w > 0], tf[w > 0], w[w > 0]
        return Unit(doc, ids, start, terms, (w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        units: list[Unit] = []
        for b in batches:
            for doc, ids, width in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("width").to_pylist()):
                x = _numbers(ids, width)
                whole = len(x) // window * window
                for at in range(0, whole, window):
                    packer.sequence([(doc, x, at, window)])
                if whole < len(x):
                    units.append(unit(doc, x.copy(), whole))
                if len(units) >= SHARD:
                    units = packer.shard(units)
                if len(packer.rows) >= 8192:
                    yield _pieces(packer)
        units = packer.shard(units) if units else []
        packer.finish(units)
        if packer.rows:
            yield _pieces(packer)

    # similar documents side by side; one document is one row, however often it is repeated
    near = tokens.repartitionByRange("m1", "m2", "doc_id").sortWithinPartitions("m1", "m2", "doc_id")
    return near.select("doc_id", "ids", "width").mapInArrow(run, PIECES)


def _pieces(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in PIECES.split(", ")])


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer_file: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>) from the pieces of documents whose ids
    are unique, padded with ``end_id`` to ``window`` unless a power of two."""
    tokens = token_ids(docs, tokenizer_file, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_numbers(x, w)[s:s + n].astype(np.int32) for x, w, s, n in
                   zip(b.column("ids"), b.column("width").to_pylist(), b.column("start").to_pylist(), b.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("offset"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    parts = pieces.join(tokens, "doc_id").select("sequence_id", "offset", "start", "length", "ids", "width").mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids")))["ids"]).alias("ids"))
    n = F.size("ids")
    pad = F.when((n < window) & (F.bit_count(n) != 1), F.array_repeat(F.lit(end_id), F.lit(window) - n)).otherwise(F.array().cast("array<int>"))
    return whole.select("sequence_id", F.concat("ids", pad).alias("ids"))
