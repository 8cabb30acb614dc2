"""Cross-tokenizer alignment (operator 12).

Every text is encoded by two tokenizers. Byte offsets at which tokens of both
end are shared cuts; they divide the tokens into groups, and all pairs of a
group are links. Cuts are found by divide and conquer: the shared end nearest
to the middle of an interval is located by bisecting the other tokenizer's
ends, outwards from the middle; both halves go on, without the ends already
tried, until an interval holds no shared end (a group).

Where a single space stands between two other characters, both kinds of
tokenizer always end a token before it, so a text falls into parts there (a
space and a word, mostly) whose groups don't depend on the rest. Each worker
remembers the groups and links of the parts it has met in a bounded table, and
divides and conquers those of all new parts of some megabytes of text at once.

Links are counted by document over the corpus. Documents are read in chunks of
about ``CHUNK`` bytes of text; a chunk is saved as one row, which holds each of
its distinct id pairs once. Only those pairs are shuffled: their document
counts are summed over the chunks, and the sums come back to their chunk, where
they are laid against the links of its documents. Chunks follow the input and
not a key, so no source, copy or frequent pair makes a large group: a pair has
one row in each chunk that holds it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import saved
from reviewlab.llm.packing import PATTERN, byte_ranks

#: bytes of text in a chunk, and in a step of its encoding (a longer text is a chunk of its own)
CHUNK, STEP = 2 << 20, 1 << 20
#: bytes of rows that are sent to Python at once
SENT = 4 << 20
#: parts of text that a worker remembers, and characters of theirs
REMEMBERED, REMEMBERED_CHARS = 150_000, 4 << 20
#: parts, and whole texts, whose fast encoding is held against the libraries' own
CHECKED, CHECKED_TEXTS = 1000, 50
#: groups with more links than this count them by distinct ids
WIDE = 1 << 12
#: bits of the second id in a pair
SHIFT = 24
#: ends tried on either side of the middle for all intervals together
NEAR = 6

_UNSAFE = re.compile(r" (?!\S)")
_CUT = re.compile(r"(?<! ) (?=\S)")


def parts_of(text: str) -> list[str]:
    """Parts of a space and ``text``, each without the space it starts with."""
    if not _UNSAFE.search(text) and not text.startswith(" "):
        return text.split(" ")
    parts = _CUT.split(" " + text)
    return parts[1:] if not parts[0] else [parts[0][1:], *parts[1:]]


class Tokenizers:
    """The two tokenizers: ids of parts, and the bytes of their tokens.

    Strings of special tokens are plain text. Models with pieces that go on
    with a space after another character can't be cut; they, and texts with the
    mark that stands for a space in pieces, encode whole texts."""

    def __init__(self, file: str, model: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = byte_ranks({t: i for t, i in spec["model"]["vocab"].items() if t not in special})
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.slow = Tokenizer.from_str(file)
        self.slow.encode_special_tokens = True
        by_id = {i: b for b, i in ranks.items()}
        self.first = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any(re.search("[^▁]▁", x) for x in names)
        self.second = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        self.checked = self.checked_texts = 0

    def ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.fast(" " + x) for x in parts]
        # the empty text has no ids, but at a text's end the part is a space
        b = [y if x else [self.space] for x, y in zip(parts, self.model.encode(parts, num_threads=1))]
        for x, ids in zip(parts, a):
            if self.checked >= CHECKED:
                break
            self.checked += 1
            if ids != self.slow.encode(" " + x, add_special_tokens=False).ids:
                raise ValueError(f"the file's tokenizer is not of the expected kind: {x[:200]!r}")
        return a, b

    def parts(self, text: str) -> list[str]:
        if self.whole or "▁" in text:
            return [text]
        parts = parts_of(text)
        if self.checked_texts < CHECKED_TEXTS:
            self.checked_texts += 1
            a, b = self.ids(parts)
            if [i for x in a for i in x] != self.slow.encode(" " + text, add_special_tokens=False).ids or [i for x in b for i in x] != self.model.encode(text):
                raise ValueError(f"the tokenizers don't part texts at single spaces: {text[:200]!r}")
        elif self.checked >= CHECKED:
            self.slow = None  # some 35 MB, not asked again
        return parts


def _nearest(a: np.ndarray, b: np.ndarray, lo: int, hi: int, left: int, right: int) -> tuple[int, int, int]:
    """(index, left, right): the shared end of a[lo:hi] nearest to the tried
    ones between ``left`` and ``right``, or -1, looked for in blocks of
    doubling width, and the first untried places on both sides."""
    width = 16
    while left >= lo or right < hi:
        x, y = max(lo, left - width + 1), min(hi, right + width)
        for part, back in ((np.arange(left, x - 1, -1), True), (np.arange(right, y), False)):
            at = part[b[np.searchsorted(b, a[part])] == a[part]]
            if len(at):
                return (int(at[0]), int(at[0]), right) if back else (int(at[0]), left, int(at[0]))
        left, right, width = x - 1, y, 2 * width
    return -1, left, right


def shared_cuts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sorted indexes of ends ``a`` that are also in ``b`` (both rising, with
    the same last end), within the intervals lo <= index < hi."""
    cuts = []
    while len(lo):
        open_ = lo < hi
        lo, hi = lo[open_], hi[open_]
        left = (lo + hi) // 2
        right = left + 1
        found = np.full(len(lo), -1)
        todo = np.arange(len(lo))
        for step in range(2 * NEAR):
            if not len(todo):
                break
            place = left[todo] if step % 2 == 0 else right[todo]
            inside = (place >= lo[todo]) & (place < hi[todo])
            at, place = todo[inside], place[inside]
            hit = b[np.searchsorted(b, a[place])] == a[place]
            found[at[hit]] = place[hit]
            if step % 2 == 0:
                left[at[~hit]] -= 1
            else:
                right[at[~hit]] += 1
            todo = todo[found[todo] < 0]
            todo = todo[(left[todo] >= lo[todo]) | (right[todo] < hi[todo])]
        for i in todo.tolist():  # long intervals without a shared end near the middle
            found[i], left[i], right[i] = _nearest(a, b, lo[i], hi[i], left[i], right[i])
        cut = found >= 0
        cuts.append(found[cut])
        lo, hi, left, right, found = lo[cut], hi[cut], left[cut], right[cut], found[cut]
        on_left = found == left
        lo, hi = (np.concatenate([lo, np.where(on_left, right, found + 1)]),
                  np.concatenate([np.where(on_left, found, left + 1), hi]))
    return np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the place of each key among them."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key[new], at


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each run of ``size``, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _summed(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), in order, with the sum of their times."""
    most, span = (int(x.max(initial=0)) + 1 for x in (row, key))
    order = np.argsort(row * span + key) if most * span < 1 << 63 else np.lexsort((key, row))
    row, key, times = row[order], key[order], times[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.add.reduceat(times, at) if len(at) else times


class Parts(dict):
    """Numbers of parts of text, with what is known of each: whether its
    tokens spell it (else all is 0), n_a, n_b, n_groups and n_links, its groups
    as text, and its distinct id pairs with their occurrences."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        super().__init__()
        self.of = tokenizers
        # a token and what follows it: a comma, the bar between the sides, the end of a group
        bare = [str(i) for i in range(max(len(tokenizers.first), len(tokenizers.second)))]
        self.words = [x + "," for x in bare] + [x + "|" for x in bare] + [x + ";" for x in bare]
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all parts but the ``keep`` that were met most often."""
        names = list(self) if keep else []
        at = np.sort(np.argsort(-self.met[:len(names)], kind="stable")[:keep]) if keep else np.zeros(0, np.int64)
        names = [names[i] for i in at.tolist()]
        chars = sum(map(len, names))
        if 2 * chars > REMEMBERED_CHARS:
            return self.forget()
        self.clear()
        self.update(zip(names, range(len(names))))
        self.new, self.chars, self.lines = [], chars, [self.lines[i] for i in at.tolist()]
        if not keep:
            none = np.zeros(0, np.int64)
            self.numbers, self.start, self.key, self.times, self.met = np.zeros((5, 0), np.int64), none, none, none, none
            return
        self.numbers = self.numbers[:, at]
        size = self.numbers[4]
        of = _ragged(self.start[at], size)
        self.start, self.key, self.times = np.cumsum(size) - size, self.key[of], self.times[of]
        self.met = self.met[at] // 2  # what was met long ago counts less

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self.chars += len(part)
        n = self[part] = len(self)
        return n

    def learn(self) -> None:
        """Align all new parts at once."""
        if not self.new:
            return
        parts, self.new = self.new, []
        ids_a, ids_b = self.of.ids(parts)
        n, first, second = len(parts), self.of.first.__getitem__, self.of.second.__getitem__
        for k, x in enumerate(parts):
            raw = (" " + x).encode()
            if b"".join(map(first, ids_a[k])) != raw or b"".join(map(second, ids_b[k])) != raw:
                ids_a[k] = ids_b[k] = []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a = np.cumsum(np.array([len(t) for t in self.of.first], np.int64)[a])
        end_b = np.cumsum(np.array([len(t) for t in self.of.second], np.int64)[b])
        own = np.flatnonzero(n_a)
        last = np.cumsum(n_a[own])  # each part's last end is shared
        cut_a = np.sort(np.concatenate([shared_cuts(end_a, end_b, last - n_a[own], last - 1), last - 1]))
        cut_b = np.searchsorted(end_b, end_a[cut_a])
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        from_a, from_b = cut_a + 1 - size_a, cut_b + 1 - size_b
        of = own[np.searchsorted(last, cut_a, "right")]
        links = size_a * size_b
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, of, links)
        self.lines += self._lines(a, b, cut_a, cut_b, size_a, size_b, n_a + n_b)
        found = []
        for g in np.flatnonzero(links > WIDE).tolist():
            ua, ca = np.unique(a[from_a[g]:cut_a[g] + 1], return_counts=True)
            ub, cb = np.unique(b[from_b[g]:cut_b[g] + 1], return_counts=True)
            found.append((np.full(len(ua) * len(ub), of[g]), np.repeat(ua, len(ub)) << SHIFT | np.tile(ub, len(ua)),
                          np.repeat(ca, len(ub)) * np.tile(cb, len(ua))))
        g = np.flatnonzero(links <= WIDE)
        group = np.repeat(g, links[g])
        i, j = np.divmod(_ragged(np.zeros(len(g), np.int64), links[g]), size_b[group])
        key = a[from_a[group] + i] << SHIFT | b[from_b[group] + j]
        found.append((of[group], key, np.ones(len(key), np.int64)))
        part, key, times = _summed(*(np.concatenate(x) for x in zip(*found)))
        size = np.bincount(part, minlength=n)
        self.start = np.concatenate([self.start, len(self.key) + np.cumsum(size) - size])
        self.key, self.times = np.concatenate([self.key, key]), np.concatenate([self.times, times])
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, np.bincount(of, minlength=n), n_links, size])], 1)
        self.met = np.concatenate([self.met, np.zeros(n, np.int64)])

    def _lines(self, a, b, cut_a, cut_b, size_a, size_b, size) -> list[str]:
        """Each part's groups as a1,a2|b1;a3|b2,b3; (nothing for a part without)."""
        last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last[0][cut_a] = last[1][cut_b] = True
        # a token's place: its own number and the other side's tokens of the groups before
        groups = np.arange(len(cut_a))
        place_a = np.arange(len(a)) + (cut_b + 1 - size_b)[np.repeat(groups, size_a)]
        place_b = np.arange(len(b)) + (cut_a + 1)[np.repeat(groups, size_b)]
        n = len(self.words) // 3
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = np.where(last[0], a + n, a)
        codes[place_b] = np.where(last[1], b + 2 * n, b)
        codes, word, ends = codes.tolist(), self.words.__getitem__, np.cumsum(size).tolist()
        return ["".join(map(word, codes[i:j])) for i, j in zip([0, *ends], ends)]


_loaded: dict[int, Parts] = {}


def _parts(file: str, model: bytes) -> Parts:
    """The parts known to this Python worker, kept between tasks."""
    key = hash((file, model))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Parts(Tokenizers(file, model))
    return _loaded[key]


class Step:
    """The links of some texts: per text n_a, n_b, n_groups, n_links and the
    hash of its groups; the distinct pairs, and each text's places among them
    with their occurrences."""

    def __init__(self, texts: list[str | None], parts: Parts) -> None:
        n = len(texts)
        if len(parts) > REMEMBERED or parts.chars > REMEMBERED_CHARS:
            parts.forget(REMEMBERED // 3)
        number = parts.__getitem__
        met = [list(map(number, parts.of.parts(t))) if t else [] for t in texts]
        parts.learn()
        spelt = parts.numbers[0] > 0
        # a text whose parts aren't spelt may only be so as a whole
        for i, x in enumerate(met):
            if len(x) > 1 and not spelt[x].all():
                met[i] = [number(texts[i])]
        parts.learn()
        spelt = parts.numbers[0] > 0
        self.sha = [""] * n
        for i, x in enumerate(met):
            if x and spelt[x[0]]:
                self.sha[i] = hashlib.sha256("".join(map(parts.lines.__getitem__, x))[:-1].encode()).hexdigest()
        row = np.repeat(np.arange(n), [len(x) for x in met])
        part = np.array([p for x in met for p in x], np.int64)
        del met
        row, part, count = _summed(row, part, np.ones(len(part), np.int64))
        np.add.at(parts.met, part, count)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        for k, out in enumerate((self.n_a, self.n_b, self.n_groups, self.n_links)):
            np.add.at(out, row, count * parts.numbers[k, part])
        size = parts.numbers[4, part]
        at = _ragged(parts.start[part], size)
        text, key, times = _summed(np.repeat(row, size), parts.key[at], np.repeat(count, size) * parts.times[at])
        self.text, self.times = text.astype(np.int32), times.astype(np.int32)
        self.pairs, self.pair = _numbered(key)

    @property
    def key(self) -> np.ndarray:
        return self.pairs[self.pair]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_CHUNK_SCHEMA = ("chunk long, doc_id array<long>, sha array<string>, n_a binary, n_b binary, n_groups binary, n_links binary, "
                 "pairs array<long>, docs array<long>, row binary, pair binary, times binary")


def _bytes(x: np.ndarray) -> pa.Array:
    """One binary value, the bytes of ``x``, which are not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)])


def _chunk_row(chunk: int, ids: list, steps: list[Step]) -> pa.RecordBatch:
    base = np.cumsum([0] + [len(s.sha) for s in steps[:-1]])
    row = np.concatenate([s.text + np.int32(k) for s, k in zip(steps, base)])
    times = np.concatenate([s.times for s in steps])
    pairs, place = _numbered(np.concatenate([s.pairs for s in steps]))
    place = np.split(place, np.cumsum([len(s.pairs) for s in steps[:-1]]))
    at = np.concatenate([p[s.pair] for s, p in zip(steps, place)])
    docs = np.bincount(at, minlength=len(pairs))
    numbers = [_bytes(np.concatenate([getattr(s, c) for s in steps]).astype(np.int64)) for c in _COUNTS]
    listed = lambda x, t: pa.array([x], pa.list_(t))
    # links lie by document, so a document's share of them is a bincount of row
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), listed(ids, pa.int64()), listed([x for s in steps for x in s.sha], pa.string()), *numbers,
         listed(pairs, pa.int64()), listed(docs, pa.int64()), *map(_bytes, (row, at, times))],
        [x.split()[0] for x in _CHUNK_SCHEMA.split(", ")])


def aligned_chunks(docs: DataFrame, tokenizer_file: str, piece_model: bytes) -> DataFrame:
    """One row a chunk of documents: their counts and hashes, the distinct
    pairs with the chunk's documents that link them, and each document's pairs
    with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer_file, piece_model))  # two files, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _parts(*sent.value)
        number = TaskContext.get().partitionId() << 32
        ids, steps, texts, size, total = [], [], [], 0, 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                ids.append(doc)
                texts.append(text)
                size += len(text or "") + 1
                if size >= STEP:
                    steps.append(Step(texts, known))
                    total, texts, size = total + size, [], 0
                if total >= CHUNK:
                    yield _chunk_row(number, ids, steps)
                    number, ids, steps, total = number + 1, [], [], 0
        if texts:
            steps.append(Step(texts, known))
        if steps:
            yield _chunk_row(number, ids, steps)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, _CHUNK_SCHEMA)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that link each id pair, and whether no other
    pair of its first id is linked by more."""
    counts = (chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
              .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n")))
    counts = saved(counts.withColumn("a", F.shiftright("pair", SHIFT)), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, tokenizer_file: str, piece_model: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    of every row of ``docs`` (doc_id, text): tokens of the byte-level file for
    a space and the text, tokens of the sentencepiece model (which adds that
    space), groups between shared byte offsets, links (occurrence pairs of a
    group), those whose id pair is linked in the most documents of its first
    id's pairs (ties included), the sum over links of their pair's documents,
    and the hash of the groups.

    Texts that are null or empty, or whose tokens don't spell them, have zeros
    and ''. Every row is a document of its own, so repeated rows and ids, also
    null ones, each count and have a row each. Other columns are not looked
    at; no rows, no result. A text is worked on as a whole by one task."""
    chunks = saved(aligned_chunks(docs, tokenizer_file, piece_model), "chunks", {"spark.sql.execution.arrow.maxBytesPerBatch": str(SENT)})
    found = (chunks.select(F.col("chunk").alias("of"), F.explode("pairs").alias("p"))
             .join(pair_counts(chunks), F.col("p") == F.col("pair")).select("of", "pair", "n", "best"))

    def finish(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        c = {k: chunk.column(k)[0] for k in chunk.column_names}
        bytes_of = lambda k, t: np.frombuffer(c[k].as_buffer(), t)
        pairs = np.asarray(c["pairs"].values)
        at = np.searchsorted(pairs, counts.column("pair").to_numpy())
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        row, pair, times = (bytes_of(k, np.int32) for k in ("row", "pair", "times"))
        rows = len(c["sha"])
        n_best, count_sum = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        np.add.at(n_best, row, times * best[pair])
        np.add.at(count_sum, row, times * n[pair])
        return pa.Table.from_arrays([c["doc_id"].values, *[pa.array(bytes_of(k, np.int64)) for k in _COUNTS],
                                     pa.array(n_best), pa.array(count_sum), c["sha"].values],
                                    ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    return chunks.drop("docs").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
