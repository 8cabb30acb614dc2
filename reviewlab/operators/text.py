"""Text operators: words, vocabulary, word-number sequences, multi-hot."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.functions.columns import TOKEN_PATTERN

#: words of a vocabulary that is handed to every task
MAX_WORDS = 1 << 20
#: bytes of text whose words a task holds at once, in some 15 times as many bytes
WORDS_OF_BYTES = 4 << 20


def words_of(text) -> Column:
    """Array of the lower-cased words of a text column."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(df: DataFrame, text: str = "review_text", word: str = "word",
           keep_empty: bool = False, position: str | None = None) -> DataFrame:
    """One row per word of ``text``; the other columns are kept, the text
    column is dropped. Narrow: no shuffle, whole texts.

    ``keep_empty`` keeps texts without words as one row with a null word;
    ``position`` adds the 0-based word position under that name.
    """
    others = [c for c in df.columns if c != text]
    gen = F.posexplode_outer if keep_empty else F.posexplode
    if position:
        return df.select(*others, gen(words_of(text)).alias(position, word))
    explode = F.explode_outer if keep_empty else F.explode
    return df.select(*others, explode(words_of(text)).alias(word))


#: words, and ends of sentences, of a text of the letters below; compared with
#: TOKEN_PATTERN for every one of them in the tests
_PLAIN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[.!?]")
#: a text with any other letter: Unicode versions may differ on it
_OTHER = "[^\\u0000-\\u012F\\u0131-\\u024F]"


def text_columns(text) -> list[Column]:
    """The columns ``__plain`` and ``__other`` that ``batch_words`` reads: the
    text itself, or where it has letters beyond Latin the words of each of its
    sentences."""
    t = F.col(text) if isinstance(text, str) else text
    other = t.rlike(_OTHER)
    return [F.when(~other, t).alias("__plain"),
            F.when(other, F.transform(F.split(t, r"[.!?]+"), lambda s: words_of(s))).alias("__other")]


def small_batches(batches):
    """The rows of Arrow batches with ``text_columns``, in slices of about
    ``WORDS_OF_BYTES`` of text; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    for b in batches:
        other = b.column("__other")
        size = pc.fill_null(pc.binary_length(b.column("__plain")), 0).to_numpy().astype(np.int64)
        size += other.is_valid().to_numpy(zero_copy_only=False) * (other.nbytes // max(1, len(other) - other.null_count))
        ends, a = np.cumsum(size + 1), 0
        while a < b.num_rows:
            n = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS_OF_BYTES, "right")))
            yield b.slice(a, n - a)
            a = n


class BatchWords(NamedTuple):
    """Words of a batch of texts, in order."""
    row: np.ndarray       # text of each word
    sentence: np.ndarray  # a number that rises from sentence to sentence
    code: np.ndarray      # of each word, its place in ``words``
    words: list           # distinct


def batch_words(batch) -> BatchWords:
    """Words (as of ``words_of``) of the ``text_columns`` of an Arrow batch.

    Texts are cut at spaces, and only distinct pieces are looked at by the
    pattern: a batch repeats few of them often."""
    import pyarrow as pa
    import pyarrow.compute as pc

    number: dict[str, int] = {}
    pieces = pc.split_pattern(batch.column("__plain"), " ")
    coded = pieces.flatten().dictionary_encode()
    found, sizes = [], []
    for piece in coded.dictionary.to_pylist():
        ws = _PLAIN.findall(piece.lower())
        sizes.append(len(ws))
        found += [-1 if w in ".!?" else number.setdefault(w, len(number)) for w in ws]
    found, sizes = np.array(found, np.int64), np.array(sizes, np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = sizes[at]
    code = found[np.repeat((np.cumsum(sizes) - sizes)[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    row = np.repeat(np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy()), n)
    ends = np.cumsum(code < 0) + row  # a text starts a sentence
    row, sentence, code = row[code >= 0], ends[code >= 0], code[code >= 0]
    per_text = pc.fill_null(pc.list_value_length(batch.column("__other")), 0).to_numpy()
    if per_text.any():
        sentences = batch.column("__other").flatten()
        coded = sentences.flatten().dictionary_encode()
        places = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int64)
        of = np.repeat(np.arange(len(sentences)), pc.fill_null(pc.list_value_length(sentences), 0).to_numpy())
        row = np.append(row, np.repeat(np.arange(batch.num_rows), per_text)[of])
        sentence = np.append(sentence, of)
        code = np.append(code, places[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)])
        order = np.argsort(row, kind="stable")
        row, sentence, code = row[order], sentence[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])
    return BatchWords(row, np.cumsum(new) - 1, code, list(number))


def word_counts(df: DataFrame, text: str = "review_text", word: str = "word") -> DataFrame:
    """(word, n): the words of a text column and how often they occur, counted
    by batch first, so that no occurrence is a row."""
    def run(batches):
        import pyarrow as pa
        for b in small_batches(batches):
            w = batch_words(b)
            yield pa.RecordBatch.from_arrays([pa.array(w.words, pa.string()), pa.array(np.bincount(w.code, minlength=len(w.words)))], [word, "n"])

    return (df.select(*text_columns(text)).mapInArrow(run, T.StructType([T.StructField(word, T.StringType()), T.StructField("n", T.LongType())]))
            .groupBy(word).agg(F.sum("n").alias("n")))


def vocabulary(toks: DataFrame, n: int = 10_000, word: str = "word") -> DataFrame:
    """``top_words`` of a frame with a row for each word."""
    return top_words(toks.groupBy(word).agg(F.count(F.lit(1)).alias("n")), n, word)


def top_words(counts: DataFrame, n: int = 10_000, word: str = "word") -> DataFrame:
    """Words of ``counts`` (word, n) numbered 1.. by falling frequency (ties by
    word), at most ``n``.

    The top-n is a ``limit`` over the ordered counts, which Spark runs as a
    per-partition top-k and a merge of at most n rows per partition (no global
    sort of the word counts). The numbering is over those n rows only.
    """
    top = counts.select(word, "n").orderBy(F.desc("n"), F.asc(word)).limit(n)
    # n rows at most: the window runs on the already-collapsed top-k.
    return top.select(word, "n", F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc(word))).alias("idx"))


def sequences(df: DataFrame, vocab: DataFrame, key: str = "v1",
              text: str = "review_text", word: str = "word",
              out: str = "seq", carry: list[str] | None = None) -> DataFrame:
    """Text to the list of its word numbers, in text order; unknown words are
    dropped; a text with no known word gives an empty list. Columns ``carry`` of
    ``df`` go along, so that nothing is to be joined back.

    Narrow: the words of a batch are looked up together in the vocabulary, and
    no word is shuffled. That vocabulary goes to every task, so it may have at
    most ``MAX_WORDS`` words; a larger one meets the words by a join."""
    rows = vocab.select(word, "idx").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        return _joined_sequences(df, vocab, [key, *(carry or [])], text, word, out)
    rows = sorted((r[0], r[1]) for r in rows if r[0] is not None)
    sent = df.sparkSession.sparkContext.broadcast(([w for w, _ in rows], [i for _, i in rows]))

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        words, idx = pa.array(sent.value[0], pa.string()), np.array(sent.value[1], np.int32)
        for b in small_batches(batches):
            w = batch_words(b)
            at = pc.fill_null(pc.index_in(pa.array(w.words, pa.string()), words), -1).to_numpy()[w.code]
            known = at >= 0
            ends = np.cumsum(np.bincount(w.row[known], minlength=b.num_rows))
            seq = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(idx[at[known]], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], seq], [*kept, out])

    kept = [key, *(carry or [])]
    src = df.select(*kept, *text_columns(text))
    return src.mapInArrow(number, T.StructType([*[src.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _joined_sequences(df: DataFrame, vocab: DataFrame, kept: list[str], text: str, word: str, out: str) -> DataFrame:
    """``sequences`` by a join of the words with a vocabulary of any size."""
    numbered = df.select(*kept, text).withColumn("__row", F.monotonically_increasing_id())
    toks = tokens(numbered, text, word=word, keep_empty=True, position="pos")
    joined = toks.join(vocab.select(word, "idx"), word, "left")
    agg = joined.groupBy("__row", *kept).agg(
        F.array_sort(F.collect_list(
            F.when(F.col("idx").isNotNull(), F.struct("pos", "idx")))).alias("pairs"))
    return agg.select(*kept, F.transform("pairs", lambda p: p["idx"]).cast("array<int>").alias(out))


def multi_hot_indices(seq, width: int | None = None) -> Column:
    """0-based non-zero positions of the multi-hot row of a sequence: word
    number k sets position k-1; numbers beyond ``width`` are dropped."""
    s = F.col(seq) if isinstance(seq, str) else seq
    idx = F.transform(F.array_sort(F.array_distinct(s)), lambda k: k - 1)
    return F.filter(idx, lambda i: i < width) if width else idx


def multi_hot(df: DataFrame, vocab: DataFrame, text: str = "review_text",
              width: int = 10_000, out: str = "features",
              word: str = "word") -> DataFrame:
    """Sparse 0/1 vector of ``width``: position k-1 is 1.0 when the text has
    the word numbered k (never densified).

    The vocabulary is at most ``width`` words (a proven bound), so it is
    handed to Spark ML's count vectorizer in binary mode, which runs on the
    JVM and keeps the vector sparse.
    """
    from pyspark.ml.feature import CountVectorizerModel

    rows = (vocab.where(F.col("idx") <= width).select(word, "idx")
            .orderBy("idx").limit(width).collect())
    words = [r[0] for r in rows]
    if [r[1] for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError("vocabulary numbers must run 1..n")
    model = CountVectorizerModel.from_vocabulary(
        words, inputCol="__words", outputCol=out, binary=True)
    with_words = df.withColumn("__words", words_of(text))
    return model.transform(with_words).drop("__words")
