"""Word-table joins and per-review sentiment scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.functions.columns import polarity_sign
from reviewlab.operators.text import MAX_WORDS, batch_words, small_batches, text_columns, tokens, words_of
from reviewlab.operators.util import bounded_broadcast


def drop_stop_words(toks: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """Anti join on the word: rows whose word is a stop word go."""
    s = bounded_broadcast(stop.select(F.col(stop.columns[0]).alias(word)).distinct())
    return toks.join(s, word, "left_anti")


def with_polarity(toks: DataFrame, bing: DataFrame, word: str = "word",
                  how: str = "inner") -> DataFrame:
    """Inner join with the polarity table; a word listed with both
    polarities yields two rows, as a relational join does."""
    b = bounded_broadcast(bing.select(word, "sentiment"))
    return toks.join(b, word, how)


def with_score(toks: DataFrame, afinn: DataFrame, word: str = "word",
               how: str = "inner") -> DataFrame:
    """Inner join with the integer-score table."""
    a = bounded_broadcast(afinn.select(word, "score"))
    return toks.join(a, word, how)


def review_sentiment(df: DataFrame, stop: DataFrame, bing: DataFrame,
                     afinn: DataFrame | None = None, keys: list[str] | None = None,
                     text: str = "review_text", keep_unmatched: bool = False,
                     polarity_name: str | None = None) -> DataFrame:
    """Per review: summed polarity (+1/-1) and summed integer score of its
    non-stop words.

    Output: ``keys`` + ``sum_sentb`` (+ ``sum_senta`` when ``afinn`` is
    given). With one lexicon only the sum is called ``sum_sent`` unless
    ``polarity_name`` says otherwise. Reviews without a matching word drop
    out (inner joins), unless ``keep_unmatched``, where they stay with 0.

    Plan: what a word adds to the sums is worked out in the word tables; the
    words of a batch of reviews are looked up there together, so that no word
    is a row and none is shuffled -> one shuffle of a row per review -> final
    sums. With ``keep_unmatched``, or tables of over ``MAX_WORDS`` words in
    common, instead: explode (narrow) -> anti/inner joins, broadcast where
    small -> partial sums per review.
    """
    keys = keys or [c for c in df.columns if c != text]
    if not keep_unmatched:
        name = polarity_name or ("sum_sentb" if afinn is not None else "sum_sent")
        worth = _worth(stop, bing, afinn)
        if worth is not None:
            return _looked_up(df, worth, keys, text, [name] + ["sum_senta"] * (afinn is not None))
    how = "left" if keep_unmatched else "inner"
    toks = tokens(df.select(*keys, text), text, keep_empty=keep_unmatched)
    # a null word (text without words, kept by keep_unmatched) is never a
    # stop word, so the anti join keeps it
    toks = drop_stop_words(toks, stop)
    toks = with_polarity(toks, bing, how=how)
    sentb = polarity_sign("sentiment")
    if keep_unmatched:
        sentb = F.when(F.col("sentiment").isNull(), F.lit(0)).otherwise(sentb)
    name = polarity_name or ("sum_sentb" if afinn is not None else "sum_sent")
    aggs = [F.sum(sentb).cast("bigint").alias(name)]
    if afinn is not None:
        toks = with_score(toks, afinn, how=how)
        aggs.append(F.sum(F.coalesce(F.col("score"), F.lit(0))).cast("bigint")
                    .alias("sum_senta"))
    return toks.groupBy(*keys).agg(*aggs)


def _bounded(words: DataFrame):
    """``words`` at the driver as an Arrow table, or None if over MAX_WORDS."""
    table = words.limit(MAX_WORDS + 1).toArrow()
    return table.combine_chunks() if table.num_rows <= MAX_WORDS else None


def _worth(stop: DataFrame, bing: DataFrame, afinn: DataFrame | None):
    """(word, b, a): what one occurrence of a word adds to the sums, as the
    joins would: a word of m rows in one table counts m times in the other."""
    words = (bing.where(F.col("word").isNotNull()).groupBy("word")
             .agg(F.sum(polarity_sign("sentiment")).cast("bigint").alias("b"), F.count(F.lit(1)).alias("nb")))
    if afinn is not None:
        scores = afinn.groupBy("word").agg(F.sum(F.coalesce(F.col("score"), F.lit(0))).cast("bigint").alias("a"), F.count(F.lit(1)).alias("na"))
        words = words.join(scores, "word").select("word", (F.col("b") * F.col("na")).alias("b"), (F.col("a") * F.col("nb")).alias("a"))
    else:
        words = words.select("word", "b", F.lit(0).cast("bigint").alias("a"))
    return _bounded(words.join(stop.select(F.col(stop.columns[0]).alias("word")), "word", "left_anti"))


def _looked_up(df: DataFrame, worth, keys: list[str], text: str, names: list[str]) -> DataFrame:
    """Sums of ``worth`` over each review's words; reviews without any of the
    words drop out."""
    sent = df.sparkSession.sparkContext.broadcast(worth)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        words = sent.value.column("word").combine_chunks()
        values = [sent.value.column(c).to_numpy() for c in ("b", "a")]
        for b in small_batches(batches):
            w = batch_words(b)
            at = pc.fill_null(pc.index_in(pa.array(w.words, pa.string()), words), -1).to_numpy()[w.code]
            row, at = w.row[at >= 0], at[at >= 0]
            met = np.flatnonzero(np.bincount(row, minlength=b.num_rows))
            sums = [np.rint(np.bincount(row, v[at], b.num_rows)[met]).astype(np.int64) for v in values]
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(met)) for k in keys] + [pa.array(v) for v in sums[:len(names)]], keys + names)

    src = df.select(*keys, *text_columns(text))
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in names])
    return src.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


# Our sentence-score settings (valence shifters): a negator in the window
# flips the sign, each amplifier there adds AMPLIFY to the weight.
WINDOW_BEFORE = 4
AMPLIFY = 0.8


def sentence_sentiment(df: DataFrame, lexicon: DataFrame, negators, amplifiers,
                       key: str = "v1", text: str = "review_text",
                       out: str = "sum_sents", word: str = "word") -> DataFrame:
    """Average sentence sentiment per review (our definition).

    Sentences are the pieces between runs of ``.!?``. Each word's score
    (0 if not in ``lexicon``) is multiplied by (-1)^(negators among the 4
    words before it) and by (1 + 0.8 x amplifiers among them); a sentence
    scores sum / sqrt(words); a review scores the mean over its sentences
    that have words, 0 when there are none. Returns ``key``, ``out``.

    ``negators`` and ``amplifiers`` are word lists or one-column frames of any
    size. With up to ``MAX_WORDS`` words in all, the words of a batch of reviews
    are looked up together and each sentence is summed where it is read; one row
    a review is shuffled. Beyond, first the few words that are shifters are found (join, broadcast
    where small) and gathered per review and sentence; they go back to their
    reviews, so that each word looks back inside its own row and no window over
    words is needed. Then explode (narrow) -> left join of the lexicon ->
    partial sums per review.
    """
    spark = df.sparkSession

    def role(words, neg: int, amp: int) -> DataFrame:
        frame = (spark.createDataFrame([(w,) for w in words], f"{word} string") if isinstance(words, (list, tuple))
                 else words.select(F.col(words.columns[0]).alias(word)))
        return frame.select(word, F.lit(neg).alias("neg"), F.lit(amp).alias("amp"))

    roles = (role(negators, 1, 0).unionByName(role(amplifiers, 0, 1))
             .groupBy(word).agg(F.max("neg").alias("neg"), F.max("amp").alias("amp")))
    sentences = F.transform(F.split(F.col(text), r"[.!?]+"), lambda s: words_of(s))
    value = F.coalesce(F.col(lexicon.columns[1]).cast("double"), F.lit(0.0))
    zero = F.lit(0)
    table = _bounded(lexicon.where(F.col(word).isNotNull()).select(word, value.alias("score"), zero.alias("neg"), zero.alias("amp"))
                     .unionByName(roles.where(F.col(word).isNotNull()).select(word, F.lit(0.0).alias("score"), "neg", "amp"))
                     .groupBy(word).agg(F.sum("score").alias("score"), F.max("neg").alias("neg"), F.max("amp").alias("amp")))
    if table is not None:
        return _scored_sentences(df.select(key, *text_columns(text)), table, key, out, word)
    # Word arrays per sentence are computed once per review, below the
    # explode; a projection next to the generator would be re-evaluated for
    # every word it produces.
    sw = df.select(key, F.filter(sentences, lambda ws: F.size(ws) > 0).alias("__sw"))
    at = sw.select(key, F.posexplode("__sw").alias("sid", "ws")).select(key, "sid", F.posexplode("ws").alias("pos", word))
    shifts = (at.join(bounded_broadcast(roles), word)
              .groupBy(key, "sid").agg(F.collect_list(F.struct("pos", "neg", "amp")).alias("s"))
              .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sid", "s"))).alias("__shifts")))

    def seen(near, i, name):
        return F.size(F.filter(near, lambda s: (s["pos"] < i) & (s["pos"] >= i - WINDOW_BEFORE) & (s[name] == 1)))

    none = F.array().cast("array<struct<pos:int,neg:int,amp:int>>")

    def words_in(ws, sid):
        near = F.coalesce(F.try_element_at("__shifts", sid), none)
        return F.transform(ws, lambda w, i: F.struct(
            w.alias(word), seen(near, i, "neg").alias("neg"), seen(near, i, "amp").alias("amp"),
            (F.lit(1.0) / F.sqrt(F.size(ws).cast("double"))).alias("wt")))

    per_word = F.flatten(F.transform("__sw", lambda ws, sid: words_in(ws, sid)))
    rows = sw.join(shifts, key, "left").select(
        key,
        F.size("__sw").alias("n_sent"),
        F.explode_outer(per_word).alias("w"),
    ).select(key, "n_sent", "w.*")
    lex = bounded_broadcast(lexicon.select(word, F.col(lexicon.columns[1]).alias("__score")))
    scored = rows.join(lex, word, "left")
    value = (F.coalesce(F.col("__score"), F.lit(0)).cast("double")
             * F.when(F.col("neg") % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
             * (F.lit(1.0) + F.lit(AMPLIFY) * F.col("amp"))
             * F.col("wt"))
    return scored.groupBy(key).agg(
        F.coalesce(F.sum(value) / F.max("n_sent"), F.lit(0.0)).alias(out))


def _scored_sentences(texts: DataFrame, table, key: str, out: str, word: str) -> DataFrame:
    """``sentence_sentiment`` of ``texts`` (key and ``text_columns``) by a bounded
    ``table`` (word, score, neg, amp)."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        words = sent.value.column(word).combine_chunks()
        # the last row stands for words that are in no list
        score, neg, amp = (np.append(sent.value.column(c).to_numpy(), 0) for c in ("score", "neg", "amp"))
        for b in small_batches(batches):
            w = batch_words(b)
            at = pc.fill_null(pc.index_in(pa.array(w.words, pa.string()), words), len(words)).to_numpy()[w.code]
            n = np.bincount(w.sentence)
            per_review = np.bincount(w.row[np.cumsum(n) - n], minlength=b.num_rows)
            place = np.arange(len(at))
            begin = np.repeat(np.cumsum(n) - n, n)
            before = np.maximum(begin, place - WINDOW_BEFORE)
            seen = [(c := np.append(0, np.cumsum(v[at])))[place] - c[before] for v in (neg, amp)]
            value = score[at] * np.where(seen[0] % 2 == 1, -1.0, 1.0) * (1.0 + AMPLIFY * seen[1]) / np.sqrt(np.repeat(n, n))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.bincount(w.row, value, b.num_rows).astype(float)), pa.array(per_review.astype(np.int64))], [key, "total", "n_sent"])

    schema = T.StructType([texts.schema[key], T.StructField("total", T.DoubleType()), T.StructField("n_sent", T.LongType())])
    return texts.mapInArrow(run, schema).groupBy(key).agg(F.coalesce(F.try_divide(F.sum("total"), F.max("n_sent")), F.lit(0.0)).alias(out))
