"""Words counted and looked up by batch against the words Spark's pattern finds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.operators import sentiment
from reviewlab.operators.sentiment import review_sentiment, sentence_sentiment
from reviewlab.operators.text import sequences, text_columns, top_words, word_counts, words_of

ODD = ["", None, " ", "a", "it's  a'b'c 'x' y'.z", "good. bad!?not good... ", "tab\tand\nline", "ΑΣ ΑΣΒ good", "İstanbul not good", "x_y ²³ ½ ª", "good good not bad",
       "Ünïcode ÉTÉ ß", "日本 語。good", "ét 9.5"]


@pytest.fixture()
def texts(spark):
    every = [f"a{chr(c)}b {chr(c)} {chr(c)}'{chr(c)}" for c in range(1, 0x250)]
    return spark.createDataFrame(list(enumerate(ODD + every)), "v1 long, review_text string").repartition(3).cache()


def test_word_counts_are_those_of_the_pattern(texts):
    want = {r["w"]: r["n"] for r in texts.select(F.explode(words_of("review_text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert {r["word"]: r["n"] for r in word_counts(texts).collect()} == want


def test_sequences_keep_order_and_carry_columns(spark, texts):
    vocab = top_words(word_counts(texts), 10_000)
    number = {r["word"]: r["idx"] for r in vocab.collect()}
    want = {r["v1"]: [number[w] for w in r["w"] or []] for r in texts.select("v1", words_of("review_text").alias("w")).collect()}
    got = sequences(texts.withColumn("x", F.col("v1") * 2), vocab, carry=["x"]).collect()
    assert {r["v1"]: r["seq"] for r in got} == want and all(r["x"] == 2 * r["v1"] for r in got)


def test_looked_up_sums_are_those_of_the_joins(spark, texts, monkeypatch):
    stop = spark.createDataFrame([("a",)], "word string")
    bing = spark.createDataFrame([("good", "positive"), ("good", "negative"), ("bad", "negative"), ("a", "positive"), ("not", "positive"), ("été", "positive")], "word string, sentiment string")
    afinn = spark.createDataFrame([("good", 3), ("bad", -3), ("été", 1), ("été", 2), ("line", 2), ("a", 5)], "word string, score int")

    def results():
        out = [review_sentiment(texts, stop, bing, afinn, keys=["v1"]), review_sentiment(texts, stop, bing, keys=["v1"]),
               sentence_sentiment(texts, afinn, ["not"], ["it's", "not"])]
        return [sorted((tuple(np.round(r, 9)) for r in x.collect())) for x in out]

    got = results()
    monkeypatch.setattr(sentiment, "MAX_WORDS", 0)      # the way for tables of any size
    assert got == results()
    assert Counter(v for _, v in got[1])[0] > 0


def test_texts_are_read_once_for_boosting(spark):
    """The rows that splits, binning and rounds read again come from files."""
    from reviewlab.plans.q_models import _boost_input, _sentiment_rows
    for f in (_boost_input, _sentiment_rows):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in plan and "MapInArrow" not in plan and "Aggregate" not in plan, plan


def test_words_of_a_large_batch_are_looked_at_in_slices(texts, monkeypatch):
    """(findings 2, 3) A batch of long texts takes no more memory than a few megabytes of them."""
    from reviewlab.operators import text

    batch = texts.select(*text_columns("review_text")).toArrow().combine_chunks().to_batches()[0]
    whole = text.batch_words(batch)
    monkeypatch.setattr(text, "WORDS_OF_BYTES", 60)
    slices = list(text.small_batches([batch, batch.slice(0, 0), batch.slice(3, 5)]))
    assert sum(s.num_rows for s in slices) == batch.num_rows + 5 and len(slices) > 100
    words, sentences, at = [], 0, 0
    for s in slices[:-1]:
        if at >= batch.num_rows:
            break
        w = text.batch_words(s)
        words += [(at + r, sentences + i, w.words[c]) for r, i, c in zip(w.row, w.sentence, w.code)]
        sentences, at = sentences + (int(w.sentence[-1]) + 1 if len(w.sentence) else 0), at + s.num_rows
    assert words == [(r, i, whole.words[c]) for r, i, c in zip(whole.row, whole.sentence, whole.code)]
