"""Stateless word scoring on a stream of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.functions.columns import polarity_sign
from reviewlab.operators.text import tokens
from reviewlab.operators.util import bounded_broadcast


def scored_words(stream: DataFrame, stop: DataFrame, bing: DataFrame, afinn: DataFrame,
                 key: str = "v1", text: str = "review_text") -> DataFrame:
    """(key, word, sentb, senta) for each non-stop word found in both word
    tables. Stream-static joins: the word tables are static, and broadcast
    where their measured size allows it."""
    t = tokens(stream.select(key, text), text)
    t = t.join(bounded_broadcast(stop.select(F.col(stop.columns[0]).alias("word"))), "word", "left_anti")
    t = t.join(bounded_broadcast(bing.select("word", "sentiment")), "word")
    t = t.join(bounded_broadcast(afinn.select("word", "score")), "word")
    return t.select(key, "word", polarity_sign("sentiment").alias("sentb"),
                    F.col("score").alias("senta"))


def review_sums(words: DataFrame, key: str = "v1") -> DataFrame:
    """Running per-review sums of a word-score stream (a streaming
    aggregation: Spark keeps one state row per review)."""
    return words.groupBy(key).agg(F.sum("sentb").cast("bigint").alias("sum_sentb"),
                                  F.sum("senta").cast("bigint").alias("sum_senta"))
