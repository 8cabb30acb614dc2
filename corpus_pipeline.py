"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage calls one operator of ``reviewlab.llm`` on what the stage before it
kept. Stages but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.llm import decontam, packing, quality, simhash, toxicity
from reviewlab.llm.common import fold, read, saved, tokenizer_file

#: a document is rejected as toxic, or kept as good, from this score on
TOXIC, GOOD = 0.7, 0.7


def _only(docs: DataFrame, scores: DataFrame, keep: str) -> DataFrame:
    """Rows of ``docs`` whose score meets ``keep``; equal ids have equal fates
    (the largest score counts), rows without an id stay."""
    bad = scores.groupBy("doc_id").agg(F.max("score").alias("score")).where(f"not ({keep})").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("_bad"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return _only(docs, scores, f"score < {TOXIC}")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return _only(docs, scores, f"score >= {GOOD}")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), 0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file(), 1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can't express models, fingerprints of XXH64 and tokenizers; the stages
#: are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, from the table ``documents``; every stage's
    result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
