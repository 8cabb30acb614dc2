"""Stand-ins for the review table and the word tables, built from the
driver's parquet tables (``documents``, ``labels``).

The real workload reads a CSV of reviews and three word tables from an
external package; neither is available, so these frames have the same
schemas and are derived deterministically from the given data, so that their
size grows with it. Every operator takes them as plain DataFrame arguments,
so real lexicons can be passed instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.functions.columns import hex_hash
from reviewlab.operators.text import word_counts
from reviewlab.operators.util import bounded_broadcast, cut_lineage

# Spark's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english"), 181 words), in its order.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now i'll you'll he'll "
    "she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's "
    "she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought "
    "that's there's what's when's where's who's why's would"
).split()

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review table: one row per document, with its label when present.

    Nulls in ``age`` and ``recommended``, empty titles and texts, ages below
    18, and a rating driven by ``quality``/``toxic``.
    """
    d = read_table(spark, sf_dir, "documents").alias("d")
    # only a measured small table is broadcast, but then surely: no text is shuffled
    lab = bounded_broadcast(read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")).alias("l")
    doc = F.col("d.doc_id")
    q, tx = F.col("l.quality"), F.col("l.toxic")
    rating = (F.when((q == 1) & (tx == 0), 4 + (doc * 31) % 2)
              .when(q == 1, 3)
              .when(tx == 1, 1)
              .when(q == 0, 2)
              .otherwise(1 + (doc * 31) % 5))
    out = (d.join(lab, doc == F.col("l.doc_id"), "left")
           .select(
                doc.alias("v1"),
                (doc % 97).cast("int").alias("clothing_id"),
                F.when(doc % 41 == 0, F.lit(None))
                 .otherwise(15 + (doc * 7919) % 85).cast("int").alias("age"),
                F.when(doc % 7 == 0, F.lit(""))
                 .otherwise(F.substring("d.text", 1, 20)).alias("title"),
                F.when(doc % 29 == 0, F.lit("")).otherwise(F.col("d.text"))
                 .alias("review_text"),
                rating.cast("int").alias("rating"),
                q.alias("recommended"),
                (F.col("d.n_chars") % 23).cast("int").alias("positive_feedback"),
                F.col("d.lang").alias("devision"),
                F.col("d.source").alias("department"),
                F.concat(F.col("d.lang"), F.lit("-"), (doc % 6).cast("string"))
                 .alias("class"),
           ))
    return out


def vocab(reviews_df: DataFrame, text: str = "review_text", min_len: int = 3,
          min_count: int = 5) -> DataFrame:
    """Words of ``min_len`` or more characters seen ``min_count`` or more times."""
    return (word_counts(reviews_df, text)
            .where((F.length("word") >= min_len) & (F.col("n") >= min_count))
            .select("word"))


@dataclass
class Lexicons:
    stop: DataFrame        # word
    bing: DataFrame        # word, sentiment ('positive' | 'negative')
    afinn: DataFrame       # word, score (int, -5..5, never 0)
    negators: DataFrame    # word
    amplifiers: DataFrame  # word


def lexicons(spark: SparkSession, sf_dir: str | None = None,
             reviews_df: DataFrame | None = None) -> Lexicons:
    """Word tables derived from the review vocabulary by md5 rules.

    * bing: vocab words with h1 % 4 in (0, 1); positive when h1 is even;
      words with h1 % 97 = 0 get a second row of the opposite polarity;
    * afinn: h17 % 3 <> 0 and h9 % 11 <> 5, score h9 % 11 - 5;
    * negators / amplifiers (for sentence scores): h25 % 211 = 0 / = 1;
    * stop: Spark's default English list.

    ``h<i>`` is the integer of the 8 hex digits of md5(word) from position i.
    The vocabulary is written to the checkpoint folder once, so the tables
    share one scan of the text.
    """
    if reviews_df is None:
        reviews_df = reviews(spark, sf_dir)
    hv = cut_lineage(vocab(reviews_df)).select(
        "word",
        hex_hash(F.col("word"), 1).alias("h1"),
        hex_hash(F.col("word"), 9).alias("h9"),
        hex_hash(F.col("word"), 17).alias("h17"),
        hex_hash(F.col("word"), 25).alias("h25"),
    )
    b = hv.where((F.col("h1") % 4).isin(0, 1))
    pos = F.col("h1") % 2 == 0
    bing = (b.select("word", F.when(pos, "positive").otherwise("negative").alias("sentiment"))
            .unionByName(b.where(F.col("h1") % 97 == 0)
                         .select("word", F.when(pos, "negative").otherwise("positive")
                                 .alias("sentiment"))))
    afinn = (hv.where((F.col("h17") % 3 != 0) & (F.col("h9") % 11 != 5))
             .select("word", (F.col("h9") % 11 - 5).cast("int").alias("score")))
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    negators = hv.where(F.col("h25") % 211 == 0).select("word")
    amplifiers = hv.where(F.col("h25") % 211 == 1).select("word")
    return Lexicons(stop, bing, afinn, negators, amplifiers)
