"""Registered queries: sampling (K1-K5) and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.functions.columns import argmax, one_hot
from reviewlab.operators.clean import non_blank
from reviewlab.operators.sampling import folds, row_share, shuffled, split_exact
from reviewlab.operators.text import multi_hot_indices, sequences, tokens, vocabulary
from reviewlab.plans.queries import prepared_reviews
from reviewlab.plans.registry import query
from reviewlab.sources.fixtures import reviews

TOKS = r"regexp_extract_all(lower(review_text), '[\p{L}\p{N}]+(?:\x27[\p{L}\p{N}]+)*')"


def _h(expr: str) -> str:
    return f"md5({expr})"


@query("split_exact", sql="""
select v1, case when row_number() over (order by md5('22-' || cast(v1 as varchar)), v1)
                     <= ceil(0.8 * count(*) over ()) then 'train' else 'test' end as split
from complete
""")
def q_split(spark, sf):
    df = prepared_reviews(spark, sf)
    return split_exact(df.select("v1"), "v1", share=0.8, seed=22)


@query("holdout_fixed", sql="""
select v1, case when row_number() over (order by md5('7-' || cast(v1 as varchar)), v1) <= 1000
                then 'validation' else 'rest' end as part
from complete
""")
def q_holdout(spark, sf):
    df = prepared_reviews(spark, sf)
    return split_exact(df.select("v1"), "v1", share=None, n=1000, seed=7, out="part",
                       first="validation", second="rest")


SHUF_SQL = """
, a as (select v1, rating, row_number() over (order by md5('22-a-' || cast(v1 as varchar)), v1) as r from complete)
, b as (select rating as rating_shuffled, row_number() over (order by md5('22-b-' || cast(v1 as varchar)), v1) as r from complete)
, sh as (select a.v1, a.rating, b.rating_shuffled from a join b using (r))
"""


@query("shuffled_labels", sql=SHUF_SQL + "select v1, rating, rating_shuffled from sh")
def q_shuffled(spark, sf):
    df = prepared_reviews(spark, sf)
    return shuffled(df.select("v1", "rating"), "v1", "rating", seed=22)


@query("chance_accuracy_shuffled", sql=SHUF_SQL + """
select round(avg(case when rating = rating_shuffled then 1.0 else 0.0 end), 6) as chance_accuracy from sh
""")
def q_chance_shuffled(spark, sf):
    s = q_shuffled(spark, sf)
    return s.agg(F.round(F.avg((F.col("rating") == F.col("rating_shuffled")).cast("double")), 6)
                 .alias("chance_accuracy"))


@query("folds", sql="""
select v1, cast(cast(('0x' || substr(md5('22-fold-' || cast(v1 as varchar)), 1, 8)) as bigint) % 5 as int) as fold
from complete
""")
def q_folds(spark, sf):
    df = prepared_reviews(spark, sf)
    return folds(df.select("v1"), "v1", 5, 22)


@query("row_share_round1", sql="""
select v1 from complete
where cast(('0x' || substr(md5('22-row1-' || cast(v1 as varchar)), 1, 8)) as bigint) / 4294967296.0 < 0.6
""")
def q_row_share(spark, sf):
    df = prepared_reviews(spark, sf)
    return row_share(df.select("v1"), "v1", 0.6, 1, 22)


VOCAB_SQL = f"""
, tv as (select v1, {TOKS} as ws from reviews where review_text <> '')
, vocab_n as (
  select word, count(*) as n from (select unnest(ws) as word from tv) group by word)
, vocab10k as (
  select word, n, cast(row_number() over (order by n desc, word) as int) as idx from vocab_n
  qualify row_number() over (order by n desc, word) <= 10000)
, seqs as (
  select tv.v1, coalesce(string_agg(cast(v.idx as varchar), ' ' order by t.pos), '') as seq

  from tv left join (select v1, unnest(ws) as word, generate_subscripts(ws, 1) as pos from tv) t using (v1)
  left join vocab10k v using (word)
  group by tv.v1)
"""


def _texts(spark, sf):
    return non_blank(reviews(spark, sf)).select("v1", "review_text")


def _vocab(spark, sf):
    return vocabulary(tokens(_texts(spark, sf), "review_text"), 10_000)


@query("vocabulary", sql=VOCAB_SQL + "select word, n, idx from vocab10k")
def q_vocabulary(spark, sf):
    return _vocab(spark, sf)


@query("sequences", sql=VOCAB_SQL + "select v1, seq from seqs")
def q_sequences(spark, sf):
    s = sequences(_texts(spark, sf), _vocab(spark, sf))
    return s.select("v1", F.array_join("seq", " ").alias("seq"))


@query("multi_hot", sql=VOCAB_SQL + """
, idx as (select distinct t.v1, v.idx - 1 as i
          from (select v1, unnest(ws) as word from tv) t join vocab10k v using (word))
select tv.v1, coalesce(string_agg(cast(i as varchar), ' ' order by i), '') as indices,
       cast(count(i) as int) as nnz
from tv left join idx using (v1) group by tv.v1
""")
def q_multi_hot(spark, sf):
    s = sequences(_texts(spark, sf), _vocab(spark, sf))
    idx = multi_hot_indices("seq", 10_000)
    return s.select("v1", F.array_join(idx, " ").alias("indices"), F.size(idx).alias("nnz"))


@query("one_hot_labels", sql="""
select v1, rating, array_to_string(list_transform(range(0, 5), lambda x: cast(x = rating - 1 as int)), ' ') as onehot
from complete
""")
def q_one_hot(spark, sf):
    df = prepared_reviews(spark, sf)
    oh = F.transform(one_hot(F.col("rating") - 1, 5), lambda x: x.cast("int").cast("string"))
    return df.select("v1", "rating", F.array_join(oh, " ").alias("onehot"))


MODAL_SQL = """
, cc as (select class, rating, count(*) as n from complete group by all)
, ca as (select class, [coalesce(sum(n) filter (where rating = 1), 0), coalesce(sum(n) filter (where rating = 2), 0),
                        coalesce(sum(n) filter (where rating = 3), 0), coalesce(sum(n) filter (where rating = 4), 0),
                        coalesce(sum(n) filter (where rating = 5), 0)] as counts, sum(n) as total
         from cc group by class)
"""


def _class_counts(spark, sf):
    df = prepared_reviews(spark, sf)
    return df.groupBy("class").agg(
        F.array(*[F.count_if(F.col("rating") == k).cast("bigint") for k in range(1, 6)]).alias("counts"),
        F.count(F.lit(1)).alias("total"))


@query("modal_rating", sql=MODAL_SQL + """
select class, array_to_string(counts, ' ') as counts, cast(list_position(counts, list_max(counts)) as int) as modal
from ca
""")
def q_modal(spark, sf):
    c = _class_counts(spark, sf)
    return c.select("class", F.array_join("counts", " ").alias("counts"), argmax("counts").alias("modal"))


@query("evaluate_class_prior", sql=MODAL_SQL + """
, pr as (select c.v1, c.rating, ca.counts, ca.total from complete c join ca using (class))
select round(avg(-ln(greatest(counts[rating] / total, 1e-7))), 6) as loss,
       round(avg(case when list_position(counts, list_max(counts)) = rating then 1.0 else 0.0 end), 6) as accuracy
from pr
""")
def q_evaluate_prior(spark, sf):
    """Evaluate (loss, accuracy) of the class-prior model: each review's
    class probabilities are the rating shares of its clothing class."""
    from reviewlab.operators.mlp import evaluate
    df = prepared_reviews(spark, sf)
    c = _class_counts(spark, sf).select(
        "class", F.transform("counts", lambda n: n / F.col("total")).alias("prob"))
    p = df.select("v1", "class", (F.col("rating") - 1).alias("label")).join(c, "class")
    return evaluate(p, "prob", "label").select(F.round("loss", 6).alias("loss"),
                                               F.round("accuracy", 6).alias("accuracy"))
