"""The registered queries, one per operator (or small group of operators)
of the review workload, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.operators.clean import complete_rows, with_age_band
from reviewlab.operators.sentiment import review_sentiment, sentence_sentiment
from reviewlab.plans.registry import query
from reviewlab.sources.fixtures import lexicons, reviews

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+(?:\x27[\p{{L}}\p{{N}}]+)*')"

KEYS10 = ["v1", "clothing_id", "age", "age_div", "recommended",
          "positive_feedback", "devision", "class", "department", "rating"]
K10 = ", ".join(KEYS10)


def prepared_reviews(spark, sf):
    """Complete reviews with age bands."""
    return with_age_band(complete_rows(reviews(spark, sf)))


def prepared(spark, sf):
    """Complete reviews with age bands, and the word tables (a scan of the
    texts of its own; see ``lexicons``)."""
    return prepared_reviews(spark, sf), lexicons(spark, sf)


# --- A1 / J1-J3 / T1 / P13: per-review sentiment sums -----------------------

@query("review_sentiment", sql=f"""
, words as (select {K10}, unnest({TOK.format(c='review_text')}) as word from complete)
select {K10},
       cast(sum(case when b.sentiment = 'positive' then 1 else -1 end) as bigint) as sum_sentb,
       cast(sum(a.score) as bigint) as sum_senta
from words w join bing b using (word) join afinn a using (word)
where not exists (select 1 from stop_words s where s.word = w.word)
group by all
""")
def q_review_sentiment(spark, sf):
    df, lx = prepared(spark, sf)
    return review_sentiment(df, lx.stop, lx.bing, lx.afinn, keys=KEYS10)


@query("review_sentiment_one_lexicon", sql=f"""
, words as (select {K10}, unnest({TOK.format(c='review_text')}) as word from complete)
select {K10},
       cast(sum(case when b.sentiment = 'positive' then 1 else -1 end) as bigint) as sum_sent
from words w join bing b using (word)
where not exists (select 1 from stop_words s where s.word = w.word)
group by all
""")
def q_review_sentiment_one(spark, sf):
    df, lx = prepared(spark, sf)
    return review_sentiment(df, lx.stop, lx.bing, keys=KEYS10)


# --- T5: average sentence sentiment ----------------------------------------

SENTENCE_SQL = f"""
, sents as (
  select v1, unnest(string_split_regex(review_text, '[.!?]+')) as sentence from complete
), sw as (
  select v1, sentence, {TOK.format(c='sentence')} as ws from sents
), sn as (
  select v1, ws, len(ws) as n, row_number() over () as sid from sw where len(ws) > 0
), wrd as (
  select v1, sid, n, unnest(ws) as word, unnest(range(1, n + 1)) as pos from sn
), flagged as (
  select w.*, coalesce(a.score, 0) as score,
         case when exists (select 1 from negators g where g.word = w.word) then 1 else 0 end as isneg,
         case when exists (select 1 from amplifiers m where m.word = w.word) then 1 else 0 end as isamp
  from wrd w left join afinn a using (word)
), win as (
  select v1, sid, n, score,
         coalesce(sum(isneg) over (partition by sid order by pos rows between 4 preceding and 1 preceding), 0) as negs,
         coalesce(sum(isamp) over (partition by sid order by pos rows between 4 preceding and 1 preceding), 0) as amps
  from flagged
), per_sent as (
  select v1, sid, sum(score * (case when negs % 2 = 1 then -1.0 else 1.0 end) * (1.0 + 0.8 * amps)) / sqrt(max(n)) as s
  from win group by v1, sid
), per_review as (
  select v1, sum(s) / count(*) as sum_sents from per_sent group by v1
)"""


@query("sentence_sentiment", sql=SENTENCE_SQL + """
select c.v1, round(coalesce(p.sum_sents, 0.0), 6) as sum_sents
from complete c left join per_review p using (v1)
""")
def q_sentence_sentiment(spark, sf):
    df, lx = prepared(spark, sf)
    s = sentence_sentiment(df, lx.afinn, lx.negators, lx.amplifiers)
    return s.select("v1", F.round("sum_sents", 6).alias("sum_sents"))


# the other query groups register themselves on import
from reviewlab.plans import q_features, q_models, q_stats, q_tables  # noqa: E402,F401
