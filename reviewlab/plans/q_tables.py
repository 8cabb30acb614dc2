"""Registered queries: sources and table steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.functions.columns import hit, polarity_sign, rating_band, shift_label
from reviewlab.operators.clean import (
    all_text, category_codes, class_pair, complete_rows, last_rows, non_blank,
    numbers, rename_all, score_window, stack_rows, with_age_band,
)
from reviewlab.operators.sentiment import review_sentiment
from reviewlab.operators.stats import class_means
from reviewlab.plans.queries import K10, KEYS10, prepared, prepared_reviews
from reviewlab.plans.registry import query
from reviewlab.sources.csv import REVIEW_COLUMNS
from reviewlab.sources.fixtures import lexicons, reviews
from reviewlab.sources.schema import level_counts, summarise

ONE_LEX_SQL = f"""
, words as (select {K10}, unnest(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}]+(?:\\x27[\\p{{L}}\\p{{N}}]+)*')) as word from complete)
, sent1 as (
  select {K10}, cast(sum(case when b.sentiment = 'positive' then 1 else -1 end) as bigint) as sum_sent
  from words w join bing b using (word)
  where not exists (select 1 from stop_words s where s.word = w.word)
  group by all)"""


def sentiment_one(spark, sf):
    df, lx = prepared(spark, sf)
    return review_sentiment(df, lx.stop, lx.bing, keys=KEYS10)


# S3: word tables derived from the data
@query("lexicon_bing", sql="select word, sentiment from bing")
def q_lexicon_bing(spark, sf):
    return lexicons(spark, sf).bing


@query("lexicon_afinn", sql="select word, score from afinn")
def q_lexicon_afinn(spark, sf):
    return lexicons(spark, sf).afinn


# Column summary and level counts
@query("summary_reviews", sql="""
, cols as (
  select 'age' as "column", cast(age as double) as x from reviews union all
  select 'rating', cast(rating as double) from reviews union all
  select 'positive_feedback', cast(positive_feedback as double) from reviews)
select "column", min(x) as min, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median,
       round(avg(x), 6) as mean, quantile_cont(x, 0.75) as q3, max(x) as max,
       cast(count(*) - count(x) as bigint) as nulls
from cols group by "column"
""")
def q_summary(spark, sf):
    s = summarise(reviews(spark, sf), ["age", "rating", "positive_feedback"])
    return s.withColumn("mean", F.round("mean", 6)).withColumn("nulls", F.col("nulls").cast("bigint"))


@query("level_counts", sql="""
select "column", level, count(*) as n from (
  select 'devision' as "column", devision as level from reviews union all
  select 'department', department from reviews union all
  select 'rating', cast(rating as varchar) from reviews) t
group by all
""")
def q_level_counts(spark, sf):
    return level_counts(reviews(spark, sf), ["devision", "department", "rating"])


# P1 + P2 + P6: rename by position over the raw documents+labels columns, keep non-blank text
@query("renamed_nonblank", sql="""
select v1, clothing_id, age, title, rating, recommended, positive_feedback, devision, department, class
from reviews where review_text <> ''
""")
def q_renamed(spark, sf):
    r = reviews(spark, sf)
    raw = r.toDF(*[f"c{i}" for i in range(len(r.columns))])  # positional names
    return non_blank(rename_all(raw, REVIEW_COLUMNS)).drop("review_text")


# P3 + P5 + P6: tree input (complete rows, age bands, selected columns)
@query("tree_input", sql="""
select age_div, recommended, devision, class, department, rating from complete
""")
def q_tree_input(spark, sf):
    df = with_age_band(complete_rows(reviews(spark, sf)))
    return df.select("age_div", "recommended", "devision", "class", "department", "rating")


# P4 + P7: drop rows with nulls in chosen columns, drop columns
@query("complete_selected", sql="""
select v1, age, rating, recommended from reviews where age is not null and recommended is not null
""")
def q_complete_selected(spark, sf):
    r = reviews(spark, sf).select("v1", "age", "rating", "recommended", "title")
    return complete_rows(r, ["age", "recommended"]).drop("title")


# P8 + P9: every column to text, then numbers back
@query("text_and_numbers", sql="""
select cast(v1 as varchar) as v1, cast(age as varchar) as age, try_cast(cast(age as varchar) as double) as age_num,
       try_cast(cast(devision as varchar) as double) as devision_num
from reviews
""")
def q_text_numbers(spark, sf):
    t = all_text(reviews(spark, sf).select("v1", "age", "devision"))
    return numbers(t.select("v1", "age", F.col("age").alias("age_num"),
                            F.col("devision").alias("devision_num")),
                   ["age_num", "devision_num"])


# P10 + P11: rating bands and label shift
@query("rating_bands", sql="""
select v1, rating,
       case when rating >= 4 then 3 when rating = 3 then 2 when rating is not null then 1 end as rating3,
       rating - 1 as label0
from reviews
""")
def q_rating_bands(spark, sf):
    r = reviews(spark, sf)
    return r.select("v1", "rating", rating_band("rating").alias("rating3"),
                    shift_label("rating", -1).alias("label0"))


# Category codes, free (sorted levels) and ordered (stated levels)
@query("category_codes", sql="""
, lv as (select department, cast(dense_rank() over (order by department) - 1 as int) as department_code
         from (select distinct department from reviews where department is not null))
select r.v1, lv.department_code,
       cast(case r.age_div when '18 ~ 29' then 0 when '30 ~ 39' then 1 when '40 ~ 49' then 2
            when '50 ~ 59' then 3 when '60 ~ 69' then 4 when '70 ~ 79' then 5 when '80 ~ 89' then 6
            when '90 ~ 99' then 7 when 'Unknown' then 8 end as int) as age_div_code
from age_banded r left join lv using (department)
""")
def q_category_codes(spark, sf):
    from reviewlab.functions.columns import AGE_BANDS, AGE_UNKNOWN
    df = with_age_band(reviews(spark, sf))
    df = category_codes(df, "department")
    df = category_codes(df, "age_div", levels=[b[2] for b in AGE_BANDS] + [AGE_UNKNOWN])
    return df.select("v1", "department_code", "age_div_code")


# Polarity signs on the word rows
@query("polarity_signs", sql="""
select word, sentiment, case when sentiment = 'positive' then 1 else -1 end as sentb from bing
""")
def q_polarity(spark, sf):
    b = lexicons(spark, sf).bing
    return b.select("word", "sentiment", polarity_sign("sentiment").alias("sentb"))


# P14 + O4: class pairs (x or 5) for x in 1..4, stacked with duplicates
@query("class_pairs_stacked", sql=ONE_LEX_SQL + """
select x as pair, v1, rating, sum_sent from sent1, (select unnest([1, 2, 3, 4]) as x) p
where rating = x or rating = 5
""")
def q_class_pairs(spark, sf):
    s = sentiment_one(spark, sf)
    return stack_rows(*[class_pair(s, x).select(F.lit(x).alias("pair"), "v1", "rating", "sum_sent")
                        for x in (1, 2, 3, 4)])


# Ratings 1..4 with score below 7
@query("score_window", sql=ONE_LEX_SQL + """
select v1, rating, sum_sent from sent1 where rating in (1, 2, 3, 4) and sum_sent < 7
""")
def q_score_window(spark, sf):
    return score_window(sentiment_one(spark, sf)).select("v1", "rating", "sum_sent")


# P17 + P18 + P19: rounded score-band prediction attached by key, hit flag
SCORE_BAND_SQL = """
, scored as (
  select v1, rating,
         case when sum_sent <= -3 then 1 when sum_sent <= -1 then 2 when sum_sent = 0 then 3
              when sum_sent <= 2 then 4 else 5 end as pred
  from sent1)"""


def score_band_prediction(df, score="sum_sent", out="pred"):
    """A baseline classifier of the rating from a sentiment sum (bands)."""
    s = F.col(score)
    return df.withColumn(out, F.when(s <= -3, 1).when(s <= -1, 2).when(s == 0, 3)
                         .when(s <= 2, 4).otherwise(5))


@query("prediction_hits", sql=ONE_LEX_SQL + SCORE_BAND_SQL + """
select c.v1, c.rating, cast(round(s.pred) as int) as pred,
       cast(s.pred = c.rating as int) as hit
from complete c left join scored s using (v1)
""")
def q_prediction_hits(spark, sf):
    df = prepared_reviews(spark, sf)
    pred = score_band_prediction(sentiment_one(spark, sf)).select("v1", "pred")
    from reviewlab.operators.clean import attach
    a = attach(df.select("v1", "rating"), pred)
    return a.select("v1", "rating", F.round("pred").cast("int").alias("pred"),
                    hit("pred", "rating").alias("hit"))


# O1 + O2: class means, the ten classes with the highest mean rating
@query("top_classes", sql=ONE_LEX_SQL + """
select class, round(avg(cast(rating as double)), 6) as mrating, round(avg(cast(sum_sent as double)), 6) as msum_sent
from sent1 group by class order by mrating desc, class limit 10
""")
def q_top_classes(spark, sf):
    m = class_means(sentiment_one(spark, sf))
    m = m.select("class", F.round("mrating", 6).alias("mrating"),
                 F.round("msum_sent", 6).alias("msum_sent"))
    return last_rows(m, [F.desc("mrating"), F.asc("class")], 10)
