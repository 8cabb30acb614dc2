"""Registered queries: statistics (A2-A5, A12-A15) and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.operators.clean import score_window
from reviewlab.operators.metrics import (
    class_metrics, compare_f1, confusion, hit_rate, matrix_accuracy,
)
from reviewlab.operators.sentiment import sentence_sentiment
from reviewlab.operators.stats import (
    best_row, chance_accuracy, chi_square, chi_square_statistic, class_means,
    crosstab_long, density, density_compare, z_scores,
)
from reviewlab.plans.q_tables import ONE_LEX_SQL, SCORE_BAND_SQL, score_band_prediction, sentiment_one
from reviewlab.plans.queries import SENTENCE_SQL, prepared, prepared_reviews
from reviewlab.plans.registry import query

R6 = lambda c, name=None: F.round(c, 6).alias(name or (c if isinstance(c, str) else None))


@query("class_means", sql=ONE_LEX_SQL + """
select class, round(avg(cast(rating as double)), 6) as mrating, round(avg(cast(sum_sent as double)), 6) as msum_sent
from sent1 group by class
""")
def q_class_means(spark, sf):
    m = class_means(sentiment_one(spark, sf))
    return m.select("class", R6("mrating"), R6("msum_sent"))


@query("class_mean_z", sql=ONE_LEX_SQL + """
, m as (select class, avg(cast(rating as double)) as mrating, avg(cast(sum_sent as double)) as msum_sent
        from sent1 group by class)
, s as (select avg(mrating) as a1, stddev_samp(mrating) as s1, avg(msum_sent) as a2, stddev_samp(msum_sent) as s2 from m)
select class, round(case when s1 <> 0 then (mrating - a1) / s1 end, 6) as mrating_z,
       round(case when s2 <> 0 then (msum_sent - a2) / s2 end, 6) as msum_sent_z
from m, s
""")
def q_class_mean_z(spark, sf):
    m = class_means(sentiment_one(spark, sf))
    z = z_scores(m, ["mrating", "msum_sent"])
    return z.select("class", R6("mrating_z"), R6("msum_sent_z"))


@query("crosstab_rating_score", sql=ONE_LEX_SQL + """
select rating, sum_sent, count(*) as n from sent1 group by all
""")
def q_crosstab(spark, sf):
    return crosstab_long(sentiment_one(spark, sf), "rating", "sum_sent")


CHI_SQL = ONE_LEX_SQL + """
, cells as (select rating, sum_sent, count(*) as n from sent1 group by all)
, rc as (select *, sum(n) over (partition by rating) as r, sum(n) over (partition by sum_sent) as c from cells)
, agg as (select sum(n * n / (r * c)) as s, sum(n) as n, count(distinct rating) as ra, count(distinct sum_sent) as cb from rc)
"""


@query("chi_square", sql=CHI_SQL + """
select round(n * (s - 1), 6) as statistic, cast((ra - 1) * (cb - 1) as bigint) as dof, cast(n as bigint) as n from agg
""")
def q_chi_square(spark, sf):
    st = chi_square_statistic(sentiment_one(spark, sf), "rating", "sum_sent")
    return st.select(R6("statistic"), "dof", "n")


@query("chi_square_test")
def q_chi_square_test(spark, sf):
    """With the p-value (checked against Spark ML's test in the unit tests)."""
    return chi_square(sentiment_one(spark, sf), "rating", "sum_sent")


# A6-A11 on the score-band prediction
CM_SQL = ONE_LEX_SQL + SCORE_BAND_SQL + """
, labels as (select unnest([1, 2, 3, 4, 5]) as l)
, grid as (select a.l as real, b.l as predict from labels a, labels b)
, counts as (select rating as real, pred as predict, count(*) as n from scored group by all)
, cm as (select g.real, g.predict, cast(coalesce(c.n, 0) as bigint) as n from grid g left join counts c using (real, predict))
, bp as (select predict as label, sum(n) as predicted, sum(case when real = predict then n else 0 end) as tp from cm group by predict)
, br as (select real as label, sum(n) as actual from cm group by real)
, met as (select label, cast(tp as bigint) as tp, cast(predicted as bigint) as predicted, cast(actual as bigint) as actual,
            case when predicted > 0 then tp / predicted end as precision,
            case when actual > 0 then tp / actual end as recall
          from bp join br using (label))
, met2 as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) end as f1 from met)
"""


def _scored(spark, sf):
    return score_band_prediction(sentiment_one(spark, sf))


def _cm(spark, sf):
    return confusion(_scored(spark, sf), "rating", "pred", labels=[1, 2, 3, 4, 5])


@query("confusion_matrix", sql=CM_SQL + "select real, predict, n from cm")
def q_confusion(spark, sf):
    return _cm(spark, sf)


@query("class_metrics", sql=CM_SQL + """
select label, tp, predicted, actual, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1, 6) as f1 from met2
""")
def q_class_metrics(spark, sf):
    m = class_metrics(_cm(spark, sf))
    return m.select("label", "tp", "predicted", "actual", R6("precision"), R6("recall"), R6("f1"))


@query("class_metrics_unlisted", sql=ONE_LEX_SQL + SCORE_BAND_SQL + """
, low as (select rating, pred from scored where rating <= 3)
, l as (select unnest([1, 2, 3]) as label)
, m as (select label, cast((select count(*) from low where rating = label and pred = label) as bigint) as tp,
               cast((select count(*) from low where pred = label) as bigint) as predicted,
               cast((select count(*) from low where rating = label) as bigint) as actual from l)
select label, tp, predicted, actual, round(case when predicted > 0 then tp / predicted end, 6) as precision,
       round(case when actual > 0 then tp / actual end, 6) as recall from m
""")
def q_class_metrics_unlisted(spark, sf):
    """Metrics of ratings 1 to 3, where predictions of 4 and 5 are misses that
    stay in the actual counts."""
    low = _scored(spark, sf).where("rating <= 3")
    m = class_metrics(confusion(low, "rating", "pred", labels=[1, 2, 3]))
    return m.select("label", "tp", "predicted", "actual", R6("precision"), R6("recall"))


WINDOW_SQL = ONE_LEX_SQL + """
, win as (select * from sent1 where rating in (1, 2, 3, 4) and sum_sent < 7)
"""


def _windowed(spark, sf):
    return score_window(sentiment_one(spark, sf))


@query("chi_square_window", sql=WINDOW_SQL + """
, cells as (select rating, sum_sent, count(*) as n from win group by all)
, rc as (select *, sum(n) over (partition by rating) as r, sum(n) over (partition by sum_sent) as c from cells)
, agg as (select sum(n * n / (r * c)) as s, sum(n) as n, count(distinct rating) as ra, count(distinct sum_sent) as cb from rc)
select round(n * (s - 1), 6) as statistic, cast((ra - 1) * (cb - 1) as bigint) as dof, cast(n as bigint) as n from agg
""")
def q_chi_square_window(spark, sf):
    """The test on the score window, as flow A runs it."""
    return chi_square_statistic(_windowed(spark, sf), "rating", "sum_sent").select(R6("statistic"), "dof", "n")


@query("class_means_window", sql=WINDOW_SQL + """
select class, round(avg(cast(rating as double)), 6) as mrating, round(avg(cast(sum_sent as double)), 6) as msum_sent
from win group by class
""")
def q_class_means_window(spark, sf):
    return class_means(_windowed(spark, sf)).select("class", R6("mrating"), R6("msum_sent"))


@query("accuracy", sql=CM_SQL + """
select round((select sum(case when real = predict then n else 0 end) / sum(n) from cm), 6) as matrix_accuracy,
       round((select avg(case when rating = pred then 1.0 else 0.0 end) from scored), 6) as hit_rate
""")
def q_accuracy(spark, sf):
    a = matrix_accuracy(_cm(spark, sf)).select(R6("accuracy", "matrix_accuracy"))
    h = hit_rate(_scored(spark, sf), "rating", "pred").select(R6("accuracy", "hit_rate"))
    return a.select("matrix_accuracy", h.select("hit_rate").scalar().alias("hit_rate"))


@query("compare_f1", sql=CM_SQL + """
, cm3 as (select case when real >= 4 then 3 when real = 3 then 2 else 1 end as r3,
                 case when predict >= 4 then 3 when predict = 3 then 2 else 1 end as p3, n from cm)
, f3 as (select label, case when p + r > 0 then 2 * p * r / (p + r) end as f1 from (
    select label, case when predicted > 0 then tp / predicted end as p, case when actual > 0 then tp / actual end as r from (
      select l as label,
             (select sum(n) from cm3 where p3 = l) as predicted,
             (select sum(n) from cm3 where r3 = l and p3 = l) as tp,
             (select sum(n) from cm3 where r3 = l) as actual
      from (select unnest([1, 2, 3]) as l))))
select coalesce(a.label, b.label) as label, round(a.f1, 6) as f1_five, round(b.f1, 6) as f1_bands
from met2 a full join f3 b using (label)
""")
def q_compare_f1(spark, sf):
    """F1 per label of the 5-class prediction next to the same prediction
    scored on 3 rating bands (two models, one table)."""
    from reviewlab.functions.columns import rating_band
    s = _scored(spark, sf)
    five = class_metrics(confusion(s, "rating", "pred", labels=[1, 2, 3, 4, 5]))
    s3 = s.select(rating_band("rating").alias("r3"), rating_band("pred").alias("p3"))
    bands = class_metrics(confusion(s3, "r3", "p3", labels=[1, 2, 3]))
    c = compare_f1(five, bands, "five", "bands")
    return c.select("label", R6("f1_five"), R6("f1_bands"))


@query("chance_accuracy", sql="""
, c as (select rating, count(*) as n from complete group by rating)
select round(sum(n * n) / (sum(n) * sum(n)), 6) as chance_accuracy from c
""")
def q_chance(spark, sf):
    df = prepared_reviews(spark, sf)
    return chance_accuracy(df, "rating").select(R6("chance_accuracy"))


@query("weakest_class", sql=CM_SQL + """
select label, tp, predicted, actual, round(f1, 6) as f1 from met2 where f1 is not null
order by f1, label limit 1
""")
def q_weakest(spark, sf):
    m = class_metrics(_cm(spark, sf)).where(F.col("f1").isNotNull())
    b = best_row(m.select("label", "tp", "predicted", "actual", "f1"), loss="f1", tie="label")
    return b.select("label", "tp", "predicted", "actual", R6("f1"))


DENSITY_SQL = """
, st as (select count(*) as n, stddev_samp(v) as sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr,
                min(v) as lo, max(v) as hi from vals)
, bwt as (select *, 0.9 * (case when least(sd, iqr / 1.34) > 0 then least(sd, iqr / 1.34) when sd > 0 then sd
                                 when abs(lo) > 0 then abs(lo) else 1.0 end) * pow(n, -0.2) as bw from st)
, g0 as (select lo - 3 * bw as x0, (hi - lo + 6 * bw) / 511 as dx, bw, n from bwt)
, gi as (select unnest(range(0, 512)) as gi)
"""


@query("density_rating", sql="""
, vals as (select cast(rating as double) as v from complete)""" + DENSITY_SQL + """
, pos as (select (v - x0) / dx as t from vals, g0)
, mass as (select b, sum(w) as m from (select floor(t) as b, 1 - (t - floor(t)) as w from pos
                                       union all select floor(t) + 1, t - floor(t) from pos) where w > 0 group by b)
select cast(gi as int) as gi, round(x0 + gi * dx, 6) as x,
       round(sum(m * exp(-0.5 * ((gi - b) * dx / bw) * ((gi - b) * dx / bw)) / (sqrt(2 * pi()) * bw * n)), 6) as density
from mass, g0, gi group by gi, x0, dx
""")
def q_density_rating(spark, sf):
    df = prepared_reviews(spark, sf)
    d = density(df, "rating")
    return d.select("gi", R6("x"), R6("density"))


@query("density_by_rating", sql=SENTENCE_SQL + """
, kk as (select c.rating, coalesce(p.sum_sents, 0.0) as v from complete c left join per_review p using (v1)
         where c.rating in (4, 5))
, vals as (select v from kk)""" + DENSITY_SQL + """
, pos as (select rating, (v - x0) / dx as t from kk, g0)
, mass as (select rating, b, sum(w) as m from (select rating, floor(t) as b, 1 - (t - floor(t)) as w from pos
                                               union all select rating, floor(t) + 1, t - floor(t) from pos) where w > 0 group by all)
, sized as (select *, sum(m) over (partition by rating) as ng from mass)
select rating, cast(gi as int) as gi, round(x0 + gi * dx, 6) as x,
       round(sum(m * exp(-0.5 * ((gi - b) * dx / bw) * ((gi - b) * dx / bw)) / (sqrt(2 * pi()) * bw * ng)), 6) as density
from sized, g0, gi group by rating, gi, x0, dx
""")
def q_density_by_rating(spark, sf):
    kk = _rating45_sents(spark, sf)
    d = density(kk, "sum_sents", by="rating")
    return d.select("rating", "gi", R6("x"), R6("density"))


def _rating45_sents(spark, sf):
    df, lx = prepared(spark, sf)
    s = sentence_sentiment(df, lx.afinn, lx.negators, lx.amplifiers)
    kk = df.where(F.col("rating").isin(4, 5)).select("v1", "rating").join(s, "v1", "left") \
        .na.fill({"sum_sents": 0.0})
    from reviewlab.operators.util import cut_lineage
    return cut_lineage(kk)   # read by the bandwidth pass and the kernel pass


@query("density_equality_statistic", sql=SENTENCE_SQL + """
, kk as (select c.rating, coalesce(p.sum_sents, 0.0) as v from complete c left join per_review p using (v1)
         where c.rating in (4, 5))
, vals as (select v from kk)""" + DENSITY_SQL + """
, binned as (select rating, round((v - x0) / dx) as b, count(*) as m from kk, g0 group by all)
, curves as (select rating, gi, sum(m * exp(-0.5 * ((gi - b) * dx / bw) * ((gi - b) * dx / bw)) / (sqrt(2 * pi()) * bw))
                                / (select sum(m) from binned x where x.rating = binned.rating) as f
             from binned, g0, gi group by rating, gi)
, pooled as (select gi, sum(m * exp(-0.5 * ((gi - b) * dx / bw) * ((gi - b) * dx / bw)) / (sqrt(2 * pi()) * bw))
                        / (select sum(m) from binned) as f0 from binned, g0, gi group by gi)
select round(sum((f - f0) * (f - f0)) * (select dx from g0), 6) as statistic from curves join pooled using (gi)
""")
def q_density_statistic(spark, sf):
    _, test = density_compare(_rating45_sents(spark, sf), "sum_sents", "rating")
    return test.select(R6("statistic"))


@query("density_equality_test")
def q_density_test(spark, sf):
    """Statistic and permutation p-value (random; rows-only check)."""
    _, test = density_compare(_rating45_sents(spark, sf), "sum_sents", "rating",
                              permutations=200)
    return test
