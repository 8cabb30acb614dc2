"""Edge rows (FIXTURES §6) and the places where the workload's scripts go
wrong (SURVEY §0.1), one test each."""

import math

import pytest
from pyspark.sql import functions as F

from reviewlab.functions.columns import age_band, argmax, one_hot, rating_band
from reviewlab.operators.metrics import class_metrics, confusion, hit_rate, matrix_accuracy
from reviewlab.operators.stats import (
    best_row, chi_square, class_means, density, gamma_q, z_scores,
)
from reviewlab.operators.sampling import folds, shuffled, split_exact


def test_age_bands_d13(spark):
    ages = [None, 17, 18, 29, 30, 89, 90, 99, 999, 1000]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = [r[0] for r in df.select(age_band("age")).collect()]
    assert got == ["Unknown", None, "18 ~ 29", "18 ~ 29", "30 ~ 39", "80 ~ 89",
                   "90 ~ 99", "90 ~ 99", "90 ~ 99", None]


def test_rating_band_keeps_null(spark):
    df = spark.createDataFrame([(r,) for r in [1, 2, 3, 4, 5, None]], "r int")
    assert [x[0] for x in df.select(rating_band("r")).collect()] == [1, 1, 2, 3, 3, None]


def test_confusion_completed_d7(spark):
    # class 2 is never predicted: its column is still there, with zeros
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (3, 3)], "real int, pred int")
    cm = confusion(df, "real", "pred", labels=[1, 2, 3])
    assert cm.count() == 9
    m = {r["label"]: r for r in class_metrics(cm).collect()}
    assert m[2]["predicted"] == 0 and m[2]["precision"] is None and m[2]["recall"] == 0.0
    assert m[1]["precision"] == 0.5 and m[1]["recall"] == 1.0
    assert matrix_accuracy(cm).first()[0] == 0.75


def test_predictions_outside_the_labels_count(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, None), (2, 2)], "real int, pred int")
    cm = confusion(df, "real", "pred", labels=[1, 2])
    m = {r["label"]: r for r in class_metrics(cm).collect()}
    assert m[1]["actual"] == 3 and m[1]["recall"] == 1 / 3 and m[1]["precision"] == 1.0
    assert sorted(m) == [1, 2] and matrix_accuracy(cm).first()[0] == 0.5
    assert hit_rate(df, "real", "pred").first()[0] == 0.5
    for bad in ([(3, 1)], [(None, 1)]):
        with pytest.raises(Exception, match="label outside the label set"):
            confusion(spark.createDataFrame(bad, "real int, pred int"), "real", "pred", labels=[1, 2]).collect()


def test_shifter_lists_of_any_size(spark):
    from reviewlab.operators.sentiment import sentence_sentiment
    df = spark.createDataFrame([(1, "not good. very good good"), (2, "plain"), (3, ""), (4, "a b c d not x very good")], "v1 long, review_text string")
    lex = spark.createDataFrame([("good", 2)], "word string, score int")
    many = spark.createDataFrame([("not",)] + [(f"w{i}",) for i in range(12_000)], "word string")
    got = {r["v1"]: r["sum_sents"] for r in sentence_sentiment(df, lex, many, ["very"]).collect()}
    assert got[1] == pytest.approx((-2 / math.sqrt(2) + (2 * 1.8 + 2 * 1.8) / math.sqrt(3)) / 2)
    assert got[2] == 0.0 and got[3] == 0.0 and got[4] == pytest.approx(-2 * 1.8 / math.sqrt(8))


def test_metrics_over_given_labels_d6(spark):
    df = spark.createDataFrame([(1, 1), (3, 2)], "real int, pred int")
    m = class_metrics(confusion(df, "real", "pred", labels=[1, 2, 3]))
    assert sorted(r["label"] for r in m.collect()) == [1, 2, 3]


def test_chi_square_matches_spark_ml_d8(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest
    rows = [(a % 3, (a * 7) % 4 + (a % 3 == 0)) for a in range(200)]
    df = spark.createDataFrame(rows, "a int, b int")
    r = chi_square(df, "a", "b").first()
    ml = spark.createDataFrame([(float(a), Vectors.dense([float(b)])) for a, b in rows],
                               ["label", "features"])
    t = ChiSquareTest.test(ml, "features", "label").first()
    assert math.isclose(r["statistic"], t.statistics[0], rel_tol=1e-9)
    assert r["dof"] == t.degreesOfFreedom[0]
    assert math.isclose(r["p_value"], t.pValues[0], rel_tol=1e-6, abs_tol=1e-12)


def test_gamma_q_known_values():
    # chi-square tail with 2 dof is exp(-x/2)
    assert math.isclose(gamma_q(1.0, 3.0), math.exp(-3.0), rel_tol=1e-12)
    assert math.isclose(gamma_q(0.5, 0.5), math.erfc(math.sqrt(0.5)), rel_tol=1e-10)


def test_class_means_average_scores_d9(spark):
    df = spark.createDataFrame([("a", 1, -3), ("a", 3, 5), ("b", 5, 0)],
                               "class string, rating int, sum_sent int")
    m = {r["class"]: r for r in class_means(df).collect()}
    assert m["a"]["mrating"] == 2.0 and m["a"]["msum_sent"] == 1.0


def test_z_scores_sd_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "k string, x double")
    assert [r["x_z"] for r in z_scores(df, ["x"]).collect()] == [None, None]


def test_best_row_tie_d10(spark):
    cv = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.7)], "paramsNum int, bestCvrmse double")
    assert best_row(cv).first()["paramsNum"] == 1


def test_split_exact_size_and_complement(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "v1")
    s = split_exact(df, "v1", share=0.8, seed=22)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 803, "test": 200}
    # same rows as a full sort by the hash
    import hashlib
    want = sorted(range(1003), key=lambda k: (hashlib.md5(f"22-{k}".encode()).hexdigest(), k))[:803]
    got = sorted(r[0] for r in s.where("split = 'train'").select("v1").collect())
    assert got == sorted(want)


def test_split_exact_empty_and_tiny(spark):
    empty = spark.range(0).withColumnRenamed("id", "v1")
    assert split_exact(empty, "v1").count() == 0
    one = spark.range(1).withColumnRenamed("id", "v1")
    assert split_exact(one, "v1").first()["split"] == "train"


def test_shuffle_is_a_permutation(spark):
    df = spark.range(0, 500).select(F.col("id").alias("v1"), (F.col("id") % 7).alias("y"))
    s = shuffled(df, "v1", "y")
    assert s.count() == 500
    a = sorted(r[0] for r in s.select("y").collect())
    b = sorted(r[0] for r in s.select("y_shuffled").collect())
    assert a == b


def test_folds_cover_all(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "v1")
    f = {r["fold"]: r["count"] for r in folds(df).groupBy("fold").count().collect()}
    assert set(f) == {0, 1, 2, 3, 4} and sum(f.values()) == 1000


def test_one_hot_and_argmax(spark):
    df = spark.createDataFrame([(2, [0.1, 0.7, 0.7])], "l int, p array<double>")
    r = df.select(one_hot("l", 4).alias("o"), argmax("p").alias("a")).first()
    assert r["o"] == [0.0, 0.0, 1.0, 0.0] and r["a"] == 2


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 5, 8]], "x double")
    d = sorted((r["x"], r["density"]) for r in density(df, "x").collect())
    step = d[1][0] - d[0][0]
    assert abs(sum(v for _, v in d) * step - 1.0) < 1e-3


def test_density_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert density(df, "x").count() == 0


def test_sequences_shuffle_no_words(spark):
    from reviewlab.operators import text
    docs = [(1, "B a, c's! zz a"), (2, None), (3, ""), (4, "zz"), (5, "a " * 20_000), (5, "c's")]
    df = spark.createDataFrame(docs, "v1 long, review_text string").repartition(2)
    vocab = spark.createDataFrame([("a", 7, 1), ("c's", 3, 2), ("b", 1, 3)], "word string, n long, idx int")
    got = text.sequences(df, vocab)
    want = [(1, [3, 1, 2, 1]), (2, []), (3, []), (4, []), (5, [1] * 20_000), (5, [2])]
    assert sorted((r["v1"], r["seq"]) for r in got.collect()) == want
    plan = text.sequences(spark.createDataFrame(docs, "v1 long, review_text string"), vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted((r["v1"], r["seq"]) for r in text._joined_sequences(df, vocab, "v1", "review_text", "word", "seq").collect()) == want
    assert text.sequences(df, vocab.limit(0)).where("size(seq) > 0").count() == 0
