"""The three end-to-end review flows, assembled from the operators, with the
fixes listed in SURVEY §0.1 (split before rebalancing, metrics over the
label set, one sentiment function for train and test, ...).

Each returns a dict of DataFrames; the learners' sizes (grid, rounds,
epochs) are arguments, the defaults small enough for a local run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.functions.columns import rating_band
from reviewlab.operators.balance import oversample_pairs
from reviewlab.operators.boost import (
    cross_validate, importance, param_grid, predict_boosted, top_features,
)
from reviewlab.operators.metrics import class_metrics, compare_f1, confusion, hit_rate
from reviewlab.operators.sampling import split_exact
from reviewlab.operators.sentiment import review_sentiment, sentence_sentiment
from reviewlab.operators.stats import (
    chi_square, class_means, density, density_compare, z_scores,
)
from reviewlab.operators.best import fit_best
from reviewlab.operators.tree import fit_tree, predict_tree
from reviewlab.operators.clean import complete_rows, score_window, with_age_band
from reviewlab.operators.util import cut_lineage
from reviewlab.plans.q_models import AGE_ORDER, TREE_FEATURES
from reviewlab.plans.queries import KEYS10
from reviewlab.sources.fixtures import Lexicons


def _grid(spark, etas=(0.02, 0.06, 0.1), depths=(2, 5, 10)):
    return param_grid(spark, eta=list(etas), max_depth=list(depths), subsample=[0.6],
                      colsample_bytree=[0.6])


def _tree_part(df: DataFrame, seed: int = 22):
    """Tree metrics on the test part; a ``split`` column of ``df`` is kept."""
    s = df if "split" in df.columns else split_exact(df, "v1", 0.8, seed=seed)
    m = fit_tree(s.where("split = 'train'"), "rating", TREE_FEATURES, cp=0.001)
    p = predict_tree(m, s.where("split = 'test'"), keep=["v1", "rating"])
    return class_metrics(confusion(p, "rating", "prediction", labels=[1, 2, 3, 4, 5]))


def polarity_three_bands(spark: SparkSession, reviews: DataFrame, lx: Lexicons,
                         rounds: int = 5, grid: DataFrame | None = None, patience: int = 10) -> dict:
    """Flow A: tree; one-lexicon sentiment; chi-square and class means;
    boosted trees on three rating bands; metrics over those bands."""
    df = with_age_band(complete_rows(reviews))
    out = {"tree_metrics": _tree_part(df)}
    s = review_sentiment(df, lx.stop, lx.bing, keys=KEYS10)
    # the table, its test and the class means are over the score window
    window = score_window(s)
    out["chi_square"] = chi_square(window, "rating", "sum_sent")
    out["class_means_z"] = z_scores(class_means(window), ["mrating", "msum_sent"])
    s3 = s.withColumn("rating", rating_band("rating"))
    feats = ["recommended", "age", "age_div", "positive_feedback", "devision", "class",
             "department", "sum_sent"]
    out.update(_boosted_part(spark, s3, feats, rounds, grid, num_class=4, labels=[1, 2, 3], patience=patience))
    return out


def _boosted_part(spark, df, feats, rounds, grid, num_class, labels, patience):
    # read by the CV, the final fit and the prediction: materialise once
    s = df if "split" in df.columns else split_exact(cut_lineage(df), "v1", 0.8, seed=22)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    grid = grid if grid is not None else _grid(spark)
    cv = cross_validate(train, "rating", feats, grid, rounds=rounds, k=5, patience=patience,
                        num_class=num_class, ordered=AGE_ORDER)
    model = fit_best(train, "rating", feats, cv, num_class=num_class, ordered=AGE_ORDER)
    pred = predict_boosted(model, test, keep=["v1", "rating"])
    cm = confusion(pred, "rating", "prediction", labels=labels)
    met = class_metrics(cm)
    return {"cv": cv, "boosted_metrics": met, "accuracy": hit_rate(pred, "rating", "prediction"),
            "importance": top_features(importance(model, spark), 8)}


def rebalanced_five_classes(spark: SparkSession, reviews: DataFrame, lx: Lexicons,
                            rounds: int = 5, grid: DataFrame | None = None, patience: int = 10) -> dict:
    """Flow B: tree; sentence and two-lexicon sentiment; split; SMOTE on
    the training part only; densities; boosted trees on 5 classes without
    ``recommended``; F1 of tree and boosted model side by side."""
    df = with_age_band(complete_rows(reviews))
    tree_met = _tree_part(df)
    sents = sentence_sentiment(df, lx.afinn, lx.negators, lx.amplifiers)
    # both sums are joined, not the texts; the texts are read once for each
    s = review_sentiment(df, lx.stop, lx.bing, lx.afinn, keys=KEYS10).join(sents, "v1")
    s = split_exact(cut_lineage(s), "v1", 0.8, seed=22)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    numeric = ["positive_feedback", "sum_sents", "sum_senta", "sum_sentb"]
    cats = ["recommended", "age", "age_div", "devision", "class", "department"]
    extra = oversample_pairs(train, "rating", (1, 2, 3, 4), 5, over=600, under=100, k=5,
                             numeric=numeric, categorical=cats)
    cols = ["v1", "rating"] + cats + numeric
    train3 = train.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c)
                            for c in cols]).unionByName(extra.select(*cols))
    train3 = cut_lineage(train3)   # read by densities, CV and the final fit
    out = {"tree_metrics": tree_met, "rebalanced_counts": train3.groupBy("rating").count(),
           "density_rating": density(train3, "rating")}
    curves, test_eq = density_compare(train3.where(F.col("rating").isin(4, 5)), "sum_sents",
                                      "rating")
    out["density_curves"], out["density_test"] = curves, test_eq
    feats = ["age", "age_div", "positive_feedback", "devision", "class", "department",
             "sum_sents", "sum_senta", "sum_sentb"]
    grid = grid if grid is not None else _grid(spark)
    cv = cross_validate(train3, "rating", feats, grid, rounds=rounds, k=5, patience=patience,
                        num_class=6, ordered=AGE_ORDER)
    model = fit_best(train3, "rating", feats, cv, num_class=6, ordered=AGE_ORDER)
    pred = predict_boosted(model, test, keep=["v1", "rating"])
    met = class_metrics(confusion(pred, "rating", "prediction", labels=[1, 2, 3, 4, 5]))
    out.update({"cv": cv, "boosted_metrics": met,
                "accuracy": hit_rate(pred, "rating", "prediction"),
                "f1": compare_f1(tree_met, met, "tree", "boosted")})
    return out


def stacked(spark: SparkSession, reviews: DataFrame, lx: Lexicons, net_rows: DataFrame,
            net_model, rounds: int = 5, grid: DataFrame | None = None, patience: int = 10) -> dict:
    """Flow C: the net's predicted class as column ``review_vector``, then
    tree, sentiment and boosted trees with that column; F1 side by side. The
    net's split travels with the rows, so that no row the net has learnt from
    is tested on later."""
    from reviewlab.operators.mlp import stack
    col = stack(net_rows.where("split = 'train'"), net_rows.where("split = 'test'"),
                net_model, "idx").select("v1", "review_vector", "split")
    df = cut_lineage(with_age_band(complete_rows(reviews.join(col, "v1"))))
    tree_met = _tree_part(df)
    sents = sentence_sentiment(df, lx.afinn, lx.negators, lx.amplifiers)
    s = cut_lineage(review_sentiment(df, lx.stop, lx.bing, lx.afinn, keys=KEYS10 + ["review_vector", "split"]).join(sents, "v1"))
    feats = ["recommended", "age", "age_div", "positive_feedback", "devision", "class",
             "department", "review_vector", "sum_senta", "sum_sentb", "sum_sents"]
    out = _boosted_part(spark, s, feats, rounds, grid, num_class=6, labels=[1, 2, 3, 4, 5], patience=patience)
    out["tree_metrics"], out["rows"] = tree_met, s
    out["f1"] = compare_f1(tree_met, out["boosted_metrics"], "tree", "boosted")
    return out
