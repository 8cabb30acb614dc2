"""Carry the best CV row into the final boosted fit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewlab.operators.boost import BoostModel, BoostParams, fit_boosted
from reviewlab.operators.stats import best_row


def fit_best(df: DataFrame, label: str, features: list[str], cv: DataFrame,
             num_class: int | None = None, key: str = "v1", seed: int = 22,
             ordered: dict[str, list] | None = None) -> BoostModel:
    """Refit on all of ``df`` with the parameters and round count of the CV
    row with the lowest test loss (lowest paramsNum on a tie)."""
    b = best_row(cv, loss="bestCvrmse_test", tie="paramsNum").first()
    p = BoostParams(eta=b["eta"], max_depth=int(b["max_depth"]), subsample=b["subsample"],
                    colsample_bytree=b["colsample_bytree"])
    return fit_boosted(df, label, features, p, rounds=max(1, int(b["bestIteration"])),
                       key=key, num_class=num_class, seed=seed, ordered=ordered)
