"""Flow C carries the net's split; flow A's table is the score window."""

import numpy as np
from pyspark.sql import functions as F

from reviewlab.operators.boost import param_grid
from reviewlab.operators.mlp import MLPModel, _init
from reviewlab.plans.flows import stacked
from reviewlab.plans.q_models import WIDTH, _net_inputs
from reviewlab.sources.fixtures import lexicons, reviews
from tests.conftest import SF_SMALL


def test_no_row_of_the_net_is_tested_on_later(spark):
    rows = _net_inputs(spark, SF_SMALL)
    model = MLPModel(WIDTH, (16, 16), 5, _init(WIDTH, (16, 16), 5, 1), [])
    grid = param_grid(spark, eta=[0.3], max_depth=[1], subsample=[1.0], colsample_bytree=[1.0])
    out = stacked(spark, reviews(spark, SF_SMALL), lexicons(spark, SF_SMALL), rows, model, rounds=1, grid=grid)
    split = {r["v1"]: r["split"] for r in rows.select("v1", "split").collect()}
    later = out["rows"].select("v1", "split", "review_vector", "sum_sents").collect()
    assert len(later) > 20 and {r["split"] for r in later} == {"train", "test"}
    assert all(r["split"] == split[r["v1"]] and 1 <= r["review_vector"] <= 5 for r in later)
    assert np.isfinite([r["sum_sents"] for r in later]).all()
    m = out["boosted_metrics"].agg(F.sum("actual")).first()[0]
    assert m == sum(r["split"] == "test" for r in later)
