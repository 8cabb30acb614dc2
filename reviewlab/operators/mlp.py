"""A small dense network on multi-hot word vectors, trained as Spark jobs.

Architecture (the workload's): ``width`` inputs -> 16 ReLU -> 16 ReLU ->
``classes`` softmax; cross-entropy; RMSprop (lr 0.001, rho 0.9, eps 1e-7);
Glorot-uniform weights, zero biases.

Training is data parallel. Each step: the weights go out as a broadcast
variable; ``mapInPandas`` runs forward and backward passes on each
partition's rows of the step (a hash draw of the key picks the step)
and emits gradient sums as rows of 16 parameters, once a partition: only
the first-layer rows of words that occur are emitted, so the output is sparse.
Rows are written once, partitioned by step, so a step reads only its own. A
``groupBy`` sums them (partial aggregation; the result is bounded by the
model size, not the data), the driver applies RMSprop. The input is never
densified: a row is its list of word positions.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.functions.columns import argmax
from reviewlab.operators.sampling import draw_hash, folds
from reviewlab.operators.util import drop_files
from reviewlab.session import ensure_checkpoint_dir


#: least probability in a loss
MIN_PROB = 1e-7


def evaluate(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Cross-entropy loss and accuracy of class probabilities against a
    0-based label: avg(-log p[label]), avg(argmax == label). One row. A
    probability counts as at least ``MIN_PROB``, so a row with p = 0 stays."""
    p = F.element_at(F.col(prob), F.col(label) + 1)
    return df.agg(F.avg(-F.log(F.greatest(p, F.lit(MIN_PROB)))).alias("loss"),
                  F.avg((argmax(prob) - 1 == F.col(label)).cast("double")).alias("accuracy"))


@dataclass
class MLPModel:
    width: int
    hidden: tuple
    classes: int
    weights: list           # [W1, b1, W2, b2, W3, b3] as numpy arrays
    history: list           # (epoch, loss, accuracy, val_loss, val_accuracy)


def _init(width, hidden, classes, seed):
    rng = np.random.default_rng(seed)
    sizes = [width, *hidden, classes]
    ws = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / (a + b))
        ws += [rng.uniform(-lim, lim, size=(a, b)), np.zeros(b)]
    return ws


def md5_weights(width: int, hidden=(16, 16), classes: int = 5, seed: int = 22) -> list:
    """Weights and biases that any engine can draw again: parameter (i, j) of
    layer l (1, 2, 3; a bias has i = -1) is the Glorot limit times 2u - 1, with
    u the first 8 hexadecimal digits of md5('seed-l-i-j') over 2^32."""
    sizes = [width, *hidden, classes]
    ws = []
    for layer, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]), 1):
        u = np.array([int(hashlib.md5(f"{seed}-{layer}-{i}-{j}".encode()).hexdigest()[:8], 16)
                      for i in range(-1, a) for j in range(b)]).reshape(a + 1, b) / 2.0 ** 32
        drawn = np.sqrt(6.0 / (a + b)) * (2 * u - 1)
        ws += [drawn[1:], drawn[0]]
    return ws


def _positions(idx) -> tuple[np.ndarray, np.ndarray]:
    """(all positions, how many of each row) of a list of rows' word positions,
    or of an Arrow column of lists."""
    if hasattr(idx, "flatten"):
        import pyarrow.compute as pc
        return np.asarray(idx.flatten()).astype(np.int64), pc.fill_null(pc.list_value_length(idx), 0).to_numpy().astype(np.int64)
    lens = np.fromiter((len(x) for x in idx), dtype=np.int64, count=len(idx))
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in idx]) if lens.sum() else np.zeros(0, dtype=np.int64)
    return flat, lens


def _forward(ws, idx):
    W1, b1, W2, b2, W3, b3 = ws
    flat, lens = _positions(idx)
    n = len(lens)
    owner = np.repeat(np.arange(n), lens)
    z1 = np.tile(b1, (n, 1))
    some = np.flatnonzero(lens)
    if len(some):
        # a column of weights at a time: sums over runs of one array are fast
        begin = (np.cumsum(lens) - lens)[some]
        for j in range(W1.shape[1]):
            z1[some, j] += np.add.reduceat(np.ascontiguousarray(W1[:, j])[flat], begin)
    h1 = np.maximum(z1, 0)
    z2 = h1 @ W2 + b2
    h2 = np.maximum(z2, 0)
    z3 = h2 @ W3 + b3
    z3 = z3 - z3.max(axis=1, keepdims=True)
    p = np.exp(z3)
    p /= p.sum(axis=1, keepdims=True)
    return flat, owner, h1, h2, p


#: values of the gradient vector in a row, so that few rows are summed
LANES = 16
GRAD_SCHEMA = "block long, " + ", ".join(f"g{i} double" for i in range(LANES))


def gradient(ws, idx, y, into: np.ndarray | None = None) -> np.ndarray:
    """Summed gradient of the cross-entropy over rows, all parameters in one
    vector, with the number of rows as last value; added to ``into`` if given."""
    W1, b1, W2, b2, W3, b3 = ws
    flat, owner, h1, h2, p = _forward(ws, idx)
    n = len(y)
    d3 = p.copy()
    d3[np.arange(n), y] -= 1.0
    d2 = (d3 @ W3.T) * (h2 > 0)
    d1 = (d2 @ W2.T) * (h1 > 0)
    out = np.zeros(sum(w.size for w in ws) + 1) if into is None else into
    if len(flat):
        first = out[:W1.size].reshape(W1.shape)
        for j in range(W1.shape[1]):
            first[:, j] += np.bincount(flat, np.ascontiguousarray(d1[:, j])[owner], W1.shape[0])
    rest = [d1.sum(axis=0), h1.T @ d2, d2.sum(axis=0), h2.T @ d3, d3.sum(axis=0), np.array([float(n)])]
    out[W1.size:] += np.concatenate([g.ravel() for g in rest])
    return out


def _grad_fn(bc, idx_col, label_col):
    def run(batches):
        import pandas as pd
        total = None
        for pdf in batches:
            if len(pdf):
                total = gradient(bc.value, list(pdf[idx_col]), pdf[label_col].to_numpy().astype(np.int64), total)
        if total is not None:
            # one emission a task: blocks of parameters that some row touched
            blocks = np.pad(total, (0, -len(total) % LANES)).reshape(-1, LANES)
            at = np.flatnonzero(blocks.any(axis=1))
            yield pd.DataFrame({"block": at.astype(np.int64)} | {f"g{i}": blocks[at, i] for i in range(LANES)})
    return run


def summed_gradient(df: DataFrame, ws: list, idx: str, label: str) -> np.ndarray:
    """``gradient`` over all rows of ``df``: summed per parameter in Spark, so
    at most the model's size comes back."""
    bc = df.sparkSession.sparkContext.broadcast(ws)
    g = (df.select(idx, label).mapInPandas(_grad_fn(bc, idx, label), T.StructType.fromDDL(GRAD_SCHEMA))
         .groupBy("block").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(LANES)]).toPandas())
    bc.unpersist()
    n = sum(w.size for w in ws) + 1
    total = np.zeros((-(-n // LANES), LANES))
    total[g["block"].to_numpy(dtype=np.int64)] = g.iloc[:, 1:].to_numpy(dtype=float)
    return total.ravel()[:n]


def _score_fn(bc, idx_col, keep, classes):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            p = _forward(bc.value, b.column(idx_col))[-1] if b.num_rows else np.zeros((0, classes))
            prob = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * classes, pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], prob], [*keep, "prob"])
    return run


def fit_mlp(df: DataFrame, idx: str, label: str, width: int, key: str = "v1",
            hidden=(16, 16), classes: int = 5, epochs: int = 10,
            steps_per_epoch: int = 34, validation: DataFrame | None = None,
            lr: float = 0.001, rho: float = 0.9, eps: float = 1e-7, seed: int = 22) -> MLPModel:
    """Train on ``df`` (``idx``: array of 0-based word positions < width;
    ``label``: 0-based class).

    An epoch has ``steps_per_epoch`` steps whatever the number of rows (34 is
    what batches of 512 make of the workload's 17,113 rows), so the number of
    jobs doesn't grow with the data: a step's rows do. Rows are dealt to steps
    by a hash of the key and written once, partitioned by step; each epoch
    visits the steps in an order of its own. The files are removed at the end."""
    spark = df.sparkSession
    steps = steps_per_epoch
    h = F.conv(F.substring(draw_hash(F.col(key), seed, "step"), 1, 8), 16, 10).cast("bigint")
    run_dir = os.path.join(ensure_checkpoint_dir(spark), f"mlp-{uuid.uuid4().hex}")
    (df.select(key, idx, label).withColumn("__step", F.pmod(h, F.lit(steps)).cast("int"))
     .write.partitionBy("__step").parquet(run_dir))
    data = spark.read.parquet(run_dir)
    ws = _init(width, hidden, classes, seed)
    acc = [np.zeros_like(w) for w in ws]
    sizes = [w.size for w in ws]
    offsets = np.cumsum([0] + sizes)
    history = []
    for epoch in range(1, epochs + 1):
        order = np.random.default_rng([seed, epoch]).permutation(steps).tolist()
        for step in order:
            total = summed_gradient(data.where(F.col("__step") == step), ws, idx, label)
            m = total[offsets[-1]]
            if m == 0:
                continue
            for i, w in enumerate(ws):
                grad = total[offsets[i]:offsets[i + 1]].reshape(w.shape) / m
                acc[i] = rho * acc[i] + (1 - rho) * grad * grad
                ws[i] = w - lr * grad / (np.sqrt(acc[i]) + eps)
        model = MLPModel(width, tuple(hidden), classes, ws, history)
        tr = _loss_acc(model, data, idx, label, key)
        va = _loss_acc(model, validation, idx, label, key) if validation is not None else (None, None)
        history.append((epoch, tr[0], tr[1], va[0], va[1]))
    drop_files(spark, run_dir)
    return MLPModel(width, tuple(hidden), classes, ws, history)


def _loss_acc(model: MLPModel, df: DataFrame, idx: str, label: str, key: str):
    p = predict_mlp(model, df.select(key, idx, label), idx, keep=[key, label])
    r = evaluate(p, "prob", label).first()
    return r["loss"], r["accuracy"]


def predict_mlp(model: MLPModel, df: DataFrame, idx: str, keep: list[str] | None = None) -> DataFrame:
    """Class probabilities (``prob``, array of classes) for each row, scored
    batch-wise with the weights broadcast; add ``argmax(prob)`` for the
    1-based predicted position."""
    keep = keep or [c for c in df.columns if c != idx]
    bc = df.sparkSession.sparkContext.broadcast(model.weights)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("prob", T.ArrayType(T.DoubleType()))])
    return df.select(*keep, *([idx] if idx not in keep else [])) \
        .mapInArrow(_score_fn(bc, idx, keep, model.classes), schema)


def history_frame(spark, model: MLPModel) -> DataFrame:
    return spark.createDataFrame(
        model.history, "epoch int, loss double, accuracy double, val_loss double, val_accuracy double")


def stack(train: DataFrame, test: DataFrame, model: MLPModel, idx: str, key: str = "v1",
          name: str = "review_vector", out_of_fold: bool = False, refit=None, k: int = 5,
          seed: int = 22) -> DataFrame:
    """The net's predicted class (1-based, as the rating) attached as a
    column to the training and the test rows, stacked with a ``split``
    column.

    The net scores its own training rows, as in the workload; with
    ``out_of_fold`` each of ``k`` folds of the training rows is scored by a net
    that ``refit(rows)`` has trained on the others, so that the column is as
    honest on training rows as on test rows."""
    parts = [(test, model, "test")]
    if out_of_fold:
        dealt = folds(train, key, k, seed, out="__fold")
        for i in range(k):
            rest = dealt.where(F.col("__fold") != i).drop("__fold")
            parts.append((dealt.where(F.col("__fold") == i), refit(rest), "train"))
    else:
        parts.append((train, model, "train"))
    scored = [predict_mlp(m, part.select(key, idx), idx, keep=[key])
              .select(key, argmax("prob").alias(name), F.lit(tag).alias("split")) for part, m, tag in parts]
    return reduce(DataFrame.unionByName, scored)
