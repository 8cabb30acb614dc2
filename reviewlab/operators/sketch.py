"""Weighted quantile sketch: cut points of numeric columns in one pass.

A summary is a sorted list of values with weights, in which a value carries
the weight of itself and of the values dropped just below it, so the weight up
to a kept value is exact when it is made. Summaries merge by sorting them
together; one of more than ``size`` points is pruned to the last value of each
of ``size`` equal shares of the weight (a value that holds a share by itself
stays alone). A prune moves ranks by at most 1/size of the weight below, and a
value passes at most as many prunes as the summary tree has levels: one for
each batch row of a task folded in pairs, then those of the merges between
tasks.

Tasks summarise their rows and send ``size`` points a column; groups of
``FAN`` summaries are merged until one is left, so no task meets more than
``FAN`` of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.util import cut_lineage

#: summaries that one task merges
FAN = 32
#: points of a summary for each cut point asked for
POINTS = 32


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Summary of all points of ``parts`` (value, weight), equal values as one."""
    v, w = (np.concatenate(x) for x in zip(*parts))
    v, at = np.unique(v, return_inverse=True)
    return v, np.bincount(at, w, len(v))


def prune(v: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``2 * size`` points: the last value of each share of the weight,
    and values that hold a share or more by themselves."""
    if len(v) <= size:
        return v, w
    upto = np.cumsum(w)
    share = upto[-1] / size
    # a point ends its share if the next one starts another, or is heavy
    cell = np.floor((upto - w / 2) / share)
    heavy = w >= share
    last = np.append(cell[1:] != cell[:-1], True) | heavy | np.append(heavy[1:], False)
    return v[last], np.diff(upto[last], prepend=0.0)


class Folded:
    """Summaries folded in pairs of equal rank, like a binary counter."""

    def __init__(self, size: int) -> None:
        self.size, self.ranks = size, []

    def add(self, v: np.ndarray, w: np.ndarray) -> None:
        part, at = prune(*merge([(v, w)]), self.size), 0
        while at < len(self.ranks) and self.ranks[at] is not None:
            part, self.ranks[at] = prune(*merge([self.ranks[at], part]), self.size), None
            at += 1
        if at == len(self.ranks):
            self.ranks.append(None)
        self.ranks[at] = part

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [p for p in self.ranks if p is not None]
        return prune(*merge(parts), self.size) if parts else (np.zeros(0), np.zeros(0))


def summaries(df: DataFrame, cols: list[str], size: int, weight: Column | None = None) -> DataFrame:
    """(col, v, w): one summary of each column's non-null, non-NaN values,
    weighted by ``weight`` (1 without; rows of weight null or 0 don't count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Folded(size) for _ in cols]
        for b in batches:
            w = np.nan_to_num(b.column("__w").to_numpy(zero_copy_only=False).astype(float))
            for c, f in zip(cols, found):
                v = b.column(c).to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(v) & (w > 0)
                if ok.any():
                    f.add(v[ok], w[ok])
        part = TaskContext.get().partitionId()
        for i, f in enumerate(found):
            v, w = f.result()
            if len(v):
                yield batch(i, part, v, w)

    def batch(i: int, part: int, v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int64()), pa.array([v], pa.list_(pa.float64())),
                                           pa.array([w], pa.list_(pa.float64()))], ["col", "part", "v", "w"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [(np.asarray(v.values), np.asarray(w.values)) for v, w in zip(table.column("v"), table.column("w"))]
        return pa.Table.from_batches([batch(table.column("col")[0].as_py(), table.column("at")[0].as_py(), *prune(*merge(parts), size))])

    schema = "col int, part long, v array<double>, w array<double>"
    w = F.lit(1.0) if weight is None else weight.cast("double")
    parts = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols], w.alias("__w")).mapInArrow(run, schema))
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        parts = parts.withColumn("at", F.floor(F.col("part") / FAN).cast("long")).groupBy("col", "at").applyInArrow(meet, schema)
        n = -(-n // FAN)
    return parts.select("col", "v", "w")


def cut_points(df: DataFrame, cols: list[str], bins: int, weight: Column | None = None, points: int = POINTS) -> dict[str, list[float]]:
    """At most ``bins`` - 1 rising cut points of each column, about equal
    weights apart: a value x lies in the bin of the cut points below it.

    A column of at most ``bins`` values is cut at each value but the last. The
    cut points (a bounded table) come to the driver."""
    size = points * bins
    out: dict[str, list[float]] = {c: [] for c in cols}
    for r in summaries(df, cols, size, weight).collect():
        v, w = np.array(r["v"]), np.array(r["w"])
        if len(v) <= bins:
            out[cols[r["col"]]] = v[:-1].tolist()
            continue
        upto = np.cumsum(w)
        at = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)
        out[cols[r["col"]]] = sorted({float(v[i]) for i in at if i < len(v) - 1})
    return out
