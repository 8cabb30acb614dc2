"""Exact order statistics without gathering a column in one task.

Distinct values with their counts are dealt to range partitions and written;
sums per partition say which partition holds a rank, and only rows of those
few partitions are ordered."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.operators.util import cut_lineage


def ranged(values: DataFrame, *order: str) -> DataFrame:
    """``values`` in range partitions by ``order``, with the partition's
    number (``pid``, rising with the values), written once."""
    return cut_lineage(values.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()))


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Quantiles of numeric columns with linear interpolation between ranks
    (None for a column without values), as ``percentile`` gives them."""
    cols = list(probs)
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    counts = (df.selectExpr(f"stack({len(cols)}, {pairs}) as (c, v)").where("v is not null")
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    rows = ranged(counts, "c", "v")
    held: dict[str, list[tuple[int, int]]] = {c: [] for c in cols}
    for r in rows.groupBy("c", "pid").agg(F.sum("n").alias("n")).orderBy("pid").collect():   # a row a partition
        held[r["c"]].append((r["pid"], r["n"]))
    wanted = []
    for c in cols:
        total = sum(n for _, n in held[c])
        for p in probs[c] if total else []:
            h = p * (total - 1)
            for rank in {math.floor(h), math.ceil(h)}:
                before = 0
                for pid, n in held[c]:
                    if rank < before + n:
                        wanted.append((c, pid, rank, rank - before))
                        break
                    before += n
    found = {}
    if wanted:
        want = F.broadcast(df.sparkSession.createDataFrame(wanted, "c string, pid int, rank long, inside long"))
        few = rows.join(want.select("c", "pid").distinct(), ["c", "pid"])
        upto = few.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "pid").orderBy("v")))
        hit = upto.join(want, ["c", "pid"]).where("inside < upto and inside >= upto - n")
        found = {(r["c"], r["rank"]): r["v"] for r in hit.select("c", "rank", "v").collect()}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        total = sum(n for _, n in held[c])
        out[c] = []
        for p in probs[c]:
            h = p * (total - 1)
            a, b = (found.get((c, x)) for x in (math.floor(h), math.ceil(h)))
            out[c].append(None if not total else a + (h - math.floor(h)) * (b - a))
    return out


def numbered(values: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): the 0-based place of each distinct non-null value."""
    rows = ranged(values.select(col).where(F.col(col).isNotNull()).distinct(), col)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)   # over a row a partition
    offsets = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(col)) - 1
    return (rows.withColumn("k", place).join(F.broadcast(offsets), "pid")
            .select(col, (F.col("offset") + F.col("k")).cast("int").alias(out)))
