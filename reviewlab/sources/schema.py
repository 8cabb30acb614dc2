"""Schema listing and column summaries (``names``/``str``/``summary``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.operators.ranges import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column: position (1-based), name, Spark type."""
    rows = [(i + 1, f.name, f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def summarise(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: min, quartiles, mean, max and missing count.

    One aggregation pass over the data (partial aggregates, no sort); the
    quartiles are exact, as in R's ``summary``, found through counts of range
    partitions. The wide result row is turned long with ``stack``.
    """
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    aggs, quartiles = [], exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    for c in cols:
        q1, median, q3 = (F.lit(q).cast("double") for q in quartiles[c])
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__min"),
                 F.first(q1).alias(f"{c}__q1"),
                 F.first(median).alias(f"{c}__median"),
                 F.avg(x).alias(f"{c}__mean"),
                 F.first(q3).alias(f"{c}__q3"),
                 F.max(x).alias(f"{c}__max"),
                 F.count_if(x.isNull()).alias(f"{c}__nulls")]
    wide = df.agg(*aggs)
    parts = ", ".join(
        f"'{c}', `{c}__min`, `{c}__q1`, `{c}__median`, `{c}__mean`, `{c}__q3`, "
        f"`{c}__max`, `{c}__nulls`" for c in cols)
    return wide.selectExpr(
        f"stack({len(cols)}, {parts}) as (`column`, min, q1, median, mean, q3, max, nulls)")


def level_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of each value of each listed column: (column, level, n).

    The columns are unpivoted per row (narrow), then one aggregation with
    map-side combine; the shuffle carries at most one row per distinct level
    per partition.
    """
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
    return (df.selectExpr(f"stack({len(cols)}, {pairs}) as (`column`, level)")
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n")))
