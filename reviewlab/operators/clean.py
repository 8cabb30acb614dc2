"""Table steps: renames, filters, casts, bands, codes, stacking.

All are projections or filters (narrow, no shuffle) except where noted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.ranges import numbered

from reviewlab.functions.columns import age_band, rating_band, to_number


def rename_all(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename every column by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def non_blank(df: DataFrame, col: str = "review_text") -> DataFrame:
    """Rows whose text is not empty (a null text goes too)."""
    return df.where(F.col(col) != "")


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with no null in ``cols`` (all columns when None). An empty
    string is not missing."""
    return df.dropna("any", subset=cols)


def with_age_band(df: DataFrame, age: str = "age", out: str = "age_div") -> DataFrame:
    return df.withColumn(out, age_band(age))


def with_rating_band(df: DataFrame, rating: str = "rating", out: str | None = None) -> DataFrame:
    return df.withColumn(out or rating, rating_band(rating))


def all_text(df: DataFrame) -> DataFrame:
    """Every column cast to string."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listed columns cast to double; text that is not a number gives null."""
    return df.select([to_number(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def category_codes(df: DataFrame, col: str, levels: list | None = None,
                   out: str | None = None) -> DataFrame:
    """0-based code of a category column.

    With ``levels`` (an ordered factor): the position in that list, null for
    a value not listed (a projection). Without: codes in ascending order of
    the distinct values, as R's ``factor`` does; the distinct values are an
    aggregation (at most one row per value per partition), numbered within
    range partitions and joined back.
    """
    out = out or f"{col}_code"
    if levels is not None:
        arr = F.array(*[F.lit(v) for v in levels])
        pos = F.array_position(arr, F.col(col))
        return df.withColumn(out, F.when(pos > 0, (pos - 1).cast("int")))
    return df.join(numbered(df, col, out), col, "left")


def class_pair(df: DataFrame, x, against=5, col: str = "rating") -> DataFrame:
    """Rows of class ``x`` or class ``against``."""
    return df.where(F.col(col).isin(x, against))


def score_window(df: DataFrame, ratings=(1, 2, 3, 4), below: float | None = 7,
                 rating: str = "rating", score: str = "sum_sent") -> DataFrame:
    """Rows with the rating in ``ratings`` and the score below ``below``."""
    cond = F.col(rating).isin(*ratings)
    if below is not None:
        cond = cond & (F.col(score) < below)
    return df.where(cond)


def attach(df: DataFrame, results: DataFrame, key: str = "v1") -> DataFrame:
    """Attach per-row results by key (never by row order)."""
    return df.join(results, key, "left")


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, duplicates kept, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def last_rows(df: DataFrame, order, n: int = 10) -> DataFrame:
    """The ``n`` rows last in ``order`` (a column name: largest first; or a
    list of sort columns). Planned as a top-k (per-partition heaps of n
    rows, merged), not a full sort."""
    cols = [F.desc(order)] if isinstance(order, str) else list(order)
    return df.orderBy(*cols).limit(n)
