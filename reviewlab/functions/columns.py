"""Row-level column expressions used by the operators.

All are built-in Spark expressions, so they stay inside whole-stage codegen
and are pushed through Catalyst like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The age bands of the review workload, as (low, high, label),
# low inclusive, high exclusive. Ages below 18 or from 1000 up match no band
# and stay null; a missing age is 'Unknown'.
AGE_BANDS = [
    (18, 30, "18 ~ 29"),
    (30, 40, "30 ~ 39"),
    (40, 50, "40 ~ 49"),
    (50, 60, "50 ~ 59"),
    (60, 70, "60 ~ 69"),
    (70, 80, "70 ~ 79"),
    (80, 90, "80 ~ 89"),
    (90, 1000, "90 ~ 99"),
]
AGE_UNKNOWN = "Unknown"

# Word pattern: runs of letters/digits, with inner apostrophes kept
# ("don't" is one word). Java regex syntax (the same text works in RE2).
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_band(age) -> Column:
    """Age to its band label; no ``otherwise``: out-of-range ages give null."""
    a = _col(age)
    expr = None
    for lo, hi, label in AGE_BANDS:
        cond = (a >= lo) & (a < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.when(a.isNull(), AGE_UNKNOWN)


def rating_band(rating) -> Column:
    """Rating to three bands: 4 and up -> 3, 3 -> 2, any other value -> 1."""
    r = _col(rating)
    return (F.when(r >= 4, F.lit(3)).when(r == 3, F.lit(2))
            .when(r.isNotNull(), F.lit(1)))


def shift_label(label, by: int = -1) -> Column:
    return _col(label) + F.lit(by)


def to_number(c) -> Column:
    """Text (or anything) to double; text that is not a number gives null."""
    return _col(c).cast("string").try_cast("double")


def polarity_sign(sentiment) -> Column:
    """'positive' -> 1, anything else -> -1."""
    return F.when(_col(sentiment) == "positive", F.lit(1)).otherwise(F.lit(-1))


def hit(pred, label) -> Column:
    """1 when the prediction equals the label, else 0 (null when either is)."""
    return (_col(pred) == _col(label)).cast("int")


def one_hot(label, k: int) -> Column:
    """0-based label to an array of k doubles with a single 1.0."""
    lab = _col(label)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: (i == lab).cast("double"))


def argmax(arr) -> Column:
    """1-based position of the largest element; the first one on a tie."""
    a = _col(arr)
    return F.array_position(a, F.array_max(a)).cast("int")


def hex_hash(c, start: int) -> Column:
    """Integer value of the 8 hex digits of md5(c) from position ``start``."""
    return F.conv(F.substring(F.md5(_col(c).cast("string")), start, 8), 16, 10) \
        .cast("bigint")
