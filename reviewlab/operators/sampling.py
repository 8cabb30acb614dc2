"""Reproducible sampling: exact-size splits, permutations, folds, shares.

Every draw is a hash of (seed, key), so results do not depend on
partitioning or task retries (a lost executor recomputes the same rows).

The exact split never sorts the data: rows are counted per hash prefix
(at most 4,096 counts reach the driver per level), whole prefixes below
the cut go to the first part, and only the one boundary prefix is ordered
to find a single threshold; the split is then a narrow comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 3            # hex digits per refinement level (4,096 buckets)
MAX_BOUNDARY_ROWS = 1_000_000


def draw_hash(key, seed, salt: str = "") -> Column:
    """md5 hex of 'seed-[salt-]key': uniform, deterministic draw per row."""
    k = F.col(key) if isinstance(key, str) else key
    number = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [number, F.lit("-")] + ([F.lit(salt), F.lit("-")] if salt else []) \
        + [k.cast("string")]
    return F.md5(F.concat(*parts))


def unit_draw(key, seed, salt: str = "") -> Column:
    """Uniform draw in [0, 1) from the first 8 hex digits of the hash."""
    h = draw_hash(key, seed, salt)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def _threshold(df: DataFrame, h: str, key: str, target: int):
    """(hash, key) of the row ranked ``target`` (1-based) by (hash, key)."""
    return _ranked(df.withColumn("__d", F.lit(0)), h, key, {0: target}).get(0)


def _ranked(rows: DataFrame, h: str, key: str, targets: dict[int, int]) -> dict:
    """For each draw d of ``targets`` the (hash, key) of the row ranked
    ``targets[d]`` among the rows with ``__d`` = d, all in the same jobs: a
    level of counts by hash prefix for the draws still open, then the rows of
    the boundary prefixes."""
    prefix, need, open_ = dict.fromkeys(targets, ""), dict(targets), set(targets)
    level = 0

    def inside(draws):
        out = F.lit(False)
        for d in sorted(draws):
            out = out | ((F.col("__d") == d) & F.col(h).startswith(prefix[d]))
        return rows.where(out)

    while open_ and level < 32:
        level += PREFIX_DIGITS
        found = {}
        for r in inside(open_).groupBy("__d", F.substring(h, 1, level).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r["__d"], []).append((r["p"], r["n"]))
        for d in sorted(open_):
            before = 0
            for p, n in sorted(found.get(d, [])):
                if before + n >= need[d]:
                    prefix[d], need[d] = p, need[d] - before
                    if n <= MAX_BOUNDARY_ROWS:
                        open_.discard(d)
                    break
                before += n
            else:
                open_.discard(d)
                need.pop(d)
    w = Window.partitionBy("__d").orderBy(h, key)
    at = F.create_map(*[F.lit(x) for d in need for x in (d, need[d])]) if need else None
    if at is None:
        return {}
    last = inside(need).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == F.element_at(at, F.col("__d")))
    return {r["__d"]: (r[h], r[key]) for r in last.select("__d", h, key).collect()}


def thresholds(df: DataFrame, key: str, targets: dict[int, int]) -> dict[int, tuple]:
    """For each seed of ``targets`` the (draw, key) up to which the rows of
    ``split_exact`` with that seed and ``n = targets[seed]`` go; seeds that
    want no rows are left out."""
    targets = {s: n for s, n in targets.items() if n > 0}
    if not targets:
        return {}
    rows = df.select(key, F.explode(F.array(*[F.lit(s) for s in targets])).alias("__d"))
    return _ranked(rows.withColumn("__h", draw_hash(F.col(key), F.col("__d"))), "__h", key, targets)


def split_exact(df: DataFrame, key: str = "v1", share: float | None = 0.8,
                n: int | None = None, seed: int = 22, out: str = "split",
                first: str = "train", second: str = "test") -> DataFrame:
    """Add ``out``: exactly ceiling(share * N) rows (or ``n`` rows) are
    ``first``, chosen without replacement; the rest are ``second``.

    Same rows as ordering all rows by md5('seed-key') (then key) and taking
    the first ones. ``key`` must be unique.
    """
    h = "__h"
    hashed = df.withColumn(h, draw_hash(key, seed))
    total = hashed.count()
    target = n if n is not None else math.ceil(share * total - 1e-9)
    target = max(0, min(int(target), total))
    if target == 0:
        return df.withColumn(out, F.lit(second))
    if target == total:
        return df.withColumn(out, F.lit(first))
    th, tk = _threshold(hashed, h, key, target)
    inside = (F.col(h) < th) | ((F.col(h) == th) & (F.col(key) <= F.lit(tk)))
    return hashed.withColumn(out, F.when(inside, first).otherwise(second)).drop(h)


def global_rank(df: DataFrame, order: Column, key: str, out: str = "rank") -> DataFrame:
    """1-based rank of each row by (order, key), with no single-partition
    step: rows are grouped by a hash-prefix of ``order`` (a hex string),
    ranked inside each prefix by a window partitioned on it, and offset by
    the counts of the smaller prefixes (prefix-count table: at most 16^L
    rows, L chosen so that a prefix holds about a million rows or fewer).
    """
    o = "__o"
    d = df.withColumn(o, order)
    total = d.count()
    digits = max(PREFIX_DIGITS, math.ceil(math.log(max(total, 1) / MAX_BOUNDARY_ROWS, 16)))
    d = d.withColumn("__p", F.substring(o, 1, digits))
    counts = d.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn(
        "__off", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    ).select("__p", F.coalesce("__off", F.lit(0)).alias("__off"))
    ranked = d.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(o, key)))
    return (ranked.join(F.broadcast(offsets), "__p")
            .withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint"))
            .drop("__p", "__off", "__r", o))


def shuffled(df: DataFrame, key: str, col: str, seed: int = 22,
             out: str | None = None) -> DataFrame:
    """Permute the values of ``col`` over the rows (each row gets the value
    of the row that holds the same rank under a second hash)."""
    out = out or f"{col}_shuffled"
    a = global_rank(df, draw_hash(key, seed, "a"), key, "__ra")
    b = global_rank(df.select(key, col), draw_hash(key, seed, "b"), key, "__rb") \
        .select(F.col("__rb").alias("__ra"), F.col(col).alias(out))
    return a.join(b, "__ra").drop("__ra")


def folds(df: DataFrame, key: str = "v1", k: int = 5, seed: int = 22,
          out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 from the hash of (seed, key): narrow, stable."""
    h = F.conv(F.substring(draw_hash(key, seed, "fold"), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))


def row_share(df: DataFrame, key: str, share: float, round_no: int,
              seed: int = 22) -> DataFrame:
    """Rows kept in one boosting round (row subsampling), drawn per round."""
    return df.where(unit_draw(key, seed, f"row{round_no}") < share)


def column_share(names: list[str], share: float, tree_no: int, seed: int = 22) -> list[str]:
    """ceiling(share * m) feature names, the smallest by md5('seed-col<t>-name')."""
    import hashlib

    m = math.ceil(share * len(names) - 1e-9)
    ranked = sorted(names, key=lambda c: (hashlib.md5(f"{seed}-col{tree_no}-{c}".encode())
                                          .hexdigest(), c))
    return sorted(ranked[:m], key=names.index)
