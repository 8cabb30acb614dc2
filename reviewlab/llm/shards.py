"""Sharding by extendible hashing (operator 10), in DataFrame operations only.

Every row has a string of hash bits: 60 from the md5 of its key, then 60 from
a number of the row itself. The directory is a binary tree over those bits: a
bucket splits on its next bit only while its bytes exceed the limit, so a
shard is the shortest prefix whose rows fit. Rows of one key part only once
the bits of the key are used up (a key that alone exceeds the limit), by the
bits of the row; a single row over the limit is a shard of its own.

The tree is grown ``STEP`` bits at a time. One aggregation sums the bytes of
each STEP-bit slice within the buckets that are still too large, the sums of
all shorter prefixes follow from those few slices, and rows of buckets that
fit are done. So a round shuffles partial sums only, whatever the skew, and
there are as many rounds as the deepest shard needs. The rows themselves meet
the finished directory in one pass, with no copy of them made; only rows of keys
that alone exceed the limit are written, to fix their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewlab.llm.common import saved

#: bits read in a round
STEP = 10
#: bits of the key's hash, then of the row's
KEY_BITS = ROW_BITS = 60


def _bits(hex_digits: Column) -> Column:
    """60 bits as text of 15 hexadecimal digits."""
    return F.lpad(F.conv(hex_digits, 16, 2), 60, "0")


def hash_bits(key: Column) -> Column:
    """First 60 bits of the md5 of a key's text; a null key is the text ''."""
    return _bits(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15))


def _grown(sizes: DataFrame, depth: int, end: int, limit: int) -> tuple[list[tuple[int, DataFrame]], bool]:
    """Directory over the bits from ``depth`` to ``end`` of ``sizes`` (bits,
    size, n): tables (slice, shard, shard_bytes, shard_rows) with the length of
    their slices, and whether some bucket is still too large at the end."""
    found = []
    while depth < end:
        fine = sizes.groupBy(F.substring("bits", 1, depth + STEP).alias("slice")).agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        fine = saved(fine, "slices")
        lengths = F.array(*[F.lit(d) for d in range(depth, depth + STEP + 1)])
        prefix = fine.select("slice", "size", "n", F.explode(lengths).alias("d")).select("slice", "size", "n", F.expr("substring(slice, 1, d)").alias("shard"), "d")
        sums = prefix.groupBy("shard").agg(F.sum("size").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        # the shortest prefix that fits is the slice's bucket
        bucket = (prefix.select("slice", "shard", "d").join(fits, "shard")
                  .groupBy("slice").agg(F.min(F.struct("d", "shard", "shard_bytes", "shard_rows")).alias("b"))
                  .select("slice", "b.shard", "b.shard_bytes", "b.shard_rows"))
        bucket = saved(bucket, "directory")
        depth += STEP
        found.append((depth, bucket))
        if fine.count() == bucket.count():
            return found, False
        sizes = saved(sizes.withColumn("slice", F.substring("bits", 1, depth)).join(bucket.select("slice"), "slice", "left_anti")
                      .select("bits", "size", "n"), "rest")
    return found, True


def _placed(rows: DataFrame, tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (row, size, bits) with the bucket of each, null where there is none."""
    for i, (depth, bucket) in enumerate(tables):
        mine = bucket.select(F.col("slice").alias(f"s{i}"), F.struct("shard", "shard_bytes", "shard_rows").alias(f"b{i}"))
        rows = rows.join(mine, F.substring("bits", 1, depth) == F.col(f"s{i}"), "left")
    return rows.select("row", "size", "bits", F.coalesce(*[F.col(f"b{i}") for i in range(len(tables))]).alias("b"))


def extendible_shards(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``rows`` with shard (text of 0 and 1: the bucket's prefix), shard_bytes
    and shard_rows (of the whole shard). ``size`` is a row's bytes; null counts
    as 0. Clashing columns of those names are replaced. ``limit`` must be
    positive. No rows: no rows. ``rows`` are read twice, so they must be the
    same both times, as those of a table are.

    Every shard holds at most ``limit`` bytes, or is one row, or rows that
    share all 120 bits (never seen but for a row number hash of equal bits)."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    rows = rows.drop("shard", "shard_bytes", "shard_rows")
    rows = rows.select(F.struct(*rows.columns).alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), hash_bits(F.col(key)).alias("bits"))
    # one narrow row a key, whatever its rows; the rows themselves are not copied
    keys = saved(rows.groupBy("bits").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "keys")
    tables, more = _grown(keys, 0, KEY_BITS, limit)
    placed = _placed(rows, tables)
    out = lambda df: df.select("row.*", "b.shard", "b.shard_bytes", "b.shard_rows")
    done = out(placed.where("b is not null"))
    if not more:
        return done
    # keys that alone exceed the limit: their rows are written once, with numbers that can't change
    number = _bits(F.substring(F.md5(F.monotonically_increasing_id().cast("string").cast("binary")), 1, 15))
    big = saved(placed.where("b is null").select("row", "size", F.concat("bits", number).alias("bits")), "big")
    tables, more = _grown(big.select("bits", "size", F.lit(1).cast("long").alias("n")), KEY_BITS, KEY_BITS + ROW_BITS, limit)
    placed = _placed(big, tables)
    done = done.unionByName(out(placed.where("b is not null")))
    if not more:
        return done
    alike = placed.where("b is null").select("row", "size", "bits")
    rest = alike.groupBy("bits").agg(F.struct(F.first("bits").alias("shard"), F.sum("size").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")).alias("b"))
    return done.unionByName(out(alike.join(rest, "bits")))


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: shard, depth (its bits), shard_bytes, shard_rows."""
    return (sharded.groupBy("shard", "shard_bytes", "shard_rows").agg(F.length("shard").alias("depth"))
            .select("shard", "depth", "shard_bytes", "shard_rows"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows as Parquet, one folder shard=... a shard. A shard is
    written by one task (its bytes are bounded), a task writes many."""
    sharded.drop("shard_bytes", "shard_rows").repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows that ``write_shards`` wrote (``schema``: of the rows without their
    shard), with shard as text; the undivided shard is ''."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("shard", StringType())])).parquet(path)
    return rows.withColumn("shard", F.coalesce("shard", F.lit("")))


__all__ = ["extendible_shards", "directory", "write_shards", "read_shards", "hash_bits"]
