"""Small helpers shared by the operators: size-checked broadcast and
lineage cuts into the cluster's checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.session import ensure_checkpoint_dir

# A side is broadcast only when its measured size is at most this many bytes;
# beyond it the join is left to Spark (AQE picks by the sizes it sees).
BROADCAST_MAX_BYTES = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Rows' bytes, about: strings by length, other columns 8 bytes each. One
    aggregation over ``df``."""
    width = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for ``df`` only if its size is measured to be small."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df


def drop_files(spark, path: str) -> None:
    """Remove a folder of staged files from whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint) and return the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over all cores. Spark joins small partitions by
    their bytes; rows that take long each would then meet in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def small_list(df: DataFrame, col: str, max_rows: int = 10_000) -> list:
    """Collect one column of a small, size-checked frame to the driver."""
    rows = df.select(col).distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{col}: more than {max_rows} values; not a word list")
    return sorted(r[0] for r in rows if r[0] is not None)
