"""CSV scan of the review table (one operator for both R readers).

Quoted fields may span lines, so a file can't be cut at any line end. It is
still read by many tasks: lines are scanned in byte splits, a first pass counts
the quotes of each split, and the parity of all quotes before a split says
whether it starts inside a quoted field. A second pass joins the lines of each
record at true record ends. What a split holds of a record that begins or ends
elsewhere (at most its first and last piece) is joined across splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.operators.util import bounded_broadcast, cut_lineage

# Column names by position, as the workload renames them.
REVIEW_COLUMNS = [
    "v1", "clothing_id", "age", "title", "review_text", "rating",
    "recommended", "positive_feedback", "devision", "department", "class",
]

REVIEW_SCHEMA = T.StructType([
    T.StructField("v1", T.LongType()),
    T.StructField("clothing_id", T.IntegerType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("recommended", T.IntegerType()),
    T.StructField("positive_feedback", T.IntegerType()),
    T.StructField("devision", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("class", T.StringType()),
])

#: bytes of a record; a longer one is an error (most likely a quote is missing)
MAX_RECORD_BYTES = 64 << 20

_PIECES = "file string, split long, n long, kind string, text string"


def _pieces(most: int):
    """Lines of splits, in order, to records (kind ``record``) and pieces: the
    end of a record begun before (``end``), a split that lies all within one
    (``inside``), the start of one that goes on (``start``). A record of more
    than ``most`` bytes is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, held, size, inside, begun_before, n = None, [], 0, False, False, 0

        def put(kind: str) -> None:
            nonlocal held, size, n
            text = "\n".join(held)
            held, size = [], 0
            if kind != "record" or text.strip():      # blank lines are no records
                out.append((*at, n, kind, text))
                n += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                              ["file", "split", "n", "kind", "text"])
            out.clear()
            return made

        for b in batches:
            for file, split, odd, line in zip(*(b.column(c).to_pylist() for c in ("file", "split", "odd", "value"))):
                if (file, split) != at:
                    if held:
                        put("inside" if begun_before else "start")
                    at, inside, begun_before, n = (file, split), bool(odd), bool(odd), 0
                held.append(line)
                size += len(line)
                if size > most:
                    raise ValueError(f"{file}: a record of more than {most} bytes near byte {split}; is a quote missing?")
                if line.count('"') % 2:
                    inside = not inside
                if not inside:
                    put("end" if begun_before else "record")
                    begun_before = False
            if len(out) > 10_000:
                yield batch()
        if held:
            put("inside" if begun_before else "start")
        if out:
            yield batch()

    return run


def read_records(spark: SparkSession, path: str, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """(file, split, n, text): the records of CSV file(s) as text, quoted line
    ends included, without the files' header records. Files are cut into byte
    splits as Spark cuts text files (compressed ones aren't cut).

    Quotes must be doubled inside quoted fields, and fields that aren't quoted
    must hold an even number of them."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "split").agg(F.sum(quotes).alias("q"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)   # a row a split
    odd = cut_lineage(counts.select(F.col("file").alias("f"), F.col("split").alias("s"),
                                    (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int").alias("odd")))
    # only splits that start inside a field are met; the join keeps the lines in
    # order where it is broadcast, and beyond that size they are sorted again
    starts = odd.where("odd = 1")
    small = bounded_broadcast(starts)
    on = (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))
    numbered = lines.withColumn("row", F.monotonically_increasing_id())
    met = numbered.join(small, on, "left").select("file", "split", "row", F.coalesce("odd", F.lit(0)).alias("odd"), "value")
    if small is starts:
        met = met.repartition("file", "split").sortWithinPartitions("file", "split", "row")
    pieces = cut_lineage(met.drop("row").mapInArrow(_pieces(max_bytes), _PIECES))
    parts = pieces.where("kind <> 'record'")
    number = F.sum((F.col("kind") == "start").cast("int")).over(Window.partitionBy("file").orderBy("split", "n"))   # at most two rows a split
    joined = (parts.withColumn("number", number).groupBy("file", "number")
              .agg(F.sort_array(F.collect_list(F.struct("split", "n", "text"))).alias("x"))
              .select("file", F.col("x")[0]["split"].alias("split"), F.col("x")[0]["n"].alias("n"), F.concat_ws("\n", "x.text").alias("text")))
    records = pieces.where("kind = 'record'").select("file", "split", "n", "text").unionByName(joined)
    return records.where("not (split = 0 and n = 0)").withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_reviews(spark: SparkSession, path: str,
                 schema: T.StructType | None = None,
                 na_text: str | None = "NA", bad_record: str | None = None) -> DataFrame:
    """Read review CSV file(s) with a header line.

    Columns are taken by position (the header's first name is blank in the
    source file) and renamed; the schema is explicit, so no inference pass.
    Quoted fields may span lines; large files are read by many tasks (see
    ``read_records``). As in R, a blank text field stays an empty string and
    the literal ``na_text`` marks a missing value. ``bad_record`` names a
    column for the text of records with too few or too many fields (null for
    the others), whose columns are filled as far as they go.
    """
    schema = schema or REVIEW_SCHEMA
    # Read text columns as strings first; types are applied after NA handling.
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("__bad", T.StringType())])
    options = {"quote": '"', "escape": '"', "emptyValue": "", "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "__bad"}
    df = read_records(spark, path).select(F.from_csv("text", F.lit(raw.toDDL()), options).alias("r")).select("r.*")
    cols = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            # an empty field is text, not missing
            c = F.coalesce(c, F.lit(""))
        if na_text is not None:
            c = F.when(c == na_text, F.lit(None)).otherwise(c)
        if isinstance(f.dataType, T.StringType):
            cols.append(c.alias(f.name))
        else:
            cols.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*cols, *([F.col("__bad").alias(bad_record)] if bad_record else []))
