import csv
import os
import random
import tempfile

import pytest

from reviewlab.sources import describe_schema, read_reviews, summarise
from reviewlab.sources.csv import REVIEW_SCHEMA, read_records
from pyspark.sql import types as T

CSV = ',Clothing ID,Age,Title,Review Text,Rating\n' \
      '0,767,33,,"multi\nline ""quoted"" text",4\n' \
      '1,1080,34,"","",5\n' \
      '2,1077,,Some,NA,3\n'


def test_csv_scan(spark):
    d = tempfile.mkdtemp(prefix="reviewlab-csv-")
    path = os.path.join(d, "reviews.csv")
    with open(path, "w") as f:
        f.write(CSV)
    schema = T.StructType(REVIEW_SCHEMA.fields[:6])
    rows = {r["v1"]: r for r in read_reviews(spark, path, schema).collect()}
    assert len(rows) == 3
    assert rows[0]["review_text"] == 'multi\nline "quoted" text'
    assert rows[0]["title"] == ""          # unquoted empty text stays text
    assert rows[1]["title"] == "" and rows[1]["review_text"] == ""
    assert rows[2]["age"] is None          # empty number is missing
    assert rows[2]["review_text"] is None  # NA is missing
    assert rows[0]["clothing_id"] == 767 and rows[1]["rating"] == 5


def whole_file_scan(spark, path, schema):
    """The same file as one task reads it, by Spark's own quoted scan."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = (spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"')
          .option("emptyValue", "").schema(raw).csv(path))
    return sorted([tuple((x or "") if f.name in ("title", "review_text", "devision", "department", "class") else x for f, x in zip(schema, r))
                   for r in df.collect()], key=str)


@pytest.mark.parametrize("split_bytes, end", [(150, "\n"), (900, "\n"), (5000, "\r\n"), (1 << 20, "\n")])
def test_split_csv_is_the_whole_scan(spark, split_bytes, end):
    rng = random.Random(split_bytes)
    words = ['plain', 'a,b', 'two\nlines', '"quoted"', 'é日', '', 'three\n\nlines "', "it's", 'end\n', '\nstart', 'long ' * 30]

    def field(x):
        return '"' + x.replace('"', '""') + '"' if x == "" or any(c in x for c in ',"\n') else x

    d = tempfile.mkdtemp(prefix="reviewlab-csv-")
    for k in range(3):
        with open(os.path.join(d, f"r{k}.csv"), "w", newline="") as f:
            f.write(',"Clothing\nID",Age,Title,Review Text,Rating' + end)
            for i in range(120):
                row = [str(1000 * k + i), str(i % 9), "", field(rng.choice(words)), field(" ".join(rng.choices(words, k=3))), str(i % 5)]
                f.write(",".join(row) + end)
                if i % 40 == 39:
                    f.write(end)
    schema = T.StructType(REVIEW_SCHEMA.fields[:6])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = read_reviews(spark, d, schema, na_text=None)
        assert split_bytes > 5000 or read_records(spark, d).select("split").distinct().count() > 1
        rows = [tuple(None if x is None else str(x) if not isinstance(x, str) else x for x in r) for r in got.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 360
    if end == "\n":
        assert sorted(rows, key=str) == whole_file_scan(spark, d, schema)
    else:   # that scan keeps the carriage return in the last field
        want = []
        for name in os.listdir(d):
            with open(os.path.join(d, name), newline="") as f:
                want += [tuple(x or (None if i in (0, 1, 2, 5) else "") for i, x in enumerate(r)) for r in list(csv.reader(f))[1:] if r]
        assert sorted(rows, key=str) == sorted(want, key=str)


def test_bad_records_and_odd_files(spark):
    d = tempfile.mkdtemp(prefix="reviewlab-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("x,y,z\n1,2,few\n1,2,3,4,5,6,7,many\n5,6,7,t,r,4\n")
    schema = T.StructType(REVIEW_SCHEMA.fields[:6])
    bad = {r["v1"]: r["bad"] for r in read_reviews(spark, d, schema, bad_record="bad").orderBy("rating").collect() if r["bad"] is None or "few" in r["bad"]}
    assert bad == {1: "1,2,few", 5: None}
    empty = os.path.join(tempfile.mkdtemp(prefix="reviewlab-csv-"), "e.csv")
    open(empty, "w").close()
    assert read_reviews(spark, empty, schema).count() == 0
    open_quote = os.path.join(tempfile.mkdtemp(prefix="reviewlab-csv-"), "q.csv")
    with open(open_quote, "w") as f:
        f.write('h\n1,"never closed\n' + "x\n" * 100)
    with pytest.raises(Exception, match="is a quote missing"):
        read_records(spark, open_quote, max_bytes=50).count()


def test_describe_schema(spark):
    df = spark.createDataFrame([(1, "a")], "v1 bigint, title string")
    got = [tuple(r) for r in describe_schema(df).collect()]
    assert got == [(1, "v1", "bigint"), (2, "title", "string")]


def test_summarise_quartiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    r = summarise(df).first()
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"], r["nulls"]) == (1, 2, 3, 4, 100, 1)
    assert r["mean"] == 22.0
