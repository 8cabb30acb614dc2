"""Class models of all labelled texts, looked up by either way."""

import random

import numpy as np
from pyspark.sql import functions as F

from reviewlab.llm import toxicity


def test_class_models_count_every_labelled_text(spark):
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' v '), 9000)").alias("text"))
    assert docs.agg(F.sum(F.length("text"))).first()[0] > 8 << 20
    table, _ = toxicity.model(docs, docs.select("doc_id", F.lit(0).alias("y")))
    assert table.where(F.size("v") == 2).agg(F.sum(F.col("v")[0])).first()[0] == 240 * 18000


def test_joined_features_are_those_of_the_sent_table(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randrange(1, 80))) for _ in range(80)] + ["", None, "only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table, shared = toxicity.model(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int"))

    def found():
        return {r["doc_id"]: r["x"] for r in toxicity.features(docs, table, shared).collect()}

    sent = found()
    monkeypatch.setattr(toxicity, "SENT_ROWS", 0)
    joined = found()
    assert sent.keys() == joined.keys() and len(sent) == len(texts)
    assert all(np.allclose(sent[k], joined[k]) for k in sent)


def test_lookups_go_packed_and_by_whole_keys(spark, monkeypatch):
    """A key asked for and its answer take a few bytes, no row each; first bits
    that many keys share give the same features."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 100_000).astype(np.uint64) << np.uint64(1))
    v = rng.integers(0, 3, (len(keys), 2)).astype(np.float32)
    row = toxicity._packed_rows(keys, v)
    got = toxicity._unpacked_rows(*row)
    assert (got[0] == keys).all() and (got[1] == v).all() and len(row[2]) + len(row[3]) < 8 * len(keys)
    first = np.unique(keys >> np.uint64(64 - 22))
    assert (toxicity._unpacked(toxicity._packed(first), len(first)) == first).all() and len(toxicity._packed(first)) < 1.5 * len(first)
    assert len(toxicity._unpacked(toxicity._packed(keys[:0]), 0)) == 0

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, id % 40), i -> concat('w', (i * id) % 60)))").alias("text"))
    table, shared = toxicity.model(docs, docs.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y")))
    sent = {r["doc_id"]: r["x"] for r in toxicity.features(docs, table, shared).collect()}
    monkeypatch.setattr(toxicity, "SENT_ROWS", 0)
    for spare in (5, -7):
        monkeypatch.setattr(toxicity, "SPARE_BITS", spare)
        joined = toxicity.features(docs, table, shared)
        # a chunk's questions and answers are rows of many keys
        assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        found = {r["doc_id"]: r["x"] for r in joined.collect()}
        assert found.keys() == sent.keys() and all(np.allclose(found[k], sent[k]) for k in sent)


def test_distinct_numbers_are_sorted_not_hashed():
    """(finding 1) Each chunk's questions are millions of hashes; to sort them takes
    a fraction of np.unique's time."""
    import time
    rng = np.random.default_rng(5)
    for x in (np.zeros(0, np.uint32), np.array([7], np.uint64), np.array([5, 1, 5, 2**64 - 1, 0, 1], np.uint64), rng.integers(0, 50, 999).astype(np.uint32)):
        assert toxicity.distinct(x).dtype == x.dtype and np.array_equal(toxicity.distinct(x), np.unique(x))

    def least(f, x):
        took = []
        for _ in range(3):
            began = time.process_time()
            f(x)
            took.append(time.process_time() - began)
        return min(took)

    many = rng.integers(0, 1 << 27, 1_000_000).astype(np.uint32)
    assert least(toxicity.distinct, many) < least(np.unique, many) / 2


def test_table_goes_to_python_as_columns(spark, monkeypatch):
    """(finding 1) No lists of numbers go through Spark's row by row writer, and
    each of the table's two kinds is read from its own files alone."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, id % 9), i -> concat('w', (i * id) % 20)))").alias("text"))
    table, shared = toxicity.model(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y")))
    seen, save = {}, toxicity.saved
    monkeypatch.setattr(toxicity, "saved", lambda df, name: (seen.setdefault(name, df), save(df, name))[1])
    monkeypatch.setattr(toxicity, "SENT_ROWS", 0)
    assert toxicity.features(docs, table, shared).count() == 60
    plan = seen["packed"]._jdf.queryExecution().executedPlan()
    sent = []

    def walk(node):
        if node.nodeName() == "MapInArrow":
            sent.append(node.child().schema().simpleString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(sent) == 2 and not any("array" in x for x in sent)
    assert plan.toString().count("FileScan") == 2


def test_bytes_are_words_as_before():
    """(finding 1) Letters, spaces and small letters by arithmetic, for all bytes."""
    from reviewlab.llm import common
    b = np.arange(256, dtype=np.uint8)
    letters = [chr(x).isalnum() if x < 128 else True for x in range(256)]
    assert common._is_letter(b).tolist() == letters
    assert common._is_space(b).tolist() == [x in (32, 9, 10, 11, 12, 13) for x in range(256)]
    assert common._lower(b).tolist() == [x + 32 if 65 <= x <= 90 else x for x in range(256)]
