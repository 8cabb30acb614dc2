"""What jobs leave behind: shuffle files on disk, tables in Python workers."""

import gc
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewlab.llm import align, common, packing, toxicity


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_saved_steps_leave_no_shuffle_files(spark):
    """(finding 2) A step's shuffle goes with the step; the setting stays as it was."""
    before, setting = shuffle_files(spark), spark.conf.get(common._CLEANUP, None)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s"))
    out = common.saved(df, "sums")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(common._CLEANUP, None) == setting
    assert out.agg(F.sum("s")).first()[0] == 5000 * 4999 // 2 and df.count() == 700  # both can be read on


def test_rounds_give_the_features_of_one_pass(spark, monkeypatch):
    """(finding 2) Chunks go in rounds of about equal size; each row is scored once."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(70)}" for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["", None, "copy"]
    docs = spark.createDataFrame([*enumerate(texts), (152, "copy"), (152, "copy"), (None, "copy")], "doc_id long, text string")
    table, shared = toxicity.model(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int"))

    def found():
        return sorted(([-1 if r["doc_id"] is None else r["doc_id"], *r["x"]] for r in toxicity.features(docs, table, shared).collect()))

    sent = found()
    names = []
    monkeypatch.setattr(toxicity, "saved", lambda df, name: (names.append((name, df.count())), common.saved(df, name))[1])
    monkeypatch.setattr(toxicity, "SENT_ROWS", 0)
    monkeypatch.setattr(toxicity, "CHUNK", 256)
    monkeypatch.setattr(toxicity, "ROUNDS", 5)
    joined = found()
    rounds = [n for name, n in names if name == "features"]
    assert len(rounds) == 5 and sum(rounds) == len(sent) and max(rounds) < len(sent) / 2
    assert np.allclose(sent, joined)


def test_workers_keep_no_pieces_of_text(spark):
    """(finding 1) A Python worker outlives the task that packed; the pieces that
    it remembered don't."""
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(0, 50), i -> concat('piece', id * i)))").alias("text"))
    assert packing.token_ids(docs, common.tokenizer_file()).count() == 200
    packing.token_ids(docs, common.tokenizer_file()).write.format("noop").mode("overwrite").save()

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"encoders": [len(packing._encoders)], "pieces": [sum(map(len, packing._encoders.values()))]})

    rows = spark.range(64).repartition(8).mapInArrow(kept, "encoders long, pieces long").collect()
    assert any(r["encoders"] for r in rows)  # workers that have packed
    assert not any(r["pieces"] for r in rows)


def test_powers_are_little_more_than_asked_for(monkeypatch):
    """(finding 1) Every worker keeps them, 16 bytes each."""
    monkeypatch.setattr(common, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    p, inv = common.powers((1 << 21) + 1)
    assert (1 << 21) < len(p) == len(inv) <= (1 << 21) + (1 << 16)
    assert ((p * inv)[:1 << 21] == 1).all()


def test_alignment_of_a_chunk_takes_little_memory():
    """(finding 1) What a worker allocates for the chunks of 8 MB of text, beside
    the tokenizers and the parts it remembers."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(5500)]
    assert 6e6 < sum(map(len, texts)) < 9e6
    parts = align.Parts(align.Tokenizers(common.tokenizer_file(), common.piece_model()))
    align.Step(texts[:60], parts)
    gc.collect()
    tracemalloc.start()
    steps, rows, step, size, total = [], 0, [], 0, 0
    for t in texts:  # as ``aligned_chunks`` does
        step.append(t)
        size += len(t) + 1
        if size >= align.STEP:
            steps.append(align.Step(step, parts))
            total, step, size = total + size, [], 0
        if total >= align.CHUNK:
            rows += align._chunk_row(0, list(range(sum(len(s.sha) for s in steps))), steps).num_rows
            steps, total = [], 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and most < 60e6


def test_alignment_forgets_rare_parts_first():
    """(finding 1) A worker's table of parts is bounded; the parts that are met
    often stay, and those it keeps give the same links."""
    known, plain = (align.Parts(align.Tokenizers(common.tokenizer_file(), common.piece_model())) for _ in range(2))
    often = "the quick, (brown) fox"
    align.Step([often] * 5 + [" ".join(f"rare{i}" for i in range(200))], known)
    known.forget(4)
    assert set(known) == set(often.split(" "))
    a, b = (align.Step([often, "rare7 fox", often + " rare9"], p) for p in (known, plain))
    assert a.sha == b.sha and a.pairs.tolist() == b.pairs.tolist() and len(a.sha[0]) == 64
    for k in ("n_a", "n_b", "n_groups", "n_links", "text", "pair", "times"):
        assert getattr(a, k).tolist() == getattr(b, k).tolist()


def test_settings_of_a_saved_step_are_its_own(spark):
    """(finding 1) Rows go to Python a few megabytes at a time in that step alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    df = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text")).mapInArrow(sizes, "n long, size long")
    rows = common.saved(df, "sizes", {name: str(align.SENT)}).collect()
    assert sum(r["n"] for r in rows) == 400 and max(r["size"] for r in rows) < 2 * align.SENT
    assert spark.conf.get(name, None) == before
