"""Classifiers by held-out rows, archives by round trip, and the pipeline."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlab.llm import arc, quality, toxicity
from reviewlab.llm.queries import CUT, op1_quality, op3_toxicity, op4_warc
from tests.conftest import SF_SMALL

SF = "/root/testdata/sf0.01"


def right(spark, scores, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= CUT) for r in rows)
    good, bad = [r["score"] for r in rows if r["y"]], [r["score"] for r in rows if not r["y"]]
    return sum(a > b for a in good for b in bad) / (len(good) * len(bad)), sum(r["predicted"] == r["y"] for r in rows) / len(rows)


def test_quality_of_held_out_documents(spark):
    scores = op1_quality(spark, SF)
    assert scores.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    order, hits = right(spark, scores, "quality")
    assert order > 0.97 and hits > 0.88


def test_toxicity_of_held_out_documents(spark):
    order, hits = right(spark, op3_toxicity(spark, SF), "toxic")
    assert order > 0.85 and hits > 0.88


def corpus(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "se", "to", "mi") for c in ("n", "l", "", "s")]
    rows, labels = [], []
    for i in range(500):
        t = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        toxic, junk = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(4):
                t[rng.randrange(len(t))] = rng.choice(["wretch", "vermin", "fool"])
        if junk:
            t = [f"{w.upper()}!!" for w in t[:6]] * 12
        rows.append((i, " ".join(t).capitalize() + ".", "x", 1, 2))
        labels.append((i, int(not junk), int(toxic and not junk)))
    rows += [(900, None, "x", 1, 2), (901, "", "x", 1, 2), (None, "baran dosel", "x", 1, 2), (3, rows[3][1], "x", 1, 2), (902, "kimi " * 30_000, "x", 1, 2)]
    labels += [(None, 1, 1), (3, None, None), (901, 2, None), (7, 1, 0), (5555, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string, y int, x int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("of, label", [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_scores_of_odd_rows(spark, of, label):
    docs, labels = corpus(spark)
    learn = F.col("doc_id") % 2 == 0
    rows = of(docs, labels, learn).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] is not None)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows) and len(rows) == docs.count()
    y = {r["doc_id"]: r[label] for r in labels.where("doc_id % 2 = 1 and doc_id < 500").dropna().collect()}
    hits = [(r["score"] >= 0.7) == y[r["doc_id"]] for r in rows if r["doc_id"] in y]
    assert sum(hits) / len(hits) > 0.95
    # the order of rows and other documents' labels in the held-out part change nothing
    other = labels.where("doc_id % 2 = 0")
    again = {r["doc_id"]: r["score"] for r in of(docs.orderBy(F.desc("doc_id")), other, learn).collect()}
    assert max(abs(again[r["doc_id"]] - r["score"]) for r in rows) < 1e-6
    assert of(docs.limit(0), labels, learn).count() == 0
    assert {r["score"] for r in of(docs, labels.limit(0), learn).collect()} <= {0.5}


def test_two_words_are_an_expression(spark):
    """Words that both classes use alike, and that only toxic texts put side by side, some twelve times in all."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu") for b in ("ra", "se", "to", "mi", "na")]
    rows, labels = [], []
    for i in range(240):
        t = [rng.choice(words) for _ in range(40)]
        t.insert(5, "left"), t.insert(20, "right")
        if i % 10 == 0:
            t[5:6], t[21:22] = ["left", "right"], []
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 10 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, known, F.col("doc_id") % 4 != 2).collect()}
    held = [(scores[i], y) for i, y in labels if i % 4 == 2]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)


def test_one_text_a_hundred_thousand_times(spark):
    """Copies of one text, labelled or not, are scored each, alike, and shuffled nowhere; the models stay within their bound."""
    docs, labels = corpus(spark)
    copies = spark.range(100_000).selectExpr("id + 10000 as doc_id", "'kiran lusel baran domin and the wretch of vermin' as text")
    known = copies.where("doc_id % 3 = 0").selectExpr("doc_id", "1 as toxic").unionByName(labels.select("doc_id", "toxic"))
    both = docs.select("doc_id", "text").unionByName(copies)
    got = toxicity.toxicity_scores(both, known, F.col("doc_id") % 2 == 0)
    assert got.count() == both.count()
    same = got.where("doc_id >= 10000").select("score").distinct().collect()
    assert len(same) == 1 and same[0]["score"] > 0.7
    chosen = known.where("toxic is not null and doc_id is not null").selectExpr("doc_id", "toxic as y")
    texts = toxicity.bounded_texts(both, chosen, 200_000).groupBy("y").agg(F.sum(F.octet_length("text")).alias("n"))
    assert all(r["n"] < 220_000 for r in texts.collect())
    table, shared = toxicity.model(both, chosen.limit(50))
    plan = toxicity.features(both, table, shared)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ratios_are_kneser_ney(spark):
    import math
    from collections import Counter

    import pyarrow as pa
    from reviewlab.llm.common import word_chunks
    rng = random.Random(13)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["", "only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table, shared = toxicity.model(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, y int"))
    answers = toxicity.answers_of(table, shared)
    corpus = Counter(w for t in texts for w in t.split())
    take = lambda n, d: (min(n, d) if isinstance(d, float) else (0, *d)[min(n, 3)])
    grams = [Counter((a, b) for i in range(c, 30, 2) for a, b in zip(["^"] + texts[i].split(), texts[i].split())) for c in (0, 1)]
    d = [toxicity.discounts(tuple(sum(n == k for n in g.values()) for k in (1, 2, 3, 4))) for g in grams]
    assert d == [list(map(tuple, shared.bigram[0]))[c] for c in (0, 1)] and all(0 < x[0] < 1 for x in d)

    def p(c, i, h, w):
        before = Counter(b for _, b in grams[c])
        D, E = shared.bigram[i][c], shared.word[i][c]
        n = sum(before.values())
        word = (before[w] - take(before[w], E)) / n + sum(take(x, E) for x in before.values()) / n * (corpus[w] + 1) / (sum(corpus.values()) + len(corpus))
        after = {b: x for (a, b), x in grams[c].items() if a == h}
        m = sum(after.values())
        return ((after.get(w, 0) - take(after.get(w, 0), D)) / m if m else 0) + (sum(take(x, D) for x in after.values()) / m if m else 1) * word

    for t in (texts[0], texts[1], texts[40], texts[61]):
        w = next(iter(word_chunks(pa.array([t]), letters_only=True)))
        for i, r in enumerate(answers.log_ratios(w.hash, w.bounds)):
            want = [math.log(p(1, i, a, b) / p(0, i, a, b)) for a, b in zip(["^"] + t.split(), t.split())]
            assert r == pytest.approx(want, abs=1e-6)


def test_prior_and_features():
    import numpy as np
    import pyarrow as pa
    from reviewlab.llm.common import word_chunks
    texts = ["", None, "One. Two! THREE | 4\n", "a a a a", "ß" * 9]
    x = np.concatenate([quality.text_features(w) for w in word_chunks(pa.array(texts, pa.string()))])
    assert x.shape == (5, quality.FEATURES) and np.isfinite(x).all() and (x[0] == x[1]).all()


def test_unlabelled_risk_finds_the_prior(spark):
    """Two clouds, positives from one; the share above a half is the prior."""
    import numpy as np
    rng = np.random.default_rng(9)
    d = quality.FEATURES
    x = rng.normal(size=(2000, d)) * 0.3
    x[:1400, 0] += 3
    u = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>")
    p = rng.normal(size=(300, d)) * 0.3
    p[:, 0] += 3
    w, mean, scale = quality.fit_nnpu(u, p, 0.7)
    g = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) @ w
    assert ((g > 0) == (np.arange(2000) < 1400)).mean() > 0.99


def clouds(spark, share):
    import numpy as np
    rng = np.random.default_rng(int(share * 10))
    d, n = quality.FEATURES, 3000
    good = rng.random(n) < share
    x = rng.normal(size=(n, d)) * 0.5
    x[good, :2] += 1.5
    p = rng.normal(size=(600, d)) * 0.5
    p[:, :2] += 1.5
    u = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>").repartition(3).cache()
    return x, p, u


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_without_labelled_negatives(spark, share):
    """The share of positives among unlabelled rows, from rows alone."""
    _, p, u = clouds(spark, share)
    assert abs(quality.class_prior(u, p) - share) < 0.08


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_fit_against_plain_descent(spark, share):
    import numpy as np
    x, p, u = clouds(spark, share)
    n, d = x.shape
    w, mean, scale = quality.fit_nnpu(u, p, share)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0) + 1e-3)
    z, zp = quality._design(x, mean, scale), quality._design(p, mean, scale)
    penalty = np.append(np.full(d, quality.RIDGE), 0)

    def risk(v):
        negative = np.logaddexp(0, z @ v).mean() - share * np.logaddexp(0, zp @ v).mean()
        return share * np.logaddexp(0, -zp @ v).mean() + max(0, negative) + 0.5 * (penalty * v ** 2).sum()

    plain, sigmoid = np.zeros(d + 1), lambda g: 1 / (1 + np.exp(-g))
    for _ in range(4000):  # the estimator as written, on all rows at once
        g, gp = z @ plain, zp @ plain
        inner = z.T @ sigmoid(g) / n - share * zp.T @ sigmoid(gp) / len(p)
        if np.logaddexp(0, g).mean() < share * np.logaddexp(0, gp).mean():
            plain += 0.05 * inner
        else:
            plain -= 0.2 * (inner - share * zp.T @ sigmoid(-gp) / len(p) + penalty * plain)
    assert risk(w) <= 1.05 * risk(plain)
    assert ((z @ w > 0) == (z @ plain > 0)).mean() > 0.98


# ----------------------------------------------------------------- archives

def plain_pages(rows):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        t = top.get(b)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if t is not None and t != i else "response", t if t != i else None))
    return sorted(out, key=str)


def test_pages_come_back(spark, tmp_path):
    big = "<html>é WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n" + "x" * 2000
    rows = [(1, "http://a/ b\n", big), (2, "http://b", big), (9, None, big), (3, "http://c", "y" * 999), (4, "http://d", "y" * 999), (5, "http://e", "z" * 1000),
            (6, "http://e", "z" * 1000), (7, "", None), (8, "http://f", ""), (9, "http://g", big), (None, "http://h", big), (10, "http://i", "\r\n\r\n"),
            (11, "http://j", "w" * 5_000_000), (None, "http://k", "v" * 1500), (None, "http://k", "v" * 1500), (2**40, "http://l", "€" * 400), (-5, "http://m", "€" * 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumns({c: F.lit(1) for c in ("key", "sha1", "part")})
    back = arc.pages_to_warc(df, str(tmp_path / "w"))
    assert sorted((tuple(r)[:5] for r in back.collect()), key=str) == plain_pages(rows)
    empty = arc.pages_to_warc(df.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0


def test_pages_of_the_table(spark, duck):
    rows = duck.execute("select page_id, url, html from pages").fetchall()
    assert sorted((tuple(r) for r in op4_warc(spark, SF_SMALL).collect()), key=str) == plain_pages(rows)


V1 = (b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\n" + arc._NAMES[1].encode() + b"\n"
      b"\nhttp://a/x y 1.2.3.4 19960923142104 text/html 5\nhe\nlo"
      b"\nhttp://b/ 1.2.3.5 1996 text/html 30\nHTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n")


def test_arc_by_declared_length():
    head = b"1 0 Alexa Internet\n" + arc._NAMES[1].encode() + b"\n"
    v1 = V1.replace(b"plain 76", b"plain %d" % len(head))
    got = list(arc.parse_arc(v1))
    assert [(v, f[0], f[2], b, cut) for _, v, f, b, cut in got] == [
        (1, "http://a/x y", "19960923142104", b"he\nlo", False), (1, "http://b/", "1996", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n", False)]
    assert [x[1:] for x in arc.parse_arc(gzip.compress(v1[:100]) + gzip.compress(v1[100:]))] == [x[1:] for x in got]
    cut = list(arc.parse_arc(v1[:-3]))
    assert cut[-1][4] and cut[-1][3].endswith(b"bo")
    assert list(arc.parse_arc(b"")) == [] and list(arc.parse_arc(b"no header")) == []
    head2 = b"2 0 x\n" + arc._NAMES[2].encode() + b"\n"
    v2 = b"filedesc://n 0.0.0.0 2001 text/plain %d\n" % len(head2) + head2 + b"\nhttp://c 1.1.1.1 20010203040506 text/html 404 - - 99 n 3\nabc\n"
    assert [(v, f[4], b) for _, v, f, b, _ in arc.parse_arc(v2)] == [(2, "404", b"abc")]


def test_warc_fields(spark, tmp_path):
    head = b"1 0 Alexa Internet\n" + arc._NAMES[1].encode() + b"\n"
    files = spark.createDataFrame([("old.arc", bytearray(V1.replace(b"plain 76", b"plain %d" % len(head)))), ("empty", bytearray()), (None, None)], "archive string, content binary")
    typed = arc.with_types(arc.arc_records(files))
    rows = sorted(typed.collect(), key=lambda r: r["url"])
    record = arc.warc_record(rows[1].asDict(recursive=True))
    (fields, block), = arc.parse_warc(record + b"\r\n\r\n")
    assert fields["warc-date"] == "1996-01-01T00:00:00Z" and fields["warc-type"] == "response" and fields["warc-record-id"].startswith("<urn:uuid:")
    assert fields["content-type"] == "application/http; msgtype=response" and block.endswith(b"body\n")
    arc.write_warc(typed, str(tmp_path / "w"))
    back = sorted(arc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: r["url"])
    assert [(r["url"], r["payload_bytes"], r["page_id"]) for r in back] == [("http://a/x y", 5, None), ("http://b/", 5, None)]


# ----------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = start = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = corpus_pipeline.saved(out, "test")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    texts = {r["doc_id"]: r["text"] for r in start.select("doc_id", "text").collect()}
    order = [texts, *kept.values()]
    for before, after in zip(order, order[1:]):
        assert after.keys() < before.keys() and all(before[i] == t for i, t in after.items())
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1 and i in kept["toxicity"]]
    assert sum(i in kept["quality"] for i in good) / len(good) > 0.9
    assert len(set(kept["near_duplicates"].values())) == len(kept["near_duplicates"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(kept["decontamination"])


def test_stages_keep_rows_they_cannot_name(spark):
    docs = spark.createDataFrame([(None, "w x y z v"), (None, None), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs, SF_SMALL).where("doc_id is null").count() == 2
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF_SMALL).where("doc_id is null").count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
