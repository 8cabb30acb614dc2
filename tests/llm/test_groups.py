"""Components, SimHash and embedding groups against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.llm import embed_dedup, simhash
from reviewlab.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.brute import Sets
from tests.llm.brute import simhash as plain_print


def classes(pairs, nodes):
    sets = Sets(nodes)
    for a, b in pairs:
        sets.join(a, b)
    by = {}
    for n in nodes:
        by.setdefault(sets.root(n), set()).add(n)
    return {frozenset(x) for x in by.values()}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(400)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "none": []}[kind]
    pairs = pairs + pairs[:5] + ([(7, 7), (None, 3)] if pairs else [])
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    by = {}
    for r in got:
        by.setdefault(r["root"], set()).add(r["node"])
    assert {frozenset(x) for x in by.values()} == classes(real, {n for p in real for n in p})
    assert len(got) == len({r["node"] for r in got})


def plain_groups(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    nodes = sorted({p for _, p in prints})
    linked = [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4]
    low = {}
    for group in classes(linked, nodes):
        ids = [i for i, p in prints if p in group and i is not None]
        for p in group:
            low[p] = min(ids, default=None)
    return sorted(((i, f"{p:016x}", low[p]) for i, p in prints), key=str)


def test_fingerprint_is_plain():
    texts = ["", "  ", "One", "a b c", "a b c d", "A b\x0bC d E f g", "É é x y z", "w " * 5000, "x y " * 9000 + "end"]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 4) & (1 << 64) - 1 == plain_print(t), t[:20]


def test_groups_of_documents(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    for k in range(60):  # near copies of one text, and copies of one of them
        words = base.split()
        words[rng.randrange(len(words))] = f"edit{k}"
        rows += [(10_000 + k, " ".join(words))] * (1 + 5 * (k == 7))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (None, base), (None, "nothing like it at all here"), (20_003, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "n", "root", "seg", "key")})
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == plain_groups(rows)


def test_all_links_within_radius(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(12):  # chains and clusters of 1 to 6 bits
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                q ^= 1 << b
            prints.add(q)
            p = q if rng.random() < 0.4 else p
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p, 1) for p in signed], "fp long, n long")
    for max_bits, segments in ((4, 3), (4, 4), (3, 2), (1, 3)):
        roots = {r["node"]: r["root"] for r in components(simhash.near_links(fps, max_bits, segments)).collect()}
        by = {}
        for p in signed:
            by.setdefault(roots.get(p, p), set()).add(p)
        linked = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits]
        assert {frozenset(x) for x in by.values()} == classes(linked, signed)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "y"), (2, "a b c d e", "z"), (5, "other words stand in here", "x"), (5, "other words stand in here", "x"),
            (None, "a b c d e", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 5, None]


def test_no_documents(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ embeddings

def plain_links(rows, threshold=0.98):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = []
    for i, (_, v, label) in enumerate(rows):
        for j in range(i):
            w, other = rows[j][1:]
            if ok[i] and ok[j] and label == other and len(v) == len(w):
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links.append((i, j))
    return links


def plain_vectors(rows):
    links = plain_links(rows)
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    out = []
    for group in classes(links, range(len(rows))):
        low = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        out += [(rows[i][0], n[i], low, low is not None and rows[i][0] == low) for i in group]
    return sorted(out, key=str)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        base = rng.normal(size=24)
        for _ in range(15):
            rows.append(([float(x) for x in base * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.uniform(0, 0.25)], int(c % 3)))
    rows += [(rows[4][0], rows[4][1])] * 3 + [(rows[4][0], None), (None, 1), ([], 1), ([0.0] * 24, 1), ([float("nan")] + [1.0] * 23, 1),
             ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e30] * 24, 0), ([1e-30] * 24, 0)]
    return [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("tile", [2048, 4])  # the second makes many tiles and pivots
def test_embedding_groups(spark, tile):
    rows = vectors()
    rows += [(None, rows[4][1], rows[4][2]), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "n", "low", "cell")})
    got = sorted((tuple(r) for r in embed_dedup.embedding_groups(df, 0.98, tile).collect()), key=str)
    assert got == plain_vectors(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.embedding_groups(df).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for width in (1, 3, 64, 1500):
        x, n = embed_dedup.unit_rows(rng.normal(size=(40, width)) * rng.uniform(1e-3, 1e3, (40, 1)))
        q, s, length, error = embed_dedup.quantised(x, n)
        u = x / n[:, None]
        low = np.outer(s, s) * (q.astype(float) @ q.T.astype(float))
        bound = np.outer(length, error) + np.outer(error, length) + np.outer(error, error)
        assert (np.abs(u @ u.T - low) <= bound + 1e-12).all() and (np.abs(q) <= 127).all()


def test_same_links_as_full_precision():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 64)).astype(np.float32)
    x = np.concatenate([base + rng.normal(size=base.shape).astype(np.float32) * s for s in (0.1, 0.15, 0.2, 0.21)])
    i, j = embed_dedup.linked_pairs(x, x, 0.98)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(u @ u.T >= 0.98))))


def test_whole_table_matches_brute_force(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    from reviewlab.llm.queries import op6_simhash_dedup
    got = sorted((tuple(r) for r in op6_simhash_dedup(spark, SF_SMALL).collect()), key=str)
    assert got == plain_groups(rows)
