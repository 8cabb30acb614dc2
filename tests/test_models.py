"""Learners against brute force on small hand-made frames."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlab.operators.balance import nearest_neighbours, smote
from reviewlab.operators.boost import (
    BoostParams, _best_splits, cross_validate, fit_boosted, importance,
    param_grid, predict_boosted,
)
from reviewlab.operators.mlp import _forward, _grad_fn, _init, evaluate, fit_mlp, predict_mlp
from reviewlab.operators.tree import fit_tree, predict_tree, prune, tree_nodes


def test_prune_collapses_weak_branch():
    # root 100 rows (60/40); left child pure-ish, right child split gains 1 error
    nodes = [
        {"id": 0, "leftChild": 1, "rightChild": 2, "impurityStats": [60.0, 40.0]},
        {"id": 1, "leftChild": -1, "rightChild": -1, "impurityStats": [50.0, 5.0]},
        {"id": 2, "leftChild": 3, "rightChild": 4, "impurityStats": [10.0, 35.0]},
        {"id": 3, "leftChild": -1, "rightChild": -1, "impurityStats": [9.0, 30.0]},
        {"id": 4, "leftChild": -1, "rightChild": -1, "impurityStats": [1.0, 5.0]},
    ]
    # node 2: err 10 as a leaf, 9 + 1 = 10 as a subtree -> alpha 0 -> collapsed
    out = {n["id"]: n for n in prune([dict(n) for n in nodes], cp=0.001)}
    assert out[2]["pruned_leaf"] and not out[3]["kept"] and out[1]["pruned_leaf"]
    # with cp = 0 a zero-gain split still goes (alpha <= 0), root split stays
    out = {n["id"]: n for n in prune([dict(n) for n in nodes], cp=0.0)}
    assert out[0]["kept"] and not out[0]["pruned_leaf"]
    # a huge cp collapses everything to the root
    out = {n["id"]: n for n in prune([dict(n) for n in nodes], cp=10.0)}
    assert out[0]["pruned_leaf"]


def test_tree_fits_a_clean_rule(spark):
    rows = [(i, "a" if i % 2 else "b", i % 3, 1 if i % 2 else 2) for i in range(120)]
    df = spark.createDataFrame(rows, "v1 long, cat string, noise int, y int")
    m = fit_tree(df, "y", ["cat", "noise"], cp=0.01, min_instances=2)
    p = predict_tree(m, df, keep=["v1", "y"])
    assert p.where("y != prediction").count() == 0
    nodes = tree_nodes(m, spark).collect()
    assert sum(1 for n in nodes if n["leaf"]) == 2
    assert nodes[0]["n"] == 120


def _plain_tree(rows, is_cat, cp, min_bucket, min_split):
    """CART on lists of (values, class): dict way -> (counts, split, surrogates, majority); values None are missing."""
    K = max(y for _, y in rows) + 1

    def counts(part):
        return [sum(1 for _, y in part if y == k) for k in range(K)]

    def gini(c):
        return sum(c) - sum(v * v for v in c) / sum(c) if sum(c) else 0.0

    def candidates(f, part):
        values = sorted({x[f] for x, _ in part if x[f] is not None})
        if is_cat[f]:
            for m in range((1 << max(0, len(values) - 1)) - 1):
                yield {v for j, v in enumerate(values) if j == 0 or m >> (j - 1) & 1}, set(values)
        else:
            for v in values[:-1]:
                yield v, None

    def side(split, x):
        f, cut, known = split[:3]
        if x[f] is None or (known is not None and x[f] not in known):
            return None
        left = x[f] in cut if known is not None else (x[f] <= cut) != (len(split) > 3)
        return "L" if left else "R"

    def surrogates(part, split):
        part = [(x, side(split, x)) for x, _ in part if side(split, x)]
        whole = {d: sum(1 for _, w in part if w == d) for d in "LR"}
        major = "R" if whole["R"] > whole["L"] else "L"
        found = []
        for f in range(len(is_cat)):
            if f == split[0]:
                continue
            values = sorted({x[f] for x, _ in part if x[f] is not None})
            if is_cat[f]:
                to = {v: [sum(1 for x, w in part if x[f] == v and w == d) for d in "LR"] for v in values}
                tries = [(f, {v for v in values if to[v][0] > to[v][1]}, set(values))]
            else:
                tries = [t for v in values[:-1] for t in ((f, v, None), (f, v, None, "turned"))]
            best = None
            for t in tries:
                ways = [(side(t, x), w) for x, w in part]
                agree = sum(1 for a, w in ways if (a or major) == w)
                bare = sum(1 for a, w in ways if a == w)
                if best is None or bare > best[0]:
                    best = bare, agree, t, min(sum(1 for a, _ in ways if a == d) for d in "LR")
            if best and best[1] > max(whole.values()) and best[3] >= 2:
                found.append((-best[1], f, best[2]))
        return [t for _, _, t in sorted(found, key=lambda t: t[:2])[:5]], major

    def way(node, x):
        for split in [node[1], *node[2]]:
            if side(split, x):
                return side(split, x)
        return node[3]

    root = counts(rows)
    limit, out, todo = cp * (sum(root) - max(root)), {}, [("", rows)]
    while todo:
        name, part = todo.pop()
        c = counts(part)
        best = None
        if sum(c) >= min_split and sum(c) - max(c) > limit:
            for f in range(len(is_cat)):
                known = [(x, y) for x, y in part if x[f] is not None]
                for cut, values in candidates(f, part):
                    a = [(x, y) for x, y in known if side((f, cut, values), x) == "L"]
                    b = [(x, y) for x, y in known if side((f, cut, values), x) == "R"]
                    if min(len(a), len(b)) < min_bucket:
                        continue
                    gain = round(gini(counts(known)) - gini(counts(a)) - gini(counts(b)), 6)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, (f, cut, values)
        if best is None:
            out[name] = (c, None, [], None)
            continue
        others, major = surrogates(part, best[1])
        out[name] = node = (c, best[1], others, major)
        for d in "LR":
            todo.append((name + d, [(x, y) for x, y in part if way(node, x) == d]))

    def leaf(x):
        name = ""
        while out[name][1]:
            name += way(out[name], x)
        return name
    return out, leaf


def test_tree_is_the_plain_one(spark):
    """Same nodes, and the same leaf for rows with missing and unknown values."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, g = int(rng.integers(0, 9)), "pqrst"[rng.integers(0, 5)]
        h = {"p": "u", "q": "u"}.get(g, "v") if rng.random() < 0.9 else "w"
        b = a + float(rng.integers(0, 3))
        y = (a > 4) + (g in "pr") if rng.random() < 0.85 else int(rng.integers(0, 3))
        drop = lambda v, p: None if rng.random() < p else v
        rows.append((i, drop(a, 0.15), drop(g, 0.15), drop(h, 0.1), drop(b, 0.1), int(y)))
    schema = "v1 long, a int, g string, h string, b double, y int"
    df = spark.createDataFrame(rows, schema)
    m = fit_tree(df, "y", ["a", "g", "h", "b"], cp=0.001)
    plain, leaf = _plain_tree([(r[1:5], r[5]) for r in rows], [False, True, True, False], 0.001, 7, 20)
    names = {0: ""}
    for n in m.nodes:
        if n["leftChild"] >= 0:
            names[n["leftChild"]], names[n["rightChild"]] = names[n["id"]] + "L", names[n["id"]] + "R"
    assert {names[n["id"]]: n["impurityStats"] for n in m.nodes} == {k: v[0] for k, v in plain.items()}
    assert any(v[2] for v in plain.values())  # some node has surrogates
    by_name = {names[n["id"]]: n for n in m.nodes}

    def expected(x):
        name = leaf(x)
        while not by_name[name]["kept"]:
            name = name[:-1]
        return int(m.labels[by_name[name]["cls"]])

    odd = [(1000 + i, *x, 0) for i, x in enumerate([(None, None, None, None), (3, "new", "u", None), (None, "p", "zz", 2.5),
                                                    (99, None, None, -7.0), (None, None, "v", 6.0), (4, "t", None, None)])]
    got = {r["v1"]: r["prediction"] for r in predict_tree(m, spark.createDataFrame(rows + odd, schema)).collect()}
    assert got == {r[0]: expected(r[1:5]) for r in rows + odd}


def test_tree_grows_as_deep_as_it_pays(spark):
    """Blocks of alternating classes, each half as long again as the one
    before: every split peels one off."""
    rows, x = [], 0
    for b in range(18):
        rows += [(x + i, b, b % 2) for i in range(int(10 * 1.35 ** b))]
        x = len(rows)
    df = spark.createDataFrame(rows, "v1 long, x int, y int")
    m = fit_tree(df, "y", ["x"], cp=0.0005)
    assert max(n["depth"] for n in m.nodes) > 12
    assert predict_tree(m, df).where("y != prediction").count() == 0
    assert sum(n["pruned_leaf"] for n in m.nodes) == 18
    with pytest.raises(ValueError):
        fit_tree(df, "y", ["x"], cp=0.0)
    one = fit_tree(df.where("y = 1"), "y", ["x"])  # one class: the root alone
    assert len(one.nodes) == 1 and predict_tree(one, df).where("prediction != 1").count() == 0


def test_nearest_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 6, size=(60, 3)).astype(float)   # many ties and duplicates
    pts[:15] = pts[0]                                         # a hot value
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)],
                               "v1 long, a double, b double, c double")
    got = {(r["v1"], r["rank"]): (r["nb_key"], r["dist"])
           for r in nearest_neighbours(df, "v1", ["a", "b", "c"], k=5).collect()}
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    x = (pts - lo) / np.where(hi - lo == 0, 1, hi - lo)
    for i in range(len(pts)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((round(d[j], 9), j) for j in range(len(pts)) if j != i)[:5]
        for r, (dist, j) in enumerate(order, start=1):
            assert got[(i, r)][0] == j
            assert abs(got[(i, r)][1] - dist) < 1e-9


@pytest.mark.parametrize("n_cats, penalty, k, cells", [(3, 1.0, 5, 2000), (3, 0.02, 4, 10), (0, 1.0, 3, 2000)])
def test_mixed_neighbours_match_brute_force(spark, monkeypatch, n_cats, penalty, k, cells):
    import reviewlab.operators.balance as bal
    monkeypatch.setattr(bal, "MAX_CELL_POINTS", cells)
    rng = np.random.default_rng(n_cats * 10 + k)
    n = 90
    group = rng.integers(0, 2, n)
    pts = rng.integers(0, 8, size=(n, 2)).astype(float)       # ties
    cats = [[["a", "b", "c", None][i] for i in rng.choice(4, 3, p=[0.7, 0.2, 0.05, 0.05])] for _ in range(n)]
    for i in range(20):                                          # a hot point
        pts[i], cats[i], group[i] = pts[0], cats[0], 0
    cats[30], group[30] = ["z", "z", "z"], 1                     # alone in its combination
    names = ["c1", "c2", "c3"][:n_cats]
    df = spark.createDataFrame([(i, int(group[i]), *map(float, pts[i]), *cats[i]) for i in range(n)],
                               "v1 long, g int, a double, b double, c1 string, c2 string, c3 string")
    got = {(r["v1"], r["rank"]): (r["nb_key"], r["dist"])
           for r in bal.nearest_neighbours(df, "v1", ["a", "b"], k=k, by="g", categorical=names, penalty=penalty).collect()}
    for g in (0, 1):
        at = np.flatnonzero(group == g)
        lo, hi = pts[at].min(axis=0), pts[at].max(axis=0)
        x = (pts - lo) / np.where(hi - lo == 0, 1, hi - lo)
        for i in at:
            dist = [((x[j] - x[i]) ** 2).sum() + penalty * sum(cats[j][c] != cats[i][c] for c in range(n_cats)) for j in at]
            order = sorted((round(math.sqrt(d), 9), int(j)) for d, j in zip(dist, at) if j != i)[:k]
            assert [got[i, r][0] for r in range(1, k + 1)] == [j for _, j in order], i
            assert np.allclose([got[i, r][1] for r in range(1, k + 1)], [d for d, _ in order], atol=1e-8)


def test_thresholds_are_those_of_exact_splits(spark, monkeypatch):
    import reviewlab.operators.sampling as sam
    df = spark.range(700).withColumnRenamed("id", "v1").repartition(4)
    for bound in (1_000_000, 3):
        monkeypatch.setattr(sam, "MAX_BOUNDARY_ROWS", bound)
        cuts = sam.thresholds(df, "v1", {5: 100, 6: 0, 7: 699, 8: 1})
        assert set(cuts) == {5, 7, 8}
        for seed, n in ((5, 100), (7, 699), (8, 1)):
            taken = sam.split_exact(df, "v1", share=None, n=n, seed=seed).where("split = 'train'")
            h = sam.draw_hash("v1", seed)
            top = taken.select(h.alias("h"), "v1").orderBy(F.desc("h"), F.desc("v1")).first()
            assert (top["h"], top["v1"]) == cuts[seed] and taken.count() == n


def test_smote_rows_between_parents(spark):
    rows = [(i, 1 if i < 12 else 5, "x" if i % 2 else "y", float(i), float(i * i % 7))
            for i in range(40)]
    df = spark.createDataFrame(rows, "v1 long, rating int, cat string, a double, b double")
    out = smote(df, "rating", 1, 5, over=200, under=100, k=3, numeric=["a", "b"],
                categorical=["cat"])
    counts = {r["origin"]: r["count"] for r in out.groupBy("origin").count().collect()}
    assert counts == {"minority": 12, "synthetic": 24, "majority": 24}
    syn = out.where("origin = 'synthetic'").collect()
    assert all(0 <= r["a"] <= 11 and r["rating"] == 1 for r in syn)
    assert all(r["cat"] in ("x", "y") for r in syn)
    keys = [r["v1"] for r in out.collect()]
    assert len(set(keys)) == len(keys)          # synthetic keys never collide


def test_net_gradient_matches_numeric_difference():
    rng = np.random.default_rng(2)
    ws = [w if w.ndim == 2 else rng.normal(size=w.shape) for w in _init(7, (4, 3), 3, seed=1)]  # off the ReLU's kink
    idx = [[0, 2], [1, 5, 6], [3], []]
    y = np.array([0, 2, 1, 1])

    def loss(wts):
        _, _, _, _, p = _forward(wts, idx)
        return -np.log(p[np.arange(4), y]).sum()

    class Sent:
        value = ws

    import pandas as pd
    batches = [pd.DataFrame({"idx": idx[:2], "y": y[:2]}), pd.DataFrame({"idx": idx[2:], "y": y[2:]}), pd.DataFrame({"idx": [], "y": []})]
    (out,) = _grad_fn(Sent, "idx", "y")(iter(batches))     # what a task runs and emits, once
    n = sum(w.size for w in ws)
    got = np.zeros((-(-(n + 1) // 16), 16))
    got[out["block"].to_numpy()] = out.iloc[:, 1:].to_numpy()
    got = got.ravel()
    assert got[n] == 4
    e, at = 1e-6, 0
    for k, w in enumerate(ws):
        for i in np.ndindex(w.shape):
            plus, minus = [x.copy() for x in ws], [x.copy() for x in ws]
            plus[k][i] += e
            minus[k][i] -= e
            assert abs(got[at] - (loss(plus) - loss(minus)) / (2 * e)) < 1e-5, (k, i)
            at += 1


def test_net_training_loss_falls(spark):
    rows = [(i, [i % 5, 5 + (i % 3)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "v1 long, idx array<int>, label int")
    m = fit_mlp(df, "idx", "label", width=8, classes=3, epochs=4, steps_per_epoch=2, lr=0.01)
    losses = [h[1] for h in m.history]
    assert losses[-1] < losses[0]
    p = predict_mlp(m, df, "idx", keep=["v1"]).first()
    assert abs(sum(p["prob"]) - 1) < 1e-9


@pytest.fixture(scope="module")
def boost_data(spark):
    rows = [(i, ["a", "b", "c"][i % 3], float((i * 7) % 11), 1 + (i % 3) + (1 if (i * 7) % 11 > 8 else 0))
            for i in range(150)]
    return spark.createDataFrame(rows, "v1 long, cat string, x double, y int")


def test_boosting_loss_falls_and_predicts(spark, boost_data):
    p = BoostParams(eta=0.3, max_depth=2)
    m = fit_boosted(boost_data, "y", ["cat", "x"], p, rounds=4)
    losses = [h[1] for h in m.history]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    pred = predict_boosted(m, boost_data, keep=["v1", "y"])
    acc = pred.select(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > 0.9
    imp = importance(m, spark).collect()
    for col in ("gain", "cover", "frequency"):
        assert abs(sum(r[col] for r in imp) - 1) < 1e-9


def plain_splits(rows, is_cat: list[bool], lam: float, gam: float, mcw: float) -> list[dict]:
    """Split search on a list of histogram rows."""
    import numpy as np
    import pandas as pd
    cols = ["j", "node", "f", "bin", "G", "H"]
    h = rows[cols].copy() if isinstance(rows, pd.DataFrame) else \
        pd.DataFrame([tuple(r) for r in rows], columns=cols)
    if h.empty:
        return []
    h = h.sort_values(["j", "node", "f", "bin"], kind="mergesort").reset_index(drop=True)
    g = h.groupby(["j", "node", "f"], sort=False)
    h["Gt"], h["Ht"] = g["G"].transform("sum"), g["H"].transform("sum")
    h["maxbin"] = g["bin"].transform("max")
    isc = np.asarray(is_cat, dtype=bool)[h["f"].to_numpy()]
    h["GL"] = np.where(isc, h["G"], g["G"].cumsum())
    h["HL"] = np.where(isc, h["H"], g["H"].cumsum())
    GR, HR = h["Gt"] - h["GL"], h["Ht"] - h["HL"]
    h["gain"] = 0.5 * (h["GL"] ** 2 / (h["HL"] + lam) + GR ** 2 / (HR + lam)
                       - h["Gt"] ** 2 / (h["Ht"] + lam)) - gam
    ok = (h["HL"] >= mcw) & (HR >= mcw) & (h["gain"] > 1e-12) & (isc | (h["bin"] < h["maxbin"]))
    c = h[ok].sort_values(["j", "node", "gain", "f", "bin"], ascending=[True, True, False, True, True],
                          kind="mergesort")
    best = c.groupby(["j", "node"], sort=False).head(1)
    return [{"j": int(r.j), "node": int(r.node), "f": int(r.f), "bin": int(r.bin),
             "gain": float(r.gain), "H": float(r.Ht)} for r in best.itertuples()]


def test_split_search_is_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(j, n, f, b, float(rng.normal()), float(rng.uniform(0.1, 2)))
            for j, n, f, b in itertools.product(range(2), range(2), range(3), range(5))]
    hist = spark.createDataFrame(rows, "j int, node int, f int, bin int, G double, H double")
    is_cat = [False, True, False]
    a = sorted((r["j"], r["node"], r["f"], r["bin"]) for r in _best_splits(hist, is_cat, 1.0, 0.0, 1.0).collect())
    b = sorted((s["j"], s["node"], s["f"], s["bin"]) for s in plain_splits(rows, is_cat, 1.0, 0.0, 1.0))
    assert a == b


def test_sketch_rank_error(spark):
    from reviewlab.operators.sketch import cut_points, summaries
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=4000), np.full(1500, 0.25), rng.integers(0, 4, 500)])
    w = rng.uniform(0, 3, len(x))
    rows = [(float(a), float(b), float(i % 5)) for i, (a, b) in enumerate(zip(x, w))] + [(None, 1.0, None), (1.0, None, None), (float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "x double, w double, few double").repartition(40)
    size = 64
    s = {r["col"]: (np.array(r["v"]), np.array(r["w"])) for r in summaries(df, ["x", "few"], size, F.col("w")).collect()}
    v, mass = s[0]
    assert len(v) <= 2 * size and abs(mass.sum() - w.sum()) < 1e-6 and (np.diff(v) > 0).all()
    exact = np.array([w[x <= c].sum() for c in v])
    # a prune of each task, one of each of two merges of 32
    assert np.abs(np.cumsum(mass) - exact).max() <= 3 * w.sum() / size
    assert s[1][0].tolist() == [0, 1, 2, 3, 4]
    cuts = cut_points(df, ["x", "few"], 16, F.col("w"))
    assert cuts["few"] == [0, 1, 2, 3] and len(cuts["x"]) <= 15 and 0.25 in cuts["x"]
    shares = np.array([w[x <= c].sum() for c in cuts["x"]]) / w.sum()
    inner = [s for c, s in zip(cuts["x"], shares) if c != 0.25]
    assert all(min(abs(s - i / 16) for i in range(1, 16)) < 0.02 for s in inner)


def test_ordered_categories_split_by_order(spark):
    rows = [(i, ["low", "mid", "high", None, "odd"][i % 5], 1 if i % 5 in (0, 1, 3, 4) else 2) for i in range(100)]
    df = spark.createDataFrame(rows, "v1 long, grade string, y int")
    m = fit_boosted(df, "y", ["grade"], BoostParams(max_depth=1), rounds=1, ordered={"grade": ["low", "mid", "high"]})
    assert [m.binning.condition("grade", s[0][1]) for _, k, s, _ in m.trees if k == 2] == ["grade <= mid"]
    assert predict_boosted(m, df, keep=["v1", "y"]).where("prediction != y").count() == 0


def plain_boosting(rows, K, params, rounds, seed, held, patience):
    """One model by itself on lists: (history, trees). ``rows``: key, y, fold, bins."""
    import hashlib
    from reviewlab.operators.sampling import column_share
    names, is_cat = ["cat", "x"], [True, False]
    y, fold, bins = (np.array(c) for c in list(zip(*rows))[1:])
    mg = np.zeros((len(rows), K))
    history, best = [], (math.inf, 0)
    train = fold != held

    def prob():
        p = np.exp(mg - mg.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for r in range(1, rounds + 1):
        p = prob()
        u = np.array([int(hashlib.md5(f"{seed}-row{r}-{k}".encode()).hexdigest()[:8], 16) / 2 ** 32 for k, *_ in rows])
        drawn = train & (u < params.subsample) if params.subsample < 1 else train
        step = np.zeros_like(mg)
        for k in range(K):
            g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
            feats = [names.index(c) for c in column_share(names, params.colsample_bytree, r * K + k, seed)]
            nodes = [(np.ones(len(rows), bool), 0)]
            while nodes:
                at, depth = nodes.pop()
                mine = at & drawn
                G, H = g[mine].sum(), h[mine].sum()
                found = []
                for f in feats if depth < params.max_depth else []:
                    codes = sorted(set(bins[mine, f]))
                    for b in codes if is_cat[f] else codes[:-1]:
                        left = mine & (bins[:, f] == b if is_cat[f] else bins[:, f] <= b)
                        GL, HL = g[left].sum(), h[left].sum()
                        gain = 0.5 * (GL ** 2 / (HL + 1) + (G - GL) ** 2 / (H - HL + 1) - G ** 2 / (H + 1))
                        if HL >= 1 and H - HL >= 1 and gain > 1e-12:
                            found.append((-round(gain, 9), f, b))
                if found:
                    _, f, b = min(found)
                    left = bins[:, f] == b if is_cat[f] else bins[:, f] <= b
                    nodes += [(at & left, depth + 1), (at & ~left, depth + 1)]
                elif mine.any():
                    step[at, k] = -G / (H + 1) * params.eta
        mg += step
        p = prob()
        loss = -np.log(p[np.arange(len(y)), y])
        history.append((r, loss[train].mean(), loss[~train].mean()))
        if history[-1][2] < best[0] - 1e-12:
            best = history[-1][2], r
        if r - best[1] >= patience:
            break
    return history, best[1]


def test_grid_rows_together_are_each_alone(spark, boost_data, monkeypatch):
    """All grid rows in one series of jobs, some stopped early, in passes of few nodes: as plain lists, one after the other."""
    import reviewlab.operators.boost as boost
    from reviewlab.operators.sampling import folds
    rng = np.random.default_rng(8)
    noisy = spark.createDataFrame([(i, "abcd"[rng.integers(4)], float(rng.integers(12)), int(rng.integers(3))) for i in range(160)],
                                  "v1 long, cat string, x double, y int")
    grid = param_grid(spark, eta=[0.1, 0.9], max_depth=[1, 3], subsample=[0.8], colsample_bytree=[0.6])
    args = dict(rounds=7, k=2, patience=2, num_class=3)
    binning = boost.fit_binning(noisy, ["cat", "x"])
    rows = [tuple(r) for r in boost._prepare(folds(noisy, "v1", 2, 22), "y", "v1", binning, [0, 1, 2], F.col("fold"), 1)
            .select("key", "y", "fold", "bins").orderBy("key").collect()]
    want = {}
    for g in grid.collect():
        p = BoostParams(eta=g["eta"], max_depth=g["max_depth"], subsample=0.8, colsample_bytree=0.6)
        alone = [plain_boosting(rows, 3, p, 7, 22, held, 99)[0] for held in (0, 1)]
        mean = [tuple(sum(h[i][c] for h in alone) / 2 for c in (1, 2)) for i in range(7)]
        best = (math.inf, 0)
        for r, (_, test) in enumerate(mean, 1):
            if test < best[0] - 1e-12:
                best = test, r
            if r - best[1] >= 2:
                break
        want[g["paramsNum"]] = (best[1], r, *mean[best[1] - 1])
    assert len({w[1] for w in want.values()}) > 1 and min(w[1] for w in want.values()) < 7     # some stop early
    for together, cells, nodes in ((None, boost.MAX_CELLS, boost.SUBTRACT_NODES), (3, 200, 1)):
        monkeypatch.setattr(boost, "MAX_CELLS", cells)
        monkeypatch.setattr(boost, "SUBTRACT_NODES", nodes)
        cv = cross_validate(noisy, "y", ["cat", "x"], grid, together=together, **args).collect()
        for r in cv:
            got = (r["bestIteration"], r["rounds"], r["bestCvrmse"], r["bestCvrmse_test"])
            assert got[:2] == want[r["paramsNum"]][:2] and np.allclose(got[2:], want[r["paramsNum"]][2:], atol=1e-9), (got, want[r["paramsNum"]])


def test_cv_table_and_grid(spark, boost_data):
    g = param_grid(spark, eta=[0.1, 0.3], max_depth=[1, 2], subsample=[1.0], colsample_bytree=[1.0])
    got = sorted((r["paramsNum"], r["eta"], r["max_depth"]) for r in g.collect())
    assert got == [(1, 0.1, 1), (2, 0.3, 1), (3, 0.1, 2), (4, 0.3, 2)]
    cv = cross_validate(boost_data, "y", ["cat", "x"], g.where("paramsNum <= 2"), rounds=3, k=3,
                        patience=10)
    rows = cv.collect()
    assert len(rows) == 2 and all(1 <= r["bestIteration"] <= 3 for r in rows)


def test_nearest_neighbours_clustered(spark, monkeypatch):
    import reviewlab.operators.balance as bal
    monkeypatch.setattr(bal, "MAX_CELL_POINTS", 6)   # force the cell refinement
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.normal(0.5, 0.001, size=(50, 2)), rng.uniform(0, 1, size=(10, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "v1 long, a double, b double")
    got = {(r["v1"], r["rank"]): r["nb_key"]
           for r in bal.nearest_neighbours(df, "v1", ["a", "b"], k=4).collect()}
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    x = (pts - lo) / (hi - lo)
    for i in range(len(pts)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = sorted((round(d[j], 9), j) for j in range(len(pts)) if j != i)[:4]
        assert [got[(i, r)] for r in range(1, 5)] == [j for _, j in order]


def test_net_leaves_no_files(spark):
    import os
    rows = [(i, [i % 5, 5 + (i % 3)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "v1 long, idx array<int>, label int")
    a = fit_mlp(df, "idx", "label", width=8, classes=3, epochs=2, steps_per_epoch=3)
    b = fit_mlp(df.orderBy(F.desc("v1")), "idx", "label", width=8, classes=3, epochs=2, steps_per_epoch=3)
    for x, y in zip(a.history, b.history):
        assert abs(x[1] - y[1]) < 1e-9 and x[2] == y[2]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [n for n in os.listdir(folder) if n.startswith("mlp-")]


def test_loss_keeps_rows_of_probability_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([1.0, 0.0], 1)], "prob array<double>, label int")
    r = evaluate(df, "prob", "label").first()
    assert abs(r["loss"] + math.log(1e-7) / 2) < 1e-9 and r["accuracy"] == 0.5


def test_labels_outside_the_classes_are_an_error(spark, boost_data):
    with pytest.raises(Exception, match="label outside the classes"):
        fit_boosted(boost_data, "y", ["x"], BoostParams(max_depth=1), rounds=1, num_class=3)


def test_equal_rows_do_not_meet_all_of_their_copies(spark):
    n = 3000                      # two points; all pairs would be 4.5 million rows
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(n)], "v1 long, a double, b double")
    got = nearest_neighbours(df, "v1", ["a", "b"], k=4).collect()
    assert len(got) == 4 * n and all(r["dist"] == 0 for r in got)
    for i in (0, 1, 2, 2999):
        want = [j for j in range(i % 2, n, 2) if j != i][:4]
        assert [r["nb_key"] for r in sorted(got, key=lambda r: r["rank"]) if r["v1"] == i] == want


@pytest.mark.parametrize("over, most", [(150, 2), (50, 1)])
def test_oversampling_by_parts_of_a_hundred(spark, over, most):
    rows = [(i, 1 if i < 60 else 5, float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "v1 long, rating int, a double")
    out = smote(df, "rating", 1, 5, over=over, under=100, k=3, numeric=["a"])
    n = out.where("origin = 'synthetic'").count()
    assert (most - 1) * 60 < n < most * 60


def test_ordered_and_one_hot_features(spark):
    from reviewlab.operators.features import feature_matrix, fit_features
    df = spark.createDataFrame([(1, "b", "low", 2.0), (2, "a", "high", 3.0), (3, None, None, 4.0), (4, "a", "odd", 5.0)],
                               "v1 long, cat string, grade string, x double")
    levels = {"grade": ["low", "mid", "high"]}
    spec = fit_features(df, ["cat", "grade", "x"], ordered=levels)
    got = {r["v1"]: list(r["features"].toArray()) for r in feature_matrix(df, spec, keep=["v1"]).collect()}
    assert got == {1: [1.0, 0.0, 2.0], 2: [0.0, 2.0, 3.0], 3: [2.0, -1.0, 4.0], 4: [0.0, -1.0, 5.0]}
    spec = fit_features(df, ["cat", "x"], one_hot=True)
    wide = {r["v1"]: list(r["features"].toArray()) for r in feature_matrix(df, spec, keep=["v1"]).collect()}
    assert wide[1][:2] == [0.0, 1.0] and wide[2][:2] == [1.0, 0.0] and wide[1][-1] == 2.0


def test_stacked_column_out_of_fold(spark):
    from reviewlab.operators.mlp import stack
    rows = [(i, [i % 5, 5 + (i % 3)], i % 3, "train" if i < 60 else "test") for i in range(80)]
    df = spark.createDataFrame(rows, "v1 long, idx array<int>, label int, split string")
    train, seen = df.where("split = 'train'"), []

    def refit(part):
        seen.append({r["v1"] for r in part.select("v1").collect()})
        return fit_mlp(part, "idx", "label", width=8, classes=3, epochs=1, steps_per_epoch=1)

    model = fit_mlp(train, "idx", "label", width=8, classes=3, epochs=1, steps_per_epoch=1)
    out = stack(train, df.where("split = 'test'"), model, "idx", out_of_fold=True, refit=refit, k=3).collect()
    assert {r["v1"]: r["split"] for r in out} == {r[0]: r[3] for r in rows} and len(out) == 80
    assert len(seen) == 3 and set.intersection(*seen) == set() and all(s < set(range(60)) for s in seen)


def test_held_rows_train_the_models_of_dealt_rows(spark, monkeypatch):
    """(findings 2, 3, 4) One model a task, or one level of all models a job:
    the same losses, rounds and trees, for numbers, ordered and free
    categories, missing values, equal keys and rows that weigh too little."""
    import reviewlab.operators.boost as boost
    rng = np.random.default_rng(12)
    rows = [(int(i % 190), ["a", "b", "c", None][rng.integers(4)], [None, "low", "mid", "high"][rng.integers(4)],
             None if i % 13 == 0 else float(rng.integers(30)), int(rng.integers(3))) for i in range(200)] + [(None, "a", "low", 1.0, 1)]
    df = spark.createDataFrame(rows, "v1 long, cat string, grade string, x double, y int")
    args = dict(num_class=4, ordered={"grade": ["low", "mid", "high"]})
    grid = param_grid(spark, eta=[0.1, 0.8], max_depth=[1, 4], subsample=[0.7, 1.0], colsample_bytree=[0.6])
    monkeypatch.setattr(boost, "HELD_ROUNDS", 3)
    monkeypatch.setattr(boost, "HELD_CELLS", 60)
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(boost, "HELD_ROWS", most)
        cv = cross_validate(df, "y", ["cat", "grade", "x"], grid, rounds=7, k=3, patience=2, **args).orderBy("paramsNum").collect()
        m = fit_boosted(df.where("v1 < 150"), "y", ["cat", "grade", "x"], BoostParams(eta=0.3, max_depth=3, subsample=0.6, colsample_bytree=0.7),
                        rounds=5, watch=df.where("v1 >= 150"), **args)
        found.append((cv, m))
    (cv, m), (dealt, n) = found
    assert len({r["rounds"] for r in cv}) > 1 and len(cv) == 8
    for a, b in zip(cv, dealt):
        assert a[:2] == b[:2] and a[4:] == b[4:] and np.allclose(a[2:4], b[2:4], atol=1e-9)
    assert np.allclose(m.history, n.history, atol=1e-9) and [t[:2] for t in m.trees] == [t[:2] for t in n.trees]
    for a, b in zip(m.trees, n.trees):
        assert a[2].keys() == b[2].keys() and a[3].keys() == b[3].keys()
        assert all(a[2][i][:2] == b[2][i][:2] and np.allclose(a[2][i], b[2][i], atol=1e-8) for i in a[2])
        assert np.allclose([a[3][i] for i in sorted(a[3])], [b[3][i] for i in sorted(b[3])], atol=1e-9)


def test_boosting_has_few_jobs(spark, boost_data):
    """(findings 2, 3, 4) Jobs don't come with the rounds, levels and grid rows of a small table."""
    grid = param_grid(spark, eta=[0.1, 0.3], max_depth=[2, 10], subsample=[0.6], colsample_bytree=[1.0])
    tracker, group = spark.sparkContext.statusTracker(), "few jobs"
    spark.sparkContext.setJobGroup(group, "")
    cv = cross_validate(boost_data, "y", ["cat", "x"], grid, rounds=20, k=3, patience=20).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["rounds"] for r in cv] == [20] * 4
    assert len(tracker.getJobIdsForGroup(group)) < 40


def test_boosted_cv_has_the_rounds_of_the_scripts(spark, monkeypatch):
    """(finding 4) Grid, folds, rounds and patience of RCode.R:299-328, on all training rows."""
    from reviewlab.plans import q_models

    seen = {}
    rows = spark.range(50).select(F.col("id").alias("v1"), F.when(F.col("id") < 40, "train").otherwise("test").alias("split"))
    monkeypatch.setattr(q_models, "_boost_input", lambda spark, sf: rows)
    monkeypatch.setattr(q_models, "cross_validate", lambda df, label, features, grid, **args: seen.update(args, n=df.count(), grid=grid.collect()))
    q_models.q_boosted_cv(spark, "")
    assert seen["n"] == 40 and (seen["rounds"], seen["patience"], seen["k"], seen["num_class"]) == (1000, 10, 5, 6)
    assert {(r["eta"], r["max_depth"], r["subsample"], r["colsample_bytree"]) for r in seen["grid"]} == set(itertools.product((0.02, 0.06, 0.1), (2, 5, 10), (0.6,), (0.6,)))


def test_boosting_of_no_rows_and_of_one(spark):
    """(findings 2, 4) No rows, no splits and no losses; one row is a leaf."""
    schema = "v1 long, cat string, x double, y int"
    grid = param_grid(spark, eta=[0.1], max_depth=[2], subsample=[0.6], colsample_bytree=[1.0])
    for rows, losses in (([], False), ([(1, "a", 1.0, 1)], True)):
        df = spark.createDataFrame(rows, schema)
        m = fit_boosted(df, "y", ["cat", "x"], BoostParams(max_depth=2, subsample=0.6), rounds=2, num_class=3)
        assert [(h[0], h[1] is not None, h[2]) for h in m.history] == [(1, losses, None), (2, losses, None)]
        assert len(m.trees) == 6 and not any(t[2] for t in m.trees) and all(bool(t[3]) == losses for t in m.trees)
        cv = cross_validate(df, "y", ["cat", "x"], grid, rounds=3, k=2, num_class=3).first()
        assert (cv["rounds"], cv["bestCvrmse_test"] is not None) == (3, losses)
