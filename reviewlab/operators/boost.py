"""Multi-class gradient-boosted trees (softmax objective) as DataFrame jobs.

Spark ML's boosted classifier is binary only, so the softmax boosting of
the workload (Chen & Guestrin 2016) is written with DataFrame operations:

* features are binned once (numbers: at most ``bins`` bins from a weighted
  quantile sketch; ordered categories: their place in the stated order, split
  by order like numbers; other categories: their level code, split one against
  the rest), and the rows are kept as (key, label, fold, bins, margins);
* all classes, all folds of a cross-validation and all rows of its grid train
  in the same jobs, as models beside each other; a model that has stopped
  early is left out of the work;
* a tree level is one pass: tasks move their rows down the trees so far and
  sum gradients and hessians of every class into histograms of the nodes of
  the level, so the shuffle is of histogram size whatever the rows. Only the
  lighter child of each split is summed; its sibling is the parent less it;
* the best split per node is found on the histogram (a window over bins) and
  collected (a row a node); leaf weights -G/(H + lambda) follow from the sums
  beside the splits;
* a round ends with one narrow pass that adds the leaves to the margins; the
  losses come with the first level of the next round.

That costs a job for each level of each round, whatever the rows. Where a task
can hold the bins of all rows (a count of at most ``HELD_ROWS``), models are
dealt over the tasks in place of rows: each task has all rows and grows one
model's trees, the same by the same rules, for ``HELD_ROUNDS`` rounds a job;
margins go on to the next job through the checkpoint folder, and what a model
trains after its group has stopped isn't looked at.

Otherwise a task holds histograms of at most ``MAX_CELLS`` cells at once; more nodes than
fit are summed in several passes. Margins are cut from their lineage every few
rounds by ``checkpoint`` into the cluster's shared checkpoint folder, so a lost
executor recomputes at most a few rounds. Row subsampling is a hash draw per
(row, round); column subsampling draws feature names per tree.
"""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlab.operators.features import split_kinds
from reviewlab.operators.sampling import column_share, unit_draw
from reviewlab.operators.sketch import cut_points
from reviewlab.operators.util import cut_lineage, spread

NODE_SLOTS_MAX_DEPTH = 12
#: histogram cells (a gradient and a hessian sum each) that a task holds at once
MAX_CELLS = 1 << 23
#: nodes of a level from which on siblings are had by subtraction; for fewer, the joins cost more than they save
SUBTRACT_NODES = 1 << 15
#: margins (models by classes) that a row carries at once in a cross-validation
MAX_MARGINS = 512
#: rounds between cuts of the lineage
CHECKPOINT_EVERY = 5
#: rows, of about 240 bytes at work, that a task holds as a whole
HELD_ROWS = 1 << 20
#: rounds of a job whose tasks hold all rows
HELD_ROUNDS = 25
#: histogram cells of a feature that such a task works on at once
HELD_CELLS = 1 << 20


@dataclass
class BoostParams:
    eta: float = 0.3
    max_depth: int = 6
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    lam: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0


@dataclass
class Binning:
    features: list[str]
    is_cat: list[bool]
    thresholds: dict          # numeric feature -> sorted cut points
    levels: dict              # categorical feature -> level list
    ordered: dict = field(default_factory=dict)   # ordered feature -> level list, in its order

    def n_bins(self, f: str) -> int:
        if f in self.ordered:
            return len(self.ordered[f])
        return len(self.levels[f]) + 1 if f in self.levels else len(self.thresholds[f]) + 1

    def condition(self, f: str, bin_: int) -> str:
        """The rule of the left side of a split, as text."""
        if f in self.levels:
            return f"{f} = {self.levels[f][bin_] if bin_ < len(self.levels[f]) else '<other>'}"
        if f in self.ordered:
            return f"{f} <= {self.ordered[f][bin_] if bin_ >= 0 else '<missing>'}"
        return f"{f} <= {self.thresholds[f][bin_]:g}" if bin_ >= 0 else f"{f} is missing"


@dataclass
class BoostModel:
    binning: Binning
    labels: list              # class values, by class index
    params: BoostParams
    trees: list = field(default_factory=list)     # (round, class, splits, leaves)
    history: list = field(default_factory=list)   # (round, train_loss, test_loss)
    key: str = "v1"


def _const_array(values, elem: str) -> Column:
    """A constant array column; Catalyst folds the parse into one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{elem}>")


def fit_binning(df: DataFrame, features: list[str], categorical: list[str] | None = None,
                bins: int = 64, ordered: dict[str, list] | None = None, weight: Column | None = None) -> Binning:
    """Cut points of the numeric features (at most bins - 1 each, from a
    weighted quantile sketch; see ``sketch.cut_points``) and sorted levels of
    the categories; ``ordered`` gives the order of ordered ones. The weight is
    a row's hessian: in the first round all are equal, so none is needed."""
    ordered = ordered or {}
    numeric, cats = split_kinds(df, [f for f in features if f not in ordered], categorical)
    thresholds = cut_points(df, numeric, bins, weight) if numeric else {}
    levels = {}
    for c in cats:
        rows = (df.select(F.col(c).cast("string").alias("v")).where("v is not null")
                .distinct().limit(100_001).collect())
        if len(rows) > 100_000:
            raise ValueError(f"{c}: too many levels for a categorical feature")
        levels[c] = sorted(r[0] for r in rows)
    return Binning(features, [c in cats for c in features], thresholds, levels, ordered)


def bin_codes(binning: Binning) -> Column:
    """array<int> of bin codes, one per feature. Numbers: count of cut
    points below the value (missing: -1). Ordered categories: place in the
    order (missing or unlisted: -1). Categories: level position (missing or
    unseen: the last code)."""
    codes = []
    for f, cat in zip(binning.features, binning.is_cat):
        if cat or f in binning.ordered:
            levels = binning.levels[f] if cat else [str(v) for v in binning.ordered[f]]
            pos = F.array_position(_const_array(levels, "string"), F.col(f).cast("string")).cast("int")
            codes.append(F.when(pos > 0, pos - 1).otherwise(F.lit(len(levels) if cat else -1)))
        else:
            th = _const_array(binning.thresholds[f], "double")
            x = F.col(f).cast("double")
            codes.append(F.when(x.isNull(), F.lit(-1))
                         .otherwise(F.size(F.filter(th, lambda t: t < x))))
    return F.array(*codes)


@dataclass
class _Model:
    """One training set with its parameters: rows of fold ``held`` are its
    test rows, all others of a fold from 0 on its training rows."""
    params: BoostParams
    held: int
    group: int                # models of a group (the folds of a grid row) stop together


def _softmax(margins: np.ndarray) -> np.ndarray:
    p = margins - margins.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _walk(bins: np.ndarray, feat: np.ndarray, cut: np.ndarray, is_cat: np.ndarray, steps: int) -> np.ndarray:
    """Node of each row after ``steps`` levels of a tree (heap-numbered; a row
    stays in a node without a split)."""
    node = np.zeros(len(bins), np.int64)
    for _ in range(steps):
        f = feat[node]
        at = np.flatnonzero(f >= 0)
        if not len(at):
            break
        f = f[at]
        value, c = bins[at, f], cut[node[at]]
        left = np.where(is_cat[f], value == c, value <= c)
        node[at] = 2 * node[at] + 2 - left
    return node


class _Trees:
    """Trees of one round, by slot j = model * K + class."""

    def __init__(self, n: int, depth: int) -> None:
        self.feat = np.full((n, 2 ** (depth + 1) - 1), -1, np.int32)
        self.cut = np.zeros_like(self.feat)
        self.leaf = np.zeros(self.feat.shape)


def _columns(b, n_margins: int):
    """Numbers of an Arrow batch of rows."""
    n = b.num_rows
    grid = lambda c: np.asarray(b.column(c).flatten()).reshape(n, -1)
    return (b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy(zero_copy_only=False),
            grid("bins"), grid("mg").reshape(n, n_margins))


def _cells(rows: DataFrame, models: list[_Model], live: list[int], K: int, binning: Binning, trees, level: int,
           todo: list[tuple[int, int]], chosen: list[list[int]], losses: bool) -> DataFrame:
    """(j, node, f, bin) -> G, H of the nodes ``todo`` of a level over the
    drawn training rows (column ``u`` holds the row's draw). With f = -1 the
    sums of each tree's root, and, with ``losses``, with f = -2 the summed loss
    and count of model j over its training (bin 0) and test rows (bin 1)."""
    import pyarrow as pa

    n_feat = len(binning.features)
    slots = [binning.n_bins(f) + 1 for f in binning.features]   # codes from -1 (missing) on
    offset = np.cumsum([0] + slots[:-1])
    feature = np.repeat(np.arange(n_feat), slots)
    code = np.arange(sum(slots)) - np.repeat(offset, slots) - 1
    total, is_cat = sum(slots), np.array(binning.is_cat, bool)
    # nodes of a tree lie together: their first place, and each node's among them
    place: dict[int, tuple[int, np.ndarray]] = {}
    size: dict[int, int] = {}
    for i, (j, node) in enumerate(todo):
        _, nodes = place.setdefault(j, (i, np.full(2 ** (level + 1) - 1, -1, np.int64)))
        nodes[node] = size.get(j, 0)
        size[j] = size.get(j, 0) + 1
    sent = rows.sparkSession.sparkContext.broadcast((trees.feat, trees.cut) if trees is not None else None)
    J = len(models) * K
    schema = "j int, node int, f int, bin int, G double, H double"

    def run(batches):
        acc = np.zeros((2, len(todo), total))
        roots, sums = np.zeros((2, J)), np.zeros((2, len(models), 2))
        for b in batches:
            if not b.num_rows:
                continue
            y, fold, bins, mg = _columns(b, J)
            u = b.column("u").to_numpy(zero_copy_only=False)
            for m in live:
                model = models[m]
                held = fold == model.held
                train = ~held & (fold >= 0)
                p = _softmax(mg[:, m * K:(m + 1) * K])
                if losses:
                    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
                    for i, part in enumerate((train, held)):
                        sums[0, m, i] += loss[part].sum()
                        sums[1, m, i] += part.sum()
                drawn = np.flatnonzero(train & (u < model.params.subsample))
                if not len(drawn):
                    continue
                p, x = p[drawn], bins[drawn]
                for k in range(K):
                    j = m * K + k
                    if j not in place:
                        continue
                    g, h = p[:, k] - (y[drawn] == k), np.maximum(2.0 * p[:, k] * (1.0 - p[:, k]), 1e-16)
                    if level == 0:
                        roots[0, j] += g.sum()
                        roots[1, j] += h.sum()
                        slot, xk = np.zeros(len(drawn), np.int64), x
                    else:
                        slot = place[j][1][_walk(x, sent.value[0][j], sent.value[1][j], is_cat, level)]
                        keep = slot >= 0
                        slot, g, h, xk = slot[keep], g[keep], h[keep], x[keep]
                    fs, n = chosen[j], size[j]
                    cell = (slot[:, None] * total + offset[fs] + 1 + xk[:, fs]).ravel()
                    for a, v in zip(acc, (g, h)):
                        a[place[j][0]:place[j][0] + n] += np.bincount(cell, np.repeat(v, len(fs)), n * total).reshape(n, total)
        at, cell = np.nonzero(acc[1])
        of = np.array(todo, np.int64).reshape(-1, 2)[at]
        parts = [(of[:, 0], of[:, 1], feature[cell], code[cell], acc[0][at, cell], acc[1][at, cell])]
        if level == 0:
            j = np.flatnonzero(roots[1])
            parts.append((j, 0 * j, 0 * j - 1, 0 * j, roots[0, j], roots[1, j]))
        if losses:
            m, i = np.nonzero(sums[1])
            parts.append((m, 0 * m, 0 * m - 2, i, sums[0][m, i], sums[1][m, i]))
        cols = [np.concatenate(x) for x in zip(*parts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(c, pa.float64()) for c in cols[4:]],
                                         ["j", "node", "f", "bin", "G", "H"])

    # cells of a node meet in one partition, where sums, windows and the best split need no further shuffle
    return (rows.select("y", "fold", "bins", "mg", "u").mapInArrow(run, schema).repartition("j", "node")
            .groupBy("j", "node", "f", "bin").agg(F.sum("G").alias("G"), F.sum("H").alias("H")))


def _moved(rows: DataFrame, models: list[_Model], live: list[int], K: int, binning: Binning, trees: _Trees) -> DataFrame:
    """``rows`` with the leaves of a round added to the margins of live models."""
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast((trees.feat, trees.cut, trees.leaf))
    is_cat, J = np.array(binning.is_cat, bool), len(models) * K

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            _, _, bins, mg = _columns(b, J)
            feat, cut, leaf = sent.value
            mg = mg.copy()
            for m in live:
                for j in range(m * K, (m + 1) * K):
                    mg[:, j] += leaf[j][_walk(bins, feat[j], cut[j], is_cat, models[m].params.max_depth)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, mg.size + 1, J), pa.int32()), pa.array(mg.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("key", "y", "fold", "bins")] + [flat], ["key", "y", "fold", "bins", "mg"])

    return rows.select("key", "y", "fold", "bins", "mg").mapInArrow(run, T.StructType([f for f in rows.schema.fields if f.name in ("key", "y", "fold", "bins", "mg")]))


def _children(parents: DataFrame, light: DataFrame) -> DataFrame:
    """Histograms of both children of every split: the summed lighter one, and
    its sibling as the parent (``parents`` names the sibling) less it."""
    near = light.select(F.col("j").alias("a"), F.col("node").alias("b"), F.col("f").alias("c"), F.col("bin").alias("d"),
                        F.col("G").alias("near_g"), F.col("H").alias("near_h"))
    # the sibling of node n is n + 1 for a left child (odd), n - 1 for a right one
    own = F.when(F.col("node") % 2 == 1, F.col("node") + 1).otherwise(F.col("node") - 1)
    rest = (parents.join(near, (F.col("j") == F.col("a")) & (own == F.col("b")) & (F.col("f") == F.col("c")) & (F.col("bin") == F.col("d")), "left")
            .select("j", "node", "f", "bin", (F.col("G") - F.coalesce("near_g", F.lit(0.0))).alias("G"), (F.col("H") - F.coalesce("near_h", F.lit(0.0))).alias("H")))
    return light.unionByName(rest.where("H > 1e-9"))


def _grow(rows: DataFrame, models: list[_Model], live: list[int], K: int, binning: Binning, chosen: list[list[int]],
          losses: bool) -> tuple[_Trees, list[dict], list[dict], dict]:
    """One tree for every class of the live models: (trees, splits by slot,
    leaves by slot, losses)."""
    J, depth = len(models) * K, max(models[m].params.max_depth for m in live)
    trees = _Trees(J, depth)
    splits: list[dict] = [{} for _ in range(J)]
    sums: list[dict] = [{} for _ in range(J)]         # node -> G, H
    seen: dict = {}
    first = models[live[0]].params
    total = sum(binning.n_bins(f) + 1 for f in binning.features)
    most = max(1, MAX_CELLS // total)
    parents, last = None, None
    todo = [(j, 0) for m in live for j in range(m * K, (m + 1) * K)]
    for level in range(depth):
        if not todo:
            break
        # many nodes are summed in several passes, each within a task's memory
        hist = None
        for i in range(0, len(todo), most):
            part = _cells(rows, models, live, K, binning, trees, level, todo[i:i + most], chosen, losses and level == 0 and i == 0)
            hist = part if hist is None else hist.unionByName(part)
        nodes = len(todo)
        if parents is not None:
            hist, nodes = _children(parents, hist), 2 * nodes
        keep = level == 0 or 2 * nodes >= SUBTRACT_NODES      # read again, below or by the next level
        if keep:
            hist = hist.persist()
        best = _best_splits(hist.where("f >= 0"), binning.is_cat, first.lam, first.gamma, first.min_child_weight)
        if level == 0:
            zero = [F.lit(0.0).alias(c) for c in ("gain", "GL", "HL")]
            best = best.unionByName(hist.where("f < 0").select("j", "node", "f", "bin", "G", "H", *zero))
        found = best.collect()      # a row a node, and the sums of roots and losses
        if last is not None:
            last.unpersist()
        last = hist if keep else None
        splitting = []
        for s in found:
            j, node = s["j"], s["node"]
            if s["f"] == -1:
                sums[j][0] = (s["G"], s["H"])
            elif s["f"] == -2:
                seen[j, s["bin"]] = (s["G"], s["H"])
            else:
                trees.feat[j, node], trees.cut[j, node] = s["f"], s["bin"]
                splits[j][node] = (s["f"], s["bin"], float(s["gain"]), float(s["H"]))
                sums[j][2 * node + 1] = (s["GL"], s["HL"])
                sums[j][2 * node + 2] = (s["G"] - s["GL"], s["H"] - s["HL"])
                if level + 1 < models[j // K].params.max_depth:
                    light = 2 * node + 1 if 2 * s["HL"] <= s["H"] else 2 * node + 2
                    splitting.append((j, node, light, 4 * node + 3 - light))
        parents = None
        # a node without the weight of two children can't be split (the margin is for rounding): it isn't summed
        able = sorted((j, child) for j, _, light, heavy in splitting for child in (light, heavy) if sums[j][child][1] >= 2 * first.min_child_weight - 1e-6)
        if len(able) < SUBTRACT_NODES:
            todo = able
            continue
        todo = sorted((j, light) for j, _, light, _ in splitting)
        siblings = rows.sparkSession.createDataFrame([(j, node, heavy) for j, node, _, heavy in splitting], "j int, node int, sibling int")
        parents = hist.where("f >= 0").join(siblings, ["j", "node"]).select("j", F.col("sibling").alias("node"), "f", "bin", "G", "H")
    if last is not None:
        last.unpersist()
    leaves: list[dict] = [{} for _ in range(J)]
    for m in live:
        p = models[m].params
        for j in range(m * K, (m + 1) * K):
            for node, (g, h) in sums[j].items():
                if node not in splits[j]:
                    leaves[j][node] = -g / (h + p.lam) * p.eta
                    trees.leaf[j, node] = leaves[j][node]
    return trees, splits, leaves, seen


def _group_loss(seen: dict, models: list[_Model], group: int) -> tuple[float | None, float | None]:
    """Mean train and test loss of the models of a group."""
    out = []
    for i in (0, 1):
        found = [seen[m, i][0] / seen[m, i][1] for m, x in enumerate(models) if x.group == group and (m, i) in seen]
        out.append(sum(found) / len(found) if found else None)
    return out[0], out[1]


class _Losses:
    """Losses by group and round, the best round of each, and the groups that
    still train: a group stops after ``patience`` rounds without a better test
    loss (train loss without test rows)."""

    def __init__(self, models: list[_Model], patience: int | None) -> None:
        self.models, self.patience = models, patience
        self.history: dict = {m.group: [] for m in models}
        self.best = {g: (math.inf, 0) for g in self.history}
        self.open = set(self.history)

    def live(self) -> list[int]:
        return [i for i, m in enumerate(self.models) if m.group in self.open]

    def note(self, r: int, seen: dict) -> None:
        for g in sorted(self.open):
            train, test = _group_loss(seen, self.models, g)
            self.history[g].append((r, train, test))
            watch = test if test is not None else train
            if watch is not None and watch < self.best[g][0] - 1e-12:
                self.best[g] = (watch, r)
            if self.patience is not None and r - self.best[g][1] >= self.patience:
                self.open.discard(g)

    def best_rounds(self) -> dict:
        return {g: b[1] for g, b in self.best.items()}


def _chosen(names: list[str], model: _Model, r: int, K: int, seed: int) -> list[list[int]]:
    """Features of a model's trees of a round, by class."""
    return [[names.index(c) for c in column_share(names, model.params.colsample_bytree, r * K + k, seed)] for k in range(K)]


def _boost(rows: DataFrame, binning: Binning, K: int, models: list[_Model], rounds: int, seed: int,
           patience: int | None, record: bool = False):
    """Core loop over ``rows`` (key, y, fold, bins). Returns, by group,
    the history [(round, train loss, test loss)] and the best round, and the
    trees [(round, class, splits, leaves)] of the first model if asked for.

    A group that has stopped (see ``_Losses``) has stopped as it would alone:
    its models are then left out."""
    if max(m.params.max_depth for m in models) > NODE_SLOTS_MAX_DEPTH:
        raise ValueError(f"max_depth above {NODE_SLOTS_MAX_DEPTH}")
    losses, trees = _Losses(models, patience), []
    base = rows.select("key", "y", "fold", "bins").persist()
    if base.count() <= HELD_ROWS:
        trees = _boost_held(base, binning, K, losses, rounds, seed, record)
        base.unpersist()
        return losses.history, losses.best_rounds(), trees
    names, note = binning.features, losses.note
    draws = any(m.params.subsample < 1 for m in models)
    cur = base.withColumn("mg", F.array_repeat(F.lit(0.0), len(models) * K)).persist()
    held = [base, cur]

    for r in range(1, rounds + 2):
        live = losses.live()
        if r > rounds:
            # the losses after the last round
            out = _cells(cur.withColumn("u", F.lit(0.0)), models, live, K, binning, None, 0, [], [[]] * len(models) * K, True)
            note(rounds, {(x["j"], x["bin"]): (x["G"], x["H"]) for x in out.where("f = -2").collect()})
            break
        drawn = cur.withColumn("u", unit_draw(F.col("key"), seed, f"row{r}") if draws else F.lit(0.0))
        chosen = [fs for m in models for fs in _chosen(names, m, r, K, seed)]
        grown, splits, leaves, seen = _grow(drawn, models, live, K, binning, chosen, losses=r > 1)
        if r > 1:
            note(r - 1, seen)
            live = losses.live()
            if not live:
                break
        if record:
            trees += [(r, k, splits[k], leaves[k]) for k in range(K)]
        nxt = _moved(cur, models, live, K, binning, grown)
        nxt = cut_lineage(nxt) if r % CHECKPOINT_EVERY == 0 else nxt.persist()
        held.append(nxt)
        if r % CHECKPOINT_EVERY == 0:
            for x in held[:-1]:
                x.unpersist()
            held = held[-1:]
        cur = nxt
    for x in held:
        x.unpersist()
    return losses.history, losses.best_rounds(), trees


@dataclass
class _Held:
    """All rows as arrays: class, fold, and codes + 1 (0: a missing number) by
    row and by feature."""
    y: np.ndarray
    fold: np.ndarray
    bins: np.ndarray          # rows by features
    is_cat: np.ndarray
    size: list[int]           # codes of each feature

    def __post_init__(self) -> None:
        self.columns = [np.ascontiguousarray(self.bins[:, f]) for f in range(len(self.size))]
        self.flat = self.bins.ravel()


def _by_key(rows: DataFrame):
    """Rows on the driver, in the order of their keys, so that two reads agree."""
    import pyarrow.compute as pc

    t = rows.toArrow()
    return t.take(pc.sort_indices(t, [("key", "ascending")])).drop(["key"])


def _best_of(G: np.ndarray, H: np.ndarray, is_cat: bool, p: BoostParams) -> tuple:
    """Best split of each node (row) by one feature, as ``_best_splits``: gain
    to 1e-9 (-inf: none), gain, code + 1, G and H of the node, of the left side."""
    Gt, Ht = G.sum(1), H.sum(1)
    met = H > 0
    if is_cat:
        GL, HL = G, H
    else:
        GL, HL = G.cumsum(1), H.cumsum(1)
        last = met.shape[1] - 1 - met[:, ::-1].argmax(1)
        met &= np.arange(met.shape[1]) < last[:, None]
    GR, HR = Gt[:, None] - GL, Ht[:, None] - HL
    met &= (HL >= p.min_child_weight) & (HR >= p.min_child_weight)
    at, bin_ = np.nonzero(met)
    gl, hl, gr, hr = GL[at, bin_], HL[at, bin_], GR[at, bin_], HR[at, bin_]
    gain = np.full(G.shape, -np.inf)
    gain[at, bin_] = 0.5 * (gl ** 2 / (hl + p.lam) + gr ** 2 / (hr + p.lam) - Gt[at] ** 2 / (Ht[at] + p.lam)) - p.gamma
    gain[gain <= 1e-12] = -np.inf
    value = np.round(gain, 9)
    best, n = value.argmax(1), np.arange(len(G))
    return value[n, best], gain[n, best], best, Gt, Ht, GL[n, best], HL[n, best]


def _held_tree(data: _Held, drawn: np.ndarray, rest: np.ndarray, g: np.ndarray, h: np.ndarray, feats: list[int], p: BoostParams) -> tuple:
    """One tree for the gradients and hessians of the drawn rows, as ``_grow``:
    (node of every row, leaf values by node, splits by node)."""
    node, nodes = np.zeros(len(data.y), np.int32), 2 ** (p.max_depth + 1) - 1
    G, H, leaf = np.zeros(nodes), np.zeros(nodes), np.zeros(nodes, bool)
    splits = []
    if not len(drawn):
        return node, G, splits
    G[0], H[0], leaf[0] = g.sum(), h.sum(), True
    # drawn rows first: the other rows only move
    todo, at, n = np.zeros(1, np.int64), np.concatenate([drawn, rest]), len(drawn)
    slot = np.zeros(len(at), np.int64)
    for level in range(p.max_depth):
        if not len(todo):
            break
        best = [np.full(len(todo), -np.inf)] + [np.zeros(len(todo)) for _ in range(6)]
        feature = np.full(len(todo), -1)
        for f in feats:
            size, x = data.size[f], data.columns[f][at[:n]]
            step = max(1, HELD_CELLS // size)
            for a in range(0, len(todo), step):
                b = min(a + step, len(todo))
                if b - a == len(todo):
                    cell, gs, hs = slot[:n] * size + x, g, h
                else:
                    own = np.flatnonzero((slot[:n] >= a) & (slot[:n] < b))
                    cell, gs, hs = (slot[own] - a) * size + x[own], g[own], h[own]
                cells = [np.bincount(cell, w, (b - a) * size).reshape(b - a, size) for w in (gs, hs)]
                found = _best_of(*cells, data.is_cat[f], p)
                better = np.flatnonzero(found[0] > best[0][a:b])
                feature[a + better] = f
                for old, new in zip(best, found):
                    old[a + better] = new[better]
        split = feature >= 0
        if not split.any():
            break
        of, left, right = todo[split], 2 * todo[split] + 1, 2 * todo[split] + 2
        _, gain, cut, Gt, Ht, GL, HL = (x[split] for x in best)
        G[left], H[left], G[right], H[right] = GL, HL, Gt - GL, Ht - HL
        leaf[of], leaf[left], leaf[right] = False, True, True
        splits.append((of, feature[split], cut.astype(np.int64) - 1, gain, Ht))
        # rows of split nodes move, and those of nodes that may split again stay at work
        go = split[slot]
        at, g, h, n, slot = at[go], g[go[:n]], h[go[:n]], int(go[:n].sum()), (np.cumsum(split) - 1)[slot[go]]
        f, c = feature[split][slot], cut.astype(data.flat.dtype)[slot]
        value = data.flat[at * len(data.size) + f]
        side = 2 * slot + np.where(data.is_cat[f], value != c, value > c)
        child = np.stack([left, right], 1).ravel()
        node[at] = child[side]
        able = H[child] >= 2 * p.min_child_weight - 1e-6
        go = able[side]
        todo = child[able]
        at, g, h, n, slot = at[go], g[go[:n]], h[go[:n]], int(go[:n].sum()), (np.cumsum(able) - 1)[side[go]]
    values = np.where(leaf, -G / (H + p.lam) * p.eta, 0.0)
    return node, values, (splits, leaf)


def _named(values: np.ndarray, splits: tuple) -> tuple[dict, dict]:
    """Splits and leaves of a tree by node, as plain numbers."""
    if not splits:
        return {}, {}
    found, leaf = splits
    rows = {int(o): (int(f), int(c), float(gain), float(h)) for part in found for o, f, c, gain, h in zip(*part)}
    return rows, {int(i): float(values[i]) for i in np.flatnonzero(leaf)}


def _boost_held(rows: DataFrame, binning: Binning, K: int, losses: _Losses, rounds: int, seed: int, record: bool) -> list:
    """``_boost`` with the bins of all rows in every task and one model a task."""
    import pyarrow as pa

    spark, models, names = rows.sparkSession, losses.models, binning.features
    size = [binning.n_bins(f) + 1 for f in names]
    kind = next(t for t, most in (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31)) if max(size) < most)
    keyed = rows.withColumn("key", F.col("key").cast("string"))
    table = _by_key(keyed.select("key", "y", F.coalesce("fold", F.lit(-1)), *[(F.element_at("bins", i + 1) + 1).cast(kind).alias(f"b{i}") for i in range(len(names))]))
    y, fold, *bins = (c.to_numpy() for c in table.columns)
    n = len(y)
    arrays = (y.astype(np.min_scalar_type(K)), fold.astype(np.int16), np.stack(bins, 1), np.array(binning.is_cat, bool), size)
    sent = spark.sparkContext.broadcast(arrays)     # at most HELD_ROWS rows of codes
    shares = sorted({m.params.subsample for m in models}) if any(m.params.subsample < 1 for m in models) else []
    trees, state = [], None
    for first in range(1, rounds + 1, HELD_ROUNDS):
        # the models that take longest begin first
        live = sorted(losses.live(), key=lambda m: -models[m].params.max_depth)
        if not live:
            break
        last = min(rounds, first + HELD_ROUNDS - 1)
        draws = None
        if shares:
            # unit_draw(key, seed, f"row{r}") of every round, as one expression
            u = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda r: unit_draw(F.col("key"), F.concat(F.lit(f"{seed}-row"), r.cast("string"))))
            cols = [F.transform("u", F.lit(s).__gt__).alias(f"s{i}") for i, s in enumerate(shares)]
            found = [c.combine_chunks().flatten().fill_null(False).to_numpy(zero_copy_only=False).reshape(n, last - first + 1)
                     for c in _by_key(keyed.withColumn("u", u).select("key", *cols)).columns]
            draws = {(s, r): np.packbits(d[:, r - first]) for s, d in zip(shares, found) for r in range(first, last + 1)}
        drawn_in = spark.sparkContext.broadcast(draws)

        def run(batches):
            data, drawn_by = _Held(*sent.value), drawn_in.value
            hit = data.y, np.arange(n)
            for b in batches:
                for m, margins in zip(b.column("m").to_pylist(), b.column("mg")):
                    model = models[m]
                    held = data.fold == model.held
                    train = ~held & (data.fold >= 0)
                    mg = np.frombuffer(margins.as_buffer(), np.float64).reshape(n, K).copy() if margins.is_valid else np.zeros((n, K))
                    prob, seen, grown = _softmax(mg), [], []
                    for r in range(first, last + 1):
                        picked = train if drawn_by is None else train & np.unpackbits(drawn_by[model.params.subsample, r], count=n).view(bool)
                        drawn, rest = np.flatnonzero(picked), np.flatnonzero(~picked)
                        yd = data.y[drawn]
                        for k, feats in enumerate(_chosen(names, model, r, K, seed)):
                            p = prob[drawn, k]
                            node, leaf, splits = _held_tree(data, drawn, rest, p - (yd == k), np.maximum(2.0 * p * (1.0 - p), 1e-16), feats, model.params)
                            mg[:, k] += leaf[node]
                            if record:
                                grown.append((r, k, *_named(leaf, splits)))
                        prob = None  # freed before the next is made
                        prob = _softmax(mg)
                        loss = -np.log(np.maximum(prob[hit[1], hit[0]], 1e-15))
                        seen.append([[loss[part].sum(), part.sum()] for part in (train, held)])
                    yield pa.RecordBatch.from_pydict(
                        {"m": pa.array([m], pa.int32()), "mg": pa.array([mg.tobytes() if last < rounds else None], pa.binary()),
                         "seen": pa.array([np.array(seen, float).tobytes()], pa.binary()), "trees": pa.array([pickle.dumps(grown)], pa.binary())})

        slots = spark.createDataFrame(list(enumerate(live)), "slot int, m int")
        task = slots.withColumn("mg", F.lit(None).cast("binary")) if state is None else slots.join(state.select("m", "mg"), "m")
        out = task.repartitionById(len(live), F.col("slot")).select("m", "mg").mapInArrow(run, "m int, mg binary, seen binary, trees binary")
        if last < rounds:
            out = state = cut_lineage(out)
        got = {x["m"]: (np.frombuffer(x["seen"]).reshape(-1, 2, 2), x["trees"]) for x in out.select("m", "seen", "trees").collect()}
        for r in range(first, last + 1):
            losses.note(r, {(m, i): tuple(got[m][0][r - first, i].tolist()) for m in got for i in (0, 1) if got[m][0][r - first, i, 1]})
        if record:
            trees += pickle.loads(got[0][1])
    return trees


def _best_splits(hist: DataFrame, is_cat: list[bool], lam: float, gam: float, mcw: float) -> DataFrame:
    """Best split per (j, node) from the histogram (histogram-sized work), of
    equal gains (to 1e-9) the first feature's lowest bin: j, node, f, bin,
    gain, H and G of the node, GL and HL of the left side."""
    cat = _const_array([int(c) for c in is_cat], "int")
    w_node = Window.partitionBy("j", "node", "f")
    w_cum = w_node.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = (hist.withColumn("Gt", F.sum("G").over(w_node)).withColumn("Ht", F.sum("H").over(w_node))
         .withColumn("isc", F.element_at(cat, F.col("f") + 1) == 1)
         .withColumn("GL", F.when(F.col("isc"), F.col("G")).otherwise(F.sum("G").over(w_cum)))
         .withColumn("HL", F.when(F.col("isc"), F.col("H")).otherwise(F.sum("H").over(w_cum)))
         .withColumn("maxbin", F.max("bin").over(w_node)))
    GR, HR = F.col("Gt") - F.col("GL"), F.col("Ht") - F.col("HL")
    gain = 0.5 * (F.col("GL") ** 2 / (F.col("HL") + lam) + GR ** 2 / (HR + lam)
                  - F.col("Gt") ** 2 / (F.col("Ht") + lam)) - gam
    cand = (h.withColumn("gain", gain)
            .where((F.col("HL") >= mcw) & (HR >= mcw) & (F.col("gain") > 1e-12)
                   & (F.col("isc") | (F.col("bin") < F.col("maxbin")))))
    best = cand.groupBy("j", "node").agg(F.max_by(
        F.struct("f", "bin", "gain", F.col("Ht").alias("H"), F.col("Gt").alias("G"), "GL", "HL"),
        F.struct(F.round("gain", 9), -F.col("f"), -F.col("bin"))).alias("s"))
    return best.select("j", "node", "s.*")


def root_histogram(df: DataFrame, label: str, features: list[str], num_class: int | None = None,
                   categorical: list[str] | None = None, key: str = "v1", bins: int = 64) -> DataFrame:
    """First-round root histogram (all margins 0): class index, feature,
    bin (and level for categories), G, H."""
    binning = fit_binning(df, features, categorical, bins)
    labels = class_labels(df, label, num_class)
    K = len(labels)
    rows = _prepare(df, label, key, binning, labels, F.lit(0), 1).withColumn("u", F.lit(0.0))
    hist = _cells(rows, [_Model(BoostParams(), 1, 0)], [0], K, binning, None, 0, [(k, 0) for k in range(K)],
                  [list(range(len(features)))] * K, False).where("f >= 0")
    names = _const_array(binning.features, "string")
    lv = F.from_json(F.lit(json.dumps([binning.levels.get(f, []) for f in binning.features])),
                     "array<array<string>>")
    return hist.select(
        F.col("j").alias("class_index"), F.element_at(names, F.col("f") + 1).alias("feature"),
        "bin", F.element_at(F.element_at(lv, F.col("f") + 1), F.col("bin") + 1).alias("level"),
        "G", "H")


def _prepare(df: DataFrame, label: str, key: str, binning: Binning, labels: list, fold: Column, M: int) -> DataFrame:
    """(key, y, fold, bins, mg) of ``df``, with margins 0 of M models."""
    lab = _const_array([str(v) for v in labels], "string")
    at = F.array_position(lab, F.col(label).cast("string"))
    y = F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(
        F.lit("label outside the classes: "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))).cast("int")
    return df.select(
        F.col(key).alias("key"), y.alias("y"), fold.cast("int").alias("fold"),
        bin_codes(binning).alias("bins"),
        F.array_repeat(F.lit(0.0), M * len(labels)).alias("mg"))


def class_labels(df: DataFrame, label: str, num_class: int | None) -> list:
    """Class values 0..num_class-1; without a class count (the workload's
    setting is one above the largest label) 0 up to the largest label."""
    if num_class is not None:
        return list(range(num_class))
    mx = df.agg(F.max(F.col(label).cast("int"))).first()[0]
    return list(range(int(mx) + 1)) if mx is not None else [0]


def fit_boosted(df: DataFrame, label: str, features: list[str], params: BoostParams,
                rounds: int, key: str = "v1", num_class: int | None = None,
                categorical: list[str] | None = None, bins: int = 64, seed: int = 22,
                watch: DataFrame | None = None, binning: Binning | None = None,
                ordered: dict[str, list] | None = None) -> BoostModel:
    """Train on ``df``; ``watch`` rows (optional) are scored every round for
    the test column of the history (no effect on training). ``ordered`` names
    ordered categories with their levels in order."""
    binning = binning or fit_binning(df, features, categorical, bins, ordered)
    labels = class_labels(df, label, num_class)
    rows = _prepare(df, label, key, binning, labels, F.lit(0), 1)
    if watch is not None:
        rows = rows.unionByName(_prepare(watch, label, key, binning, labels, F.lit(1), 1))
    history, _, trees = _boost(spread(rows, "key"), binning, len(labels), [_Model(params, 1, 0)], rounds, seed, patience=None, record=True)
    return BoostModel(binning, labels, params, trees, history[0], key)


def cross_validate(df: DataFrame, label: str, features: list[str], grid: DataFrame,
                   rounds: int, k: int = 5, patience: int = 10, key: str = "v1",
                   num_class: int | None = None, categorical: list[str] | None = None,
                   bins: int = 64, seed: int = 22, ordered: dict[str, list] | None = None,
                   together: int | None = None) -> DataFrame:
    """k-fold CV of every grid row. The folds and classes of ``together`` grid
    rows train in the same jobs (by default as many as keep a row's margins
    within ``MAX_MARGINS``); the result doesn't depend on it. A grid row stops
    after ``patience`` rounds without a better mean test log-loss.

    Returns paramsNum, bestIteration, bestCvrmse (train log-loss at the best
    round), bestCvrmse_test, eta, max_depth, subsample, colsample_bytree,
    rounds (trained).
    """
    from reviewlab.operators.sampling import folds as fold_col
    binning = fit_binning(df, features, categorical, bins, ordered)
    labels = class_labels(df, label, num_class)
    K = len(labels)
    chosen = grid.orderBy("paramsNum").collect()   # the grid: a few rows
    together = together or max(1, MAX_MARGINS // (k * K))
    base = cut_lineage(spread(_prepare(fold_col(df, key, k, seed), label, key, binning, labels, F.col("fold"), 1).drop("mg"), "key"))
    out = []
    for i in range(0, len(chosen), together):
        part = chosen[i:i + together]
        models = [_Model(BoostParams(eta=g["eta"], max_depth=int(g["max_depth"]), subsample=g["subsample"],
                                     colsample_bytree=g["colsample_bytree"]), fold, n) for n, g in enumerate(part) for fold in range(k)]
        history, best, _ = _boost(base, binning, K, models, rounds, seed, patience=patience)
        for n, g in enumerate(part):
            h = {r: (a, b) for r, a, b in history[n]}
            # without any better round than none (a loss that isn't a number), the first
            train, test = h[max(1, best[n])]
            out.append((int(g["paramsNum"]), max(1, best[n]), train, test, float(g["eta"]), int(g["max_depth"]),
                        float(g["subsample"]), float(g["colsample_bytree"]), len(h)))
    return df.sparkSession.createDataFrame(
        out, "paramsNum int, bestIteration int, bestCvrmse double, bestCvrmse_test double, "
             "eta double, max_depth int, subsample double, colsample_bytree double, rounds int")


def param_grid(spark, **lists) -> DataFrame:
    """All combinations of the value lists, the first argument varying
    fastest, numbered 1.. as ``paramsNum`` (rows made by explodes)."""
    names = list(lists)
    df = spark.range(1).select(F.lit(1).alias("__one"))
    for n in reversed(names):
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in lists[n]])).alias(f"__i_{n}", n))
    num = F.lit(0)
    stride = 1
    for n in names:
        num = num + F.col(f"__i_{n}") * stride
        stride *= len(lists[n])
    return df.select((num + 1).cast("int").alias("paramsNum"), *names)


def predict_boosted(model: BoostModel, df: DataFrame, keep: list[str] | None = None,
                    out: str = "prediction", rounds: int | None = None) -> DataFrame:
    """Predicted class of each row: trees applied batch-wise with numpy
    (``mapInPandas``; the trees, a bounded table, travel with the task)."""
    keep = keep or [model.key]
    depth = model.params.max_depth
    NN = 2 ** (depth + 1) - 1
    K = len(model.labels)
    use = [t for t in model.trees if rounds is None or t[0] <= rounds]
    T_ = len(use)
    feat = np.full((T_, NN), -1, dtype=np.int64)
    thr = np.zeros((T_, NN), dtype=np.int64)
    leaf = np.zeros((T_, NN))
    cls = np.zeros(T_, dtype=np.int64)
    for t, (_, k, splits, leaves) in enumerate(use):
        cls[t] = k
        for n, (f, b, _, _) in splits.items():
            feat[t, n], thr[t, n] = f, b
        for n, w in leaves.items():
            leaf[t, n] = w
    iscat = np.array(model.binning.is_cat, dtype=bool)
    labels = model.labels

    def score(batches):
        for pdf in batches:
            bins = np.stack(pdf["__bins"].to_numpy()) if len(pdf) else np.zeros((0, len(iscat)), np.int64)
            n = len(pdf)
            mg = np.zeros((n, K))
            rows = np.arange(n)
            for t in range(T_):
                node = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    f = feat[t, node]
                    live = f >= 0
                    fb = bins[rows, np.where(live, f, 0)]
                    left = np.where(iscat[np.where(live, f, 0)], fb == thr[t, node], fb <= thr[t, node])
                    node = np.where(live, np.where(left, 2 * node + 1, 2 * node + 2), node)
                mg[:, cls[t]] += leaf[t, node]
            pred = mg.argmax(axis=1) if n else np.zeros(0, dtype=np.int64)
            res = pdf.drop(columns=["__bins"])
            res[out] = [labels[i] for i in pred]
            yield res

    src = df.select(*keep, bin_codes(model.binning).alias("__bins"))
    fields = [f for f in src.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(out, T.IntegerType())])
    return src.mapInPandas(score, schema)


def importance(model: BoostModel, spark=None) -> DataFrame:
    """Per feature: share of total gain, cover and split count over all
    trees (each share sums to 1)."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    agg: dict[int, list] = {}
    for _, _, splits, _ in model.trees:
        for f, _, gain, cover in splits.values():
            a = agg.setdefault(f, [0.0, 0.0, 0])
            a[0] += gain
            a[1] += cover
            a[2] += 1
    tg = sum(a[0] for a in agg.values()) or 1.0
    tc = sum(a[1] for a in agg.values()) or 1.0
    tn = sum(a[2] for a in agg.values()) or 1
    rows = [(model.binning.features[f], a[0] / tg, a[1] / tc, a[2] / tn) for f, a in agg.items()]
    return spark.createDataFrame(rows, "feature string, gain double, cover double, frequency double")


def top_features(imp: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` features with the largest gain share (ties by name)."""
    return imp.orderBy(F.desc("gain"), F.asc("feature")).limit(n)
