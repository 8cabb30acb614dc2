"""Classification tree with cost-complexity pruning, grown without a depth cap.

Rows become bin codes (``boost.fit_binning``), and equal rows one row with a
count. The tree grows level by level: one pass moves rows down the tree so far
and sums class counts by node and bin in every task, one shuffle brings the
cells of a node together, where its best Gini split is found; a second pass of
the same kind counts which way the rows of each other bin go, for surrogate
splits. Only splits come to the driver.

A node is grown on only while its subtree can still pay for itself: a branch
stays if its error reduction per extra leaf is more than ``cp`` x root error,
and no reduction is larger than the node's own error. So a node of error at
most cp x root error is a leaf, and as the errors of a level sum to the root's
at most, a level has under 1 / cp nodes to split, whatever the data; that
bounds the model and needs no cap on depth.

A split sends a row by its feature's value; where that is missing, or a level
the node hasn't seen, by the first of up to ``SURROGATES`` surrogate splits
whose feature has a value, and else with the majority. Weakest-link pruning at
``cp`` follows (Breiman et al. 1984; the error is the resubstitution
misclassification count, the ``cp`` convention of the workload)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlab.operators.boost import Binning, bin_codes, fit_binning
from reviewlab.operators.util import cut_lineage, small_list

#: surrogate splits of a node at most
SURROGATES = 5
#: levels of a category in a node up to which all two-way partitions are tried
EXHAUSTIVE = 20
#: count cells that a task holds at once
MAX_CELLS = 4_000_000


@dataclass
class Split:
    feature: int
    left: list                # codes that go left
    right: list


@dataclass
class TreeModel:
    binning: Binning
    labels: list              # class values as text, by index
    nodes: list               # dicts, id order (a child's id is above its parent's), with pruning applied
    label: str
    numeric_label: bool = False


def prune(nodes: list[dict], cp: float) -> list[dict]:
    """Weakest-link pruning at ``cp``, from the last node up and down again;
    a child's id is above its parent's."""
    by_id = {n["id"]: n for n in nodes}
    down = sorted(by_id)
    for n in nodes:
        counts = n["impurityStats"]
        n["n"] = float(sum(counts))
        n["err"] = n["n"] - max(counts) if counts else 0.0
        n["cls"] = max(range(len(counts)), key=lambda k: (counts[k], -k)) if counts else 0
    limit = cp * by_id[down[0]]["err"]
    for i in reversed(down):
        n = by_id[i]
        n["sub_err"], n["sub_leaves"], n["collapsed"] = n["err"], 1, False
        if n["leftChild"] >= 0:
            kids = [by_id[n["leftChild"]], by_id[n["rightChild"]]]
            sub_err, leaves = (sum(k[x] for k in kids) for x in ("sub_err", "sub_leaves"))
            n["collapsed"] = (n["err"] - sub_err) / (leaves - 1) <= limit
            if not n["collapsed"]:
                n["sub_err"], n["sub_leaves"] = sub_err, leaves
    root = by_id[down[0]]
    root["depth"], root["parent"], root["kept"] = 0, None, True
    for i in down:
        n = by_id[i]
        n["pruned_leaf"] = n["kept"] and (n["leftChild"] < 0 or n["collapsed"])
        if n["leftChild"] >= 0:
            for kid in (by_id[n["leftChild"]], by_id[n["rightChild"]]):
                kid["depth"], kid["parent"] = n["depth"] + 1, i
                kid["kept"] = n["kept"] and not n["collapsed"]
    return nodes


# ------------------------------------------------------------ codes and moves

@dataclass
class _Slots:
    """Places of the features' codes in one row of cells: code c of feature f
    is at ``offset[f] + c + 1`` (a missing number is code -1, a missing or
    unknown category the last code)."""
    is_cat: np.ndarray
    size: list[int]
    offset: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.offset = np.cumsum([0] + self.size[:-1])

    @classmethod
    def of(cls, b: Binning) -> _Slots:
        return cls(np.array(b.is_cat, bool), [b.n_bins(f) + 1 for f in b.features])

    def codes(self, f: int) -> range:
        """Codes of a feature that are values, in order."""
        return range(self.size[f] - 2 if self.is_cat[f] else self.size[f] - 1)


class _Walk:
    """A tree as arrays, for moving many rows at once."""

    def __init__(self, nodes: list[dict], slots: _Slots, leaf: str | None = None) -> None:
        n = len(nodes)
        self.child = np.full((n, 2), -1, np.int64)
        self.feat, self.at = np.full((n, 1 + SURROGATES), -1, np.int64), np.zeros((n, 1 + SURROGATES), np.int64)
        self.default = np.zeros(n, np.int64)
        sides = [np.zeros(0, np.int8)]
        place = 0
        for d in nodes:
            i = d["id"]
            if d["leftChild"] >= 0 and not (leaf and d[leaf]):
                self.child[i] = d["leftChild"], d["rightChild"]
            self.default[i] = d.get("majority", 0)
            for r, s in enumerate(d.get("rules", [])):
                side = np.zeros(slots.size[s.feature], np.int8)  # by code + 1: 1 left, 2 right, 0 unknown
                side[np.array(s.left, int) + 1], side[np.array(s.right, int) + 1] = 1, 2
                self.feat[i, r], self.at[i, r] = s.feature, place
                sides.append(side)
                place += len(side)
        self.sides = np.concatenate(sides)

    def side(self, node: np.ndarray, x: np.ndarray, rule: int) -> np.ndarray:
        """Where a rule of their node sends rows: 1 left, 2 right, 0 unknown."""
        f, out = self.feat[node, rule], np.zeros(len(node), np.int8)
        ok = np.flatnonzero(f >= 0)
        out[ok] = self.sides[self.at[node[ok], rule] + x[ok, f[ok]] + 1]
        return out

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Node at which each row ends."""
        node = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(self.child[node, 0] >= 0)
        while len(todo):
            at, rows = node[todo], x[todo]
            way = np.zeros(len(todo), np.int8)
            for r in range(self.feat.shape[1]):
                open_ = np.flatnonzero(way == 0)
                if not len(open_):
                    break
                way[open_] = self.side(at[open_], rows[open_], r)
            way = np.where(way > 0, way - 1, self.default[at])
            node[todo] = self.child[at, way]
            todo = todo[self.child[node[todo], 0] >= 0]
        return node


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _counted(rows: DataFrame, slots: _Slots, walk: _Walk, todo: list[int], classes: int, surrogate: bool) -> DataFrame:
    """(node, cell, k, n): rows of the nodes ``todo`` by code and class, with
    cell -1 for the whole node; or, for surrogates, by code and the side (0, 1)
    to which their node's split sends them. One partial sum a task."""
    sent = rows.sparkSession.sparkContext.broadcast(walk)
    K, total = 2 if surrogate else classes, sum(slots.size)
    offset, n_nodes = slots.offset, len(walk.child)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = sent.value
        place = np.full(n_nodes, -1, np.int64)
        place[todo] = np.arange(len(todo))
        acc = np.zeros((len(todo), total + 1, K))
        for b in batches:
            if not b.num_rows:
                continue
            x, n = _matrix(b.column("x"), b.num_rows), b.column("n").to_numpy().astype(float)
            node, k = walk.leaf(x), b.column("y").to_numpy().astype(np.int64)
            ok = place[node] >= 0
            if surrogate:
                k = walk.side(node, x, 0).astype(np.int64) - 1
                ok &= k >= 0
            x, n, k, at = x[ok], n[ok], k[ok], place[node[ok]]
            cell = np.column_stack([x + offset + 2, np.zeros(len(x), np.int64)])  # place 0: the whole node
            flat = ((at[:, None] * (total + 1) + cell) * K + k[:, None]).ravel()
            acc += np.bincount(flat, np.repeat(n, cell.shape[1]), acc.size).reshape(acc.shape)
        node, cell, k = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(todo, np.int32)[node]), pa.array((cell - 1).astype(np.int32)), pa.array(k.astype(np.int32)),
                                          pa.array(acc[node, cell, k].astype(np.int64))], ["node", "cell", "k", "n"])

    return (rows.mapInArrow(run, "node int, cell int, k int, n long").repartition("node")
            .groupBy("node", "cell", "k").agg(F.sum("n").alias("n")))


def _node_cells(table: pa.Table, total: int, K: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts by cell and class, counts of the whole node)."""
    out = np.zeros((total + 1, K))
    np.add.at(out, (table.column("cell").to_numpy() + 1, table.column("k").to_numpy()), table.column("n").to_numpy())
    return out[1:], out[0]


# ------------------------------------------------------------ splits of a node

def _partitions(c: np.ndarray, cat: bool, exhaustive: int) -> Iterator[tuple[np.ndarray, object]]:
    """Candidate splits of values in order with class counts ``c``: (counts of
    the left sides, function from a candidate's place to its left values)."""
    n = len(c)
    if not cat:
        yield np.cumsum(c, 0)[:-1], lambda i: list(range(i + 1))
    elif n <= exhaustive:  # all partitions, the first value on the left
        left = c[:1]
        for row in c[1:]:
            left = np.concatenate([left, left + row])
        yield left[:-1], lambda m: [0] + [j for j in range(1, n) if m >> (j - 1) & 1]
    else:  # values in the order of each class's share, as is exact for two classes
        share = c / c.sum(1, keepdims=True)
        for k in range(c.shape[1]):
            order = np.argsort(share[:, k], kind="stable")

            def left_of(i: int, order: np.ndarray = order) -> list[int]:
                side = order[:i + 1] if 0 in order[:i + 1] else order[i + 1:]
                return sorted(side.tolist())

            yield np.cumsum(c[order], 0)[:-1], left_of


def best_split(cells: np.ndarray, slots: _Slots, min_bucket: int, exhaustive: int = EXHAUSTIVE) -> tuple[float, Split] | None:
    """The split of largest Gini gain, rounded to six digits; of equal ones the
    first feature's first. A value that is missing counts for neither side."""
    best = None
    for f in range(len(slots.size)):
        codes = slots.codes(f)
        c = cells[slots.offset[f] + 1:slots.offset[f] + 1 + len(codes)]
        seen = np.flatnonzero(c.sum(1))
        if len(seen) < 2:
            continue
        c = c[seen]
        whole = c.sum(0)
        for left, left_of in _partitions(c, slots.is_cat[f], exhaustive):
            nl = left.sum(1)
            nr = whole.sum() - nl
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left ** 2).sum(1) / nl + ((whole - left) ** 2).sum(1) / nr - (whole ** 2).sum() / whole.sum()
            gain = np.where((nl >= min_bucket) & (nr >= min_bucket), np.round(gain, 6), 0.0)
            i = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[i] > 0 and (best is None or gain[i] > best[0]):
                mine = left_of(i)
                if slots.is_cat[f]:
                    here = set(mine)
                    split = Split(f, [int(seen[j]) for j in mine], [int(v) for j, v in enumerate(seen) if j not in here])
                else:  # values that the node hasn't seen go by their order
                    cut = int(seen[mine[-1]])
                    split = Split(f, list(codes[:cut + 1]), list(codes[cut + 1:]))
                best = float(gain[i]), split
    return best


def surrogate_splits(sides: np.ndarray, whole: np.ndarray, slots: _Slots, primary: int) -> list[Split]:
    """Splits of other features that agree with the primary one on more rows
    than the majority does, the best first, with at least two rows a side."""
    found = []
    for f in range(len(slots.size)):
        if f == primary:
            continue
        codes = slots.codes(f)
        c = sides[slots.offset[f] + 1:slots.offset[f] + 1 + len(codes)]
        seen = np.flatnonzero(c.sum(1))
        if len(seen) < 2:
            continue
        if slots.is_cat[f]:
            to_left = c[:, 0] > c[:, 1]
            left, right = [int(i) for i in seen if to_left[i]], [int(i) for i in seen if not to_left[i]]
        else:
            upto = np.cumsum(c, 0)[seen[:-1]]
            rest = c.sum(0) - upto
            same, turned = upto[:, 0] + rest[:, 1], upto[:, 1] + rest[:, 0]
            i = int(np.argmax(np.maximum(same, turned)))
            low, high = list(codes[:seen[i] + 1]), list(codes[seen[i] + 1:])
            left, right = (low, high) if same[i] >= turned[i] else (high, low)
        agree = c[left, 0].sum() + c[right, 1].sum()
        # rows without a value of f go with the majority
        lost = whole - c.sum(0)
        agree += lost[int(whole[1] > whole[0])]
        if agree > whole.max() and min(c[left].sum(), c[right].sum()) >= 2:
            found.append((-agree, f, Split(f, left, right)))
    return [s for _, _, s in sorted(found, key=lambda t: t[:2])[:SURROGATES]]


# ----------------------------------------------------------------------- tree

def fit_tree(df: DataFrame, label: str, features: list[str], cp: float = 0.001,
             max_depth: int | None = None, min_instances: int = 7, min_split: int = 20, max_bins: int = 64,
             categorical: list[str] | None = None, ordered: dict[str, list] | None = None,
             exhaustive: int = EXHAUSTIVE) -> TreeModel:
    """Gini tree of ``label`` on ``features``, pruned at ``cp``.

    A node of fewer than ``min_split`` rows is not split, nor so that a side
    has fewer than ``min_instances`` (of those whose value is there). Rows with
    a null label are left out. ``cp`` must be positive, or ``max_depth`` given,
    as one of them bounds the model. A category of more than ``exhaustive``
    levels in a node is cut in the order of each class's share in place of all
    partitions."""
    if cp <= 0 and max_depth is None:
        raise ValueError("cp must be positive where no depth is given")
    known = df.where(F.col(label).isNotNull())
    binning = fit_binning(known, features, categorical, bins=max_bins, ordered=ordered)
    slots = _Slots.of(binning)
    labels = [str(v) for v in small_list(known.select(F.col(label).cast("string").alias(label)), label)]
    if not labels:
        raise ValueError(f"{label}: no row has a value")
    y = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label).cast("string")) - 1
    rows = known.select(bin_codes(binning).alias("x"), y.cast("int").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows)
    K, total = len(labels), sum(slots.size)
    fresh = lambda i: dict(id=i, leftChild=-1, rightChild=-1)
    nodes, todo, depth, limit = [fresh(0)], [0], 0, 0.0
    while todo:
        walk = _Walk(nodes, slots)
        stop = max_depth is not None and depth >= max_depth
        floor = limit

        def choose(table: pa.Table) -> pa.Table:
            cells, whole = _node_cells(table, total, K)
            open_ = not stop and whole.sum() >= min_split and whole.sum() - whole.max() > floor
            s = best_split(cells, slots, min_instances, exhaustive) if open_ else None
            gain, s = s or (0.0, Split(-1, [], []))
            return pa.table({"node": table.column("node")[:1].cast(pa.int32()), "counts": pa.array([whole], pa.list_(pa.float64())), "gain": pa.array([gain]),
                             "feature": pa.array([s.feature], pa.int32()), "left": pa.array([s.left], pa.list_(pa.int32())),
                             "right": pa.array([s.right], pa.list_(pa.int32()))})

        split = []
        for part in _parts(todo, total * K):
            found = (_counted(rows, slots, walk, part, K, False).groupBy("node")
                     .applyInArrow(choose, "node int, counts array<double>, gain double, feature int, left array<int>, right array<int>"))
            for r in found.collect():  # one row a node of the level
                d = nodes[r["node"]]
                d["impurityStats"] = list(r["counts"])
                if r["feature"] >= 0:
                    d["gain"], d["rules"] = r["gain"], [Split(r["feature"], r["left"], r["right"])]
                    split.append(r["node"])
        if not depth:
            limit = cp * (sum(nodes[0]["impurityStats"]) - max(nodes[0]["impurityStats"]))
        if split:
            walk = _Walk(nodes, slots)
            first = {i: nodes[i]["rules"][0].feature for i in split}

            def agree(table: pa.Table) -> pa.Table:
                sides, whole = _node_cells(table, total, 2)
                node = table.column("node")[0].as_py()
                s = [Split(-1, [], [])] + surrogate_splits(sides, whole, slots, first[node])
                return pa.table({"node": pa.array([node] * len(s), pa.int32()), "rank": pa.array(range(len(s)), pa.int32()),
                                 "majority": pa.array([int(whole[1] > whole[0])] * len(s), pa.int32()),
                                 "feature": pa.array([v.feature for v in s], pa.int32()), "left": pa.array([v.left for v in s], pa.list_(pa.int32())),
                                 "right": pa.array([v.right for v in s], pa.list_(pa.int32()))})

            for part in _parts(split, total * 2):
                found = (_counted(rows, slots, walk, part, K, True).groupBy("node")
                         .applyInArrow(agree, "node int, rank int, majority int, feature int, left array<int>, right array<int>"))
                for r in sorted(found.collect(), key=lambda r: (r["node"], r["rank"])):  # SURROGATES + 1 rows a node
                    if r["rank"]:
                        nodes[r["node"]]["rules"].append(Split(r["feature"], r["left"], r["right"]))
                    nodes[r["node"]]["majority"] = r["majority"]
        todo = []
        for i in sorted(split):
            nodes[i]["leftChild"], nodes[i]["rightChild"] = len(nodes), len(nodes) + 1
            todo += [len(nodes), len(nodes) + 1]
            nodes += [fresh(len(nodes)), fresh(len(nodes) + 1)]
        depth += 1
    numeric = all(v.lstrip("-").isdigit() for v in labels)
    return TreeModel(binning, labels, prune(nodes, cp), label, numeric)


def _parts(nodes: list[int], width: int) -> Iterator[list[int]]:
    """Nodes of a level in parts whose cells a task can hold."""
    most = max(1, MAX_CELLS // width)
    for i in range(0, len(nodes), most):
        yield nodes[i:i + most]


def predict_tree(model: TreeModel, df: DataFrame, out: str = "prediction",
                 keep: list[str] | None = None) -> DataFrame:
    """Class of each row's pruned leaf (a narrow map)."""
    keep = keep or df.columns
    walk = df.sparkSession.sparkContext.broadcast(_Walk(model.nodes, _Slots.of(model.binning), "collapsed"))
    names = np.array([model.labels[n["cls"]] for n in model.nodes], dtype=object)

    @F.pandas_udf("string")
    def leaf_class(x: pd.Series) -> pd.Series:
        return pd.Series(names[walk.value.leaf(np.stack(x.to_numpy()))] if len(x) else [], dtype=object)

    pred = leaf_class(bin_codes(model.binning))
    return df.select(*keep, (pred.cast("int") if model.numeric_label else pred).alias(out))


def _rule(binning: Binning, s: Split, left: bool) -> str:
    name, codes = binning.features[s.feature], s.left if left else s.right
    if binning.is_cat[s.feature]:
        return f"{name} in {{{', '.join(map(str, (binning.levels[name][c] for c in codes)))}}}"
    low = min(codes) == 0
    cut = max(codes) if low else min(codes) - 1
    at = binning.ordered[name][cut] if name in binning.ordered else f"{binning.thresholds[name][cut]:g}"
    return f"{name} {'<=' if low else '>'} {at}"


def tree_nodes(model: TreeModel, spark=None, grown: bool = False) -> DataFrame:
    """Node listing of the pruned tree (``grown``: before pruning): id, parent,
    depth, rule, n, loss, class, class shares, leaf, gain of its split, rules
    of its surrogates (of the left side)."""
    spark = spark or SparkSession.getActiveSession()
    by_id = {n["id"]: n for n in model.nodes}
    rows = []
    for n in model.nodes:
        if not (grown or n["kept"]):
            continue
        rule = "root"
        if n["parent"] is not None:
            p = by_id[n["parent"]]
            rule = _rule(model.binning, p["rules"][0], n["id"] == p["leftChild"])
        leaf = n["leftChild"] < 0 if grown else n["pruned_leaf"]
        others = [] if leaf else [_rule(model.binning, s, True) for s in n["rules"][1:]]
        rows.append((n["id"], n["parent"], n["depth"], rule, int(n["n"]), int(n["err"]), model.labels[n["cls"]],
                     [c / n["n"] if n["n"] else 0.0 for c in n["impurityStats"]], bool(leaf), None if leaf else float(n["gain"]), others))
    return spark.createDataFrame(
        rows, "id int, parent int, depth int, rule string, n bigint, loss bigint, "
              "class string, shares array<double>, leaf boolean, gain double, surrogates array<string>")
