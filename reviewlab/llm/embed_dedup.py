"""Embedding near-duplicates by int8 tile products (operator 2).

Vectors of one label are cut into tiles. A pair of tiles is multiplied in
int8: each unit vector x is s*q + e with integer q in -127..127, so that

    |x.y - s_x s_y (q_x.q_y)| <= |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|

where the norms of the errors e are measured for each vector. Only pairs whose
product plus that bound reaches the threshold are computed again in double
precision; no other pair can reach it. The integer products are summed in
float32, which is exact while 127^2 * width < 2^24, so long vectors are
multiplied in pieces of 1024 components.

Tiles hold vectors that are near the same pivot (a bounded sample of the
vectors). From the largest angle between a pivot and its vectors follows which
pairs of pivots can't have a link (triangle inequality on the sphere); their
tiles are never met. Pivots change the work and not the result.

A pair of tiles returns link counts and a spanning forest of its links, never
the pairs, so a group of near copies costs rows in proportion to its vectors.
Equal vectors of a label are one node that counts as many."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import saved
from reviewlab.llm.components import components

#: vectors in a tile, about
TILE = 2048
#: pivots at most; a fixed bound, so that pairs of pivots may be broadcast
MAX_PIVOTS = 128
_PIECE = 1024
_SLACK = 1e-6  # covers rounding of the float64 norms and scales, generously


def usable(vector: str) -> Column:
    """True for a vector with components, all finite, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def unit_rows(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision scaled by their largest component (so that no
    square overflows or vanishes), and their norms."""
    x = flat.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def quantised(x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: q (float32 with int8 values), scale, length of s*q,
    length of the error."""
    u = x / norm[:, None]
    s = np.abs(u).max(1) / 127.0
    q = np.rint(u / s[:, None])
    e = u - s[:, None] * q
    return q.astype(np.int8).astype(np.float32), s, s * np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", e, e))


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` whose cosine is at least
    ``threshold`` in double precision."""
    (xa, na), (xb, nb) = unit_rows(a), unit_rows(b)
    qa, sa, la, ea = quantised(xa, na)
    qb, sb, lb, eb = quantised(xb, nb)
    dots = np.zeros((len(a), len(b)), np.float64 if a.shape[1] > _PIECE else np.float32)
    for k in range(0, a.shape[1], _PIECE):
        dots += qa[:, k:k + _PIECE] @ qb[:, k:k + _PIECE].T
    out_i, out_j = [], []
    step = max(1, (1 << 21) // max(1, len(b)))
    for k in range(0, len(a), step):  # bounded memory for the bounds
        r = slice(k, k + step)
        upper = dots[r] * np.outer(sa[r], sb) + np.outer(la[r], eb) + np.outer(ea[r], lb + eb)
        i, j = np.nonzero(upper >= threshold - _SLACK)
        for p in range(0, len(i), 1 << 16):
            ii, jj = i[p:p + (1 << 16)] + k, j[p:p + (1 << 16)]
            cos = np.einsum("ij,ij->i", xa[ii], xb[jj]) / (na[ii] * nb[jj])
            ok = cos >= threshold
            out_i.append(ii[ok])
            out_j.append(jj[ok])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of n nodes."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def _tile_product(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r] for k in batch.schema.names}
                ids = [np.asarray(row[k].values, np.int64) for k in ("ids_a", "ids_b")]
                n = [np.asarray(row[k].values, np.int64) for k in ("n_a", "n_b")]
                vecs = [np.asarray(row[k].values, np.float32).reshape(len(ids[s]), -1) for s, k in enumerate(("vecs_a", "vecs_b"))]
                same = row["same"].as_py()
                i, j = linked_pairs(*vecs, threshold)
                if same:
                    up = i < j
                    i, j = i[up], j[up]
                    ids, n, offset = [ids[0]], [n[0]], 0
                else:
                    offset = len(ids[0])
                j = j + offset
                all_ids, all_n = np.concatenate(ids), np.concatenate(n)
                links = np.bincount(i, all_n[j], len(all_ids)) + np.bincount(j, all_n[i], len(all_ids))
                root = forest(i, j, len(all_ids))
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(all_ids[at]), pa.array(links[at].astype(np.int64)), pa.array(all_ids[root[at]])],
                    ["node", "links", "near"])
    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``
    (vec_id, embedding, label).

    Two vectors are compared only when their labels are equal and not null and
    their widths are equal. Null, empty or zero vectors and vectors with null
    or non-finite components link with nothing; they and unlinked vectors are
    components of their own. Repeated rows are vectors of their own that link
    with each other, and share a vec_id. Null vec_id: the row is kept, is
    linked and counted, but no component is named after it unless it has
    nothing else. An empty table gives no rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<float>").alias("v"), F.col("label").cast("string").alias("label"))
    good = rows.where(usable("v") & F.col("label").isNotNull())
    # equal vectors of a label are one node; the number is fixed by writing it
    nodes = saved(good.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
                  .select(F.monotonically_increasing_id().alias("node"), "label", "v", "low", "n"), "nodes")
    tiles = saved(_tiles(nodes, threshold, tile), "tiles")
    found = saved(_products(tiles, threshold), "products")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("near").alias("v")))
    rooted = (nodes.select("node", "low").join(roots, "node", "left")
              .select("node", "low", F.coalesce("root", "node").alias("root")))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(low, "root").select("node", "component_id")
    per_node = saved(nodes.join(named, "node").join(links, "node", "left")
                     .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "answers")
    joined = good.join(per_node, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = (rows.where(~F.coalesce(usable("v") & F.col("label").isNotNull(), F.lit(False)))
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tiles(nodes: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Tiles of nodes: (label, width, cell, tile, ids, ns, vecs), with the
    largest angle of the cell's vectors to its pivot and the cells that they
    may link to (``reach``)."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("label", F.size("v").alias("width")).count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    # few enough pivots that a cell of the largest label still fills some tiles
    n_pivots = max(1, min(MAX_PIVOTS, most // (4 * tile)))
    pivots = [r["v"] for r in nodes.select("v", F.xxhash64(F.lit("pivot"), "v").alias("h"))
              .orderBy("h").limit(n_pivots).collect()] if n_pivots > 1 else []
    units = [p / np.linalg.norm(p) for p in (np.asarray(v, np.float64) for v in pivots)]
    width = F.size("v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, angles = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, math.pi)
            lists = b.column("v")
            widths = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten(), np.float32)
            at = np.concatenate([[0], np.cumsum(widths)])
            for w in np.unique(widths):
                rows = np.flatnonzero(widths == w)
                same = [(k, p) for k, p in enumerate(units) if len(p) == w]
                if same:
                    x, n = unit_rows(flat[at[rows][:, None] + np.arange(w)])
                    cos = (x @ np.stack([p for _, p in same]).T) / n[:, None]
                    best = cos.argmax(1)
                    cells[rows] = np.array([k for k, _ in same], np.int32)[best]
                    angles[rows] = np.arccos(np.clip(cos[np.arange(len(rows)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("n"), lists, pa.array(cells), pa.array(angles)],
                                             ["node", "label", "n", "v", "cell", "angle"])

    placed = saved(nodes.select("node", "label", "n", "v")
                   .mapInArrow(place, "node long, label string, n long, v array<float>, cell int, angle double"), "placed")
    full = (placed.groupBy("label", width.alias("width"), "cell")
            .agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius")))
    cut = full.select("label", "width", "cell", "radius", F.ceil(F.col("size") / tile).cast("int").alias("cuts"))
    dealt = (placed.withColumn("width", width).join(cut, ["label", "width", "cell"])
             .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")))
    packed = (dealt.groupBy("label", "width", "cell", "tile")
              .agg(F.sort_array(F.collect_list(F.struct("node", "n", "v"))).alias("x"), F.first("radius").alias("radius"), F.first("cuts").alias("cuts"))
              .select("label", "width", "cell", "tile", "cuts", "radius", F.col("x.node").alias("ids"), F.col("x.n").alias("ns"), F.flatten("x.v").alias("vecs")))
    if len(units) < 2:
        return packed.withColumn("reach", F.array("cell"))
    # cells whose pivots are within their radii and the threshold's angle
    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    gaps = [(i, j, float(np.arccos(np.clip(units[i] @ units[j], -1, 1)))) for i in range(len(units)) for j in range(i, len(units))
            if len(units[i]) == len(units[j])]
    gap = F.broadcast(spark.createDataFrame(gaps, "cell int, other int, gap double"))  # MAX_PIVOTS^2 rows at most
    radii = cut.select("label", "width", F.col("cell").alias("other"), F.col("radius").alias("other_radius"))
    reach = (cut.join(gap, "cell").join(radii, ["label", "width", "other"])
             .where(F.col("gap") <= F.col("radius") + F.col("other_radius") + limit)
             .groupBy("label", "width", "cell").agg(F.sort_array(F.collect_list("other")).alias("reach")))
    return packed.join(reach, ["label", "width", "cell"], "left").withColumn("reach", F.coalesce("reach", F.array("cell")))


def _products(tiles: DataFrame, threshold: float) -> DataFrame:
    """(node, links, near): for each pair of tiles that may have links, how
    many vectors each linked node has there, and a node that it is joined to."""
    names = tiles.select("label", "width", "cell", "tile", "reach")
    other = tiles.select("label", "width", F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"))
    pairs = (names.select("label", "width", "cell", "tile", F.explode("reach").alias("cell_b"))
             .join(other, ["label", "width", "cell_b"])
             .where("cell < cell_b or (cell = cell_b and tile <= tile_b)"))
    a = tiles.select("label", "width", "cell", "tile", F.col("ids").alias("ids_a"), F.col("ns").alias("n_a"), F.col("vecs").alias("vecs_a"))
    b = tiles.select("label", "width", F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"),
                     F.col("ids").alias("ids_b"), F.col("ns").alias("n_b"), F.col("vecs").alias("vecs_b"))
    same = ((F.col("cell") == F.col("cell_b")) & (F.col("tile") == F.col("tile_b"))).alias("same")
    met = (saved(pairs, "pairs").join(a, ["label", "width", "cell", "tile"]).join(b, ["label", "width", "cell_b", "tile_b"])
           .select("ids_a", "n_a", "vecs_a", "ids_b", "n_b", "vecs_b", same))
    return met.mapInArrow(_tile_product(threshold), "node long, links long, near long")
