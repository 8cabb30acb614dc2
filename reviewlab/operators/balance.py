"""Rebalancing rare classes with synthetic rows (SMOTE, Chawla et al. 2002).

For a minority class x against a majority class: every minority row gets
``over/100`` synthetic rows, each placed at a random point between the row
and one of its ``k`` nearest minority neighbours (numeric columns are
interpolated; a categorical column takes the value of either parent, as in
SMOTE-NC); then ``under/100`` majority rows per synthetic row are drawn
without replacement (with copies when there are too few).

Nearest neighbours are exact, without comparing all pairs:

* distance: the root of the squared gaps of the numeric columns, each scaled
  by its range, plus ``penalty`` for each category that differs;
* identical feature rows are first collapsed into one point with a count
  (a value held by a third of the rows is one point, not a hot key);
* points are indexed by their combination of categories: first a point meets
  those of its own combination, then those that differ in one category (for
  each category, an equi-join on all the others), then in two, and so on. A
  point is final when its k-th distance is below that of the mildest mismatch
  not yet visited, and only open points go on;
* within a combination points are placed in grid cells of side ``s``; each
  point still open is compared with the points of its 3^d neighbouring cells
  only (an equi-join on the cell key). Cells hold every point up to ``s`` away
  in the numeric columns; points whose k-th distance needs more repeat with
  cells three times wider (at the coarsest level one cell holds the whole
  combination).

All draws are md5 hashes of (seed, key, copy number), so a rerun or a
recomputed partition gives the same rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlab.operators.sampling import draw_hash, thresholds, unit_draw
from reviewlab.operators.util import bounded_broadcast, cut_lineage, spread


MAX_CELL_POINTS = 2_000


def _offsets(d: int) -> list[list[int]]:
    return [list(o) for o in itertools.product((-1, 0, 1), repeat=d)]


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(str(values)), kind)


@dataclass
class _Points:
    """Distinct points (g, pid, x, cats, m) and how they are compared."""
    frame: DataFrame
    d: int
    n_cats: int
    penalty: float
    k: int

    def masked(self, frame: DataFrame, n_apart: int, *more: str) -> DataFrame:
        """A row for each choice of ``n_apart`` categories that may differ:
        the mask, and a hash of the other categories."""
        masks = [[int(i in apart) for i in range(self.n_cats)] for apart in itertools.combinations(range(self.n_cats), n_apart)]
        rows = frame.select(*frame.columns, *more, F.explode(_constant(masks, "array<array<int>>")).alias("mask"))
        kept = F.zip_with("cats", "mask", lambda c, a: F.when(a == 0, c).otherwise(F.lit("")))
        return rows.withColumn("kept", F.xxhash64("mask", kept))

    def cell(self, s: float) -> Column:
        return F.transform("x", lambda v: F.floor(v / s).cast("bigint"))

    def side(self, n_apart: int, cell_points: int) -> float:
        """Side of cells that hold about ``cell_points`` points of a
        combination on average and at most MAX_CELL_POINTS, as far as
        narrowing them helps (clustered data)."""
        keyed = self.masked(self.frame, n_apart).select("g", "mask", "kept", "x")
        seen = keyed.groupBy("g", "mask", "kept").count().agg(F.sum("count"), F.count(F.lit(1))).first()
        s = min(1.0, (cell_points * seen[1] / max(seen[0], 1)) ** (1.0 / max(self.d, 1)))
        for _ in range(20 if self.d else 0):
            if keyed.groupBy("g", "kept", self.cell(s).alias("c")).count().agg(F.max("count")).first()[0] <= MAX_CELL_POINTS:
                break
            s /= 3
        return s

    def meet(self, queries: DataFrame, n_apart: int, s: float) -> DataFrame:
        """(qid, pid, m, dist) of points in the cells around each query that
        differ from it in just the masked categories."""
        points = self.masked(self.frame, n_apart).withColumn("c", self.cell(s))
        around = F.transform(_constant(_offsets(self.d), "array<array<bigint>>"), lambda o: F.zip_with("c", o, lambda a, b: a + b))
        q = self.masked(queries, n_apart).withColumn("c", self.cell(s)).select(
            "g", F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("cats").alias("qcats"), "kept", "mask", F.explode(around).alias("c"))
        met = q.join(points.drop("mask"), ["g", "kept", "c"])
        apart = F.zip_with("cats", "qcats", lambda a, b: (a != b).cast("int"))
        gap = F.aggregate(F.zip_with("qx", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
        # a point's own copies are neighbours at distance 0
        own = F.when(F.col("qid") == F.col("pid"), F.col("m") - 1).otherwise(F.col("m"))
        return met.where(apart == F.col("mask")).select("qid", "pid", own.alias("m"), F.sqrt(gap + self.penalty * n_apart).alias("dist")).where("m > 0")

    def nearest(self, met: DataFrame) -> DataFrame:
        """Rows of ``met`` up to each query's k-th distance, ties included,
        with that distance (``kd``, null for fewer than k)."""
        w = Window.partitionBy("qid").orderBy(F.round("dist", 9), "pid")
        ranked = met.withColumn("upto", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        kd = F.min(F.when(F.col("upto") >= self.k, F.round("dist", 9))).over(Window.partitionBy("qid"))
        return ranked.withColumn("kd", kd).where(F.col("kd").isNull() | (F.round("dist", 9) <= F.col("kd"))).select("qid", "pid", "m", "dist", "kd")


def _search(points: _Points, cell_points: int) -> DataFrame:
    """(qid, pid, m, dist): of each point the points up to its k-th distance."""
    done, best = [], None
    active = points.frame
    for n_apart in range(points.n_cats + 1):
        s = points.side(n_apart, cell_points)
        wait = active.select("g", "pid", "x", "cats")
        parts = []
        while True:
            met = points.meet(wait, n_apart, s)
            if best is not None:
                met = met.unionByName(best.join(wait.select(F.col("pid").alias("qid")), "qid", "left_semi").select("qid", "pid", "m", "dist"))
            near = cut_lineage(points.nearest(met))
            # cells of side s hold all points whose numeric gap is at most s
            # (null for a point that has met fewer than k; a little more for the rounding of kd)
            square = F.max("kd") * F.max("kd") - points.penalty * n_apart
            need = F.when(F.max("kd").isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))) + 1e-8)
            state = near.groupBy(F.col("qid").alias("q")).agg(need.alias("need"))
            last = s >= 1.0
            seen = state.where(F.lit(True) if last else F.col("need") <= s).select("q")
            parts.append(near.join(seen, F.col("qid") == F.col("q"), "left_semi"))
            if last:
                break
            wait = cut_lineage(spread(wait.join(seen, F.col("pid") == F.col("q"), "left_anti"), "pid"))
            if wait.limit(1).count() == 0:
                break
            # next cells: three times wider, or at once as wide as the smallest need
            least = state.where(F.col("need") > s).agg(F.min("need")).first()[0]
            s = min(1.0, max(3 * s, least or 0.0))
        best = parts[0]
        for x in parts[1:]:
            best = best.unionByName(x)
        if n_apart == points.n_cats:
            done.append(best.select("qid", "pid", "m", "dist"))
            break
        # the mildest mismatch not visited is n_apart + 1 categories; at an equal distance a smaller key may wait there
        bound = round((points.penalty * (n_apart + 1)) ** 0.5, 9)
        final = F.col("kd").isNotNull() & (F.col("kd") < bound)
        done.append(best.where(final).select("qid", "pid", "m", "dist"))
        best = cut_lineage(best.where(~final))
        settled = done[-1].select("qid").distinct()
        active = cut_lineage(spread(active.join(settled, F.col("pid") == F.col("qid"), "left_anti"), "pid"))
        if active.limit(1).count() == 0:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def nearest_neighbours(df: DataFrame, key: str, numeric: list[str], k: int = 5,
                       cell_points: int = 8, by: str | None = None,
                       categorical: list[str] | None = None, penalty: float = 1.0) -> DataFrame:
    """Exact k nearest neighbours of every row among the rows of ``df``
    (with ``by``: among the rows of the same group; each group is scaled by
    its own ranges, and all groups are searched in the same jobs).

    Returns (key, nb_key, dist, rank): rank 1..k by (distance rounded to 1e-9,
    neighbour key); fewer than k when the group is that small. Rows with a
    null numeric value are left out; a null category is a value of its own.
    """
    spark = df.sparkSession
    cats = categorical or []
    g = F.col(by) if by else F.lit(0)
    level = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    base = df.select(key, g.alias("__g"), *[F.col(c).cast("double").alias(c) for c in numeric],
                     F.array(*[level(c) for c in cats]).cast("array<string>").alias("__cats")).dropna(subset=[key, "__g", *numeric])
    # ranges per group: one row per group (size-checked), joined back
    ranges = base.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(f"lo_{c}") for c in numeric],
                                     *[F.max(c).alias(f"hi_{c}") for c in numeric])
    if base.limit(1).count() == 0:
        return spark.createDataFrame([], f"{key} bigint, nb_key bigint, dist double, rank int")
    scaled = [F.try_divide(F.col(c) - F.col(f"lo_{c}"),
                           F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"),
                                  F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(F.lit(1.0)))
              for c in numeric]
    pts = base.join(bounded_broadcast(ranges), "__g") \
        .select(key, F.col("__g").alias("g"), F.array(*scaled).cast("array<double>").alias("x"), F.col("__cats").alias("cats"))
    # distinct points with their row keys (identical rows collapse)
    vec = cut_lineage(spread(pts.groupBy("g", "x", "cats").agg(F.count(F.lit(1)).alias("m"), F.min(key).alias("pid")), "pid"))
    nb = _search(_Points(vec, len(numeric), len(cats), penalty, k), cell_points)
    # back to rows: of each neighbour point no row needs more than the k + 1
    # smallest keys (one may be the row itself), so m equal rows never meet all
    # m; those keys are picked in salted groups first
    members = cut_lineage(pts.join(vec.select("g", "x", "cats", "pid"), ["g", "x", "cats"]).select(key, "pid"))
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    few = (members.withColumn("__r", F.row_number().over(Window.partitionBy("pid", salt).orderBy(key)))
           .where(F.col("__r") <= k + 1)
           .withColumn("__r", F.row_number().over(Window.partitionBy("pid").orderBy(key)))
           .where(F.col("__r") <= k + 1).select(F.col(key).alias("nb_key"), "pid"))
    nbr = cut_lineage(nb.join(few, "pid")
                      .withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("dist", 9), "nb_key")))
                      .where(F.col("__r") <= k + 1).select("qid", "nb_key", "dist"))
    rows = members.withColumnRenamed("pid", "qid").join(nbr, "qid").where(F.col(key) != F.col("nb_key"))
    w2 = Window.partitionBy(key).orderBy(F.round("dist", 9), "nb_key")
    return (rows.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
            .select(key, "nb_key", "dist", "rank"))


def smote(df: DataFrame, label: str, minority, against=5, over: int = 600, under: int = 100,
          k: int = 5, numeric: list[str] | None = None, categorical: list[str] | None = None,
          key: str = "v1", seed: int = 22, penalty: float = 1.0) -> DataFrame:
    """Minority rows, their synthetic rows and the drawn majority rows
    (column ``origin`` says which), for the class pair (minority, against).

    Synthetic rows get key -(copy * 10^12 + parent key) - 1 (negative, so
    they never collide with data keys).
    """
    return oversample_pairs(df, label, [minority], against, over=over, under=under, k=k,
                            numeric=numeric, categorical=categorical, key=key,
                            seed=seed, penalty=penalty).drop("pair")


def oversample_pairs(df: DataFrame, label: str, minorities=(1, 2, 3, 4), against=5,
                     over: int = 600, under: int = 100, k: int = 5,
                     numeric: list[str] | None = None, categorical: list[str] | None = None,
                     key: str = "v1", seed: int = 22, penalty: float = 1.0) -> DataFrame:
    """``smote`` of each minority class against the majority class, stacked
    (column ``pair``). Neighbours and synthetic rows of all minority classes
    are computed in the same jobs; each pair draws its own majority rows.
    Categories count in the distance (``penalty`` for each that differs)."""
    numeric = numeric or []
    categorical = categorical or []
    minorities = list(minorities)
    cols = [key, label] + categorical + numeric
    data = df.select(*cols)
    mino = data.where(F.col(label).isin(*minorities))
    majo = data.where(F.col(label) == against)
    # over / 100 copies of each row; a rest of r percent is one more copy for
    # the share r of the rows, by a hash draw
    copies, rest = divmod(over, 100)
    n_copies = F.lit(copies) + (unit_draw(F.col(key), seed, "over") < rest / 100).cast("int")
    # read three times below: written once to the checkpoint folder
    nb = cut_lineage(nearest_neighbours(mino, key, numeric, k, by=label, categorical=categorical, penalty=penalty))
    n_nb = nb.groupBy(key).agg(F.count(F.lit(1)).alias("nn"))
    # one synthetic row per (row, copy): neighbour rank and gap are hash draws
    syn = (mino.join(n_nb, key)
           .select("*", n_copies.alias("__n")).where("__n > 0")
           .select("*", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy")).drop("__n"))
    gkey = F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))
    pick = F.pmod(F.conv(F.substring(draw_hash(gkey, seed, "nb"), 1, 8), 16, 10).cast("bigint"),
                  F.col("nn")) + 1
    syn = syn.withColumn("rank", pick.cast("int")).join(nb, [key, "rank"])
    partner = data.select(F.col(key).alias("nb_key"),
                          *[F.col(c).alias(f"nb_{c}") for c in categorical + numeric])
    syn = syn.join(partner, "nb_key")
    gap = unit_draw(gkey, seed, "gap")
    out = [(-(F.col("copy") * F.lit(10 ** 12) + F.col(key)) - 1).alias(key), F.col(label)]
    for c in categorical:
        take_nb = unit_draw(gkey, seed, f"cat-{c}") < 0.5
        out.append(F.when(take_nb, F.col(f"nb_{c}")).otherwise(F.col(c)).alias(c))
    for c in numeric:
        x, y = F.col(c).cast("double"), F.col(f"nb_{c}").cast("double")
        out.append((x + gap * (y - x)).alias(c))
    synthetic = cut_lineage(syn.select(*out).withColumn("origin", F.lit("synthetic"))
                            .withColumn("pair", F.col(label)))
    # majority rows per pair: under% of its synthetic count, without
    # replacement while they last, then further whole copies. Of a whole copy
    # every row is taken, of the last one those up to a threshold draw; the
    # thresholds of all pairs are found in the same jobs
    n_syn = {r[0]: r[1] for r in synthetic.groupBy(label).count().collect()}
    n_maj = majo.count()
    mcast = [F.col(key), F.col(label)] + [F.col(c) for c in categorical] + \
        [F.col(c).cast("double").alias(c) for c in numeric]
    want = {x: n_syn.get(x, 0) * under // 100 for x in minorities} if n_maj else {}
    draw = {x: seed + 1000 * (want[x] // n_maj) + x for x in want}
    cuts = thresholds(majo, key, {draw[x]: want[x] % n_maj for x in want})
    copies = F.array(*[F.struct(F.lit(x).alias("pair"), F.lit(want[x] // n_maj).alias("whole"), F.lit(draw[x]).alias("draw"),
                                F.lit(cuts.get(draw[x], ("", None))[0]).alias("h"), F.lit(cuts.get(draw[x], ("", None))[1]).cast("bigint").alias("k")) for x in want])
    parts = [mino.select(*mcast).withColumn("origin", F.lit("minority"))
             .withColumn("pair", F.col(label)), synthetic]
    if want:
        taken = majo.select(*mcast, F.explode(copies).alias("c"))
        h = draw_hash(F.col(key), F.col("c.draw"))
        inside = (h < F.col("c.h")) | ((h == F.col("c.h")) & (F.col(key) <= F.col("c.k")))
        times = F.col("c.whole") + inside.cast("int")
        parts.append(taken.withColumn("n", times).where("n > 0").withColumn("r", F.explode(F.sequence(F.lit(1), F.col("n"))))
                     .select(key, label, *categorical, *numeric, F.lit("majority").alias("origin"), F.col("c.pair").alias("pair")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
