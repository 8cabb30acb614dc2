"""Statistics: class means, z-scores, contingency tables, chi-square,
chance accuracy, kernel densities and the best CV row.

Every statistic is an aggregation with map-side combine; what reaches a
single task is histogram-sized (one row per class, cell, distinct value or
grid point), never the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.operators.ranges import exact_quantiles
from reviewlab.operators.util import bounded_broadcast


def class_means(df: DataFrame, by: str = "class",
                cols: dict[str, str] | None = None) -> DataFrame:
    """Mean of each column per group: ``cols`` maps output name -> column."""
    cols = cols or {"mrating": "rating", "msum_sent": "sum_sent"}
    return df.groupBy(by).agg(*[F.avg(F.col(c).cast("double")).alias(n)
                                for n, c in cols.items()])


def z_scores(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd over all rows of ``df`` for each column (sample sd).

    Mean and sd are scalar subqueries: Spark runs each aggregate once and
    substitutes the value, so no join or cross product is planned. A column
    with sd 0 gives null.
    """
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        mean = df.select(F.avg(F.col(c).cast("double"))).scalar()
        sd = df.select(F.stddev_samp(F.col(c).cast("double"))).scalar()
        out = out.withColumn(c + suffix, F.try_divide(x - mean, F.when(sd != 0, sd)))
    return out


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form: (a, b, n), non-zero cells only."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic of independence of ``a`` and ``b`` and its
    degrees of freedom: N (sum n^2 / (r c) - 1), (rows - 1)(cols - 1),
    over the non-zero cells (rows with a null in a or b are left out, as a
    table of two factors does). One row: statistic, dof, n.
    """
    cells = crosstab_long(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    # row and column totals are aggregates joined back (no window keyed by a
    # value that might hold most of the rows)
    rows_t = cells.groupBy(a).agg(F.sum("n").alias("r"))
    cols_t = cells.groupBy(b).agg(F.sum("n").alias("c"))
    cells = cells.join(rows_t, a).join(cols_t, b)
    agg = cells.agg(
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"),
        F.sum("n").alias("n"),
        F.countDistinct(a).alias("ra"),
        F.countDistinct(b).alias("cb"))
    return agg.select(
        (F.col("n") * (F.col("s") - 1)).alias("statistic"),
        ((F.col("ra") - 1) * (F.col("cb") - 1)).cast("bigint").alias("dof"),
        F.col("n").cast("bigint").alias("n"))


def gamma_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x) (series / continued
    fraction, as in standard numerical texts)."""
    if x <= 0:
        return 1.0
    lg = math.lgamma(s)
    if x < s + 1:
        term = total = 1.0 / s
        a = s
        for _ in range(10_000):
            a += 1
            term *= x / a
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + s * math.log(x) - lg))
    tiny = 1e-300
    b = x + 1 - s
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + s * math.log(x) - lg) * h


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence: statistic, dof, p_value.

    The statistic is a Spark aggregation; the p-value is the chi-square
    tail of that single number. No verdict is attached: a small p means the
    two are unlikely to be independent.
    """
    row = chi_square_statistic(df, a, b).first()
    stat, dof = row["statistic"], row["dof"]
    p = gamma_q(dof / 2.0, stat / 2.0) if stat is not None and dof and dof > 0 else None
    return df.sparkSession.createDataFrame(
        [(stat, dof, p)], "statistic double, dof bigint, p_value double")


def chance_accuracy(df: DataFrame, label: str) -> DataFrame:
    """Expected accuracy of guessing by shuffling the labels: sum (n_k/N)^2.

    Exact expectation from the class counts (one small aggregation).
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")))
                      .alias("chance_accuracy"))


def bandwidth_nrd0(df: DataFrame, col: str) -> DataFrame:
    """Silverman's rule of thumb: 0.9 min(sd, IQR/1.34) n^(-1/5), one row
    with n, sd, iqr, lo, hi, bw (lo/hi are the data range)."""
    x = F.col(col).cast("double")
    q1, q3 = exact_quantiles(df, {col: [0.25, 0.75]})[col]
    iqr = F.lit(None if q1 is None else q3 - q1).cast("double")
    s = df.where(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("sd"),
        F.first(iqr).alias("iqr"),
        F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo_sp = F.least(F.col("sd"), F.col("iqr") / 1.34)
    # R's fallbacks when the spread is 0
    spread = (F.when(lo_sp > 0, lo_sp)
              .when(F.col("sd") > 0, F.col("sd"))
              .when(F.abs(F.col("lo")) > 0, F.abs(F.col("lo")))
              .otherwise(F.lit(1.0)))
    return s.withColumn("bw", 0.9 * spread * F.pow(F.col("n").cast("double"), -0.2))


def density(df: DataFrame, col: str, points: int = 512, cut: float = 3.0,
            by: str | None = None, bw: float | None = None) -> DataFrame:
    """Gaussian kernel density of ``col`` at ``points`` grid values.

    Linear binning: each value is shared between the two grid values beside
    it, in one aggregation (two additions a row, a grid-sized shuffle); then
    the binned masses are smoothed over the grid, grid x grid. The grid runs
    from min - cut*bw to max + cut*bw. With ``by`` the groups share
    one grid and one bandwidth (from all rows) and each curve integrates to
    1. Bandwidth, grid start and step come from one small aggregate row.
    Returns (``by``,) gi, x, density.
    """
    st = bandwidth_nrd0(df, col).first()  # one row: n, sd, iqr, lo, hi, bw
    if not st["n"]:
        schema = ([f"`{by}` string"] if by else []) + ["gi int", "x double", "density double"]
        return df.sparkSession.createDataFrame([], ", ".join(schema))
    bwv = float(bw) if bw is not None else st["bw"]
    bw_v = F.lit(bwv)
    x0 = F.lit(st["lo"] - cut * bwv)
    dx = F.lit((st["hi"] - st["lo"] + 2 * cut * bwv) / (points - 1))
    keys = [by] if by else []
    t = (F.col(col).cast("double") - x0) / dx
    beside = F.array(F.struct(F.floor(t).alias("b"), (1 - (t - F.floor(t))).alias("w")),
                     F.struct((F.floor(t) + 1).alias("b"), (t - F.floor(t)).alias("w")))
    vals = (df.where(F.col(col).isNotNull()).select(*keys, F.explode(beside).alias("e"))
            .where("e.w > 0").groupBy(*keys, F.col("e.b").alias("b")).agg(F.sum("e.w").alias("m")))
    if by:
        # group sizes: one row per group (aggregated map-side), joined back;
        # a group holding most rows never lands in a single task
        sizes = vals.groupBy(by).agg(F.sum("m").alias("ng"))
        vals = vals.join(bounded_broadcast(sizes), by)
    else:
        vals = vals.withColumn("ng", F.lit(st["n"]))
    spread = vals.select(*keys, "b", "m", "ng",
                         F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("gi"))
    z = (F.col("gi") - F.col("b")) * dx / bw_v
    k = F.col("m") * F.exp(-0.5 * z * z) / (F.lit(math.sqrt(2 * math.pi)) * bw_v * F.col("ng"))
    out = spread.groupBy(*keys, "gi").agg(F.sum(k).alias("density"))
    return out.select(*keys, "gi", (x0 + F.col("gi") * dx).alias("x"), "density")


def density_gap(curves: DataFrame, pooled: DataFrame, by: str) -> DataFrame:
    """Integrated squared gap between each group's curve and the pooled
    curve, summed over groups: one row (statistic)."""
    j = curves.join(pooled.select("gi", F.col("density").alias("pooled"), "x"), ["gi", "x"])
    dx = pooled.select((F.max("x") - F.min("x")) / (F.count(F.lit(1)) - 1)).scalar()
    return j.agg((F.sum((F.col("density") - F.col("pooled")) ** 2) * dx).alias("statistic"))


def density_compare(df: DataFrame, col: str, by: str, points: int = 512,
                    cut: float = 3.0, permutations: int = 0, seed: int = 22):
    """Densities of ``col`` per group on one grid and bandwidth, and a test
    that they are equal.

    Returns (curves, test): curves = (by, gi, x, density); test = one row
    (statistic, p_value). The statistic is the integrated squared gap of the
    group curves to the pooled curve, of values rounded to the grid, and the
    one that the p-value is of. The permutation p-value (when
    ``permutations`` > 0) relabels rows at random: values are binned to the
    grid (at most ``points`` bins per group, collected: a proven bound), and
    group counts per bin are redrawn from a multivariate hypergeometric, so
    the rows never leave the executors.
    """
    import numpy as np

    curves = density(df, col, points, cut, by=by)
    stats = bandwidth_nrd0(df, col).first()
    stat = p = None
    if stats["n"]:
        bw, lo, hi = stats["bw"], stats["lo"], stats["hi"]
        x0, step = lo - cut * bw, (hi - lo + 2 * cut * bw) / (points - 1)
        binned = (df.where(F.col(col).isNotNull() & F.col(by).isNotNull())
                  .groupBy(by, F.round((F.col(col).cast("double") - x0) / step).cast("int").alias("b"))
                  .agg(F.count(F.lit(1)).alias("m")).collect())
        groups = sorted({r[by] for r in binned})
        counts = np.zeros((len(groups), points), dtype=np.int64)
        for r in binned:
            counts[groups.index(r[by]), r["b"]] += r["m"]
        xs = x0 + step * np.arange(points)
        kern = np.exp(-0.5 * ((xs[:, None] - xs[None, :]) / bw) ** 2) / (math.sqrt(2 * math.pi) * bw)

        def gap(c):
            f = (c @ kern.T) / c.sum(axis=1, keepdims=True)
            f0 = c.sum(axis=0) @ kern.T / c.sum()
            return float(((f - f0) ** 2).sum() * step)

        observed = stat = gap(counts)
        rng = np.random.default_rng(seed)
        total, sizes, hits = counts.sum(axis=0), counts.sum(axis=1), 0
        for _ in range(permutations):
            remaining, draw = total.copy(), np.zeros_like(counts)
            for g, n in enumerate(sizes[:-1]):
                draw[g] = rng.multivariate_hypergeometric(remaining, int(n))
                remaining -= draw[g]
            draw[-1] = remaining
            hits += gap(draw) >= observed - 1e-12
        p = (hits + 1) / (permutations + 1) if permutations else None
    out = df.sparkSession.createDataFrame([(stat, p)], "statistic double, p_value double")
    return curves, out


def best_row(cv: DataFrame, loss: str = "bestCvrmse", tie: str = "paramsNum") -> DataFrame:
    """The row with the lowest ``loss``; on a tie the lowest ``tie`` wins.
    One aggregation (min_by over a struct), no sort."""
    cols = cv.columns
    return (cv.agg(F.min_by(F.struct(*cols), F.struct(loss, tie)).alias("b"))
            .select("b.*"))
