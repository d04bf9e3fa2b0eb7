"""Scores of (row, cluster) and (column, cluster) pairs, and what is made of them.

Matrices are (gene, cond, value), memberships (gene, slot, cluster) and (cond, slot, cluster), scores
(gene or cond, cluster, score). Everything of one cluster is small next to the matrix, so cluster means are
aggregated first and joined; Spark broadcasts them where they are small enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables
from .matrix import extremes, fix_extreme, with_row, without_extremes
from .stats import MAD_SCALE, counted, quantile, quantiles

#: Points of a density's grid and of its curve (fixed values), and places of a run that are opened at once.
GRID, POINTS, STEP = 512, 256, 1 << 16


def members(memb: DataFrame, name: str) -> DataFrame:
    """Each cluster's members once, whatever their slots; 0 is a free slot."""
    return memb.filter("cluster > 0").select(name, "cluster").distinct()


def cluster_means(m: DataFrame, row_memb: DataFrame) -> DataFrame:
    """(cluster, cond, mu): the mean over a cluster's genes of every condition."""
    return m.join(members(row_memb, "gene"), "gene").groupBy("cluster", "cond").agg(F.avg("value").alias("mu"))


def row_scores(m: DataFrame, row_memb: DataFrame, col_memb: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """ln of the mean squared distance of every gene from a cluster's means, over the cluster's conditions.

    A cluster without genes or with no more than one condition has no scores. ``means`` are those of ``cluster_means``, if there.
    """
    cols = members(col_memb, "cond")
    wide = cols.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    cols = cols.join(wide, "cluster", "left_semi")
    mu = (cluster_means(m, row_memb) if means is None else means).join(cols, ["cluster", "cond"])
    away = F.avg(F.pow(F.col("value") - F.col("mu"), 2))
    clipped = F.least(F.greatest(away, F.lit(1e-20)), F.lit(1000.0))
    return m.join(mu, "cond").groupBy("gene", "cluster").agg(F.ln(clipped + 1e-99).alias("score"))


def column_scores(m: DataFrame, row_memb: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Mean squared distance from the cluster's mean, over |mean| + 0.01, of each condition in clusters of several genes."""
    rows = members(row_memb, "gene")
    many = rows.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    x = m.join(rows.join(many, "cluster", "left_semi"), "gene")
    mu = x.groupBy("cluster", "cond").agg(F.avg("value").alias("mu")) if means is None else means
    away = F.avg(F.pow(F.col("value") - F.col("mu"), 2)) / (F.abs(F.max("mu")) + 0.01)
    return x.join(mu, ["cluster", "cond"]).groupBy("cluster", "cond").agg(away.alias("score"))


def filled_column_scores(scores: DataFrame, conds: DataFrame, clusters: DataFrame, col_memb: DataFrame) -> DataFrame:
    """All (cond, cluster) cells, missing ones as the 95 % quantile of the members' scores, then without extremes."""
    scores = tables.keep(scores, "scores")
    (top,) = quantiles(scores.join(members(col_memb, "cond"), ["cond", "cluster"], "left_semi"), "score", [0.95])
    grid = conds.select("cond").crossJoin(clusters.select("cluster"))  # the matrix of the result
    d = tables.keep(grid.join(scores, ["cond", "cluster"], "left").withColumn("score", F.coalesce("score", F.lit(top).cast("double"))), "cells")
    return fix_extreme(d, value="score")


def min_rank(scores: DataFrame, value: str = "score") -> DataFrame:
    """Ranks over all cells from 0, ties the lowest, NULL none; see ``stats.counted``."""
    cells = tables.keep(scores, "cells")
    ranks = counted(cells, value).select(F.col(value).alias("_v"), F.col("low").alias("rank"))
    return cells.join(ranks, cells[value] == ranks["_v"], "left").drop("_v")


def top_clusters(scores: DataFrame, name: str, n: int) -> DataFrame:
    """The n clusters of highest score of each row, ties to the smaller cluster, missing ones last: place from 1."""
    w = W.partitionBy(name).orderBy(F.col("score").desc_nulls_last(), "cluster")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def seed_columns(m: DataFrame, row_memb: DataFrame, per_col: int) -> DataFrame:
    """Columns' memberships from rows' first slots: the clusters in which a column's score is lowest."""
    negated = column_scores(m, row_memb.filter("slot = 0")).withColumn("score", -F.col("score"))
    return top_clusters(negated, "cond", per_col).select("cond", (F.col("place") - 1).alias("slot"), "cluster")


def quantile_normalise(scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Score matrices (function, gene, cluster, score) brought to one distribution.

    At each place of the sorted cells the weighted mean over the matrices, divided by the sum of weights once
    more; a cell gets the value at its lowest place among equals. Functions without a weight have none.

    Cells are counted by value (``stats.counted``) instead of sorted; a value that many cells have stands for
    a run of places, which is opened in steps of STEP.
    """
    cells = tables.keep(scores.select("function", "gene", "cluster", "score").filter(F.col("score").isNotNull()), "cells")
    if weights is not None:
        cells = cells.join(weights.select("function"), "function", "left_semi")
    values = tables.keep(counted(cells, "score", ["function"]), "ranks")
    weight = F.lit(1.0) if weights is None else F.col("weight")
    weighted = values.withColumn("weight", F.lit(1.0)) if weights is None else values.join(weights.select("function", "weight"), "function")
    steps = weighted.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))))
    first = F.col("low") + F.col("_s") * STEP
    places = steps.withColumn("low", F.explode(F.sequence(first, F.least(first + STEP, F.col("low") + F.col("n")) - 1)))
    means = places.groupBy("low").agg(F.avg(F.col("score") * weight).alias("mean"))
    if weights is not None:
        means = with_row(means, weights.agg(F.sum("weight").alias("_w"))).withColumn("mean", F.col("mean") / F.col("_w")).drop("_w")
    brought = values.join(means, "low").select("function", "score", "mean")
    return cells.join(brought, ["function", "score"]).select("function", "gene", "cluster", F.col("mean").alias("score"))


def _settled(d: DataFrame) -> tuple[DataFrame, int]:
    """A matrix, read from a table, without extremes and less its 99 % quantile; and its cells' number."""
    d, n = _clamped(tables.keep(d.select("gene", "cluster", F.col("score").cast("double").alias("score")), "scores"))
    (top,) = quantiles(d, "score", [0.99], n)
    return d.withColumn("score", F.col("score") - F.lit(top)), n


def _clamped(d: DataFrame, least: float = -20.0) -> tuple[DataFrame, int]:
    top, low, n = d.agg(*extremes(least, "score"), F.count("*")).first()
    return d.withColumn("score", without_extremes("score", least, F.lit(top).cast("double"), F.lit(low).cast("double"))), n


def combine(row: DataFrame, others: list[tuple[DataFrame, float]], row_memb: DataFrame, row_scaling: float = 1.0) -> DataFrame:
    """Scaled sum of score matrices (gene, cluster, score), the first being the rows'.

    Each loses its extremes and its 99 % quantile. The rows' are centred on the median of the members' scores
    and divided by their median absolute deviation (their sd if that is 0, nothing if that is 0 too); the others are brought
    to the rows' scale by the 1 % quantiles (in a sparse matrix the tenth smallest score, or the least one).

    Each matrix is written once; its few statistics are numbers on the driver, so that the rest is one pass.
    """
    first, n = _settled(row)
    own = first.join(members(row_memb, "gene"), ["gene", "cluster"], "left_semi")
    (mid,) = quantiles(own, "score", [0.5], n)
    if mid is not None:
        (mad,) = quantiles(own.withColumn("score", F.abs(F.col("score") - F.lit(mid))), "score", [0.5], n)
        scale = mad * MAD_SCALE or own.agg(F.stddev_samp("score")).first()[0]
        if scale:
            first = first.withColumn("score", (F.col("score") - F.lit(mid)) / F.lit(scale))
    first, n = _clamped(first)
    total = first.select("gene", "cluster", (F.col("score") * row_scaling).alias("score"))
    (at_rows,) = quantiles(first, "score", [0.01], n) if others else (None,)
    for d, scaling in others:
        d, n = _settled(d)
        (at,) = quantiles(d, "score", [0.01], n)
        tenth = [r[0] for r in d.select("score").orderBy("score").limit(10).collect()]
        unit = abs(at or 0.0) or abs(tenth[-1] if tenth else 0.0) or abs(tenth[0] if tenth else 0.0)
        scaled = F.col("score") / F.lit(unit) * F.lit(abs(at_rows or 0.0)) if unit else F.col("score")
        total = total.unionByName(d.select("gene", "cluster", (scaled * scaling).alias("score")))
    return total.groupBy("gene", "cluster").agg(F.sum("score").alias("score"))


def size_factor(scores: DataFrame, sizes: DataFrame, dim: float, slots: int, clusters: int, least: float) -> DataFrame:
    """score * exp(-size / (dim * slots / clusters)), a cluster's size being ``least`` at least."""
    size = F.greatest(F.coalesce("n", F.lit(0)).cast("double"), F.lit(float(least)))
    d = scores.join(sizes.select("cluster", "n"), "cluster", "left")
    return d.withColumn("score", F.col("score") * F.exp(-size / F.lit(dim * slots / clusters))).drop("n")


def fuzz(scores: DataFrame, memb: DataFrame, name: str, coefficient: float, seed: int) -> DataFrame:
    """Adds normal noise of coefficient * sd of the members' scores, drawn by (seed, row, cluster), so not by partition."""
    sd = scores.join(members(memb, name), [name, "cluster"], "left_semi").agg((F.stddev_samp("score") * coefficient).alias("_sd"))
    text = lambda salt: F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), F.col(name).cast("string"), F.col("cluster").cast("string"))
    u = lambda salt: (F.conv(F.substring(F.md5(text(salt)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))
    return with_row(scores, sd).withColumn("score", F.col("score") + F.coalesce("_sd", F.lit(0.0)) * normal).drop("_sd")


def reverse_sums(bins: np.ndarray, wide: float, lo: float, up: float, low: float, high: float) -> np.ndarray:
    """Of weights on a grid from lo to up: the Gaussian density (by FFT, on twice the grid) at POINTS points from low to high, summed from the right."""
    n = len(bins)
    k = np.arange(2 * n) * (2 * (up - lo) / (2 * n - 1))
    k[n + 1 :] = -k[n - 1 : 0 : -1]
    kernel = np.exp(-0.5 * (k / wide) ** 2) / (wide * np.sqrt(2 * np.pi))
    dens = np.maximum(0, np.real(np.fft.ifft(np.fft.fft(bins, 2 * n) * np.conj(np.fft.fft(kernel))))[:n])
    return np.cumsum(np.interp(np.linspace(low, high, POINTS), np.linspace(lo, up, n), dens)[::-1])[::-1]


def density(scores: DataFrame, memb: DataFrame, name: str, *, rows: bool, other: DataFrame | None = None) -> DataFrame:
    """Density of each cluster's column of scores under its members' scores, as (name, cluster, score).

    Bandwidth max(range of all scores / 100, 0.001), for rows times 10 * exp(-members / 10). Uniform for clusters without
    members (columns: with one) or, if the other axis' memberships are given, without any of those.

    Members' scores are binned linearly on a grid of GRID, so that Python gets a grid a cluster, whatever its size, and
    answers with a curve of POINTS points, at which all scores are read off.
    """
    cells = tables.keep(scores.select(name, "cluster", F.col("score").cast("double").alias("score")), "cells")
    ends = cells.groupBy("cluster").agg(F.count("*").alias("all"), F.min("score").alias("least"), F.max("score").alias("most"))
    width = ends.agg(F.greatest((F.max("most") - F.min("least")) / 100, F.lit(0.001)).alias("width"))  # of one row a cluster
    own = cells.join(members(memb, name), [name, "cluster"], "left_semi").filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    size = own.groupBy("cluster").agg(F.count("*").alias("size"))
    if other is not None:
        size = size.join(other.filter("cluster > 0").select("cluster").distinct(), "cluster", "left_semi")
    size = size.filter(F.col("size") > (0 if rows else 1))
    wide = F.col("width") * 2 * (10 * F.exp(-F.col("size") / 10) if rows else F.lit(1.0))
    d = with_row(ends.join(size, "cluster"), width).withColumn("wide", wide)
    d = d.withColumn("low", F.col("least") - 1).withColumn("high", F.col("most") + 1).withColumn("lo", F.col("low") - 4 * F.col("wide")).withColumn("up", F.col("high") + 4 * F.col("wide"))
    d = tables.keep(d.select("cluster", "size", "wide", "low", "high", "lo", "up"), "ends")  # a row for each cluster
    pos = own.join(d, "cluster").select("cluster", "size", ((F.col("score") - F.col("lo")) / ((F.col("up") - F.col("lo")) / (GRID - 1))).alias("pos"))
    left, part = F.floor("pos"), F.col("pos") - F.floor("pos")
    sides = F.explode(F.array(F.struct(left.alias("cell"), ((1 - part) / F.col("size")).alias("w")), F.struct((left + 1).alias("cell"), (part / F.col("size")).alias("w"))))
    bins = pos.select("cluster", sides.alias("b")).groupBy("cluster", "b.cell").agg(F.sum("b.w").alias("w"))
    grids = bins.groupBy("cluster").agg(F.collect_list(F.struct("cell", "w")).alias("bins"))  # at most GRID

    def curves(batches):
        for p in batches:
            out = []
            for r in p.itertuples():
                y = np.zeros(GRID)
                for b in r.bins:
                    y[int(b["cell"])] += b["w"]
                out.append(reverse_sums(y, r.wide, r.lo, r.up, r.low, r.high))
            yield pd.DataFrame({"cluster": p["cluster"], "low": p["low"], "high": p["high"], "curve": out})

    kind = dict(scores.dtypes)["cluster"]
    curve = grids.join(d, "cluster").mapInPandas(curves, f"cluster {kind}, low double, high double, curve array<double>")
    at = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * (POINTS - 1)
    i = F.least(F.floor(at), F.lit(POINTS - 2)).cast("int")
    read = F.get("curve", i) + (F.get("curve", i + 1) - F.get("curve", i)) * (at - i)
    found = tables.keep(cells.join(curve, "cluster", "left").select(name, "cluster", F.when(F.col("curve").isNotNull(), read).alias("score"), F.col("curve").isNull().alias("none")), "density")
    total = found.groupBy("cluster").agg(F.sum("score").alias("total"), F.count("*").alias("all"))
    share = F.when(F.col("none"), 1 / F.col("all")).when(F.col("total") != 0, F.col("score") / F.col("total")).otherwise(F.col("score"))
    return found.join(total, "cluster").select(name, "cluster", share.alias("score"))


def background(x: np.ndarray, n: int, rng: np.random.Generator, *, samples: int | None = None, chunk: int = 200, tolerance: float = 0.001, limit: int = 1_000_000) -> np.ndarray:
    """Sorted variances of n of the values, chunk by chunk until one changes neither their mean nor their variance
    by ``tolerance`` of what it was; ``limit`` of them stands for a time limit. Or ``samples`` of them."""
    draw = lambda k: np.array([x[rng.choice(len(x), n, replace=False)].var() for _ in range(k)])
    if samples is not None:
        return np.sort(draw(samples))
    parts, size, before = [], 0, None
    while size < limit:
        parts.append(draw(chunk))
        size += chunk
        # from the chunks' sums, about the first chunk's mean
        if before is None:
            at = parts[0].mean()
            first = second = 0.0
        first, second = first + (parts[-1] - at).sum(), second + ((parts[-1] - at) ** 2).sum()
        now = at + first / size, max(0.0, second / size - (first / size) ** 2)
        if before is not None and all(a == b or abs(a - b) < tolerance * abs(b) for a, b in zip(now, before, strict=True)):
            break
        before = now
    return np.sort(np.concatenate(parts))


def bootstrap_pvalues(m: DataFrame, row_memb: DataFrame, *, samples: int | None = None, seed: int = 11) -> DataFrame:
    """Share of variances of n random values of a condition that are below a cluster's own; 1 for n <= 1.

    The samples of a condition and size are drawn once, by (seed, condition, size), until they converge
    (see ``background``), or ``samples`` of them.
    """
    own = m.filter("value IS NOT NULL").join(members(row_memb, "gene"), "gene").groupBy("cluster", "cond").agg(F.count("*").alias("n"), F.var_pop("value").alias("v"))
    wanted = own.groupBy("cond").agg(F.collect_list(F.struct("cluster", "n", "v")).alias("own"))  # a row for each cluster
    values = m.filter("value IS NOT NULL").groupBy("cond").agg(F.sort_array(F.collect_list("value")).alias("values"))  # one column of the matrix

    def test(batches):
        for p in batches:
            for cond, values_, rows in zip(p["cond"], p["values"], p["own"], strict=True):
                x, by_n, out = np.asarray(values_, float), {}, []
                for r in rows:
                    n = int(r["n"])
                    if n > 1 and n not in by_n:
                        by_n[n] = background(x, n, np.random.default_rng([seed, int(cond) & 0x7FFFFFFF, n]), samples=samples)
                    out.append(np.searchsorted(by_n[n], r["v"], "left") / len(by_n[n]) if n > 1 else 1.0)
                yield pd.DataFrame({"cond": cond, "cluster": [r["cluster"] for r in rows], "pvalue": out})

    return wanted.join(values, "cond").mapInPandas(test, f"cond {dict(m.dtypes)['cond']}, cluster {dict(row_memb.dtypes)['cluster']}, pvalue double")
