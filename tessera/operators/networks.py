"""Interaction networks as edges (network, src, dst, weight), operons, and scores by adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables
from .matrix import with_row
from .scoring import members
from .stats import trim_mean

LEAST_EDGES, OPERON_WEIGHT = 10, 1000.0


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once for a network, loops out; of its weights the one of the smallest line."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    d = edges.filter("src <> dst").groupBy("network", a.alias("src"), b.alias("dst"))
    return d.agg(F.min_by("weight", F.struct("line", "weight")).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("network", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def renamed(edges: DataFrame, thesaurus: DataFrame, genes: DataFrame, *, check_size: bool = True) -> DataFrame:
    """Edges between genes known by the thesaurus (alias, original) and in ``genes`` (gene), under their original names."""
    t = thesaurus.select("alias", F.col("original").alias("gene")).join(genes.select("gene").distinct(), "gene", "left_semi")
    d = edges.join(t.select(F.col("alias").alias("src"), F.col("gene").alias("_a")), "src").join(t.select(F.col("alias").alias("dst"), F.col("gene").alias("_b")), "dst")
    out = undirected(d.select("network", F.col("_a").alias("src"), F.col("_b").alias("dst"), "weight", "line"))
    if check_size and out.limit(LEAST_EDGES).count() < LEAST_EDGES:
        raise ValueError(f"fewer than {LEAST_EDGES} edges are left")
    return out


def validate(edges: DataFrame, thesaurus: DataFrame, genes: DataFrame) -> DataFrame:
    """One row a network: its nodes, how many of them are genes by the thesaurus, and whether that is half or more."""
    nodes = both_ways(edges.select("network", "src", "dst", "weight")).select("network", F.col("src").alias("alias")).distinct()
    known = thesaurus.join(genes.select(F.col("gene").alias("original")).distinct(), "original", "left_semi").select("alias").distinct()
    d = nodes.join(known.withColumn("_k", F.lit(1)), "alias", "left").groupBy("network").agg(F.count("*").alias("nodes"), F.count("_k").alias("found"))
    return d.withColumn("valid", F.col("found") * 2 >= F.col("nodes"))


def normalised(edges: DataFrame) -> DataFrame:
    """All networks rescaled to the largest total, edges counting both ways."""
    totals = edges.groupBy("network").agg((2 * F.sum("weight")).alias("_t"))
    d = with_row(edges.join(totals, "network"), totals.agg(F.max("_t").alias("_m")))
    return d.withColumn("weight", F.try_divide(F.col("weight") * F.col("_m"), F.col("_t"))).drop("_t", "_m")


def exponential(edges: DataFrame) -> DataFrame:
    """Weights as 1000 * exp(w / most) / e, the most being that of all edges given."""
    return with_row(edges, edges.agg(F.max("weight").alias("_m"))).withColumn("weight", 1000 * F.exp(F.col("weight") / F.col("_m")) / F.exp(F.lit(1.0))).drop("_m")


def network_sums(edges: DataFrame, row_memb: DataFrame) -> DataFrame:
    """(network, cluster, gene, s): the weights of a gene's edges to a cluster's members, where there are any."""
    rows = members(row_memb, "gene").withColumnRenamed("gene", "src")
    return both_ways(edges).join(rows, "src").groupBy("network", "cluster", F.col("dst").alias("gene")).agg(F.sum("weight").alias("s"))


def network_scores(edges: DataFrame, row_memb: DataFrame, genes: DataFrame, network_weights: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """-ln(1 + mean weight of edges to a cluster's members) of genes with such an edge, networks summed by weight.

    Cells without an edge are absent and count as 0. ``sums`` are those of ``network_sums``, if there.
    """
    rows = members(row_memb, "gene")
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    near = network_sums(edges, row_memb) if sums is None else sums
    near = near.join(genes.select("gene").distinct(), "gene", "left_semi").join(size, "cluster")
    near = near.withColumn("score", -F.log1p(F.col("s") / F.col("n")))
    if network_weights is not None:
        near = near.join(network_weights.select("network", F.col("weight").alias("w")), "network")
    else:
        near = near.withColumn("w", F.lit(1.0))
    return near.groupBy("gene", "cluster").agg(F.sum(F.col("score") * F.col("w")).alias("score"))


def network_score_means(edges: DataFrame, row_memb: DataFrame, genes: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """By network: the mean over clusters of the members' mean score trimmed by 5 %, members without a score at 0. ``sums`` as in ``network_scores``."""
    rows = members(row_memb, "gene")
    names = edges.select("network").distinct()
    size = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    near = network_sums(edges, row_memb) if sums is None else sums
    near = near.join(size, "cluster").select("network", "cluster", "gene", (-F.log1p(F.col("s") / F.col("n"))).alias("score"))
    full = rows.crossJoin(names).join(near, ["network", "cluster", "gene"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return trim_mean(full, ["network", "cluster"], "score", 0.05).groupBy("network").agg(F.avg("trim_mean").alias("mean"))


def groups(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(gene, operon): the smallest gene of each connected group, by minima over neighbours and pointer jumping.

    Each round writes its state as a table, which cuts the lineage and outlives an executor; the one before goes.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = tables.keep(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = tables.keep(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")), "labels")
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), F.col("l").alias("nl")), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        new = label.join(near, "u").select("u", F.least("l", "nl").alias("l"), F.col("l").alias("old"))
        new = new.alias("x").join(label.select(F.col("u").alias("j"), F.col("l").alias("jl")), F.col("l") == F.col("j"), "left")
        new = tables.keep(new.select("u", F.least("l", F.coalesce("jl", "l")).alias("l"), "old"), "labels")
        tables.drop(label)
        if not new.filter("l <> old").limit(1).count():
            tables.drop(edges)
            return new.select(F.col("u").alias("gene"), F.col("l").alias("operon"))
        label = new


def operon_heads(operons: DataFrame, features: DataFrame) -> DataFrame:
    """(head, gene) for each operon (gene, operon) by its features (gene, start, end, reverse).

    If over 60 % of the genes are reverse the head is the one with the largest end, if under 40 % that with
    the smallest start; other operons are left out. Ties go to the smaller gene.
    """
    d = operons.join(features, "gene")
    heads = d.groupBy("operon").agg(
        F.avg(F.col("reverse").cast("double")).alias("back"), F.min_by("gene", F.struct(-F.col("end"), "gene")).alias("last"), F.min_by("gene", F.struct("start", "gene")).alias("first")
    )
    head = F.when(F.col("back") > 0.6, F.col("last")).when(F.col("back") < 0.4, F.col("first"))
    return operons.join(heads.select("operon", head.alias("head")).filter("head IS NOT NULL"), "operon").select("head", "gene", "operon")


def operon_edges(operons: DataFrame, most: int) -> DataFrame:
    """All pairs of genes of an operon, operons of up to ``most`` genes (the twentieth part of all genes)."""
    size = operons.groupBy("operon").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("operon")
    d = operons.join(size, "operon", "left_semi")
    other = d.select("operon", F.col("gene").alias("dst"))
    return d.join(other, "operon").filter("gene < dst").select(F.lit("operons").alias("network"), F.col("gene").alias("src"), "dst", F.lit(OPERON_WEIGHT).alias("weight"))


def tail(edges: DataFrame) -> DataFrame:
    """Place of each edge in its network, heaviest first."""
    return edges.withColumn("place", F.row_number().over(W.partitionBy("network").orderBy(F.col("weight").desc(), "src", "dst")))
