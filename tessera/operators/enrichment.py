"""Scores by overlap of clusters with gene sets (set_type, set_name, gene)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import members
from .stats import hypergeometric_tail

SIGNIFICANT = 0.05


def overlaps(row_memb: DataFrame, sets: DataFrame) -> DataFrame:
    """Genes that a cluster and a set share, where there are any, with the sizes: overlap, m (set), k (cluster among all), total."""
    all_ = sets.select("set_type", "gene").distinct()
    total = all_.groupBy("set_type").agg(F.count("*").alias("total"))
    rows = members(row_memb, "gene")
    k = rows.join(all_, "gene").groupBy("set_type", "cluster").agg(F.count("*").alias("k"))
    m = sets.distinct().groupBy("set_type", "set_name").agg(F.count("*").alias("m"))
    shared = rows.join(sets.distinct(), "gene").groupBy("set_type", "cluster", "set_name").agg(F.count("*").alias("overlap"))
    return shared.join(m, ["set_type", "set_name"]).join(k, ["set_type", "cluster"]).join(total, "set_type")


def pvalues(row_memb: DataFrame, sets: DataFrame) -> DataFrame:
    d = overlaps(row_memb, sets).withColumn("n", F.col("total") - F.col("m"))
    return hypergeometric_tail(d, "overlap", "m", "n", "k").drop("n")


def best_sets(row_memb: DataFrame, sets: DataFrame) -> DataFrame:
    """The set of least p-value of each cluster and set type, ties to the first name."""
    p = pvalues(row_memb, sets)
    return p.groupBy("set_type", "cluster").agg(F.min_by("set_name", F.struct("pvalue", "set_name")).alias("set_name"), F.min("pvalue").alias("pvalue"))


def scores(row_memb: DataFrame, sets: DataFrame, clusters: int, reference: float, weights: DataFrame | None = None, *, best: DataFrame | None = None) -> DataFrame:
    """(gene, cluster, score): 0.5 for genes of a cluster's best set, 1 for those it shares, damped by its p-value
    and scaled by ``reference`` (the 10 % quantile of the rows' scores); set types summed by weight, absent is 0."""
    best = best_sets(row_memb, sets) if best is None else best
    level = SIGNIFICANT / clusters
    damp = F.when(F.col("pvalue") <= level, 1.0).otherwise(F.log10("pvalue") / F.log10(F.lit(level)))
    d = best.join(sets.distinct(), ["set_type", "set_name"])
    d = d.join(members(row_memb, "gene").withColumn("_in", F.lit(1.0)), ["gene", "cluster"], "left")
    own = F.try_divide(F.coalesce("_in", F.lit(0.5)), damp) * reference
    d = d.withColumn("score", own)
    d = d.join(weights, "set_type") if weights is not None else d.withColumn("weight", F.lit(1.0))
    return d.groupBy("gene", "cluster").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def best_set_lines(best: DataFrame, clusters: int, value: str) -> DataFrame:
    """One CSV line an iteration and set type: the value (set_name or pvalue) of each cluster, NA without one."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), F.col(value).cast("string"))))
    d = best.groupBy("iteration", "set_type").agg(cells.alias("c"))
    fields = F.transform(F.sequence(F.lit(1), F.lit(clusters)), lambda i: F.coalesce(F.try_element_at("c", i), F.lit("NA")))
    return d.select("iteration", "set_type", F.concat_ws(",", F.col("iteration").cast("string"), F.array_join(fields, ",")).alias("line"))
