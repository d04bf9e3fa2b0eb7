"""Command line: a run over a matrix file, with settings from INI files and switches that override them."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.config import Config
from .plans.run import Run, default_functions, functions_of
from .sources import text


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description="finds biclusters in a matrix")
    p.add_argument("ratios", help="a table, its first column the rows' names")
    p.add_argument("--out", default="out", help="a folder that all executors share")
    p.add_argument("--config", action="append", default=[], help="INI file; later ones go before earlier ones")
    p.add_argument("--pipeline", help="JSON file of the scoring functions")
    p.add_argument("--nonetworks", action="store_true")
    p.add_argument("--nomotifs", action="store_true")
    p.add_argument("--organism", default="", help="code by which gene names are put right")
    p.add_argument("--string", help="network file of three columns")
    p.add_argument("--operons", help="operon predictions")
    p.add_argument("--synonyms", help="names and their originals: alias;original lines")
    p.add_argument("--sequences", help="FASTA file of the sequences before genes, by gene, in which motifs are searched")
    p.add_argument("--sets", action="append", default=[], help="type=path of gene sets")
    p.add_argument("--rowseed", help="membership file of the rows")
    p.add_argument("--colseed", help="membership file of the columns")
    p.add_argument("--sep", default="\t")
    p.add_argument("--no-normalise", dest="normalise", action="store_false")
    p.add_argument("--resume", type=int, default=0, help="the iteration whose memberships are there")
    p.add_argument("--continue", dest="going", action="store_true", help="go on behind the last save point in the folder, if there is one")
    p.add_argument("--num-clusters", dest="clusters", type=int)
    p.add_argument("--num-iterations", dest="num_iterations", type=int)
    p.add_argument("--random-seed", dest="seed", type=int)
    return p.parse_args(words)


def settings(a: argparse.Namespace) -> Config:
    given = {k: getattr(a, k) for k in ("clusters", "num_iterations", "seed") if getattr(a, k) is not None}
    return Config.read(*a.config, **given)


def networks(spark: SparkSession, a: argparse.Namespace, genes: DataFrame) -> DataFrame | None:
    """The networks that the files have, between genes of the matrix, brought to one total."""
    from .operators.networks import groups, normalised, operon_edges, renamed

    if a.nonetworks or not (a.string or a.operons):
        return None
    known = genes.select(F.col("gene").alias("alias"), F.col("gene").alias("original"))
    if a.synonyms:
        lines = text.delimited(spark, a.synonyms, ";").select(F.get("fields", F.lit(0)).alias("alias"), F.get("fields", F.lit(1)).alias("original"), "line")
        named = lines.groupBy("alias").agg(F.max_by("original", "line").alias("original"))
        known = known.unionByName(named.join(known.select("alias"), "alias", "left_anti"))  # a gene's own name goes first
    out = text.string_edges(spark, a.string, a.organism, known, genes) if a.string else None
    if a.operons:
        own = operon_edges(groups(text.operon_predictions(spark, a.operons)), max(2, genes.count() // 20)).withColumn("line", F.monotonically_increasing_id())
        own = renamed(own, known, genes, check_size=False)
        out = own if out is None else out.unionByName(own)
    return normalised(out)


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> Run:
    a = arguments(words)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    m = text.ratios(spark, a.ratios, a.sep, normalise=a.normalise, resumed=a.resume > 0)
    m = m.select(F.col("row").alias("gene"), F.col("col").alias("cond"), "value")
    functions, columns = default_functions(networks=not a.nonetworks and bool(a.string or a.operons), motifs=bool(a.sequences) and not a.nomotifs), "Columns"
    if a.pipeline:
        with open(a.pipeline) as f:
            functions, columns = functions_of(json.load(f))
    sets = None
    for item in a.sets:
        kind, path = item.split("=", 1)
        d = text.gene_sets(spark, path, kind)
        sets = d if sets is None else sets.unionByName(d)
    if sets is not None and "SetEnrichment" not in functions:
        functions = (*functions, "SetEnrichment")
    sequences = text.fasta_source(spark, a.sequences).select(F.col("id").alias("gene"), "id", "seq") if a.sequences else None
    run = Run(spark, m, a.out, settings(a), sets=sets, sequences=sequences, functions=functions, column_function=columns)
    run.edges = networks(spark, a, run.genes)
    done = run.resume(a.resume) if a.resume else run.resume() if a.going else 0
    if done:
        pass
    elif a.rowseed and a.colseed:
        run.start(text.memberships(spark, a.rowseed, a.sep, "gene"), text.memberships(spark, a.colseed, a.sep, "cond"))
    else:
        run.seed()
    run.run(done + 1)
    run.finish()
    run.config.write(f"{a.out}/final.ini")
    return run


if __name__ == "__main__":
    main()
