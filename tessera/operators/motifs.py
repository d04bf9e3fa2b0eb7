"""Motif scores: sequences of clusters, external search tools where they are installed, and p-values as scores."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import members
from .sequences import unique_sequences, upstream

#: Sequences between which a cluster is searched, and seconds a tool may take.
LEAST, MOST, SECONDS = 3, 70, 600


def gene_sequences(genes: DataFrame, thesaurus: DataFrame, features: DataFrame, contigs: DataFrame, near: int, far: int, heads: DataFrame | None = None) -> DataFrame:
    """(gene, id, seq): the window before each gene, or before the head of its operon (head, gene), by feature id.

    Genes without a name in the thesaurus (alias, original), a feature or a contig (contig, seq) have none.
    """
    d = genes.select("gene").join(thesaurus.select(F.col("alias").alias("gene"), F.col("original").alias("id")), "gene")
    if heads is not None:
        h = heads.groupBy(F.col("gene").alias("id")).agg(F.min("head").alias("_head"))
        d = d.join(h, "id", "left").withColumn("id", F.coalesce("_head", "id")).drop("_head")
    d = d.join(features.select("id", "contig", "start", "end", "reverse"), "id").join(contigs.select("contig", F.col("seq").alias("_c")), "contig")
    return d.select("gene", "id", upstream(F.col("_c"), F.col("start"), F.col("end"), F.col("reverse"), near, far).alias("seq")).filter("seq <> ''")


def cluster_sequences(row_memb: DataFrame, sequences: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(cluster, id, seq) of clusters with ``least`` to ``most`` different sequences."""
    d = unique_sequences(members(row_memb, "gene").join(sequences, "gene").select("cluster", "id", "seq").distinct())
    fit = d.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most)).select("cluster")
    return d.join(fit, "cluster", "left_semi")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Clusters of (cluster, id, seq) whose sequences are not those of the last search."""
    print_ = lambda d: d.groupBy("cluster").agg(F.hash(F.sort_array(F.collect_list("id"))).alias("h"), F.count("*").alias("n"))
    return print_(now).join(print_(before), ["cluster", "h", "n"], "left_anti").select("cluster")


def run_tool(sequences: DataFrame, command: list[str], parse: Callable[[str], list[dict]], ddl: str) -> DataFrame:
    """Runs an external tool once a cluster on its sequences (at most MOST) as a FASTA file, ``{fasta}`` in the command.

    Where the tool isn't installed the result is empty, as it is for a cluster on which it fails or takes too long.
    """
    spark = sequences.sparkSession
    if shutil.which(command[0]) is None:
        return spark.createDataFrame([], f"cluster long, {ddl}")
    names = [x.strip().split(" ")[0] for x in ddl.split(",")]

    def search(p: pd.DataFrame) -> pd.DataFrame:
        with tempfile.NamedTemporaryFile("w", suffix=".fa") as f:
            f.write("".join(f">{i}\n{s}\n" for i, s in zip(p["id"], p["seq"], strict=True)))
            f.flush()
            try:
                done = subprocess.run([x.replace("{fasta}", f.name) for x in command], capture_output=True, text=True, timeout=SECONDS, check=True)
            except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
                return pd.DataFrame(columns=["cluster", *names])
        found = parse(done.stdout)
        return pd.DataFrame([{k: r.get(k) for k in names} for r in found]).assign(cluster=p["cluster"].iloc[0])[["cluster", *names]] if found else pd.DataFrame(columns=["cluster", *names])

    return sequences.groupBy("cluster").applyInPandas(search, f"cluster long, {ddl}")


#: The tools' own options.
MEME_OPTIONS = "-time 600 -dna -revcomp -maxsize 9999999 -evt 1e9 -minw 6 -mod zoops -nostatus -text".split()
MAST_430 = "-nostatus -stdout -text -brief -ev 999999 -mev 9999999 -mt 0.99 -seqp -remcorr".split()
MAST_481 = "-nostatus -ev 1500 -mev 99999 -mt 0.99 -nohtml -notext -seqp -remcorr".split()
#: Word length and mutations of each run of an analysis.
WEEDER_RUNS = {"small": [(6, 1), (8, 2)], "medium": [(6, 1), (8, 2), (10, 3)], "large": [(6, 1), (8, 2), (10, 3), (12, 4)], "extra": [(6, 1), (8, 3), (10, 4), (12, 4)]}
SEED_EVALUE = 0.1


def meme_command(fasta: str, background: str, motifs: int, *, widest: int = 24, seed: str | None = None) -> list[str]:
    """``seed``: the consensus from which version 4.3.0 starts (see ``seed_consensus``); later versions have none."""
    return ["meme", fasta, "-bfile", background, "-nmotifs", str(motifs), "-maxw", str(widest), *MEME_OPTIONS, *(["-cons", seed] if seed else [])]


def seed_consensus(motifs: DataFrame) -> DataFrame:
    """(cluster, consensus) of the motif of least e-value, if that is below SEED_EVALUE, from (cluster, motif_num, evalue, consensus)."""
    best = motifs.groupBy("cluster").agg(F.min_by(F.struct("evalue", "consensus"), F.struct("evalue", "motif_num")).alias("b"))
    return best.filter(F.col("b.evalue") < SEED_EVALUE).select("cluster", F.upper("b.consensus").alias("consensus"))


def mast_command(version: str, motifs: str, fasta: str, background: str, folder: str) -> list[str]:
    if version == "4.3.0":
        return ["mast", motifs, "-d", fasta, "-bfile", background, *MAST_430]
    return ["mast", motifs, fasta, "-bfile", background, *MAST_481, "-oc", folder]


def tomtom_command(version: str, motifs: str, *, threshold: float = 0.5, distance: str = "ed", overlap: int = 4, pseudo: float = 0.0) -> list[str]:
    """Compares the motifs of a file with each other; options changed their names with 4.11, the files' with 4.3.0."""
    new = version.startswith("4.11")
    pseudos = ["-motif-pseudo", f"{pseudo:.3f}"] if new else ["-query-pseudo", f"{pseudo:.3f}", "-target-pseudo", f"{pseudo:.3f}"]
    files = ["-target", motifs, "-query", motifs] if version == "4.3.0" else [motifs, motifs]
    return ["tomtom", "-verbosity", "1", "-thresh" if new else "-q-thresh", f"{threshold:.3f}", "-dist", distance, "-min-overlap", str(overlap), "-text", *pseudos, *files]


def weeder_commands(fasta: str, organism: str, *, analysis: str = "small", results: int = 50, both_strands: bool = True, multiple: bool = False, all_sequences: bool = False, frequencies: str | None = None) -> list[list[str]]:
    """A run for each word length, then the adviser, which writes the result beside the input."""
    common = ["-f", fasta, "-R", "100" if all_sequences else "50", "-O", organism]
    ends = ["-M" if multiple else "-N", "-S" if both_strands else "-N", "-T", str(results), *(["-F", frequencies] if frequencies else [])]
    return [*[["weederTFBS", *common, "-W", str(w), "-e", str(e), *ends] for w, e in WEEDER_RUNS[analysis]], ["adviser", fasta]]


def matches(lines: DataFrame, text: str = "value") -> DataFrame:
    """(motif_info_id1, motif_info_id2, pvalue) of a comparison's output, motifs with themselves left out."""
    f = F.split(F.trim(text), "\t")
    d = lines.filter(F.length(F.trim(text)) > 0).select(f.alias("f"))
    d = d.select(*[F.expr(f"try_cast(get(f, {i}) AS {kind})").alias(n) for i, kind, n in ((0, "BIGINT", "motif_info_id1"), (1, "BIGINT", "motif_info_id2"), (3, "DOUBLE", "pvalue"))])
    return d.filter("motif_info_id1 <> motif_info_id2 AND pvalue IS NOT NULL")


def words_of(pssms: DataFrame, length: int = 8) -> DataFrame:
    """Of (cluster, motif_num, pssm, ...) those of ``length`` positions, numbered anew from 1."""
    d = pssms.filter(F.size("pssm") == length)
    return d.withColumn("motif_num", F.row_number().over(W.partitionBy("cluster").orderBy("motif_num")))


def least_pvalues(hits: DataFrame, names: DataFrame) -> DataFrame:
    """(cluster, gene, pvalue) from hits (cluster, id, pvalue), ids by their row names (id, name): a gene's least."""
    return hits.join(names.select("id", F.col("name").alias("gene")), "id").groupBy("cluster", "gene").agg(F.min("pvalue").alias("pvalue"))


def motif_scores(pvalues: DataFrame) -> DataFrame:
    """Natural logs of (cluster, gene, pvalue), 0 staying 0; without a p-value a cell is absent and counts as 0."""
    return pvalues.select("gene", "cluster", F.when(F.col("pvalue") != 0, F.ln("pvalue")).otherwise(0.0).alias("score"))


def annotations(hits: DataFrame) -> DataFrame:
    """Hits (cluster, gene, position, hit_pvalue, motif_num signed by strand) by motif."""
    hit = F.struct("gene", F.col("position").alias("position"), (F.col("motif_num") < 0).alias("reverse"), F.col("hit_pvalue").alias("pvalue"))
    return hits.groupBy("cluster", F.abs("motif_num").alias("motif_num")).agg(F.sort_array(F.collect_list(hit)).alias("annotations"))


def mean_score(scores: DataFrame, row_memb: DataFrame) -> DataFrame:
    """One row: the mean of the members' scores only."""
    return scores.join(members(row_memb, "gene"), ["gene", "cluster"], "left_semi").agg(F.avg("score").alias("mean"))
