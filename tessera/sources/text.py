"""Readers of delimited text, matrices, names, sequences and networks."""

from __future__ import annotations

import json
import os
import shutil
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import center_scale, no_nan, nochange_filter
from ..operators.names import patched
from ..operators.networks import exponential, renamed


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of small files, numbered from 0; .gz is unpacked."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, line, text) of a folder's parts in order: by the parts' names, then by line."""
    return lines(spark, path).select(F.regexp_extract("path", "[^/]*$", 0).alias("part"), "line", "text").filter("text <> ''").orderBy("part", "line")


def delimited(spark: SparkSession, path: str, sep: str = "\t", *, header: bool = False, comment: str | None = None, quote: str | None = None) -> DataFrame:
    """(line, fields): empty lines are left out, with a comment character also comments and blank lines; every
    quote character goes; the header's line goes too and its names are in ``delimited_header``."""
    d = lines(spark, path).filter(F.length("text") > 0)
    if comment:
        d = d.filter(~F.col("text").startswith(comment) & (F.length(F.trim("text")) > 0))
    text = F.replace(F.col("text"), F.lit(quote), F.lit("")) if quote else F.col("text")
    d = d.select("line", F.split(text, _literal(sep)).alias("fields"))
    if header:
        d = d.crossJoin(F.broadcast(d.agg(F.min("line").alias("_h")))).filter("line > _h").drop("_h")
    return d


def delimited_header(spark: SparkSession, path: str, sep: str = "\t", *, comment: str | None = None, quote: str | None = None) -> list[str]:
    first = delimited(spark, path, sep, comment=comment, quote=quote).orderBy("line").first()
    return list(first["fields"]) if first else []


def _literal(sep: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in sep)


def matrix(spark: SparkSession, path: str, sep: str = "\t", *, quote: str = '"', case_sensitive: bool = True, missing: str = "NA") -> DataFrame:
    """(row, col, value) of a table whose first column names the rows, whatever its header calls it, or if it has no name there.

    A folder's files have a header each, or only the first of them by name has one (see ``writers.write_matrix``).
    """
    if path.startswith(("http://", "https://")):
        raise ValueError("stage the file first")
    files = sorted(spark.read.text(path).inputFiles())
    top = lambda file: [r["value"] for r in spark.read.text(file).limit(2).collect()]
    first = top(files[0]) if files else []
    rest = files[1:] if len(files) > 1 and top(files[1])[:1] != first[:1] else []  # parts without a header
    head, below = first[0].split(sep) if first else [], first[1:] or (top(rest[0])[:1] if rest else [])
    cols = [x.strip(quote) for x in head]
    cols = cols if not below or len(below[0].split(sep)) > len(cols) else cols[1:]
    name = "_row" if "_row" not in cols else "__row"
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in (name, *cols))
    table = lambda at, header: spark.read.csv(at, sep=sep, quote=quote, header=header, nullValue=missing, schema=schema, enforceSchema=True)
    w = table(files[0], True).unionByName(table(rest, False)) if rest else table(path, True)
    row = F.col(f"`{name}`") if case_sensitive else F.upper(f"`{name}`")
    w = w.select(row.alias("row"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in cols])
    return no_nan(w.unpivot("row", cols, "col", "value"))


def ratios(spark: SparkSession, path: str, sep: str = "\t", *, normalise: bool = True, resumed: bool = False, **options: object) -> DataFrame:
    """A run's matrix: without rows and columns in which nothing changes, its rows centred and scaled; one that is resumed was filtered before."""
    m = matrix(spark, path, sep, **options)
    if not normalise:
        return m
    return center_scale(m if resumed else nochange_filter(m)).select("row", "col", "value")


def memberships(spark: SparkSession, path: str, sep: str = " ", name: str = "gene") -> DataFrame:
    """(name, slot, cluster) of lines with a quoted name and its clusters, apart by ``sep`` or colons."""
    d = delimited(spark, path, sep, quote='"').withColumn("all", F.flatten(F.transform(F.slice("fields", 2, 1 << 20), lambda x: F.split(x, ":"))))
    d = d.select(F.get("fields", F.lit(0)).alias(name), F.posexplode("all").alias("slot", "cluster"))
    return d.select(name, F.col("slot").cast("long"), F.expr("try_cast(cluster AS BIGINT)").alias("cluster")).filter("cluster IS NOT NULL")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq), lines joined; records without a sequence are left out."""
    d = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0).select(F.split("value", "\r?\n").alias("l"))
    seq = F.array_join(F.transform(F.slice("l", 2, 1 << 30), F.trim), "")
    return d.select(F.get(F.split(F.trim(F.get("l", F.lit(0))), r"\s+"), F.lit(0)).alias("id"), seq.alias("seq")).filter("seq <> ''")


def fasta_source(spark: SparkSession, path: str, thesaurus: DataFrame | None = None) -> DataFrame:
    """Sequences upper-cased, X as N, under their original names where a thesaurus is given."""
    d = fasta(spark, path).withColumn("seq", F.translate(F.upper("seq"), "X", "N"))
    if thesaurus is None:
        return d
    return d.join(thesaurus.select(F.col("alias").alias("id"), "original"), "id").select(F.col("original").alias("id"), "seq")


def features(spark: SparkSession, path: str) -> DataFrame:
    """RSAT features: columns named by the file's own ``-- field`` comments, positions without < and >."""
    d = lines(spark, path)
    names = [r["n"] for r in d.filter(F.col("text").rlike(r"^-- field")).orderBy("line").select(F.regexp_extract("text", r"^-- field \d+\s+(\S+)", 1).alias("n")).collect()]
    if not names:
        raise ValueError("the file doesn't say what its fields are")
    rows = d.filter(~F.col("text").startswith("--") & (F.length("text") > 0)).select(F.split("text", "\t").alias("f"))
    field = lambda n: F.get("f", F.lit(names.index(n)))
    pos = lambda n: F.regexp_replace(field(n), "[<>]", "").cast("int")
    return rows.select(field("id").alias("id"), field("type").alias("type"), field("name").alias("name"), field("contig").alias("contig"), pos("start_pos").alias("start"), pos("end_pos").alias("end"), (field("strand") == "R").alias("reverse"))


def contig(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(contig, seq) of a file of sequence lines without a header."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.lit(name).alias("contig"), F.upper(F.regexp_replace("value", r"\s", "")).alias("seq"))


def rsat(spark: SparkSession, folder: str, feature: str = "feature") -> tuple[DataFrame, DataFrame, DataFrame]:
    """An organism's staged files: its features (CDS), synonyms (alias, original), and the contigs that its features are on."""
    own = features(spark, f"{folder}/{feature}.tab")
    names = delimited(spark, f"{folder}/{feature}_names.tab", comment="--").select(F.trim(F.get("fields", F.lit(1))).alias("alias"), F.trim(F.get("fields", F.lit(0))).alias("original"), "line")
    names = names.groupBy("alias").agg(F.max_by("original", F.struct("line", "original")).alias("original"))
    contigs = None
    for r in own.select("contig").distinct().collect():  # an organism has a few
        c = contig(spark, f"{folder}/{r['contig']}.tab", r["contig"])
        contigs = c if contigs is None else contigs.unionByName(c)
    return own, names, contigs if contigs is not None else spark.createDataFrame([], "contig string, seq string")


def fetched(url: str, path: str) -> str:
    """A local copy of what a URL names, fetched by the driver unless it is there already (a small file of names or predictions)."""
    if not os.path.exists(path):
        with urllib.request.urlopen(url) as source, open(f"{path}.part", "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(f"{path}.part", path)
    return path


def operon_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) that are predicted to be in one operon."""
    return spark.read.csv(path, sep="\t", header=True).filter("bOp = 'TRUE'").select(F.col("SysName1").alias("src"), F.col("SysName2").alias("dst"))


def string_network(spark: SparkSession, path: str, sep: str = "\t", prefix: str | None = None) -> DataFrame:
    """(network, src, dst, weight, line) of three columns; ``prefix`` keeps an organism's lines and takes it off."""
    d = spark.read.csv(path, sep=sep, schema="src string, dst string, weight double")
    if prefix:
        d = d.filter(F.col("src").startswith(prefix)).select(F.substring("src", len(prefix) + 1, 1 << 20).alias("src"), F.substring("dst", len(prefix) + 1, 1 << 20).alias("dst"), "weight")
    return d.select(F.lit("string").alias("network"), "src", "dst", "weight", F.monotonically_increasing_id().alias("line"))


def string_edges(spark: SparkSession, path: str, organism: str, thesaurus: DataFrame, genes: DataFrame, *, sep: str = "\t", prefix: str | None = None, scale: bool = True) -> DataFrame:
    """An organism's network of a file, ready to score: its spellings put right, edges between genes of the matrix under their row names.

    Weights are scaled by the largest one of the whole file, whether its edge is kept or not.
    """
    d = string_network(spark, path, sep, prefix)
    d = d.withColumn("src", patched(organism, F.col("src"))).withColumn("dst", patched(organism, F.col("dst")))
    return renamed(exponential(d) if scale else d, thesaurus, genes, check_size=False)


def taxonomy(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} string" for n in names))


def gene_sets(spark: SparkSession, path: str, set_type: str) -> DataFrame:
    """(set_type, set_name, gene) of a JSON object of lists, or of lines ``set,g1;g2``; weights aren't supported."""
    if path.endswith((".json", ".json.gz")):
        d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("set_name", "genes"))
        return d.select(F.lit(set_type).alias("set_type"), "set_name", F.explode("genes").alias("gene"))
    d = delimited(spark, path, ",", quote='"')
    if d.filter(F.size("fields") > 2).limit(1).count():
        raise ValueError("sets with weights are not supported")
    genes = F.explode(F.split(F.get("fields", F.lit(1)), ";"))
    return d.select(F.lit(set_type).alias("set_type"), F.get("fields", F.lit(0)).alias("set_name"), genes.alias("gene")).withColumn("gene", F.trim("gene")).filter("gene <> ''")


def pipeline(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
