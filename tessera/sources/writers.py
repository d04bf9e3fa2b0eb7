"""Sinks: tables by iteration, and the text formats of other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.membership import packed
from ..operators.sequences import fasta_lines


def append_iteration(df: DataFrame, path: str, iteration: int | None = None) -> None:
    """Rows of an iteration, in a folder of their own, so that reading one iteration reads its files only."""
    d = df if iteration is None else df.withColumn("iteration", F.lit(iteration))
    d.write.mode("append").partitionBy("iteration").parquet(path)


def overwrite_row(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)


def write_ordered(d: DataFrame, path: str, *keys: str | Column, gzip: bool = False) -> None:
    """The texts in ``value`` as lines of a folder's parts: each a range of the keys, in order by their names."""
    d.orderBy(*keys).select("value").write.text(path, compression="gzip" if gzip else "none")


def write_matrix(m: DataFrame, path: str, cols: list, *, row: str = "row", col: str = "col", value: str = "value", gzip: bool = False) -> None:
    """Tab-separated, 17 decimals, rows by name; the header, without a label for the rows' names, is the first line of the first part."""
    cells = m.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("string"), value))).alias("c"))
    fields = [F.coalesce(F.format_string("%.17f", F.col("c")[str(c)]), F.lit("NA")) for c in cols]
    body = cells.select(F.col(row).cast("string").alias("_k"), F.concat_ws("\t", F.col(row).cast("string"), *fields).alias("value"))
    head = m.sparkSession.range(1).select(F.lit("").alias("_k"), F.lit("\t".join(map(str, cols))).alias("value"))
    write_ordered(body.withColumn("_h", F.lit(1)).unionByName(head.withColumn("_h", F.lit(0))), path, "_h", "_k", gzip=gzip)


def write_fasta(seqs: DataFrame, path: str) -> None:
    fasta_lines(seqs).select("text").write.text(path)


def write_memberships(memb: DataFrame, path: str, name: str) -> None:
    """A line a name, in order, as parts."""
    write_ordered(packed(memb, name).select(name, F.concat_ws("\t", F.col(name).cast("string"), "clusters").alias("value")), path, name)


def background_lines(freqs: DataFrame, order: int) -> DataFrame:
    """Lines of a background file, shorter k-mers first, after a comment."""
    body = freqs.select("k", "kmer", F.concat_ws(" ", "kmer", F.format_string("%.8f", "freq")).alias("value"))
    head = freqs.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"), F.lit("").alias("kmer"), F.lit(f"# {order} order Markov background model").alias("value"))
    return body.unionByName(head).orderBy("k", "kmer").select("value")


def meme_lines(motifs: DataFrame, pssm: DataFrame, letters: dict[str, float]) -> DataFrame:
    """Motifs (name, evalue, num_sites) with rows (name, pos, a, c, g, t) as the input of comparison tools."""
    row = F.concat_ws(" ", *[F.format_string("%.6f", F.col(x).cast("double")) for x in "acgt"])
    rows = pssm.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("t")))).alias("l"))
    d = motifs.join(rows, "name")
    head = F.format_string("MOTIF %s\nBL MOTIF %s width=0 seqs=0\nletter-probability matrix: alength= 4 w= %d nsites= %d E= %.3e\n", F.col("name").cast("string"), F.col("name").cast("string"), F.size("l"), F.col("num_sites").cast("int"), F.col("evalue"))
    body = d.select(F.col("name").cast("string").alias("_k"), F.concat(head, F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("value"))
    text = "MEME version 3.0\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies (from dataset with add-one prior applied):\n" + " ".join(f"{k} {v:.3f}" for k, v in sorted(letters.items()))
    return body.unionByName(motifs.sparkSession.range(1).select(F.lit("").alias("_k"), F.lit(text).alias("value"))).orderBy("_k").select("value")


def expression_json(expressions: DataFrame) -> DataFrame:
    """One JSON text a cluster: its genes' values by condition."""
    items = F.sort_array(F.collect_list(F.struct("gene", F.col("cond").alias("condition"), "value")))
    return expressions.groupBy("cluster").agg(F.to_json(items).alias("value"))


def microformats(rows: DataFrame) -> DataFrame:
    """One HTML text a cluster (cluster, genes, conds as arrays) with its names as lists."""
    items = lambda c, kind: F.concat(F.lit(f'<ol class="{kind}">'), F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ol>"))
    return rows.select("cluster", F.concat(F.format_string('<div class="cluster" id="cluster-%d">', F.col("cluster")), items(F.col("genes"), "genes"), items(F.col("conds"), "conditions"), F.lit("</div>")).alias("value"))


def matrix_parts(m: DataFrame, parts: int, least: int, most: int, *, col: str = "col", seed: int = 1) -> DataFrame:
    """Random subsets of columns for an ensemble: part, and the cells; each part draws its size and columns by hash."""
    cols = m.select(col).distinct()
    draws = m.sparkSession.range(parts).select(F.col("id").alias("part"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most - least + 1)) + least).alias("_k"))
    from pyspark.sql import Window as W

    picks = cols.crossJoin(F.broadcast(draws)).withColumn("_r", F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("part", col, F.lit(seed + 1)), col)))
    return m.join(picks.filter("_r <= _k").select("part", col), col)


def weeder_tables(pssms: DataFrame) -> DataFrame:
    """The two texts of each motif (cluster, motif_num, evalue, pssm, sites): its matrix behind a line of its length, e-value and genes with a
    site, and its sites, numbered."""
    rows = F.array_join(F.transform("pssm", lambda r: F.format_string("%f,%f,%f,%f", r[0], r[1], r[2], r[3])), "\n")
    genes = F.size(F.array_distinct(F.transform("sites", lambda x: x["name"])))
    first = F.concat(F.format_string("%d,NA,%f,%d\n", F.size("pssm"), F.col("evalue"), genes), rows)
    site = lambda x, i: F.format_string("%d,%s,%s,%d,%f,%s", i + 1, x["name"], F.when(x["reverse"], "-").otherwise("+"), x["start"], x["pvalue"], x["seq"])
    second = F.concat(F.lit(",gene,strand,start,p.value,site\n"), F.array_join(F.transform("sites", site), "\n"))
    return pssms.select("cluster", "motif_num", first.alias("f1"), second.alias("f2"))


def sequence_lines(seqs: DataFrame, sep: str = ",") -> DataFrame:
    """Lines of ids and sequences for a table."""
    return seqs.select(F.concat_ws(sep, F.col("id").cast("string"), F.col("seq")).alias("value"))


def pssm_lines(rows: DataFrame) -> DataFrame:
    """One text a motif, a line for each position, for comparison by eye."""
    line = F.format_string("%.3f %.3f %.3f %.3f", *[F.col(x).cast("double") for x in "acgt"])
    d = rows.groupBy("motif_info_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("t")))).alias("l"))
    return d.select("motif_info_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("value"))
