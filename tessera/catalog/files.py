"""Files: what writers put down and readers get back, result stores, and the settings of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import scalars
from ..operators import enrichment as E
from ..operators import motifs as M
from ..operators import names as N
from ..operators import results as R
from ..operators import sequences as Q
from ..plans import config
from ..sources import pages, store, text, writers
from . import results, scores
from .base import query
from .matrix import long, sparse


def lines_at(d: DataFrame, name: str, *, suffix: str = "") -> str:
    """A folder with the rows' ``value`` as text lines: one file in order of ``place`` if there is such a column, else parts as they come."""
    path = tables.place(d.sparkSession, name)
    if "place" in d.columns:
        d = d.orderBy("place").coalesce(1)
    d.select("value").write.text(path + suffix)
    return path + suffix


@query("matrix_file", "SELECT CAST(gene AS VARCHAR) AS row, CAST(cond AS VARCHAR) AS col, value FROM expr_sparse")
def _(v):
    path = tables.place(v.spark, "matrix")
    conds = [r[0] for r in v.expr_sparse.select("cond").distinct().orderBy("cond").collect()]
    writers.write_matrix(sparse(v), path, conds, gzip=True)
    return text.matrix(v.spark, path).select("row", "col", F.round("value", 9).alias("value"))


RATIOS = {
    "m": "SELECT gene AS row, cond AS col, value - 4.5 AS value FROM expr_sparse",
    "z": "SELECT count(DISTINCT row) AS nr, count(DISTINCT col) AS nc FROM m",
    "r": "SELECT row FROM m, z GROUP BY row, nc HAVING (nc - sum(CASE WHEN abs(value) > 0.17 THEN 1 ELSE 0 END)) / nc < 0.98",
    "c": "SELECT col FROM m, z GROUP BY col, nr HAVING (nr - sum(CASE WHEN abs(value) > 0.17 THEN 1 ELSE 0 END)) / nr < 0.1",
    "k": "SELECT m.* FROM m JOIN r USING (row) JOIN c USING (col)",
    "s": "SELECT row, quantile_cont(value, 0.5) AS mid, round(stddev_samp(value), 8) AS sd FROM k GROUP BY 1",
}


@query("ratio_file", "SELECT CAST(row AS VARCHAR) AS row, CAST(col AS VARCHAR) AS col, round((value - mid) / nullif(sd, 0), 5) + 0.0 AS value FROM k JOIN s USING (row)", **RATIOS)
def _(v):
    path = tables.place(v.spark, "ratios")
    conds = [r[0] for r in v.expr_sparse.select("cond").distinct().orderBy("cond").collect()]
    writers.write_matrix(sparse(v).withColumn("value", F.col("value") - 4.5), path, conds)
    return text.ratios(v.spark, path).select("row", "col", (F.round("value", 5) + 0.0).alias("value"))


@query("row_and_column_values", "SELECT 'row' AS axis, cond AS name, value FROM expr WHERE gene = 7 UNION ALL SELECT 'col', gene, value FROM expr WHERE cond = 19952")
def _(v):
    from ..operators import matrix as X

    row = X.row_values(long(v), 7).select(F.lit("row").alias("axis"), F.col("col").alias("name"), "value")
    return row.unionByName(X.column_values(long(v), 19952).select(F.lit("col").alias("axis"), F.col("row").alias("name"), "value"))


@query("row_filter", "SELECT gene AS row, cond AS col, round(value - min(value) OVER (PARTITION BY gene), 6) + 0.0 AS value FROM expr")
def _(v):
    from ..operators import matrix as X

    return X.row_filter(long(v), lambda x: x - x.min()).withColumn("value", F.round("value", 6) + 0.0)


@query("delimited_file", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM {nation} WHERE n_nationkey > 0")
def _(v):
    row = F.concat(F.lit('"'), F.col("n_nationkey"), F.lit('";'), F.col("n_name"), F.lit(';"'), F.col("n_regionkey"), F.lit('"'))
    d = v.nation.select((F.col("n_nationkey") * 3).alias("place"), row.alias("value"))
    d = d.unionByName(d.select((F.col("place") + 1).alias("place"), F.lit("# note; of no row").alias("value"))).unionByName(d.select((F.col("place") + 2).alias("place"), F.lit("  ").alias("value")))
    got = text.delimited(v.spark, lines_at(d, "delimited"), ";", header=True, comment="#", quote='"')
    return got.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(("key", "name", "region"))])


@query("fasta_file", "SELECT CAST(id AS VARCHAR) AS id, seq FROM seqs WHERE length(seq) > 0")
def _(v):
    path = tables.place(v.spark, "fasta")
    writers.write_fasta(v.seqs, path)
    return text.fasta(v.spark, path)


@query("fasta_source", "SELECT concat('D', CAST(id AS VARCHAR)) AS id, replace(seq, 'A', 'N') AS seq FROM seqs WHERE id % 2 = 0")
def _(v):
    path = tables.place(v.spark, "fasta")
    writers.write_fasta(v.seqs.select("id", F.lower(F.translate("seq", "A", "x")).alias("seq")), path)
    known = v.seqs.filter("id % 2 = 0").select(F.col("id").cast("string").alias("alias"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("original"))
    return text.fasta_source(v.spark, path, known)


@query("membership_file", "SELECT CAST(gene AS VARCHAR) AS gene, row_number() OVER (PARTITION BY gene ORDER BY slot) - 1 AS slot, cluster FROM row_memb")
def _(v):
    path = tables.place(v.spark, "members")
    writers.write_memberships(v.row_memb, path, "gene")
    return text.memberships(v.spark, path, "\t")


@query("gene_set_files", "SELECT 'json' AS set_type, set_name, CAST(gene AS VARCHAR) AS gene FROM sets WHERE set_type = 'nation' UNION ALL SELECT 'csv', set_name, CAST(gene AS VARCHAR) FROM sets WHERE set_type = 'balance'")
def _(v):
    by = lambda kind: v.sets.filter(F.col("set_type") == kind).groupBy("set_name").agg(F.sort_array(F.collect_list(F.col("gene").cast("string"))).alias("genes"))
    whole = by("nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("set_name", "genes")))).alias("value"))  # a small file
    lines = by("balance").select(F.concat(F.lit('"'), F.col("set_name"), F.lit('",'), F.array_join("genes", "; ")).alias("value"))
    json = text.gene_sets(v.spark, lines_at(whole, "sets", suffix=".json"), "json")
    return json.unionByName(text.gene_sets(v.spark, lines_at(lines, "sets"), "csv"))


@query("taxonomy_file", "SELECT CAST(n_nationkey AS VARCHAR) AS tid, n_name AS code, CAST(n_regionkey AS VARCHAR) AS ncbi FROM {nation}")
def _(v):
    d = v.nation.select(F.col("n_nationkey").alias("place"), F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    d = d.unionByName(v.spark.createDataFrame([(-1, "# numbers of species")], "place int, value string"))
    return text.taxonomy(v.spark, lines_at(d, "taxonomy"), ["tid", "code", "ncbi"])


@query("operon_file", "SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM predictions")
def _(v):
    d = v.predictions.select(F.concat_ws("\t", F.lit("1"), F.lit("2"), "src", "dst", F.lit("TRUE")).alias("value"), F.col("src").alias("place"))
    d = d.unionByName(v.predictions.select(F.concat_ws("\t", F.lit("1"), F.lit("2"), "dst", "src", F.lit("FALSE")).alias("value"), F.col("src").alias("place")))
    d = d.unionByName(v.spark.createDataFrame([("Gene1\tGene2\tSysName1\tSysName2\tbOp", -1)], "value string, place long"))
    return text.operon_predictions(v.spark, lines_at(d, "operons"))


@query(
    "string_file",
    "SELECT src, dst, round(weight, 6) AS weight FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, arg_min(1000 * exp(weight / (SELECT max(weight) FROM e)) / exp(1.0), line) AS weight FROM (SELECT concat('G', CAST(src AS VARCHAR)) AS a, concat('G', CAST(dst AS VARCHAR)) AS b, weight, line FROM e) x WHERE a <> b AND substr(a, 2)::BIGINT % 3 > 0 AND substr(b, 2)::BIGINT % 3 > 0 GROUP BY 1, 2) y",
    e="SELECT src, dst, max(weight) AS weight, min(line) AS line FROM edges WHERE network = 'first' AND src < dst GROUP BY 1, 2",
)
def _(v):
    e = v.edges.filter("network = 'first' AND src < dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    d = e.select(F.concat_ws("\t", F.concat(F.lit("99.SO"), "src"), F.concat(F.lit("99.SO"), "dst"), "weight").alias("value"))
    d = d.unionByName(v.spark.createDataFrame([("98.SO1\t98.SO2\t1e9",)], "value string"))
    names = v.genes.select(F.concat(F.lit("SO_"), F.col("gene").cast("string")).alias("alias"), F.concat(F.lit("G"), F.col("gene").cast("string")).alias("original"), "gene")
    known = names.filter("gene % 3 > 0").select(F.col("original").alias("gene"))
    return text.string_edges(v.spark, lines_at(d, "string"), "son", names.drop("gene"), known, prefix="99.").select("src", "dst", F.round("weight", 6).alias("weight"))


LOCATED = {
    "f": "SELECT s_suppkey AS gene, concat('F', CAST(s_suppkey AS VARCHAR)) AS id, concat('c', CAST(s_nationkey % 4 AS VARCHAR)) AS contig, (s_suppkey * 37 % 200)::BIGINT + 1 AS s, (s_suppkey * 37 % 200)::BIGINT + 40 AS e, s_nationkey % 2 = 0 AS reverse FROM {supplier}",
    "g": "SELECT concat('c', CAST(cluster % 4 AS VARCHAR)) AS contig, string_agg(seq, '' ORDER BY id) AS seq FROM seqs WHERE id < 8 GROUP BY 1",
    "w": "SELECT id, gene, reverse, seq, CASE WHEN reverse THEN e + 1 - 20 ELSE s - 1 - 30 END AS a, CASE WHEN reverse THEN e + 1 + 30 ELSE s - 1 + 20 END AS b FROM f JOIN g USING (contig)",
    "cut": "SELECT id, gene, reverse, CASE WHEN least(b, length(seq) + 1) > greatest(a, 1) THEN substr(seq, greatest(a, 1)::BIGINT, (least(b, length(seq) + 1) - greatest(a, 1))::BIGINT) ELSE '' END AS part FROM w",
    "up": "SELECT id, gene, CASE WHEN reverse THEN reverse(translate(upper(part), 'ACGT', 'TGCA')) ELSE part END AS seq FROM cut",
}


def rsat_folder(v) -> str:
    """An organism's files as the readers find them."""
    folder = tables.place(v.spark, "rsat")
    s = v.supplier.withColumn("start", F.col("s_suppkey") * 37 % 200 + 1)
    row = F.concat_ws("\t", F.concat(F.lit("F"), "s_suppkey"), F.lit("CDS"), "s_name", F.concat(F.lit("c"), F.col("s_nationkey") % 4), F.concat(F.lit("<"), "start"), F.concat(F.lit(">"), F.col("start") + 39), F.when(F.col("s_nationkey") % 2 == 0, "R").otherwise("D"))
    head = [f"-- field {i + 1}\t{n}" for i, n in enumerate(("id", "type", "name", "contig", "start_pos", "end_pos", "strand"))]
    heads = v.spark.createDataFrame([(i - 100, h) for i, h in enumerate(head)], "place long, value string")
    heads.unionByName(s.select(F.col("s_suppkey").alias("place"), row.alias("value"))).orderBy("place").select("value").coalesce(1).write.text(f"{folder}/feature.tab")
    s.select(F.concat_ws("\t", F.concat(F.lit("F"), "s_suppkey"), "s_name", F.lit("primary")).alias("value")).coalesce(1).write.text(f"{folder}/feature_names.tab")
    for c in range(4):
        seq = v.seqs.filter(f"id < 8 AND cluster % 4 = {c}").orderBy("id").select(F.lower("seq").alias("value"))
        seq.coalesce(1).write.text(f"{folder}/c{c}.tab")
    return folder


@query("feature_file", "SELECT id, 'CDS' AS type, s_name AS name, contig, s::INTEGER AS \"start\", e::INTEGER AS \"end\", reverse FROM f JOIN {supplier} ON s_suppkey = gene", **LOCATED)
def _(v):
    return text.features(v.spark, f"{rsat_folder(v)}/feature.tab")


@query("gene_sequences", "SELECT s_name AS gene, id, seq FROM up JOIN {supplier} ON s_suppkey = gene WHERE seq <> ''", **LOCATED)
def _(v):
    own, names, contigs = text.rsat(v.spark, rsat_folder(v))
    return M.gene_sequences(v.supplier.select(F.col("s_name").alias("gene")), names, own, contigs, -20, 30)


HEADS = "SELECT s_suppkey AS gene, s_suppkey - s_suppkey % 3 + 1 AS head FROM {supplier} WHERE s_suppkey % 2 = 0 AND s_suppkey - s_suppkey % 3 + 1 IN (SELECT s_suppkey FROM {supplier})"


@query("operon_sequences", "SELECT s.s_name AS gene, up.id, up.seq FROM {supplier} s LEFT JOIN h ON h.gene = s.s_suppkey JOIN up ON up.gene = coalesce(h.head, s.s_suppkey) WHERE up.seq <> ''", **LOCATED, h=HEADS)
def _(v):
    own, names, contigs = text.rsat(v.spark, rsat_folder(v))
    s = v.supplier.select(F.col("s_suppkey").alias("gene"))
    h = s.filter("gene % 2 = 0").select(F.concat(F.lit("F"), "gene").alias("gene"), (F.col("gene") - F.col("gene") % 3 + 1).alias("head"))
    h = h.join(s.select(F.col("gene").alias("head")), "head", "left_semi").select("gene", F.concat(F.lit("F"), "head").alias("head"))
    return M.gene_sequences(v.supplier.select(F.col("s_name").alias("gene")), names, own, contigs, -20, 30, h)


@query("sequence_table", "SELECT concat(id, ',', seq) AS value FROM up WHERE seq <> ''", **LOCATED)
def _(v):
    own, names, contigs = text.rsat(v.spark, rsat_folder(v))
    return writers.sequence_lines(M.gene_sequences(v.supplier.select(F.col("s_name").alias("gene")), names, own, contigs, -20, 30))


@query("reverse_map", "SELECT original AS id, max(alias) AS name FROM thesaurus WHERE alias IN (SELECT s_name FROM {supplier} UNION SELECT concat('S', CAST(s_suppkey AS VARCHAR)) FROM {supplier} WHERE s_suppkey % 2 = 0) GROUP BY 1")
def _(v):
    names = v.supplier.select(F.col("s_name").alias("name")).union(v.supplier.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))
    return N.by_feature(names, v.thesaurus)


@query("oligo_map", "SELECT m.gene, e.cond AS col, value FROM expr_sparse e JOIN (SELECT p_size AS gene, max(p_partkey) AS oligo FROM {part} GROUP BY 1) m ON m.oligo = e.gene")
def _(v):
    o = v.part.groupBy("p_size").agg(F.max("p_partkey").alias("oligo")).select("oligo", F.col("p_size").alias("gene"), F.lit(1).alias("line"))
    o = o.unionByName(o.select("oligo", (F.col("gene") + 100).alias("gene"), F.lit(0).alias("line")))
    return N.by_oligo(v.expr_sparse.select(F.col("gene").alias("oligo"), F.col("cond").alias("col"), "value"), o)


@query("name_exceptions", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Pseudomonas aeruginosa' ELSE n_name END AS species, CASE WHEN n_nationkey = 5 THEN '511145' ELSE CAST(n_nationkey AS VARCHAR) END AS taxonomy FROM {nation}")
def _(v):
    species = F.when(F.col("n_nationkey") == 3, "Pseudomonas aeruginosa PAO1").otherwise(F.col("n_name"))
    number = F.when(F.col("n_nationkey") == 5, "83333").otherwise(F.col("n_nationkey").cast("string"))
    return v.nation.select("n_nationkey", N.patched_species(species).alias("species"), N.patched_taxonomy(number).alias("taxonomy"))


@query("modified_names", "SELECT s_suppkey, concat('VNG', lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'), 'C', CASE WHEN s_suppkey % 3 = 0 THEN 'm' ELSE '' END) AS first, CASE WHEN s_suppkey % 3 = 0 THEN concat('VNG', lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0'), 'C') END AS second FROM {supplier}")
def _(v):
    name = F.concat(F.lit("VNG"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("C"), F.when(F.col("s_suppkey") % 3 == 0, "m").otherwise(""))
    both = N.without_vng_modification(name)
    return v.supplier.select("s_suppkey", F.get(both, F.lit(0)).alias("first"), F.get(both, F.lit(1)).alias("second"))


@query("gene_pairs", "SELECT a.n_regionkey, a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN {nation} c ON a.n_regionkey = c.n_regionkey AND b.n_nationkey < c.n_nationkey")
def _(v):
    d = N.combinations(v.nation, ["n_regionkey"], "n_nationkey", 3)
    return d.select("n_regionkey", *[F.col("items")[i].alias(x) for i, x in enumerate("abc")])


@query("all_kmers", "SELECT row_number() OVER (ORDER BY a.kmer) - 1 AS place, a.kmer, coalesce(n, 0) AS times FROM (SELECT concat(a, b, c, d) AS kmer FROM l, (SELECT a AS b FROM l) y, (SELECT a AS c FROM l) z, (SELECT a AS d FROM l) w) a LEFT JOIN (SELECT substr(seq, i, 4) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, len(seq) - 2)) AS i FROM seqs) q GROUP BY 1) t ON t.kmer = a.kmer", l="SELECT unnest(['A', 'C', 'G', 'T']) AS a")
def _(v):
    """All words of four letters and how often the sequences have them."""
    return Q.all_kmers(v.spark, 4).join(Q.kmers(v.seqs, 4), "kmer", "left").select("place", "kmer", F.coalesce("times", F.lit(0)).alias("times"))


@query("degenerate_letters", "SELECT id, translate(upper(translate(seq, 'ACG', 'rkn')), 'RYKMSWN', 'GTGAGAG') AS seq FROM seqs")
def _(v):
    return v.seqs.select("id", Q.concrete(F.concat(F.lit(" "), F.translate("seq", "ACG", "rkn"), F.lit("\t "))).alias("seq"))


@query("outer_products", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_nationkey * 2 - b.n_nationkey AS value FROM {nation} a, {nation} b WHERE a.n_regionkey = b.n_regionkey")
def _(v):
    d = v.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    d = d.select("k", F.posexplode(scalars.outer(F.col("k"), F.col("k"), lambda a, b: a * 2 - b)).alias("i", "r"))
    return d.select(F.get("k", F.col("i")).alias("a"), F.posexplode("r").alias("j", "value"), "k").select("a", F.get("k", F.col("j")).alias("b"), "value")


N_ITERATIONS = 200


def iterations(v, **columns) -> DataFrame:
    """What settings give for each iteration that was logged, and how many log rows it has."""
    rows = [(i, *[f(i) for f in columns.values()]) for i in range(1, N_ITERATIONS + 1)]
    kinds = ", ".join(f"{n} {'boolean' if isinstance(rows[0][k + 1], bool) else 'double'}" for k, n in enumerate(columns))
    logged = v.runs.groupBy("iteration").agg(F.count("*").alias("logged"))
    return logged.join(F.broadcast(v.spark.createDataFrame(rows, f"iteration long, {kinds}")), "iteration")  # a row for each iteration of the settings


STEPS = "SELECT iteration AS i, count(*) AS logged FROM runs GROUP BY 1"


@query("schedules", "SELECT i AS iteration, logged, i % 7 = 1 AS networks, i >= 2 AND (i - 2) % 10 = 0 AS motifs, i IN (3, 5) OR (i >= 20 AND i % 20 = 0) AS mixed FROM n", n=STEPS)
def _(v):
    return iterations(v, networks=config.Schedule("1,7"), motifs=config.Schedule("2,10"), mixed=config.Schedule("3:5:20,20"))


@query("scalings", "SELECT i AS iteration, logged, round(CASE WHEN i < 150 THEN 1e-5 + (0.5 - 1e-5) * (i - 1) / 149 ELSE 0.5 END, 9) AS seq, round(CASE WHEN i <= 100 THEN 1e-5 ELSE 1e-5 + (1 - 1e-5) * least(i - 101, 149) / 149 END, 9) AS joined, 0.3::DOUBLE AS const FROM n", n=STEPS)
def _(v):
    of = lambda t: (lambda f: lambda i: round(f(i), 9))(config.scaling(t, N_ITERATIONS))
    return iterations(v, seq=of("seq(1e-5, 0.5, length=num_iterations*3/4)"), joined=of("c(rep(1e-5, 100), seq(1e-5, 1, length=num_iterations*3/4))"), const=of("0.3"))


@query("fuzzy_coefficients", "SELECT i AS iteration, logged, round(0.75 * exp(-i / 50.0), 9) AS own, round(0.7 * exp(-i / (200 / 3.0)) + 0.05, 9) AS standard FROM n", n=STEPS)
def _(v):
    own = iterations(v, own=lambda i: round(config.fuzzy_coefficient(i, N_ITERATIONS), 9))
    return own.select("iteration", "logged", "own", F.round(scalars.standard_fuzzy(F.col("iteration"), N_ITERATIONS), 9).alias("standard"))


@query(
    "default_clusters",
    "SELECT iteration, n AS genes, c AS conds, round_even(n * 2 / 20.0, 0)::BIGINT AS clusters, round_even(CASE WHEN c >= 60 THEN round_even(n * 2 / 20.0, 0) / 2 ELSE 2 * round_even(n * 2 / 20.0, 0) / 3 END, 0)::BIGINT AS per_col FROM (SELECT iteration, count(DISTINCT order_num) AS n FROM row_members GROUP BY 1) r JOIN (SELECT iteration, count(DISTINCT order_num) AS c FROM column_members GROUP BY 1) q USING (iteration)",
)
def _(v):
    """Clusters and slots for the sizes that iterations have."""
    size = lambda d, name: d.groupBy("iteration").agg(F.count_distinct("order_num").alias(name))
    slots = F.udf(config.default_clusters, "struct<clusters:long,per_col:long>")  # a row for each iteration
    d = size(v.row_members, "genes").join(size(v.column_members, "conds"), "iteration")
    return d.withColumn("s", slots("genes", "conds")).select("iteration", "genes", "conds", "s.clusters", "s.per_col")


@query("result_store", "SELECT cluster, num_rows, num_cols, residual, iteration FROM cluster_stats WHERE iteration = (SELECT max(iteration) FROM cluster_stats WHERE iteration < 6)")
def _(v):
    folder = tables.place(v.spark, "store")
    writers.append_iteration(v.cluster_stats.filter("iteration < 4"), f"{folder}/cluster_stats")
    writers.append_iteration(v.cluster_stats.filter("iteration BETWEEN 4 AND 5"), f"{folder}/cluster_stats")
    for i in (4, 5):
        writers.append_iteration(v.row_members.filter(f"iteration = {i}").drop("iteration"), f"{folder}/row_members", i)
    s = store.Store(v.spark, folder)
    return s.table("cluster_stats", s.last_iteration())


MOTIFS = "SELECT rowid, cluster, motif_num, evalue FROM motif_infos WHERE iteration = 2 AND seqtype = 'upstream'"


def motifs_of(v) -> DataFrame:
    """Motifs with their matrices, annotations and sites, as a search gives them."""
    m = v.motif_infos.filter("iteration = 2 AND seqtype = 'upstream'").select("rowid", "cluster", "motif_num", "evalue")
    p = v.motif_pssm_rows.groupBy(F.col("motif_info_id").alias("rowid")).agg(F.sort_array(F.collect_list(F.struct("pos", F.array(*[F.col(x).cast("double") for x in "acgt"]).alias("r")))).alias("p")).select("rowid", F.transform("p", lambda x: x["r"]).alias("pssm"))
    a = v.motif_annotations.join(v.row_names, F.col("gene_num") == F.col("order_num")).groupBy(F.col("motif_info_id").alias("rowid"))
    a = a.agg(F.collect_list(F.struct(F.col("name").alias("gene"), "position", "reverse", "pvalue")).alias("annotations"))
    d = m.join(p, "rowid").join(a, "rowid").withColumn("motif_num", F.col("rowid"))
    site = F.struct(F.concat(F.lit("s"), F.col("rowid").cast("string")).alias("name"), F.lit(True).alias("reverse"), F.col("cluster").alias("start"), F.col("evalue").alias("pvalue"), F.lit("A").alias("left"), F.lit("CC").alias("seq"), F.lit("").alias("right"))
    return d.withColumn("sites", F.array(site))


OWN = "SELECT o.* FROM (" + MOTIFS + ") o WHERE rowid IN (SELECT motif_info_id FROM motif_pssm_rows) AND rowid IN (SELECT motif_info_id FROM motif_annotations JOIN row_names ON gene_num = order_num)"


@query("motif_results", "SELECT m.rowid AS motif_num, cluster, evalue, n_rows, n_found, n_sites FROM m JOIN (SELECT motif_info_id, count(*) AS n_rows FROM motif_pssm_rows GROUP BY 1) p ON p.motif_info_id = m.rowid JOIN (SELECT motif_info_id, count(*) AS n_found FROM motif_annotations JOIN row_names ON gene_num = order_num GROUP BY 1) a ON a.motif_info_id = m.rowid, (SELECT 1::BIGINT AS n_sites) z", m=OWN)
def _(v):
    t = R.motif_tables(motifs_of(v), 2, "upstream", v.row_names)
    n = lambda x, name: t[x].groupBy(F.col("motif_info_id").alias("rowid")).agg(F.count("*").alias(name))
    d = t["motif_infos"].join(n("motif_pssm_rows", "n_rows"), "rowid").join(n("motif_annotations", "n_found"), "rowid").join(n("meme_motif_sites", "n_sites"), "rowid")
    return d.select("motif_num", "cluster", "evalue", "n_rows", "n_found", "n_sites")


@query(
    "weeder_files",
    "SELECT rowid AS motif_num, cluster, concat(printf('%d,NA,%f,%d', len(r)::INTEGER, evalue, 1), chr(10), array_to_string(r, chr(10))) AS f1, concat(',gene,strand,start,p.value,site', chr(10), printf('1,s%d,-,%d,%f,CC', rowid, cluster, evalue)) AS f2 FROM m JOIN (SELECT motif_info_id, list(printf('%f,%f,%f,%f', a::DOUBLE, c::DOUBLE, g::DOUBLE, t::DOUBLE) ORDER BY pos) AS r FROM motif_pssm_rows GROUP BY 1) p ON p.motif_info_id = m.rowid",
    m=OWN,
)
def _(v):
    return writers.weeder_tables(motifs_of(v))


@query("pssm_dump", "SELECT motif_info_id, string_agg(printf('%.3f %.3f %.3f %.3f', a::DOUBLE, c::DOUBLE, g::DOUBLE, t::DOUBLE), chr(10) ORDER BY pos) AS value FROM motif_pssm_rows GROUP BY 1")
def _(v):
    return writers.pssm_lines(v.motif_pssm_rows)


@query("motif_matches", "SELECT motif_info_id1, motif_info_id2, pvalue FROM tomtom_results")
def _(v):
    row = F.concat_ws("\t", F.col("motif_info_id1").cast("string"), F.col("motif_info_id2").cast("string"), F.lit("0"), F.col("pvalue").cast("string"), F.lit("ACGT"))
    d = v.tomtom_results.select(row.alias("value")).unionByName(v.motif_infos.select(F.concat_ws("\t", "rowid", "rowid", F.lit("0"), F.lit("0.0"), F.lit("AC")).alias("value")))
    return M.matches(d.unionByName(v.spark.createDataFrame([("#Query ID\tTarget ID\tOptimal offset\tp-value",), ("",)], "value string")))


@query("background_file", "SELECT CASE WHEN k = 0 THEN '# 1 order Markov background model' ELSE concat(kmer, ' ', printf('%.8f', round(f, 8))) END AS value FROM b", **{f"k{k}": f"SELECT {k} AS k, kmer, n / sum(n) OVER () AS f FROM (SELECT substr(seq, i, {k}) AS kmer, count(*) AS n FROM (SELECT seq, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM seqs) q GROUP BY 1) w" for k in (1, 2)}, b="SELECT 0 AS k, '' AS kmer, 0.0 AS f UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2")
def _(v):
    freqs = Q.background(v.seqs, 1).withColumn("freq", F.round("freq", 8))
    return writers.background_lines(freqs, 1)


@query("best_set_lines", "SELECT CAST(2 AS BIGINT) AS iteration, set_type, concat('2,', string_agg(coalesce(set_name, 'NA'), ',' ORDER BY cluster)) AS line FROM (SELECT t.set_type, c.cluster, set_name FROM (SELECT DISTINCT set_type FROM sets) t CROSS JOIN (SELECT unnest(generate_series(1, 8)) AS cluster) c LEFT JOIN (SELECT set_type, cluster, arg_min(set_name, (pvalue, set_name)) AS set_name FROM pv GROUP BY 1, 2) b ON b.set_type = t.set_type AND b.cluster = c.cluster) q GROUP BY 2", **scores.SETS)
def _(v):
    p = scores.pvalues(v).groupBy("set_type", "cluster").agg(F.min_by("set_name", F.struct("pvalue", "set_name")).alias("set_name"))
    return E.best_set_lines(p.withColumn("iteration", F.lit(2).cast("long")), 8, "set_name")


@query(
    "graph_file",
    "SELECT value FROM (SELECT concat('  <node id=\"', kind, ':', id, '\"><data key=\"kind\">', kind, '</data></node>') AS value FROM n UNION ALL SELECT concat('  <edge source=\"', CASE kind WHEN 'similar' THEN 'motif' ELSE 'cluster' END, ':', a, '\" target=\"', CASE kind WHEN 'member' THEN 'gene' ELSE 'motif' END, ':', b, '\"><data key=\"kind\">', kind, '</data></edge>') FROM e) q",
    n=f"SELECT 'cluster' AS kind, CAST(cluster AS VARCHAR) AS id FROM row_members UNION SELECT 'gene', name FROM row_members JOIN row_names USING (order_num) UNION SELECT 'motif', {results.KEY} FROM motif_infos",
    k=f"SELECT rowid, {results.KEY} AS key FROM motif_infos",
    e=f"SELECT 'member' AS kind, CAST(cluster AS VARCHAR) AS a, name AS b FROM row_members JOIN row_names USING (order_num) UNION SELECT 'motif', CAST(cluster AS VARCHAR), {results.KEY} FROM motif_infos UNION SELECT 'similar', x.key, y.key FROM tomtom_results JOIN k x ON x.rowid = motif_info_id1 JOIN k y ON y.rowid = motif_info_id2 WHERE pvalue <= 0.02",
)
def _(v):
    nodes = R.graph_nodes(v.row_members, v.row_names, v.motif_infos)
    edges = R.graph_edges(v.row_members, v.row_names, v.motif_infos, v.tomtom_results, 0.02)
    return R.graph_lines(nodes, edges).filter("part IN (1, 2)").select("value")


@query("expression_files", "SELECT cluster, string_agg(concat('{\"gene\":', CAST(gene AS VARCHAR), ',\"condition\":', CAST(cond AS VARCHAR), ',\"value\":', CAST(value::DECIMAL(18, 2) AS VARCHAR), '}'), ',' ORDER BY gene, cond) AS value FROM (SELECT cluster, e.gene, e.cond, value FROM expr e JOIN (SELECT DISTINCT gene, cluster FROM row_memb) m ON m.gene = e.gene) q GROUP BY 1")
def _(v):
    d = v.expr.join(v.row_memb.select("gene", "cluster").distinct(), "gene").withColumn("value", F.round("value", 2).cast("decimal(18,2)"))
    d = writers.expression_json(d)
    return d.select("cluster", F.expr("substring(value, 2, length(value) - 2)").alias("value"))


@query("microformats", "SELECT cluster, concat('<div class=\"cluster\" id=\"cluster-', CAST(cluster AS VARCHAR), '\"><ol class=\"genes\">', (SELECT string_agg(concat('<li>', CAST(gene AS VARCHAR), '</li>'), '' ORDER BY CAST(gene AS VARCHAR)) FROM rm WHERE rm.cluster = c.cluster), '</ol><ol class=\"conditions\">', (SELECT string_agg(concat('<li>', CAST(cond AS VARCHAR), '</li>'), '' ORDER BY CAST(cond AS VARCHAR)) FROM cm WHERE cm.cluster = c.cluster), '</ol></div>') AS value FROM (SELECT DISTINCT cluster FROM rm) c", rm="SELECT DISTINCT gene, cluster FROM row_memb", cm="SELECT DISTINCT cond, cluster FROM col_memb")
def _(v):
    lists = lambda d, n, out: d.groupBy("cluster").agg(F.sort_array(F.collect_set(F.col(n).cast("string"))).alias(out))
    return writers.microformats(lists(v.row_memb, "gene", "genes").join(lists(v.col_memb, "cond", "conds"), "cluster"))


@query("cluster_stack", "SELECT cluster, count(DISTINCT gene) AS nrows, string_agg(DISTINCT CAST(gene AS VARCHAR), ',' ORDER BY CAST(gene AS VARCHAR)) AS rows, max(k) AS ncols, max(residual) AS residual FROM row_memb LEFT JOIN (SELECT cluster, count(DISTINCT cond) AS k FROM col_memb GROUP BY 1) c USING (cluster) LEFT JOIN (SELECT cluster, residual FROM cluster_stats WHERE iteration = 3) s USING (cluster) GROUP BY 1")
def _(v):
    d = R.cluster_stack(v.row_memb.withColumn("gene", F.col("gene").cast("string")), v.col_memb, v.cluster_stats.filter("iteration = 3"))
    return d.select("cluster", "nrows", F.array_join("rows", ",").alias("rows"), "ncols", "residual")


@query("portal_chain", "SELECT r_name AS species, n_name AS network, s_suppkey AS bicluster_id, concat('P', CAST(l_partkey AS VARCHAR)) AS gene FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {supplier} ON s_nationkey = n_nationkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) l ON l_suppkey = s_suppkey")
def _(v):
    species = v.region.select(F.col("r_regionkey").alias("species_id"), F.col("r_name").alias("species"))
    nets = v.nation.select(F.col("n_nationkey").alias("network_id"), F.col("n_name").alias("network"), F.col("n_regionkey").alias("species_id"))
    clusters = v.supplier.select(F.col("s_suppkey").alias("bicluster_id"), F.col("s_nationkey").alias("network_id"))
    genes = v.spark.read.parquet(f"{v.sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("bicluster_id"), F.col("l_partkey").alias("gene_id")).distinct()
    names = v.part.select(F.col("p_partkey").alias("gene_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))
    return R.linked_species(species, nets, clusters, genes, names)


PORTAL = {"g": "SELECT DISTINCT gene FROM row_memb WHERE cluster = 2", "c": "SELECT DISTINCT cond FROM col_memb WHERE cluster = 2"}


@query("portal_values", "SELECT gene, cond, value FROM expr WHERE gene IN (SELECT gene FROM g) OR cond IN (SELECT cond FROM c)", **PORTAL)
def _(v):
    return R.in_either(v.expr, v.row_memb.filter("cluster = 2"), v.col_memb.filter("cluster = 2"))


@query("portal_expressions", "SELECT g.gene, concat(CAST(g.gene AS VARCHAR), chr(9), string_agg(CASE WHEN value IS NULL THEN 'NA' ELSE printf('%.6f', value) END, chr(9) ORDER BY c.cond)) AS line FROM g CROSS JOIN c LEFT JOIN expr_sparse e ON e.gene = g.gene AND e.cond = c.cond GROUP BY g.gene", g="SELECT DISTINCT gene FROM part_cells WHERE gene % 3 = 0", c="SELECT DISTINCT cond FROM part_cells WHERE cond >= 1994")
def _(v):
    genes, conds = v.part_cells.filter("gene % 3 = 0"), v.part_cells.filter("cond >= 1994")
    return R.expression_table(v.expr_sparse, genes, conds)


SVG = "concat('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"', CAST({0} AS VARCHAR), '\" height=\"100\">', {1}, '</svg>')"


@query(
    "expression_plots",
    f"SELECT cluster, {SVG.format('max(w)', "string_agg(concat('<polyline fill=\"none\" stroke=\"gray\" points=\"', t, '\"/>'), '' ORDER BY gene)")} AS svg FROM (SELECT cluster, gene, count(*) * 10 AS w, string_agg(concat(CAST(i * 10 AS VARCHAR), ',', CAST(y AS VARCHAR)), ' ' ORDER BY i) AS t FROM pt GROUP BY 1, 2) q GROUP BY 1",
    rm="SELECT DISTINCT gene, cluster FROM row_memb", cm="SELECT DISTINCT cond, cluster FROM col_memb",
    ex="SELECT rm.cluster, e.gene, e.cond, cm.cond IS NULL AS out, value FROM expr e JOIN rm ON rm.gene = e.gene LEFT JOIN cm ON cm.cluster = rm.cluster AND cm.cond = e.cond",
    pt="SELECT cluster, gene, row_number() OVER (PARTITION BY cluster, gene ORDER BY out, cond) - 1 AS i, round(100 * (max(value) OVER (PARTITION BY cluster) - value) / (max(value) OVER (PARTITION BY cluster) - min(value) OVER (PARTITION BY cluster)))::BIGINT AS y FROM ex",
)
def _(v):
    rm, cm = v.row_memb.select("gene", "cluster").distinct(), v.col_memb.select("cond", "cluster").distinct()
    return pages.expression_svg(R.cluster_expressions(v.expr, rm, cm))


@query(
    "position_plots",
    f"SELECT iteration, cluster, seqtype, {SVG.format('max(position + length)', "string_agg(concat('<rect class=\"m', motif_num, '\" x=\"', position, '\" y=\"', y, '\" width=\"', length, '\" height=\"4\"/>'), '' ORDER BY gene, position, motif_num, y, length)")} AS svg FROM (SELECT *, (dense_rank() OVER (PARTITION BY iteration, cluster, seqtype ORDER BY gene) - 1) * 10 + CASE WHEN reverse THEN 5 ELSE 0 END AS y FROM an) q GROUP BY 1, 2, 3",
    an="SELECT DISTINCT iteration, cluster, seqtype, name AS gene, motif_num, position, reverse, coalesce(length, 0) AS length FROM motif_annotations a JOIN motif_infos i ON i.rowid = a.motif_info_id JOIN row_names ON order_num = gene_num LEFT JOIN (SELECT motif_info_id, count(*) AS length FROM motif_pssm_rows GROUP BY 1) p ON p.motif_info_id = i.rowid",
)
def _(v):
    lengths = v.motif_pssm_rows.groupBy("motif_info_id").agg(F.count("*").alias("length"))
    return pages.positions_svg(R.annotations(v.motif_annotations, v.motif_infos, v.row_names, lengths).drop("pvalue").distinct())


LOGO = " + ".join(f"CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END" for x in "acgt")
STACK = ", ".join(f"{{'h': round(100 * greatest(b, 0) / 2 * {x.lower()})::BIGINT, 'b': '{x}', 'c': '{c}'}}" for x, c in pages.COLOURS.items())


@query(
    "logo_plots",
    f"SELECT motif_info_id, {SVG.format('count(DISTINCT i) * 10', "string_agg(CASE WHEN h > 0 THEN concat('<text x=\"', i * 10, '\" y=\"', 100 - up, '\" font-size=\"', h, '\" fill=\"', c, '\">', l, '</text>') ELSE '' END, '' ORDER BY i, k)")} AS svg FROM st GROUP BY 1",
    p="SELECT motif_info_id, row_number() OVER (PARTITION BY motif_info_id ORDER BY pos) - 1 AS i, a::DOUBLE AS a, c::DOUBLE AS c, g::DOUBLE AS g, t::DOUBLE AS t FROM motif_pssm_rows",
    bt=f"SELECT *, 2.0::DOUBLE + {LOGO} AS b FROM p",
    so=f"SELECT motif_info_id, i, list_sort([{STACK}]) AS s FROM bt",
    st="SELECT motif_info_id, i, k, s[k].h AS h, s[k].b AS l, s[k].c AS c, coalesce(list_sum([x.h FOR x IN s[1 : k - 1]]), 0)::BIGINT AS up FROM so, (SELECT unnest([1, 2, 3, 4]) AS k) z",
)
def _(v):
    return pages.logo_svg(v.motif_pssm_rows)


@query("index_page", "SELECT iteration, concat('<!DOCTYPE html><html><body><table><tr><th>cluster</th><th>rows</th><th>columns</th><th>residual</th></tr>', string_agg(concat('<tr><td><a href=\"cluster-', cluster, '.html\">', cluster, '</a></td><td>', num_rows, '</td><td>', num_cols, '</td><td>', printf('%.4f', round(CAST(residual AS DECIMAL(18, 6)), 4)::DOUBLE), '</td></tr>'), '' ORDER BY residual, cluster), '</table></body></html>') AS html FROM cluster_stats GROUP BY 1")
def _(v):
    return pages.index_page(v.cluster_stats)


@query(
    "cluster_pages",
    "SELECT r.iteration, r.cluster, concat('<!DOCTYPE html><html><body><h1>Cluster ', r.cluster, '</h1><p>residual ', printf('%.4f', round(CAST(coalesce(residual, 1.0) AS DECIMAL(18, 6)), 4)::DOUBLE), ', e-value ', printf('%.3e', coalesce(e, 1.0) * (1 + 1e-12)), '</p><h2>Rows</h2><ul>', r.l, '</ul><h2>Columns</h2><ul>', coalesce(c.l, ''), '</ul></body></html>') AS html FROM r LEFT JOIN c USING (iteration, cluster) LEFT JOIN s USING (iteration, cluster) LEFT JOIN m USING (iteration, cluster)",
    r="SELECT iteration, cluster, string_agg(concat('<li>', name, '</li>'), '' ORDER BY name) AS l FROM row_members JOIN row_names USING (order_num) GROUP BY 1, 2",
    c="SELECT iteration, cluster, string_agg(concat('<li>', name, '</li>'), '' ORDER BY name) AS l FROM column_members JOIN column_names USING (order_num) GROUP BY 1, 2",
    s="SELECT iteration, cluster, max(residual) AS residual FROM cluster_stats GROUP BY 1, 2",
    m="SELECT iteration, cluster, min(evalue) AS e FROM motif_infos GROUP BY 1, 2",
)
def _(v):
    d = R.cluster_rows(v.row_members, v.row_names, v.column_members, v.column_names, v.cluster_stats, v.motif_infos)
    return pages.cluster_page(d)
