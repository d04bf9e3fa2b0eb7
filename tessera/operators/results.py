"""Queries over the result tables (see the README's list of tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matrix import with_row


def last_iteration(d: DataFrame) -> DataFrame:
    """Rows of the largest iteration. The maximum is one row; on a table partitioned by iteration it prunes."""
    return with_row(d, d.agg(F.max("iteration").alias("_i"))).filter("iteration = _i").drop("_i")


def series(stats: DataFrame, types: DataFrame, category: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Scores by type and iteration, of a category or of named types."""
    t = types
    if category is not None:
        t = t.filter(F.col("category") == category)
    if names is not None:
        t = t.filter(F.col("name").isin(names))
    return stats.join(t, "statstype").select("category", "name", "iteration", "score")


def bounds(d: DataFrame, by: list[str] | None = None) -> DataFrame:
    return d.groupBy(*(by or [])).agg(F.floor(F.min("score")).alias("low"), F.ceil(F.max("score")).alias("high"), F.count("*").alias("n"))


def run_log(logs: DataFrame, without: list[str]) -> DataFrame:
    """The scaling of each iteration of a function, 0 where it was not active."""
    return logs.filter(~F.col("logtype").isin(without)).select("logtype", "iteration", "rowid", F.when(F.col("active") == 1, F.col("scaling")).otherwise(0.0).alias("scaling"))


def progress(runs: DataFrame) -> DataFrame:
    """Per cent done, and hours and minutes from start to finish (or to the last update)."""
    seconds = F.unix_timestamp("finish_time") - F.unix_timestamp("start_time")
    return runs.withColumn("progress", F.least(F.lit(100.0), F.col("last_iteration") / F.col("num_iterations") * 100)).withColumn("hours", F.floor(seconds / 3600)).withColumn("minutes", F.floor(seconds % 3600 / 60))


def mean_members(stats: DataFrame) -> DataFrame:
    return stats.groupBy("iteration").agg(F.avg("num_rows").alias("rows"), F.avg("num_cols").alias("cols"))


def slider_ranges(stats: DataFrame, motifs: DataFrame) -> DataFrame:
    """One row: ranges of residuals and of log10 e-values, and the hundredth part of each as a step."""
    r = stats.agg(F.min("residual").alias("min_residual"), F.max("residual").alias("max_residual"))
    e = motifs.filter("evalue > 0").agg(F.log10(F.min("evalue")).alias("min_evalue"), F.log10(F.max("evalue")).alias("max_evalue"))
    d = r.crossJoin(e)  # one row each
    return d.withColumn("residual_step", (F.col("max_residual") - F.col("min_residual")) / 100).withColumn("evalue_step", (F.col("max_evalue") - F.col("min_evalue")) / 100)


def named_members(members: DataFrame, names: DataFrame) -> DataFrame:
    return members.join(names, "order_num").select("iteration", "cluster", "order_num", "name")


def search(members: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Clusters with a member whose name has the text, whatever its case."""
    return named_members(members, names).filter(F.col("name").ilike(f"%{text}%")).select("iteration", "cluster").distinct()


def filter_motifs(motifs: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    if least is not None:
        motifs = motifs.filter(F.col("evalue") >= least)
    return motifs if most is None else motifs.filter(F.col("evalue") <= most)


def filter_clusters(stats: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    if least is not None:
        stats = stats.filter(F.col("residual") >= least)
    if most is not None:
        stats = stats.filter(F.col("residual") <= most)
    return stats.select("iteration", "cluster").distinct()


def format_float(x: Column) -> Column:
    return F.when(x <= 1e-3, F.format_string("%.2e", x)).otherwise(F.format_string("%.2f", x))


def motif_strings(motifs: DataFrame, consensus: DataFrame) -> DataFrame:
    """(seqtype -> [consensus (e-value), ...]) of each cluster, sequence types and motifs in order."""
    d = motifs.join(consensus.withColumnRenamed("motif_info_id", "rowid"), "rowid", "left")
    one = F.concat(F.coalesce("consensus", F.lit("")), F.lit(" ("), format_float(F.col("evalue")), F.lit(")"))
    lists = d.groupBy("iteration", "cluster", "seqtype").agg(F.sort_array(F.collect_list(F.struct("motif_num", "rowid", one.alias("t")))).alias("l"))
    text = F.concat(F.lit("("), F.col("seqtype"), F.lit(" -> ["), F.array_join(F.transform("l", lambda x: x["t"]), ", "), F.lit("])"))
    return lists.groupBy("iteration", "cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seqtype", text.alias("t")))), lambda x: x["t"]), "").alias("motifs"))


def cluster_expressions(m: DataFrame, genes: DataFrame, conds: DataFrame) -> DataFrame:
    """Member genes by conditions, the cluster's own conditions first, missing values as 0."""
    d = m.join(genes, "gene").join(conds.withColumn("_in", F.lit(True)), ["cluster", "cond"], "left")
    return d.select("cluster", "gene", "cond", F.coalesce("_in", F.lit(False)).alias("in_cluster"), F.coalesce("value", F.lit(0.0)).alias("value"))


def annotations(found: DataFrame, motifs: DataFrame, names: DataFrame, lengths: DataFrame) -> DataFrame:
    d = found.join(motifs.select(F.col("rowid").alias("motif_info_id"), "iteration", "cluster", "seqtype", "motif_num"), "motif_info_id")
    d = d.join(names.select(F.col("order_num").alias("gene_num"), F.col("name").alias("gene")), "gene_num")
    return d.join(lengths, "motif_info_id", "left").select("iteration", "cluster", "seqtype", "gene", "motif_num", "position", "reverse", "pvalue", F.coalesce("length", F.lit(0)).alias("length"))


def graph_nodes(members: DataFrame, names: DataFrame, motifs: DataFrame) -> DataFrame:
    """Clusters, genes and motifs of one iteration's graph."""
    c = members.select("cluster").distinct().select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("id"))
    g = members.select("order_num").distinct().join(names, "order_num").select(F.lit("gene").alias("kind"), F.col("name").alias("id"))  # whatever the iteration
    m = motifs.select(F.lit("motif").alias("kind"), F.concat_ws("_", "cluster", "seqtype", "motif_num").alias("id"))
    return c.unionByName(g).unionByName(m).distinct()


def graph_edges(members: DataFrame, names: DataFrame, motifs: DataFrame, similar: DataFrame, most: float) -> DataFrame:
    """Cluster - gene, cluster - motif, and motif - motif of matches up to a p-value."""
    own = members.select("cluster", "order_num").distinct()  # whatever the iteration
    cg = own.join(names, "order_num").select(F.lit("member").alias("kind"), F.col("cluster").cast("string").alias("a"), F.col("name").alias("b"))
    key = F.concat_ws("_", "cluster", "seqtype", "motif_num")
    cm = motifs.select(F.lit("motif").alias("kind"), F.col("cluster").cast("string").alias("a"), key.alias("b"))
    m = motifs.select("rowid", key.alias("key"))
    mm = similar.filter(F.col("pvalue") <= most).join(m.select(F.col("rowid").alias("motif_info_id1"), F.col("key").alias("a")), "motif_info_id1")
    mm = mm.join(m.select(F.col("rowid").alias("motif_info_id2"), F.col("key").alias("b")), "motif_info_id2").select(F.lit("similar").alias("kind"), "a", "b")
    return cg.unionByName(cm).unionByName(mm).distinct()


def inclusion(m: DataFrame, genes: DataFrame, conds: DataFrame, level: float, zero: float = 0.05) -> DataFrame:
    """Each (cluster, cond): the members' mean as UP, DOWN or ZERO around a level, or EXCLUDE outside of the cluster."""
    mean = m.join(genes, "gene").groupBy("cluster", "cond").agg(F.avg("value").alias("mean"))
    d = mean.join(conds.withColumn("_in", F.lit(True)), ["cluster", "cond"], "left")
    word = F.when(F.col("_in").isNull(), "EXCLUDE").when(F.abs(F.col("mean") - level) <= zero, "ZERO").when(F.col("mean") > level, "UP").otherwise("DOWN")
    return d.select("cluster", "cond", word.alias("state"))


def precision_recall(predicted: DataFrame, gold: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Of (a, b, weight) against the pairs of ``gold`` at each threshold (a short list)."""
    total = gold.agg(F.count("*").alias("_g"))
    d = predicted.join(gold.withColumn("_hit", F.lit(1)), ["a", "b"], "left").crossJoin(F.broadcast(thresholds.select("threshold"))).crossJoin(F.broadcast(total))
    taken = F.col("weight") >= F.col("threshold")
    out = d.groupBy("threshold").agg(F.sum(taken.cast("long")).alias("n"), F.sum((taken & F.col("_hit").isNotNull()).cast("long")).alias("tp"), F.max("_g").alias("_g"))
    return out.select("threshold", "n", "tp", F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "_g").alias("recall"))


def cluster_rows(members: DataFrame, names: DataFrame, cols: DataFrame, col_names: DataFrame, stats: DataFrame, motifs: DataFrame) -> DataFrame:
    """One row a cluster of an iteration: its names on both axes, residual and least e-value (1 without)."""
    lists = lambda d, n, out: named_members(d, n).groupBy("iteration", "cluster").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias(out))
    e = motifs.groupBy("iteration", "cluster").agg(F.min("evalue").alias("evalue"))
    d = lists(members, names, "rows").join(lists(cols, col_names, "cols"), ["iteration", "cluster"], "left").join(stats.select("iteration", "cluster", "residual"), ["iteration", "cluster"], "left").join(e, ["iteration", "cluster"], "left")
    return d.select("iteration", "cluster", "rows", F.coalesce("cols", F.lit("")).alias("cols"), F.coalesce("residual", F.lit(1.0)).alias("residual"), F.coalesce("evalue", F.lit(1.0)).alias("evalue"))


def two_motif_evalues(motifs: DataFrame) -> DataFrame:
    """E-values of clusters with exactly two motifs, in order of the motifs."""
    d = motifs.groupBy("iteration", "cluster").agg(F.sort_array(F.collect_list(F.struct("motif_num", "rowid", "evalue"))).alias("l")).filter(F.size("l") == 2)
    return d.select("iteration", "cluster", F.col("l")[0]["evalue"].alias("first"), F.col("l")[1]["evalue"].alias("second"))


def numbered(d: DataFrame, *order: Column) -> DataFrame:
    return d.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


def renamed(d: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """Rows with new values of a column where ``changes`` (old, new) has them."""
    return d.join(changes.select(F.col("old").alias(name), "new"), name, "left").withColumn(name, F.coalesce("new", name)).drop("new")


def upserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table and those new rows whose key it doesn't have."""
    return table.unionByName(new.dropDuplicates(key).join(table, key, "left_anti"))


def motif_tables(motifs: DataFrame, iteration: int, seqtype: str, names: DataFrame) -> dict[str, DataFrame]:
    """The result tables of motifs (cluster, motif_num, evalue, pssm as rows of four, annotations of gene, position, reverse and
    pvalue, sites of name, reverse, start, pvalue, left, seq and right). Their key is a hash of what makes a motif one."""
    d = motifs.withColumn("rowid", F.xxhash64(F.lit(iteration), F.lit(seqtype), "cluster", "motif_num"))
    rows = d.select(F.col("rowid").alias("motif_info_id"), F.posexplode("pssm").alias("pos", "r"))
    found = d.select(F.col("rowid").alias("motif_info_id"), F.explode("annotations").alias("x")).select("motif_info_id", F.col("x.gene").alias("name"), "x.position", "x.reverse", "x.pvalue")
    return {
        "motif_infos": d.select("rowid", "cluster", F.lit(seqtype).alias("seqtype"), "motif_num", "evalue"),
        "motif_pssm_rows": rows.select("motif_info_id", "pos", *[F.col("r")[i].alias(x) for i, x in enumerate("acgt")]),
        "motif_annotations": found.join(names, "name").select("motif_info_id", F.col("order_num").alias("gene_num"), "position", "reverse", "pvalue"),
        "meme_motif_sites": d.select(F.col("rowid").alias("motif_info_id"), F.explode("sites").alias("x")).select("motif_info_id", F.col("x.name").alias("seq_name"), "x.reverse", "x.start", "x.pvalue", F.col("x.left").alias("flank_left"), "x.seq", F.col("x.right").alias("flank_right")),
    }


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph (see graph_nodes and graph_edges) as lines of GraphML in order: place, value."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    ends = {"member": ("cluster", "gene"), "motif": ("cluster", "motif"), "similar": ("motif", "motif")}
    kind = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in ends.items() for x in (k, v[i])]), F.col("kind"))
    own = lambda k, c: F.concat(k, F.lit(":"), quoted(F.col(c)))
    n = nodes.select(F.lit(1).alias("part"), F.format_string('  <node id="%s"><data key="kind">%s</data></node>', own(F.col("kind"), "id"), F.col("kind")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.format_string('  <edge source="%s" target="%s"><data key="kind">%s</data></edge>', own(kind(0), "a"), own(kind(1), "b"), F.col("kind")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="kind" for="all" attr.name="kind" attr.type="string"/>\n<graph edgedefault="undirected">'
    both = [(0, head), (3, "</graph>\n</graphml>")]
    return n.unionByName(e).unionByName(nodes.sparkSession.createDataFrame(both, "part int, value string")).orderBy("part", "value")


def linked_species(species: DataFrame, networks: DataFrame, biclusters: DataFrame, genes: DataFrame, names: DataFrame) -> DataFrame:
    """species (species_id) with its networks (network_id, species_id), their biclusters (bicluster_id, network_id) and genes
    (bicluster_id, gene_id), by name."""
    d = species.join(networks, "species_id").join(biclusters, "network_id").join(genes, "bicluster_id").join(names, "gene_id")
    return d.select("species", "network", "bicluster_id", "gene")


def in_either(d: DataFrame, genes: DataFrame, conds: DataFrame) -> DataFrame:
    """Cells (gene, cond, value) whose gene is among the genes or whose condition is among the conditions."""
    g, c = genes.select("gene").distinct().withColumn("_g", F.lit(True)), conds.select("cond").distinct().withColumn("_c", F.lit(True))
    return d.join(g, "gene", "left").join(c, "cond", "left").filter("_g OR _c").select("gene", "cond", "value")


def expression_table(d: DataFrame, genes: DataFrame, conds: DataFrame, *, digits: int = 6) -> DataFrame:
    """(gene, line): a line of each gene, with its value in each condition in their order, NA where there is none."""
    grid = genes.select("gene").distinct().crossJoin(F.broadcast(conds.select("cond").distinct()))  # the table asked for
    text = F.coalesce(F.format_string(f"%.{digits}f", "value"), F.lit("NA"))
    cells = grid.join(in_either(d, genes, conds), ["gene", "cond"], "left").groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("cond", F.when(F.col("value").isNull(), "NA").otherwise(text).alias("t")))).alias("c"))
    return cells.select("gene", F.concat_ws("\t", F.col("gene").cast("string"), F.array_join(F.transform("c", lambda x: x["t"]), "\t")).alias("line"))


def cluster_stack(rows: DataFrame, cols: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a cluster for other programs: its genes and conditions as lists, their numbers, its residual."""
    lists = lambda d, n, out: d.groupBy("cluster").agg(F.sort_array(F.collect_set(n)).alias(out))
    d = lists(rows, "gene", "rows").join(lists(cols, "cond", "cols"), "cluster", "left").join(stats.select("cluster", "residual"), "cluster", "left")
    return d.select("cluster", F.size("rows").cast("long").alias("nrows"), F.coalesce(F.size("cols"), F.lit(0)).cast("long").alias("ncols"), "rows", "cols", "residual")
