"""Queries over the result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as R
from ..operators import sequences as Q
from ..operators import stats as S
from ..operators.matrix import with_row
from .base import query

LAST = "SELECT * FROM cluster_stats WHERE iteration = (SELECT max(iteration) FROM cluster_stats)"


@query("run_status", "SELECT event_id AS rowid, least(100.0, event_id % 120 / 100.0 * 100) AS progress, floor((event_id * 37 % 100000) / 3600)::BIGINT AS hours, floor((event_id * 37 % 100000) % 3600 / 60)::BIGINT AS minutes FROM {events}")
def _(v):
    d = v.events.select(F.col("event_id").alias("rowid"), (F.col("event_id") % 120).alias("last_iteration"), F.lit(100).alias("num_iterations"), F.col("ts").alias("start_time"), F.timestamp_seconds(F.unix_timestamp("ts") + F.col("event_id") * 37 % 100000).alias("finish_time"))
    return R.progress(d).select("rowid", "progress", "hours", "minutes")


@query("iterations", "SELECT DISTINCT iteration FROM cluster_stats")
def _(v):
    return v.cluster_stats.select("iteration").distinct()


@query("mean_residuals", "SELECT iteration, score FROM iteration_stats JOIN statstypes USING (statstype) WHERE name = 'median_residual'")
def _(v):
    return R.series(v.iteration_stats, v.statstypes, names=["median_residual"]).select("iteration", "score")


@query("fuzzy_coeffs", "SELECT iteration, score FROM iteration_stats JOIN statstypes USING (statstype) WHERE name = 'fuzzy_coeff'")
def _(v):
    return R.series(v.iteration_stats, v.statstypes, names=["fuzzy_coeff"]).select("iteration", "score")


@query("median_residual_by_iteration", "SELECT iteration, round(quantile_cont(residual, 0.5), 9) AS residual, count(*) AS clusters FROM cluster_stats GROUP BY 1")
def _(v):
    return v.cluster_stats.groupBy("iteration").agg(F.round(S.quantile("residual", 0.5), 9).alias("residual"), F.count("*").alias("clusters"))


@query("mean_cluster_members", "SELECT iteration, round(avg(num_rows), 6) AS rows, round(avg(num_cols), 6) AS cols FROM cluster_stats GROUP BY 1")
def _(v):
    return R.mean_members(v.cluster_stats).select("iteration", F.round("rows", 6).alias("rows"), F.round("cols", 6).alias("cols"))


@query("runlog", "SELECT logtype, iteration, rowid, CASE WHEN active = 1 THEN scaling ELSE 0.0 END AS scaling FROM runs WHERE logtype NOT IN ('view', 'click')")
def _(v):
    return R.run_log(v.runs, ["view", "click"])


@query("int_hist", f"SELECT num_rows, count(*) AS times FROM ({LAST}) q GROUP BY 1")
def _(v):
    return S.int_histogram(R.last_iteration(v.cluster_stats), "num_rows")


@query("float_hist", "SELECT least(19, floor((residual - a) / ((b - a) / 20)))::BIGINT AS bucket, round(max(a + least(19, floor((residual - a) / ((b - a) / 20))) * ((b - a) / 20)), 6) AS low, count(*) AS times FROM cluster_stats, (SELECT min(residual) AS a, max(residual) AS b FROM cluster_stats) z GROUP BY 1")
def _(v):
    return S.float_histogram(v.cluster_stats, "residual").select("bucket", F.round("low", 6).alias("low"), "times")


@query("score_series", "SELECT name, floor(min(score))::BIGINT AS low, ceil(max(score))::BIGINT AS high, count(*) AS n FROM iteration_stats JOIN statstypes USING (statstype) WHERE category = 'network' GROUP BY 1")
def _(v):
    return R.bounds(R.series(v.iteration_stats, v.statstypes, "network"), ["name"])


@query("generic_score_means", "SELECT name, iteration, round(avg(score), 6) AS score FROM iteration_stats JOIN statstypes USING (statstype) WHERE name NOT IN ('median_residual', 'fuzzy_coeff') AND (category = 'main' OR category = 'scoring') GROUP BY 1, 2")
def _(v):
    t = v.statstypes.filter(~F.col("name").isin("median_residual", "fuzzy_coeff") & ((F.col("category") == "main") | (F.col("category") == "scoring")))
    return R.series(v.iteration_stats, t).groupBy("name", "iteration").agg(F.round(F.avg("score"), 6).alias("score"))


@query("slider_ranges", "SELECT min_residual, max_residual, round(min_evalue, 6) AS min_evalue, round(max_evalue, 6) AS max_evalue, round((max_residual - min_residual) / 100, 6) AS residual_step FROM (SELECT min(residual) AS min_residual, max(residual) AS max_residual FROM cluster_stats) a, (SELECT log10(min(evalue)) AS min_evalue, log10(max(evalue)) AS max_evalue FROM motif_infos WHERE evalue > 0) b")
def _(v):
    return R.slider_ranges(v.cluster_stats, v.motif_infos).select("min_residual", "max_residual", F.round("min_evalue", 6).alias("min_evalue"), F.round("max_evalue", 6).alias("max_evalue"), F.round("residual_step", 6).alias("residual_step"))


@query("clusters_by_residual", f"SELECT cluster, residual, num_rows, num_cols, row_number() OVER (ORDER BY residual, cluster) AS place FROM ({LAST}) q")
def _(v):
    return R.numbered(R.last_iteration(v.cluster_stats), F.col("residual"), F.col("cluster")).select("cluster", "residual", "num_rows", "num_cols", "place")


@query("clusters_search", "SELECT DISTINCT iteration, cluster FROM row_members JOIN row_names USING (order_num) WHERE name ILIKE '%00000001%'")
def _(v):
    return R.search(v.row_members, v.row_names, "00000001")


@query("clusters_sorted", "SELECT s.iteration, s.cluster, residual, round(e, 6) AS evalue, row_number() OVER (ORDER BY e DESC NULLS LAST, s.iteration, s.cluster) AS place FROM cluster_stats s LEFT JOIN (SELECT iteration, cluster, min(evalue) AS e FROM motif_infos GROUP BY 1, 2) m ON m.iteration = s.iteration AND m.cluster = s.cluster")
def _(v):
    e = v.motif_infos.groupBy("iteration", "cluster").agg(F.min("evalue").alias("e"))
    d = v.cluster_stats.join(e, ["iteration", "cluster"], "left")
    return R.numbered(d, F.col("e").desc_nulls_last(), F.col("iteration"), F.col("cluster")).select("iteration", "cluster", "residual", F.round("e", 6).alias("evalue"), "place")


@query("filter_clusters", "SELECT DISTINCT iteration, cluster FROM cluster_stats WHERE residual >= 0.5 AND residual <= 3")
def _(v):
    return R.filter_clusters(v.cluster_stats, 0.5, 3)


@query("filter_motifs", "SELECT * FROM motif_infos WHERE evalue >= 0.01 AND evalue <= 0.015")
def _(v):
    return R.filter_motifs(v.motif_infos, 0.01, 0.015)


@query("cluster_members", "SELECT iteration, cluster, string_agg(name, ',' ORDER BY name) AS rows FROM row_members JOIN row_names USING (order_num) GROUP BY 1, 2")
def _(v):
    return R.named_members(v.row_members, v.row_names).groupBy("iteration", "cluster").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("rows"))


GENES = "SELECT DISTINCT gene, cluster FROM row_memb"
CONDS = "SELECT DISTINCT cond, cluster FROM col_memb"


def pairs(v):
    return v.row_memb.select("gene", "cluster").distinct(), v.col_memb.select("cond", "cluster").distinct()


@query("cluster_expressions", "SELECT rm.cluster, e.gene, e.cond, cm.cond IS NOT NULL AS in_cluster, coalesce(value, 0) AS value FROM expr e JOIN rm ON rm.gene = e.gene LEFT JOIN cm ON cm.cond = e.cond AND cm.cluster = rm.cluster", rm=GENES, cm=CONDS)
def _(v):
    return R.cluster_expressions(v.expr, *pairs(v))


BOX = "r[1] AS least, r[CAST(floor(n / 4) AS INT) + 1] AS lower, r[CAST(least(floor(n / 2 + n % 2), n - 1) AS INT) + 1] AS middle, r[CAST(n - floor(n / 4) - 1 AS INT) + 1] AS upper, r[n] AS most"


@query("boxplot", f"SELECT cluster, cond, {BOX} FROM (SELECT rm.cluster, e.cond, list(value ORDER BY value) AS r, count(*) AS n FROM expr e JOIN rm ON rm.gene = e.gene GROUP BY 1, 2) q", rm=GENES)
def _(v):
    return S.five_numbers(v.expr.join(pairs(v)[0], "gene"), ["cluster", "cond"], "value")


@query("cluster_motif", "SELECT i.rowid, pos, a, c, g, t FROM motif_infos i JOIN p ON p.motif_info_id = i.rowid WHERE iteration = 3 AND motif_num = 1", p="SELECT motif_info_id, pos, CAST(a AS DOUBLE) AS a, CAST(c AS DOUBLE) AS c, CAST(g AS DOUBLE) AS g, CAST(t AS DOUBLE) AS t FROM motif_pssm_rows")
def _(v):
    d = v.motif_infos.filter("iteration = 3 AND motif_num = 1").select("rowid")
    return v.motif_pssm_rows.join(d, F.col("motif_info_id") == F.col("rowid")).select("rowid", "pos", *[F.col(x).cast("double") for x in "acgt"])


@query("motif_counts", "SELECT i.rowid, coalesce(n, 0) AS num_annotations, coalesce(length, 0) AS length FROM motif_infos i LEFT JOIN (SELECT motif_info_id, count(*) AS n FROM motif_annotations GROUP BY 1) a ON a.motif_info_id = i.rowid LEFT JOIN (SELECT motif_info_id, count(*) AS length FROM motif_pssm_rows GROUP BY 1) p ON p.motif_info_id = i.rowid")
def _(v):
    n = v.motif_annotations.groupBy(F.col("motif_info_id").alias("rowid")).agg(F.count("*").alias("n"))
    p = v.motif_pssm_rows.groupBy(F.col("motif_info_id").alias("rowid")).agg(F.count("*").alias("l"))
    return v.motif_infos.select("rowid").join(n, "rowid", "left").join(p, "rowid", "left").select("rowid", F.coalesce("n", F.lit(0)).alias("num_annotations"), F.coalesce("l", F.lit(0)).alias("length"))


@query("annotations", "SELECT iteration, cluster, seqtype, name AS gene, motif_num, position, reverse, pvalue, coalesce(length, 0) AS length FROM motif_annotations a JOIN motif_infos i ON i.rowid = a.motif_info_id JOIN row_names ON order_num = gene_num LEFT JOIN (SELECT motif_info_id, count(*) AS length FROM motif_pssm_rows GROUP BY 1) p ON p.motif_info_id = i.rowid")
def _(v):
    lengths = v.motif_pssm_rows.groupBy("motif_info_id").agg(F.count("*").alias("length"))
    return R.annotations(v.motif_annotations, v.motif_infos, v.row_names, lengths)


@query("annotations_by_gene", "SELECT iteration, cluster, seqtype, name AS gene, count(*) AS n, min(pvalue) AS best FROM motif_annotations a JOIN motif_infos i ON i.rowid = a.motif_info_id JOIN row_names ON order_num = gene_num GROUP BY 1, 2, 3, 4")
def _(v):
    lengths = v.motif_pssm_rows.groupBy("motif_info_id").agg(F.count("*").alias("length"))
    return R.annotations(v.motif_annotations, v.motif_infos, v.row_names, lengths).groupBy("iteration", "cluster", "seqtype", "gene").agg(F.count("*").alias("n"), F.min("pvalue").alias("best"))


@query("distinct_genes_per_motif", "SELECT motif_info_id, count(DISTINCT gene_num) AS genes FROM motif_annotations GROUP BY 1")
def _(v):
    return v.motif_annotations.groupBy("motif_info_id").agg(F.count_distinct("gene_num").alias("genes"))


KEY = "concat_ws('_', CAST(cluster AS VARCHAR), seqtype, CAST(motif_num AS VARCHAR))"


@query("graph_nodes", f"SELECT 'cluster' AS kind, CAST(cluster AS VARCHAR) AS id FROM row_members UNION SELECT 'gene', name FROM row_members JOIN row_names USING (order_num) UNION SELECT 'motif', {KEY} FROM motif_infos")
def _(v):
    return R.graph_nodes(v.row_members, v.row_names, v.motif_infos)


@query("graph_edges", f"SELECT 'member' AS kind, CAST(cluster AS VARCHAR) AS a, name AS b FROM row_members JOIN row_names USING (order_num) UNION SELECT 'motif', CAST(cluster AS VARCHAR), {KEY} FROM motif_infos UNION SELECT 'similar', m1.k, m2.k FROM tomtom_results JOIN mk m1 ON m1.rowid = motif_info_id1 JOIN mk m2 ON m2.rowid = motif_info_id2 WHERE pvalue <= 0.02", mk=f"SELECT rowid, {KEY} AS k FROM motif_infos")
def _(v):
    return R.graph_edges(v.row_members, v.row_names, v.motif_infos, v.tomtom_results, 0.02)


@query("motif_selfjoin", "SELECT motif_info_id1, motif_info_id2, m1.cluster AS cluster1, m2.cluster AS cluster2, pvalue FROM tomtom_results JOIN motif_infos m1 ON m1.rowid = motif_info_id1 JOIN motif_infos m2 ON m2.rowid = motif_info_id2 WHERE m1.cluster <> m2.cluster")
def _(v):
    a = v.motif_infos.select(F.col("rowid").alias("motif_info_id1"), F.col("cluster").alias("cluster1"))
    b = v.motif_infos.select(F.col("rowid").alias("motif_info_id2"), F.col("cluster").alias("cluster2"))
    return v.tomtom_results.join(a, "motif_info_id1").join(b, "motif_info_id2").filter("cluster1 <> cluster2").select("motif_info_id1", "motif_info_id2", "cluster1", "cluster2", "pvalue")


LETTER = "CASE WHEN greatest(a, c, g, t) < 0.4 THEN 'n' WHEN greatest(a, c, g, t) < 0.7 THEN lower(x) ELSE x END"


@query(
    "motif_strings",
    "SELECT iteration, cluster, string_agg(t, '' ORDER BY seqtype) AS motifs FROM (SELECT iteration, cluster, seqtype, concat('(', seqtype, ' -> [', string_agg(concat(coalesce(consensus, ''), ' (', CASE WHEN evalue <= 0.001 THEN printf('%.2e', evalue) ELSE printf('%.2f', round(CAST(evalue AS DECIMAL(18, 8)), 2)::DOUBLE) END, ')'), ', ' ORDER BY motif_num, rowid), '])') AS t FROM motif_infos LEFT JOIN co ON motif_info_id = rowid GROUP BY 1, 2, 3) q GROUP BY 1, 2",
    co=f"SELECT motif_info_id, string_agg({LETTER}, '' ORDER BY pos) AS consensus FROM (SELECT *, CASE WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END AS x FROM motif_pssm_rows) q GROUP BY 1",
)
def _(v):
    return R.motif_strings(v.motif_infos, Q.consensus(v.motif_pssm_rows, ["motif_info_id"]).drop("length"))


@query("inclusion_matrix", "SELECT m.cluster, m.cond, CASE WHEN cm.cond IS NULL THEN 'EXCLUDE' WHEN abs(mean - 10) <= 0.05 THEN 'ZERO' WHEN mean > 10 THEN 'UP' ELSE 'DOWN' END AS state FROM m LEFT JOIN cm ON cm.cluster = m.cluster AND cm.cond = m.cond", rm=GENES, cm=CONDS, m="SELECT rm.cluster, e.cond, avg(value) AS mean FROM expr e JOIN rm ON rm.gene = e.gene GROUP BY 1, 2")
def _(v):
    return R.inclusion(v.expr, *pairs(v), 10.0)


@query("precision_recall", "SELECT threshold, n, tp, round(tp / nullif(n, 0), 6) AS precision, round(tp / nullif(g, 0), 6) AS recall FROM (SELECT threshold, sum(CASE WHEN weight >= threshold THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN weight >= threshold AND g.src IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS tp, max(k) AS g FROM p LEFT JOIN gold g ON g.src = p.src AND g.dst = p.dst, (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS threshold) t, (SELECT count(*) AS k FROM gold) z GROUP BY 1) q", p="SELECT src, dst, weight FROM edges WHERE network = 'first'", gold="SELECT src, dst FROM edges WHERE network = 'second'")
def _(v):
    p = v.edges.filter("network = 'first'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    g = v.edges.filter("network = 'second'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    t = v.spark.sql("SELECT explode(array(1.0D, 2.0D, 3.0D)) AS threshold")
    return R.precision_recall(p, g, t).select("threshold", "n", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("last_iteration_extract", "SELECT iteration, cluster, order_num FROM row_members WHERE iteration = (SELECT max(iteration) FROM row_members)")
def _(v):
    return R.last_iteration(v.row_members)


@query("two_motif_evalues", "SELECT iteration, cluster, l[1].evalue AS first, l[2].evalue AS second FROM (SELECT iteration, cluster, list({'evalue': evalue} ORDER BY motif_num, rowid) AS l, count(*) AS n FROM motif_infos GROUP BY 1, 2) q WHERE n = 2".replace("{'evalue': evalue}", "struct_pack(evalue := evalue)"))
def _(v):
    return R.two_motif_evalues(v.motif_infos)


@query(
    "cmresults",
    "SELECT r.iteration, r.cluster, r.rows, coalesce(c.cols, '') AS cols, coalesce(residual, 1.0) AS residual, coalesce(e, 1.0) AS evalue FROM r LEFT JOIN c ON c.iteration = r.iteration AND c.cluster = r.cluster LEFT JOIN cluster_stats s ON s.iteration = r.iteration AND s.cluster = r.cluster LEFT JOIN (SELECT iteration, cluster, min(evalue) AS e FROM motif_infos GROUP BY 1, 2) m ON m.iteration = r.iteration AND m.cluster = r.cluster",
    r="SELECT iteration, cluster, string_agg(name, ',' ORDER BY name) AS rows FROM row_members JOIN row_names USING (order_num) GROUP BY 1, 2",
    c="SELECT iteration, cluster, string_agg(name, ',' ORDER BY name) AS cols FROM column_members JOIN column_names USING (order_num) GROUP BY 1, 2",
)
def _(v):
    return R.cluster_rows(v.row_members, v.row_names, v.column_members, v.column_names, v.cluster_stats, v.motif_infos)


@query("rename_genes", "SELECT order_num, CASE WHEN order_num % 10 = 0 THEN concat('TF', CAST(order_num AS VARCHAR)) ELSE name END AS name FROM row_names")
def _(v):
    changes = v.row_names.filter("order_num % 10 = 0").select(F.col("name").alias("old"), F.concat(F.lit("TF"), F.col("order_num").cast("string")).alias("new"))
    return R.renamed(v.row_names, changes, "name").select("order_num", "name")


@query("upsert_genes", "SELECT order_num, name FROM row_names WHERE order_num % 2 = 0 UNION ALL SELECT order_num, concat(name, '-new') FROM row_names WHERE order_num % 2 <> 0")
def _(v):
    return R.upserted(v.row_names.filter("order_num % 2 = 0"), v.row_names.withColumn("name", F.concat("name", F.lit("-new"))), ["order_num"])


@query("nonmember_conditions", "SELECT k.cluster, conds.cond FROM conds CROSS JOIN (SELECT DISTINCT cluster FROM col_memb) k WHERE NOT EXISTS (SELECT 1 FROM col_memb c WHERE c.cond = conds.cond AND c.cluster = k.cluster)")
def _(v):
    ids = v.col_memb.select("cluster").distinct()
    return v.conds.crossJoin(ids).join(v.col_memb.select("cond", "cluster"), ["cond", "cluster"], "left_anti").select("cluster", "cond")


@query("score_means", "SELECT round(avg(m), 6) AS mean FROM (SELECT cluster, avg(residual) AS m FROM cluster_stats GROUP BY 1) q")
def _(v):
    return v.cluster_stats.groupBy("cluster").agg(F.avg("residual").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"))


@query("scaled_stats", "SELECT rowid, round(score - (SELECT quantile_cont(score, 0.99) FROM iteration_stats), 6) + 0.0 AS score FROM iteration_stats")
def _(v):
    return with_row(v.iteration_stats, v.iteration_stats.agg(S.quantile("score", 0.99).alias("q"))).select("rowid", (F.round(F.col("score") - F.col("q"), 6) + 0.0).alias("score"))
