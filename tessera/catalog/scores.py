"""Scores, ranks, normalisation, enrichment and membership changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..bindings import CLUSTERS
from ..operators import enrichment as E
from ..operators import membership as B
from ..operators import motifs as M
from ..operators import rescoring as K
from ..operators import scoring as S
from .base import query, r6

ROWS = {
    "rm": "SELECT DISTINCT gene, cluster FROM row_memb",
    "cm": "SELECT DISTINCT cond, cluster FROM col_memb",
    "mu": "SELECT rm.cluster, e.cond, avg(value) AS mu FROM expr e JOIN rm ON e.gene = rm.gene JOIN cm ON cm.cond = e.cond AND cm.cluster = rm.cluster WHERE rm.cluster IN (SELECT cluster FROM cm GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2",
    "rs": "SELECT e.gene, mu.cluster, round(ln(least(greatest(avg(pow(value - mu, 2)), 1e-20), 1000.0) + 1e-99), 6) + 0.0 AS score FROM expr e JOIN mu ON e.cond = mu.cond GROUP BY 1, 2",
}
COLS = {
    "rm": "SELECT DISTINCT gene, cluster FROM row_memb WHERE cluster IN (SELECT cluster FROM (SELECT DISTINCT gene, cluster FROM row_memb) q GROUP BY 1 HAVING count(*) > 1)",
    "xm": "SELECT rm.cluster, e.cond, avg(value) AS mu FROM expr e JOIN rm ON e.gene = rm.gene GROUP BY 1, 2",
    "cs": "SELECT rm.cluster, e.cond, round(avg((value - mu) * (value - mu)) / (abs(max(mu)) + 0.01), 6) + 0.0 AS score FROM expr e JOIN rm ON e.gene = rm.gene JOIN xm ON xm.cluster = rm.cluster AND xm.cond = e.cond GROUP BY 1, 2",
}


def rows(v):
    s = S.row_scores(v.expr, v.row_memb, v.col_memb)
    return s.withColumn("score", r6("score"))


def cols(v):
    s = S.column_scores(v.expr, v.row_memb)
    return s.withColumn("score", r6("score"))


def second(v):
    """A further score matrix on the same cells."""
    return rows(v).withColumn("score", F.round(F.col("score") * ((F.col("gene") + F.col("cluster")) % 5), 6) + 0.0)


SECOND = {**ROWS, "s2": "SELECT gene, cluster, round(score * ((gene + cluster) % 5), 6) + 0.0 AS score FROM rs"}


@query("row_scores", "SELECT * FROM rs", **ROWS)
def _(v):
    return rows(v)


@query("column_scores", "SELECT * FROM cs", **COLS)
def _(v):
    return cols(v)


@query(
    "column_scores_filled",
    "SELECT cond, cluster, CASE WHEN score IS NULL THEN hi WHEN score < -20 THEN lo ELSE score END AS score FROM f, (SELECT max(score) AS hi, min(CASE WHEN score >= -20 THEN score END) AS lo FROM f) b",
    **COLS,
    q="SELECT round(quantile_cont(score, 0.95), 6) AS q FROM cs JOIN (SELECT DISTINCT cond, cluster FROM col_memb) c USING (cond, cluster)",
    f="SELECT g.cond, g.cluster, coalesce(cs.score, q) AS score FROM (SELECT cond, cluster FROM conds, (SELECT DISTINCT cluster FROM row_memb UNION ALL SELECT 99) k) g LEFT JOIN cs ON cs.cond = g.cond AND cs.cluster = g.cluster, q",
)
def _(v):
    ids = v.row_memb.select("cluster").distinct().unionByName(v.spark.sql("SELECT CAST(99 AS BIGINT) AS cluster"))
    return S.filled_column_scores(cols(v), v.conds, ids, v.col_memb).withColumn("score", r6("score"))


@query("rank_min", "SELECT gene, cluster, score, rank() OVER (ORDER BY score) - 1 AS rank FROM rs", **ROWS)
def _(v):
    return S.min_rank(rows(v)).withColumn("rank", F.col("rank").cast("long"))


@query("top_clusters_per_gene", "SELECT gene, cluster, score, place FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, cluster) AS place FROM rs) q WHERE place <= 2", **ROWS)
def _(v):
    return S.top_clusters(rows(v), "gene", 2).withColumn("place", F.col("place").cast("long"))


@query("best_clusters", "SELECT gene, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS clusters FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, cluster) AS place FROM rs) q WHERE place <= 3 GROUP BY gene", **ROWS)
def _(v):
    return S.top_clusters(rows(v), "gene", 3).groupBy("gene").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cluster")), lambda c: c.cast("string")), ",").alias("clusters"))


@query(
    "best_column_seed",
    "SELECT cond, row_number() OVER (PARTITION BY cond ORDER BY -score DESC, cluster) - 1 AS slot, cluster FROM cs QUALIFY slot < 3",
    rm="SELECT DISTINCT gene, cluster FROM row_memb WHERE slot = 0 AND cluster IN (SELECT cluster FROM row_memb WHERE slot = 0 GROUP BY 1 HAVING count(*) > 1)",
    xm=COLS["xm"],
    cs=COLS["cs"].replace("round(", "(").replace(", 6) + 0.0 AS score", ") AS score"),
)
def _(v):
    return S.seed_columns(v.expr, v.row_memb, 3).withColumn("slot", F.col("slot").cast("long"))


@query(
    "quantile_normalize",
    "SELECT function, gene, cluster, round(mean, 9) + 0.0 AS score FROM s JOIN p ON p.place = s.low",
    **SECOND,
    u="SELECT 'Rows' AS function, gene, cluster, score FROM rs UNION ALL SELECT 'Second', gene, cluster, score FROM s2",
    s="SELECT *, row_number() OVER (PARTITION BY function ORDER BY score) AS place, rank() OVER (PARTITION BY function ORDER BY score) AS low FROM u",
    p="SELECT place, avg(score) AS mean FROM s GROUP BY 1",
)
def _(v):
    both = rows(v).select(F.lit("Rows").alias("function"), "gene", "cluster", "score").unionByName(second(v).select(F.lit("Second").alias("function"), "gene", "cluster", "score"))
    return S.quantile_normalise(both).withColumn("score", F.round("score", 9) + 0.0)


@query(
    "quantile_normalize_weighted",
    "SELECT function, gene, cluster, round(mean, 9) + 0.0 AS score FROM s JOIN p ON p.place = s.low",
    **SECOND,
    u="SELECT 'Rows' AS function, 3.0 AS w, gene, cluster, score FROM rs UNION ALL SELECT 'Second', 0.5, gene, cluster, score FROM s2",
    s="SELECT *, row_number() OVER (PARTITION BY function ORDER BY score) AS place, rank() OVER (PARTITION BY function ORDER BY score) AS low FROM u",
    p="SELECT place, avg(score * w) / 3.5 AS mean FROM s GROUP BY 1",
)
def _(v):
    both = rows(v).select(F.lit("Rows").alias("function"), "gene", "cluster", "score").unionByName(second(v).select(F.lit("Second").alias("function"), "gene", "cluster", "score"))
    weights = v.spark.sql("SELECT 'Rows' AS function, CAST(3 AS DOUBLE) AS weight UNION ALL SELECT 'Second', CAST(0.5 AS DOUBLE)")
    return S.quantile_normalise(both, weights).withColumn("score", F.round("score", 9) + 0.0)


@query(
    "combine_scores",
    "SELECT gene, cluster, round(sum(score), 6) + 0.0 AS score FROM (SELECT gene, cluster, score * 6.0 AS score FROM r3 UNION ALL SELECT gene, cluster, score / (SELECT abs(quantile_cont(score, 0.01)) FROM b2) * (SELECT abs(quantile_cont(score, 0.01)) FROM r3) * 0.5 FROM b2) q GROUP BY 1, 2",
    **SECOND,
    r1="SELECT gene, cluster, CASE WHEN score < -20 THEN (SELECT min(score) FROM rs WHERE score >= -20) ELSE score END AS score FROM rs",
    r2="SELECT gene, cluster, score - (SELECT quantile_cont(score, 0.99) FROM r1) AS score FROM r1",
    o="SELECT score FROM r2 JOIN rm USING (gene, cluster)",
    mid="SELECT quantile_cont(score, 0.5) AS mid FROM o",
    spread="SELECT 1.4826 * quantile_cont(abs(score - mid), 0.5) AS mad FROM o, mid",
    r2b="SELECT gene, cluster, (score - mid) / mad AS score FROM r2, mid, spread",
    r3="SELECT gene, cluster, CASE WHEN score < -20 THEN (SELECT min(score) FROM r2b WHERE score >= -20) ELSE score END AS score FROM r2b",
    b1="SELECT gene, cluster, CASE WHEN score < -20 THEN (SELECT min(score) FROM s2 WHERE score >= -20) ELSE score END AS score FROM s2",
    b2="SELECT gene, cluster, score - (SELECT quantile_cont(score, 0.99) FROM b1) AS score FROM b1",
)
def _(v):
    return S.combine(rows(v), [(second(v), 0.5)], v.row_memb, 6.0).withColumn("score", r6("score"))


@query(
    "size_compensation",
    "SELECT cond, cluster, round(score * exp(-greatest(n, d / 10.0) / (d * 3.0 / 8)), 6) + 0.0 AS score FROM cs JOIN (SELECT cluster, count(DISTINCT cond) AS n FROM col_memb GROUP BY 1) k USING (cluster), (SELECT count(*) AS d FROM conds) z",
    **COLS,
)
def _(v):
    d = v.conds.count()
    return S.size_factor(cols(v), B.counts(v.col_memb, "cond"), d, 3, CLUSTERS, d / 10).withColumn("score", r6("score")).select("cond", "cluster", "score")


@query("fuzz_sd", "SELECT round(0.75 * stddev_samp(score), 6) AS sd FROM rs JOIN rm USING (gene, cluster)", **ROWS)
def _(v):
    return rows(v).join(S.members(v.row_memb, "gene"), ["gene", "cluster"], "left_semi").agg(F.round(0.75 * F.stddev_samp("score"), 6).alias("sd"))


UNIFORM = "(('0x' || substr(md5(concat_ws(':', '1', '{0}', CAST(gene AS VARCHAR), CAST(cluster AS VARCHAR))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


@query(
    "fuzzify",
    f"SELECT gene, cluster, round(score + sd * sqrt(-2 * ln({UNIFORM.format(1)})) * cos(2 * pi() * {UNIFORM.format(2)}), 6) + 0.0 AS score FROM rs, (SELECT 0.75 * stddev_samp(score) AS sd FROM rs JOIN rm USING (gene, cluster)) z",
    **ROWS,
)
def _(v):
    return S.fuzz(rows(v), v.row_memb, "gene", 0.75, 1).withColumn("score", r6("score"))


def kernel_density(name: str, scores: str, memb: str, least: int, factor: str) -> dict[str, str]:
    """The density by direct sums over the grid."""
    return {
        "ends": f"SELECT cluster, min(score) - 1 AS low, max(score) + 1 AS high FROM {scores} GROUP BY 1",
        "par": f"SELECT cluster, low, high, size, wide, low - 4 * wide AS lo, high + 4 * wide AS up FROM (SELECT cluster, low, high, size, width * 2 * {factor} AS wide FROM ends JOIN (SELECT cluster, count(*) AS size FROM {scores} JOIN {memb} USING ({name}, cluster) GROUP BY 1 HAVING count(*) > {least}) k USING (cluster), (SELECT greatest((max(score) - min(score)) / 100, 0.001) AS width FROM {scores}) z) q",
        "pos": f"SELECT cluster, size, (score - lo) / ((up - lo) / 511) AS pos FROM {scores} JOIN {memb} USING ({name}, cluster) JOIN par USING (cluster)",
        "bins": "SELECT cluster, cell, sum(w) AS w FROM (SELECT cluster, floor(pos)::BIGINT AS cell, (1 - (pos - floor(pos))) / size AS w FROM pos UNION ALL SELECT cluster, floor(pos)::BIGINT + 1, (pos - floor(pos)) / size FROM pos) q GROUP BY 1, 2",
        "dens": "SELECT cluster, i, greatest(0, sum(w * exp(-0.5 * pow(abs(i - cell) * (2 * (up - lo) / 1023) / wide, 2)) / (wide * sqrt(2 * pi())))) AS y FROM bins JOIN par USING (cluster), (SELECT unnest(range(512)) AS i) g GROUP BY 1, 2",
        "ppt": "SELECT cluster, j, least(floor(x), 510)::BIGINT AS i, x FROM (SELECT cluster, j, (low + (high - low) * j / 255 - lo) / (up - lo) * 511 AS x FROM par, (SELECT unnest(range(256)) AS j) g) q",
        "curve": "SELECT cluster, j, sum(y) OVER (PARTITION BY cluster ORDER BY j DESC) AS y FROM (SELECT ppt.cluster, j, a.y + (b.y - a.y) * (x - ppt.i) AS y FROM ppt JOIN dens a ON a.cluster = ppt.cluster AND a.i = ppt.i JOIN dens b ON b.cluster = ppt.cluster AND b.i = ppt.i + 1) q",
        "rd": f"SELECT {name}, cluster, least(floor(t), 254)::BIGINT AS j, t FROM (SELECT {name}, cluster, (score - low) / (high - low) * 255 AS t FROM {scores} JOIN par USING (cluster)) q",
        "den": f"SELECT rd.{name}, rd.cluster, a.y + (b.y - a.y) * (t - rd.j) AS y FROM rd JOIN curve a ON a.cluster = rd.cluster AND a.j = rd.j JOIN curve b ON b.cluster = rd.cluster AND b.j = rd.j + 1",
    }


DENSE = "SELECT {0}, cluster, round(coalesce(y / sum(y) OVER (PARTITION BY cluster), 1.0 / count(*) OVER (PARTITION BY cluster)), 8) AS score FROM {1} LEFT JOIN den USING ({0}, cluster)"


@query("density_scores", DENSE.format("gene", "rs"), **ROWS, **kernel_density("gene", "rs", "rm", 0, "10 * exp(-size / 10.0)"))
def _(v):
    return S.density(rows(v), v.row_memb, "gene", rows=True).withColumn("score", F.round("score", 8))


@query("density_column_scores", DENSE.format("cond", "cs"), **COLS, cm=ROWS["cm"], **kernel_density("cond", "cs", "cm", 1, "1.0"))
def _(v):
    return S.density(cols(v), v.col_memb, "cond", rows=False).withColumn("score", F.round("score", 8))


@query("bscm_pvalues")
def _(v):
    return S.bootstrap_pvalues(v.expr, v.row_memb)


CANDIDATES = {
    **ROWS,
    "k": "SELECT cluster, quantile_cont(score, 0.33) AS cut FROM rs JOIN rm USING (gene, cluster) GROUP BY 1",
    "c": "SELECT rs.gene, rs.cluster, score FROM rs JOIN k ON k.cluster = rs.cluster WHERE score < cut AND NOT EXISTS (SELECT 1 FROM rm WHERE rm.gene = rs.gene AND rm.cluster = rs.cluster)",
    "cc": "SELECT gene, cluster, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, gene) AS i FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM c) q) w WHERE n <= 100 AND i <= 50",
}


@query("postadjust_candidates", "SELECT * FROM cc", **CANDIDATES)
def _(v):
    return B.candidates(v.row_memb, rows(v), "gene").select("gene", "cluster", "score")


@query(
    "postadjust",
    "SELECT gene, slot, cluster FROM row_memb UNION ALL SELECT cc.gene, top + row_number() OVER (PARTITION BY cc.gene ORDER BY cluster), cluster FROM cc JOIN (SELECT gene, max(slot) AS top FROM row_memb GROUP BY 1) t ON t.gene = cc.gene",
    **CANDIDATES,
)
def _(v):
    return B.postadjust(v.row_memb, rows(v), "gene")


def moved(name: str, memb: str, names: str, scores: str, slots: int, *, by_id: bool) -> dict[str, str]:
    """One change a name: a free slot, (columns: a cluster held twice,) or the slot of largest gain takes the best cluster of its place."""
    at = "b[least({0}, len(b))]"
    gains = ", ".join(f"CASE WHEN list_contains(b, s[{i}]) THEN 0 ELSE coalesce((SELECT score FROM {scores} x WHERE x.{name} = o.{name} AND x.cluster = o.b[least({i}, len(o.b))]) - (SELECT score FROM {scores} x WHERE x.{name} = o.{name} AND x.cluster = o.s[{i}]), 0) END" for i in range(1, slots + 1))
    twice = "CASE " + " ".join(f"WHEN len(list_filter(s, lambda c: c = s[{i}])) > 1 THEN {i}" for i in range(1, slots + 1)) + " ELSE 0 END"
    return {
        "held": f"SELECT {name}, list(cluster ORDER BY slot) AS s FROM (SELECT g.{name}, i AS slot, coalesce(m.cluster, 0) AS cluster FROM {names} g CROSS JOIN (SELECT unnest(range({slots})) AS i) z LEFT JOIN {memb} m ON m.{name} = g.{name} AND m.slot = i) q GROUP BY 1",
        "best": f"SELECT {name}, list(cluster ORDER BY {'cluster' if by_id else 'place'}) AS b FROM (SELECT {name}, cluster, row_number() OVER (PARTITION BY {name} ORDER BY score DESC, cluster) AS place FROM {scores}) q WHERE place <= {slots} GROUP BY 1",
        "o": f"SELECT {name}, s, b FROM held JOIN best USING ({name})",
        "gs": f"SELECT {name}, s, b, [{gains}] AS gain, coalesce(list_position(s, 0), 0) AS free, {'0' if by_id else twice} AS twice FROM o",
        "pick": f"SELECT {name}, s, b, CASE WHEN free > 0 THEN free WHEN twice > 0 THEN twice ELSE list_position(gain, list_max(gain)) END AS i, {'false' if by_id else 'free > 0 OR twice > 0'} AS always FROM gs",
        "new": f"SELECT {name}, s, i, {at.format('i')} AS c, always OR NOT list_contains(s, {at.format('i')}) AS moves FROM pick",
    }


MOVED = "SELECT {0}, k - 1 AS slot, CASE WHEN moves AND k = i THEN c ELSE s[k] END AS cluster FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM new) q"


@query("update_rows", MOVED.format("gene"), **ROWS, **moved("gene", "row_memb", "genes", "rs", 2, by_id=True))
def _(v):
    return B.update(B.padded(v.row_memb, v.genes, "gene", 2), rows(v), "gene", 2, rows=True)


@query("update_cols", MOVED.format("cond"), **COLS, **moved("cond", "col_memb", "conds", "cs", 3, by_id=False))
def _(v):
    return B.update(B.padded(v.col_memb, v.conds, "cond", 3), cols(v), "cond", 3, rows=False)


@query("kmeans_seed")
def _(v):
    conds = [r[0] for r in v.conds.orderBy("cond").collect()]
    return B.seed_kmeans(v.expr, 4, conds)


@query("free_slots", "SELECT g.gene, 3 - n AS free, n AS first FROM (SELECT gene, count(*) AS n FROM row_memb GROUP BY 1) g WHERE n < 3")
def _(v):
    return B.free_slots(B.padded(v.row_memb, v.genes, "gene", 3), "gene")


@query("clusters_for_row", "SELECT gene, string_agg(CAST(cluster AS VARCHAR), ':' ORDER BY slot) AS clusters FROM row_memb GROUP BY 1")
def _(v):
    return B.packed(v.row_memb, "gene")


@query("multi_slot", "SELECT cond, cluster, count(*) AS times FROM (SELECT cond, cluster FROM col_memb UNION ALL SELECT cond, 1 + (cond + 1) % 8 FROM conds WHERE cond % 2 = 0) q GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    from ..operators.stats import repeated

    more = v.conds.filter("cond % 2 = 0").select("cond", (1 + (F.col("cond") + 1) % 8).alias("cluster"))
    return repeated(v.col_memb.select("cond", "cluster").unionByName(more), ["cond"], "cluster")


@query("membership_counts", "SELECT cluster, count(DISTINCT gene) AS n FROM row_memb GROUP BY 1")
def _(v):
    return B.counts(v.row_memb, "gene")


@query("membership_diff", "SELECT gene, CAST(1 + (gene * 7 + 3) % 8 AS VARCHAR) AS only_a, '' AS only_b FROM genes WHERE (gene * 7 + 3) % 8 <> gene % 8")
def _(v):
    d = B.differing(v.row_memb, v.row_memb.filter("slot = 0"), "gene")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return d.select("gene", text("only_a").alias("only_a"), text("only_b").alias("only_b"))


SETS = {
    "rm": ROWS["rm"],
    "av": "SELECT DISTINCT set_type, gene FROM sets",
    "tt": "SELECT set_type, count(*) AS total FROM av GROUP BY 1",
    "kk": "SELECT set_type, cluster, count(*) AS k FROM rm JOIN av USING (gene) GROUP BY 1, 2",
    "ms": "SELECT set_type, set_name, count(DISTINCT gene) AS m FROM sets GROUP BY 1, 2",
    "ov": "SELECT s.set_type, rm.cluster, s.set_name, count(*) AS overlap, max(m) AS m, max(k) AS k, max(total) AS total FROM rm JOIN (SELECT DISTINCT * FROM sets) s ON s.gene = rm.gene JOIN ms ON ms.set_type = s.set_type AND ms.set_name = s.set_name JOIN kk ON kk.set_type = s.set_type AND kk.cluster = rm.cluster JOIN tt ON tt.set_type = s.set_type GROUP BY 1, 2, 3",
    "lc": "SELECT set_type, cluster, set_name, unnest(generate_series(greatest(overlap + 1, k - (total - m)), least(m, k))) AS x, m, k, total - m AS n FROM ov",
    "te": "SELECT set_type, cluster, set_name, sum(exp(lgamma(m + 1.0) - lgamma(x + 1.0) - lgamma(m - x + 1.0) + lgamma(n + 1.0) - lgamma(k - x + 1.0) - lgamma(n - k + x + 1.0) - lgamma(m + n + 1.0) + lgamma(k + 1.0) + lgamma(m + n - k + 1.0))) AS p FROM lc GROUP BY 1, 2, 3",
    "pv": "SELECT ov.*, round(coalesce(p, 0), 9) AS pvalue FROM ov LEFT JOIN te USING (set_type, cluster, set_name)",
}


def pvalues(v):
    return E.pvalues(v.row_memb, v.sets).withColumn("pvalue", F.round("pvalue", 9))


@query("set_overlap", "SELECT * FROM ov", **SETS)
def _(v):
    return E.overlaps(v.row_memb, v.sets)


@query("hypergeom_pvalue", "SELECT set_type, cluster, set_name, overlap, pvalue FROM pv", **SETS)
def _(v):
    return pvalues(v).select("set_type", "cluster", "set_name", "overlap", "pvalue")


@query("best_set", "SELECT set_type, cluster, min(pvalue) AS pvalue, arg_min(set_name, (pvalue, set_name)) AS set_name FROM pv GROUP BY 1, 2", **SETS)
def _(v):
    return pvalues(v).groupBy("set_type", "cluster").agg(F.min("pvalue").alias("pvalue"), F.min_by("set_name", F.struct("pvalue", "set_name")).alias("set_name"))


@query(
    "enrichment_scores",
    "SELECT gene, cluster, round(sum(score), 6) + 0.0 AS score FROM (SELECT s.gene, bs.cluster, -3.0 * CASE WHEN rm.gene IS NULL THEN 0.5 ELSE 1.0 END / damp AS score FROM bs JOIN (SELECT DISTINCT * FROM sets) s ON s.set_type = bs.set_type AND s.set_name = bs.set_name LEFT JOIN rm ON rm.gene = s.gene AND rm.cluster = bs.cluster) q GROUP BY 1, 2",
    **SETS,
    bs=f"SELECT *, CASE WHEN p <= 0.05 / {CLUSTERS} THEN 1.0 ELSE log10(p) / log10(0.05 / {CLUSTERS}) END AS damp FROM (SELECT set_type, cluster, min(p) AS p, arg_min(set_name, (p, set_name)) AS set_name FROM (SELECT ov.set_type, ov.cluster, ov.set_name, coalesce(p, 0) AS p FROM ov LEFT JOIN te USING (set_type, cluster, set_name)) x GROUP BY 1, 2) y",
)
def _(v):
    return E.scores(v.row_memb, v.sets, CLUSTERS, -3.0).withColumn("score", r6("score"))


@query("set_genes", "SELECT DISTINCT set_type, gene FROM sets")
def _(v):
    return v.sets.select("set_type", "gene").distinct()


@query("resume_members", "SELECT upper(name) AS name, row_number() OVER (PARTITION BY upper(name) ORDER BY cluster) - 1 AS slot, cluster FROM (SELECT DISTINCT name, cluster FROM row_members JOIN row_names USING (order_num) WHERE iteration = (SELECT max(iteration) FROM row_members)) q")
def _(v):
    return B.resumed(v.row_members, v.row_names, v.row_names.select(F.upper("name").alias("name")), "name")


PVALUES = "SELECT cond, cluster, (cond * 7 + cluster * 3) % 50 / 100.0 AS p FROM conds, (SELECT DISTINCT cluster FROM row_memb) k"


@query("resplit", "SELECT cond, row_number() OVER (PARTITION BY cond ORDER BY cluster) - 1 AS slot, cluster FROM p WHERE p <= 0.05", p=PVALUES)
def _(v):
    p = v.conds.crossJoin(v.row_memb.select("cluster").distinct())
    return B.resplit(p.withColumn("pvalue", (F.col("cond") * 7 + F.col("cluster") * 3) % 50 / 100.0))


HITS = "SELECT motif_info_id % 20 AS cluster, gene_num AS gene, position, pvalue AS hit_pvalue, (CASE WHEN reverse THEN -1 ELSE 1 END) * (motif_info_id % 2 + 1) AS motif_num FROM motif_annotations"


@query("motif_scores", "SELECT gene, cluster, round(CASE WHEN p <> 0 THEN ln(p) ELSE 0.0 END, 6) + 0.0 AS score FROM (SELECT gene, cluster, min(hit_pvalue) AS p FROM h GROUP BY 1, 2) q", h=HITS)
def _(v):
    h = hits(v).groupBy("gene", "cluster").agg(F.min("hit_pvalue").alias("pvalue"))
    return M.motif_scores(h).withColumn("score", r6("score"))


def hits(v):
    num = F.when(F.col("reverse"), -1).otherwise(1) * (F.col("motif_info_id") % 2 + 1)
    return v.motif_annotations.select((F.col("motif_info_id") % 20).alias("cluster"), F.col("gene_num").alias("gene"), "position", F.col("pvalue").alias("hit_pvalue"), num.alias("motif_num"))


@query("motif_annotation_groups", "SELECT cluster, abs(motif_num) AS motif_num, count(*) AS n, sum(CASE WHEN motif_num < 0 THEN 1 ELSE 0 END)::BIGINT AS reversed FROM h GROUP BY 1, 2", h=HITS)
def _(v):
    d = M.annotations(hits(v))
    return d.select("cluster", "motif_num", F.size("annotations").cast("long").alias("n"), F.size(F.filter("annotations", lambda a: a["reverse"])).cast("long").alias("reversed"))


@query("motif_mean_score", "SELECT round(avg(ln(p)), 6) AS mean FROM (SELECT gene, cluster + 1 AS cluster, min(hit_pvalue) AS p FROM h WHERE hit_pvalue > 0 GROUP BY 1, 2) q JOIN (SELECT DISTINCT gene, cluster FROM row_memb) m USING (gene, cluster)", h=HITS)
def _(v):
    h = hits(v).filter("hit_pvalue > 0").groupBy("gene", (F.col("cluster") + 1).alias("cluster")).agg(F.min("hit_pvalue").alias("pvalue"))
    return M.mean_score(M.motif_scores(h), v.row_memb).select(F.round("mean", 6).alias("mean"))


@query("cluster_sequences", "SELECT cluster, id, seq FROM u WHERE cluster IN (SELECT cluster FROM u GROUP BY 1 HAVING count(*) BETWEEN 3 AND 70)", u="SELECT cluster, seq, min(id) AS id FROM (SELECT m.cluster, s.id, s.seq FROM (SELECT DISTINCT gene, cluster FROM row_memb) m JOIN seqs s ON s.id = m.gene) q GROUP BY 1, 2")
def _(v):
    return M.cluster_sequences(v.row_memb, v.seqs.select(F.col("id").alias("gene"), "id", "seq")).select("cluster", "id", "seq")


#: The rows' memberships after a third of a cluster's genes have gone to another one.
MOVED = {"moved": "SELECT gene, slot, CASE WHEN slot = 0 AND cluster = 1 AND gene % 3 = 0 THEN CAST(3 AS BIGINT) ELSE cluster END AS cluster FROM row_memb"}


def moved(v):
    goes = (F.col("slot") == 0) & (F.col("cluster") == 1) & (F.col("gene") % 3 == 0)
    return v.row_memb.withColumn("cluster", F.when(goes, F.lit(3).cast("long")).otherwise(F.col("cluster")))


@query(
    "membership_changes",
    """SELECT gene, cluster, 1 AS change FROM (SELECT gene, cluster FROM moved EXCEPT SELECT gene, cluster FROM row_memb) a WHERE cluster > 0
        UNION ALL SELECT gene, cluster, -1 FROM (SELECT gene, cluster FROM row_memb EXCEPT SELECT gene, cluster FROM moved) b WHERE cluster > 0""",
    **MOVED,
)
def _(v):
    return K.changes(moved(v), v.row_memb, "gene")


def again(v, before, score):
    """Scores after the change from those before it, as a run has them in tables; ``score`` is asked for changed clusters."""
    clusters = tables.keep(K.changed(K.changes(moved(v), v.row_memb, "gene")), "changed")
    return K.rescored(tables.keep(before, "scores"), clusters, lambda k: score(K.of(moved(v), k), k)).withColumn("score", r6("score"))


@query("row_scores_rescored", "SELECT * FROM rs", **{**MOVED, **ROWS, "rm": "SELECT DISTINCT gene, cluster FROM moved"})
def _(v):
    return again(v, S.row_scores(v.expr, v.row_memb, v.col_memb), lambda memb, k: S.row_scores(v.expr, memb, K.of(v.col_memb, k)))


@query("column_scores_rescored", "SELECT * FROM cs", **{**MOVED, **COLS, "rm": COLS["rm"].replace("row_memb", "moved")})
def _(v):
    return again(v, S.column_scores(v.expr, v.row_memb), lambda memb, k: S.column_scores(v.expr, memb))
