"""Networks and operons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import networks as N
from .base import query, r6

DEDUPED = "SELECT network, least(src, dst) AS src, greatest(src, dst) AS dst, arg_min(weight, (line, weight)) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2, 3"
BOTH = "SELECT network, src, dst, weight FROM ed UNION ALL SELECT network, dst, src, weight FROM ed"
SCORES = {
    "ed": DEDUPED, "sy": BOTH, "rm": "SELECT DISTINCT gene, cluster FROM row_memb", "sz": "SELECT cluster, count(*) AS n FROM rm GROUP BY 1",
    "ns": "SELECT network, rm.cluster, sy.dst AS gene, -ln(1 + sum(weight) / max(n)) AS score FROM sy JOIN rm ON sy.src = rm.gene JOIN sz ON sz.cluster = rm.cluster GROUP BY 1, 2, 3",
}
CHAIN = "SELECT src, dst FROM predictions"


@query("network_dedupe", DEDUPED)
def _(v):
    return N.undirected(v.edges)


@query("network_normalize", "SELECT network, src, dst, round(weight * (SELECT max(t) FROM (SELECT sum(weight) AS t FROM ed GROUP BY network) q) / sum(weight) OVER (PARTITION BY network), 6) AS weight FROM ed", ed=DEDUPED)
def _(v):
    return N.normalised(N.undirected(v.edges)).select("network", "src", "dst", F.round("weight", 6).alias("weight"))


@query("string_normalize", "SELECT network, src, dst, round(1000 * exp(weight / (SELECT max(weight) FROM ed)) / exp(1.0), 6) AS weight FROM ed", ed=DEDUPED)
def _(v):
    return N.exponential(N.undirected(v.edges)).select("network", "src", "dst", F.round("weight", 6).alias("weight"))


@query("network_scores", "SELECT gene, cluster, round(sum(score * 0.5), 6) + 0.0 AS score FROM ns WHERE gene IN (SELECT gene FROM genes) GROUP BY 1, 2", **SCORES)
def _(v):
    weights = v.spark.sql("SELECT 'first' AS network, CAST(0.5 AS DOUBLE) AS weight UNION ALL SELECT 'second', CAST(0.5 AS DOUBLE)")
    return N.network_scores(N.undirected(v.edges), v.row_memb, v.genes, weights).withColumn("score", r6("score"))


@query(
    "network_score_means",
    "SELECT network, round(avg(m), 6) + 0.0 AS mean FROM (SELECT network, cluster, avg(score) AS m FROM ranked WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05) GROUP BY 1, 2) q GROUP BY 1",
    **SCORES,
    fl="SELECT k.network, rm.cluster, rm.gene, coalesce(score, 0) AS score FROM rm CROSS JOIN (SELECT DISTINCT network FROM edges) k LEFT JOIN ns ON ns.network = k.network AND ns.cluster = rm.cluster AND ns.gene = rm.gene",
    ranked="SELECT *, row_number() OVER (PARTITION BY network, cluster ORDER BY score) AS i, count(*) OVER (PARTITION BY network, cluster) AS n FROM fl",
)
def _(v):
    return N.network_score_means(N.undirected(v.edges), v.row_memb, v.genes).select("network", r6("mean").alias("mean"))


@query("network_validate", "SELECT network, count(*) AS nodes, count(k.gene) AS found, count(k.gene) * 2 >= count(*) AS valid FROM (SELECT network, src AS node FROM edges UNION SELECT network, dst FROM edges) q LEFT JOIN known k ON k.gene = node GROUP BY 1")
def _(v):
    own = v.known
    return N.validate(v.edges, own.select(F.col("gene").alias("alias"), F.col("gene").alias("original")), own)


@query("network_rename", "SELECT network, least(src, dst) + 1000 AS src, greatest(src, dst) + 1000 AS dst, arg_min(weight, (line, weight)) AS weight FROM edges WHERE src <> dst AND src IN (SELECT gene FROM known) AND dst IN (SELECT gene FROM known) GROUP BY 1, 2, 3")
def _(v):
    t = v.genes.select(F.col("gene").alias("alias"), (F.col("gene") + 1000).alias("original"))
    known = v.known.select((F.col("gene") + 1000).alias("gene"))
    return N.renamed(v.edges, t, known, check_size=False)


def _reach(sql: str) -> str:
    from .. import bindings

    parts = bindings.oracle(CHAIN)
    at = parts.rindex(" SELECT src, dst FROM predictions")
    return f"WITH RECURSIVE {parts[5:at]}, c AS ({parts[at + 1:]}), b AS (SELECT src AS u, dst AS v FROM c UNION SELECT dst, src FROM c), r AS (SELECT u, u AS w FROM b UNION SELECT r.u, b.v FROM r JOIN b ON b.u = r.w), op AS (SELECT u AS gene, min(w) AS operon FROM r GROUP BY 1) {sql}"


def operons(v):
    return N.groups(v.predictions)


def features(v):
    return v.supplier.select(F.col("s_suppkey").alias("gene"), (F.col("s_suppkey") * 37 % 1000).alias("start"), (F.col("s_suppkey") * 37 % 1000 + 300).alias("end"), (F.col("s_nationkey") % 2 == 0).alias("reverse"))


@query("operon_groups")
def _(v):
    return operons(v)


@query("operon_heads")
def _(v):
    return N.operon_heads(operons(v), features(v))


@query("operon_edges")
def _(v):
    return N.operon_edges(operons(v), 5).select("src", "dst", "weight")


FEATURES = "f AS (SELECT s_suppkey AS gene, s_suppkey * 37 % 1000 AS s, s_suppkey * 37 % 1000 + 300 AS e, s_nationkey % 2 = 0 AS rev FROM supplier)"


def _register() -> None:
    from .base import ORACLE_SQL

    ORACLE_SQL["operon_groups"] = _reach("SELECT * FROM op")
    heads = f", {FEATURES}, h AS (SELECT operon, CASE WHEN avg(rev::INT) > 0.6 THEN arg_min(gene, (-e, gene)) WHEN avg(rev::INT) < 0.4 THEN arg_min(gene, (s, gene)) END AS head FROM op JOIN f USING (gene) GROUP BY 1)"
    ORACLE_SQL["operon_heads"] = _reach("SELECT head, gene, operon FROM op JOIN h USING (operon) WHERE head IS NOT NULL").replace(") SELECT head,", f"){heads} SELECT head,")
    ORACLE_SQL["operon_edges"] = _reach("SELECT a.gene AS src, b.gene AS dst, 1000.0::DOUBLE AS weight FROM op a JOIN op b ON a.operon = b.operon AND a.gene < b.gene WHERE a.operon IN (SELECT operon FROM op GROUP BY 1 HAVING count(*) <= 5)")


_register()
