"""Matrix filters and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix as M
from ..operators import stats as S
from ..operators.scoring import members
from .base import query, r6

LONG = "SELECT gene AS row, cond AS col, value FROM expr"


def long(v):
    return v.expr.select(F.col("gene").alias("row"), F.col("cond").alias("col"), "value")


def sparse(v):
    return v.expr_sparse.select(F.col("gene").alias("row"), F.col("cond").alias("col"), "value")


YEARS = list(range(1990, 2030))


@query("matrix_pivot", "SELECT gene AS row, " + ", ".join(f"max(CASE WHEN cond = {y} THEN value END) AS c{y}" for y in YEARS) + " FROM expr_sparse GROUP BY gene")
def _(v):
    w = M.wide(sparse(v), YEARS)
    return w.select("row", *[F.col(str(y)).alias(f"c{y}") for y in YEARS])


@query("matrix_unpivot", "SELECT CAST(o_orderkey AS BIGINT) AS row, 'o_totalprice' AS col, o_totalprice AS value FROM {orders} UNION ALL SELECT o_orderkey, 'half', o_totalprice / 2 FROM {orders}")
def _(v):
    return M.long(v.orders.select(F.col("o_orderkey").alias("row"), "o_totalprice", (F.col("o_totalprice") / 2).alias("half")))


@query("matrix_sorted", "SELECT row_number() OVER (ORDER BY s_name) AS place, s_name AS name FROM {supplier}")
def _(v):
    from pyspark.sql import Window as W

    return v.supplier.select(F.row_number().over(W.orderBy("s_name")).cast("long").alias("place"), F.col("s_name").alias("name"))


@query("submatrix_by_name", "SELECT gene AS row, cond AS col, value FROM expr WHERE gene IN (SELECT gene FROM row_memb WHERE cluster = 3) AND cond IN (SELECT cond FROM col_memb WHERE cluster = 3)")
def _(v):
    rows = v.row_memb.filter("cluster = 3").withColumnRenamed("gene", "row")
    return M.submatrix(long(v), rows, v.col_memb.filter("cluster = 3").withColumnRenamed("cond", "col"))


@query("index_lookup", "SELECT name, coalesce((SELECT CAST(n_nationkey AS BIGINT) FROM {nation} WHERE n_name = name), -1) AS idx FROM (SELECT DISTINCT upper(c_mktsegment) AS name FROM {customer} UNION SELECT n_name FROM {nation}) q")
def _(v):
    wanted = v.customer.select(F.upper("c_mktsegment").alias("name")).union(v.nation.select("n_name")).distinct()
    return M.index_of(v.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("idx")), wanted, index="idx")


@query(
    "nochange_filter",
    """SELECT m.* FROM m JOIN r USING (row) JOIN c USING (col)""",
    m="SELECT gene AS row, cond AS col, value - 4.5 AS value FROM expr_sparse",
    z="SELECT count(DISTINCT row) AS nr, count(DISTINCT col) AS nc FROM m",
    r="SELECT row FROM m, z GROUP BY row, nc HAVING (nc - sum(CASE WHEN abs(value) > 0.17 THEN 1 ELSE 0 END)) / nc < 0.98",
    c="SELECT col FROM m, z GROUP BY col, nr HAVING (nr - sum(CASE WHEN abs(value) > 0.17 THEN 1 ELSE 0 END)) / nr < 0.1",
)
def _(v):
    return M.nochange_filter(sparse(v).withColumn("value", F.col("value") - 4.5)).select("row", "col", "value")


@query(
    "center_scale",
    "SELECT row, col, round((value - mid) / nullif(sd, 0), 6) + 0.0 AS value FROM m JOIN s USING (row)",
    m=LONG,
    s="SELECT row, quantile_cont(value, 0.5) AS mid, round(stddev_samp(value), 8) AS sd FROM m GROUP BY row",
)
def _(v):
    return M.center_scale(long(v)).select("row", "col", r6("value").alias("value"))


@query("replace_nan", "SELECT gene AS row, cond AS col, coalesce(value, 0) AS value FROM expr_sparse")
def _(v):
    return M.replace_missing(sparse(v), 0).select("row", "col", "value")


@query("apply_log", "SELECT gene AS row, cond AS col, round(CASE WHEN value <> 0 THEN ln(value) ELSE value END, 6) + 0.0 AS value FROM expr")
def _(v):
    return M.apply_log(long(v)).select("row", "col", r6("value").alias("value"))


@query(
    "fix_extreme_values",
    "SELECT row, col, CASE WHEN value IS NULL THEN hi WHEN value < -20 THEN lo ELSE value END AS value FROM m, b",
    m="SELECT gene AS row, cond AS col, CASE WHEN gene % 9 <> 0 THEN round((value - 4) * (gene % 11), 6) END AS value FROM expr_sparse",
    b="SELECT max(value) AS hi, min(CASE WHEN value >= -20 THEN value END) AS lo FROM m",
)
def _(v):
    m = sparse(v).withColumn("value", F.when(F.col("row") % 9 != 0, F.round((F.col("value") - 4) * (F.col("row") % 11), 6)))
    return M.fix_extreme(m).select("row", "col", "value")


@query("subtract_quantile", "SELECT gene AS row, cond AS col, round(value - (SELECT quantile_cont(value, 0.99) FROM expr), 6) + 0.0 AS value FROM expr")
def _(v):
    return M.subtract_quantile(long(v), 0.99).select("row", "col", r6("value").alias("value"))


@query("multiply_column", "SELECT gene AS row, cond AS col, round(CASE WHEN cond = 1995 THEN value * 2 ELSE value END, 6) AS value FROM expr_sparse")
def _(v):
    return M.multiply_column(sparse(v), 1995, 2.0).select("row", "col", F.round("value", 6).alias("value"))


@query(
    "row_col_means",
    "SELECT 'row' AS axis, gene AS name, round(avg(value), 9) AS mean FROM expr_sparse GROUP BY gene UNION ALL SELECT 'col', cond, round(avg(value), 9) FROM expr_sparse GROUP BY cond",
)
def _(v):
    mean = F.round(F.avg("value"), 9).alias("mean")
    return v.expr_sparse.groupBy(F.lit("row").alias("axis"), F.col("gene").alias("name")).agg(mean).unionByName(v.expr_sparse.groupBy(F.lit("col").alias("axis"), F.col("cond").alias("name")).agg(mean))


@query("quantiles", "SELECT cond, round(quantile_cont(value, 0.1), 9) AS q10, round(quantile_cont(value, 0.5), 9) AS q50, round(quantile_cont(value, 0.95), 9) AS q95 FROM expr_sparse GROUP BY cond")
def _(v):
    return v.expr_sparse.groupBy("cond").agg(*[F.round(S.quantile("value", p), 9).alias(n) for p, n in ((0.1, "q10"), (0.5, "q50"), (0.95, "q95"))])


@query("min_max", "SELECT cond, min(value) AS least, max(value) AS most, round(stddev_samp(value), 8) AS sd FROM expr_sparse GROUP BY cond")
def _(v):
    return v.expr_sparse.groupBy("cond").agg(F.min("value").alias("least"), F.max("value").alias("most"), S.r_stddev("value").alias("sd"))


@query(
    "trim_mean",
    "SELECT cond, round(avg(value), 6) AS mean FROM r WHERE i > floor(n * 0.05) AND i <= n - floor(n * 0.05) GROUP BY cond",
    r="SELECT cond, value, row_number() OVER (PARTITION BY cond ORDER BY value) AS i, count(*) OVER (PARTITION BY cond) AS n FROM expr_sparse WHERE value IS NOT NULL",
)
def _(v):
    return S.trim_mean(v.expr_sparse, ["cond"], "value", 0.05, "mean").select("cond", F.round("mean", 6).alias("mean"))


@query(
    "mad",
    "SELECT cond, round(1.4826 * quantile_cont(abs(value - mid), 0.5), 6) AS mad FROM expr_sparse JOIN c USING (cond) GROUP BY cond",
    c="SELECT cond, quantile_cont(value, 0.5) AS mid FROM expr_sparse GROUP BY cond",
)
def _(v):
    return S.mad(v.expr_sparse, ["cond"], "value").select("cond", F.round("mad", 6).alias("mad"))


@query("row_variance", "SELECT round(avg(v), 6) AS row_variance FROM (SELECT var_samp(value) AS v FROM expr GROUP BY gene) q")
def _(v):
    return S.mean_row_variance(long(v)).select(F.round("row_variance", 6).alias("row_variance"))


@query("col_variance_r", "SELECT cond AS col, round(var_pop(value) * n / (n - 1), 6) AS variance FROM expr_sparse, (SELECT count(DISTINCT gene) AS n FROM expr_sparse) q GROUP BY cond, n")
def _(v):
    return S.r_variance_columns(sparse(v)).select("col", F.round("variance", 6).alias("variance"))


RESIDUAL = {
    "m": "SELECT r.cluster, gene, cond, value FROM expr JOIN (SELECT DISTINCT gene, cluster FROM row_memb) r USING (gene) JOIN (SELECT DISTINCT cond, cluster FROM col_memb) c USING (cond) WHERE r.cluster = c.cluster",
    "rm": "SELECT cluster, gene, avg(value) AS r FROM m GROUP BY 1, 2",
    "cm": "SELECT cluster, cond, avg(value) AS c FROM m GROUP BY 1, 2",
    "mm": "SELECT cluster, avg(r) AS mu, count(*) AS nr, (SELECT count(*) FROM cm WHERE cm.cluster = rm.cluster) AS nc FROM rm GROUP BY 1",
}


@query(
    "cluster_residuals",
    "SELECT m.cluster, round(CASE WHEN least(max(nr), max(nc)) <= 1 THEN 1.0 ELSE avg(abs(value + mu - r - c)) END, 6) AS residual FROM m JOIN rm ON m.cluster = rm.cluster AND m.gene = rm.gene JOIN cm ON m.cluster = cm.cluster AND m.cond = cm.cond JOIN mm ON m.cluster = mm.cluster GROUP BY 1",
    **RESIDUAL,
)
def _(v):
    m = v.expr.join(members(v.row_memb, "gene"), "gene").join(members(v.col_memb, "cond"), ["cond", "cluster"])
    return S.residual(m, ["cluster"], "gene", "cond").select("cluster", F.round("residual", 6).alias("residual"))


@query(
    "cluster_residuals_scaled",
    "SELECT m.cluster, round(CASE WHEN least(max(nr), max(nc)) <= 1 THEN 1.0 ELSE avg(abs(value + mu - r - c)) / least(coalesce(max(v), 0.5), 0.5) END, 6) AS residual FROM m JOIN rm ON m.cluster = rm.cluster AND m.gene = rm.gene JOIN cm ON m.cluster = cm.cluster AND m.cond = cm.cond JOIN mm ON m.cluster = mm.cluster JOIN rv ON rv.cluster = m.cluster GROUP BY 1",
    **RESIDUAL,
    rv="SELECT cluster, avg(v) AS v FROM (SELECT cluster, gene, var_samp(value) AS v FROM m GROUP BY 1, 2) q GROUP BY 1",
)
def _(v):
    """Over the rows' variance, which counts up to 0.5."""
    m = v.expr.join(members(v.row_memb, "gene"), "gene").join(members(v.col_memb, "cond"), ["cond", "cluster"])
    return S.residual(m, ["cluster"], "gene", "cond", most_variance=0.5).select("cluster", F.round("residual", 6).alias("residual"))


@query("residual", "SELECT round(avg(abs(value + mu - r - c)), 6) AS residual FROM expr JOIN (SELECT gene, avg(value) AS r FROM expr GROUP BY 1) a USING (gene) JOIN (SELECT cond, avg(value) AS c FROM expr GROUP BY 1) b USING (cond), (SELECT avg(r) AS mu FROM (SELECT avg(value) AS r FROM expr GROUP BY gene) q) z")
def _(v):
    return S.residual(long(v).withColumn("all", F.lit(1)), ["all"]).select(F.round("residual", 6).alias("residual"))


@query("repeated_values", "SELECT c_nationkey, c_mktsegment, count(*) AS times FROM {customer} GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return S.repeated(v.customer, ["c_nationkey"], "c_mktsegment")


@query("invalid_numbers", "SELECT doc_id AS line FROM {documents} WHERE text IS NOT NULL AND TRY_CAST(text AS DOUBLE) IS NULL")
def _(v):
    return M.invalid_numbers(v.documents.select(F.col("doc_id").alias("line"), "text"))


@query("clean_names", "SELECT s_suppkey, regexp_replace(replace(replace(concat('X', s_name, '.1'), '\"', ''), '.', '-'), '^X', '') AS name FROM {supplier}")
def _(v):
    return v.supplier.select("s_suppkey", M.clean_name(F.concat(F.lit("X"), "s_name", F.lit(".1"))).alias("name"))


@query("without_repeated_columns", "SELECT gene AS row, cond AS col, value FROM expr_sparse")
def _(v):
    m = sparse(v)
    return M.without_repeated_columns(m.unionByName(m.withColumn("col", F.col("col") + 10000)))


@query(
    "matrix_diff",
    "SELECT a.gene AS row, a.cond AS col, a.value AS a, b.value AS b FROM expr_sparse a JOIN b ON a.gene = b.gene AND a.cond = b.cond WHERE (a.value IS NULL) <> (b.value IS NULL) OR abs(a.value - b.value) > 0.5",
    b="SELECT gene, cond, CASE WHEN gene % 5 <> 0 THEN round(value + gene % 3 - 1, 6) END AS value FROM expr_sparse",
)
def _(v):
    m = sparse(v)
    return M.differences(m, m.withColumn("value", F.when(F.col("row") % 5 != 0, F.round(F.col("value") + F.col("row") % 3 - 1, 6))), 0.5)
