"""A short run of the iteration from given memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..bindings import CLUSTERS
from ..operators import results as R
from ..operators.networks import undirected
from ..plans.config import Config
from ..plans.run import Run
from ..sources.store import Store
from ..streaming.monitor import Monitor
from .base import query, r6

ALWAYS = {x: "1,1" for x in ("Rows", "Columns", "Networks", "SetEnrichment")}


@query("run_iterations")
def _(v):
    """Statistics of all clusters after two iterations and the adjustment behind them."""
    folder = tables.place(v.spark, "run")
    c = Config(num_iterations=2, clusters=CLUSTERS, per_col=3, result_frequency=1, stats_frequency=1, schedules=ALWAYS)
    run = Run(v.spark, v.expr, folder, c, edges=undirected(v.edges), sets=v.sets, functions=("Rows", "Networks", "SetEnrichment"))
    run.start(v.row_memb, v.col_memb)
    run.run()
    run.finish()
    return Store(v.spark, folder).table("cluster_stats").select("iteration", "cluster", "num_rows", "num_cols", "residual")


def written(d: DataFrame, folder: str, table: str) -> None:
    """As a run does: iterations in folders of their own, each written anew."""
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(f"{folder}/{table}")


@query(
    "live_monitor",
    """SELECT 'residual' AS series, name, iteration, round(score, 6) + 0.0 AS value FROM iteration_stats JOIN statstypes USING (statstype) WHERE name = 'median_residual'
        UNION ALL SELECT 'members', 'rows', iteration, round(avg(num_rows), 6) + 0.0 FROM cluster_stats GROUP BY iteration
        UNION ALL SELECT 'members', 'cols', iteration, round(avg(num_cols), 6) + 0.0 FROM cluster_stats GROUP BY iteration
        UNION ALL SELECT 'log', logtype, iteration, round(CASE WHEN active = 1 THEN scaling ELSE 0.0 END, 6) + 0.0 FROM runs WHERE logtype NOT IN ('view', 'click')""",
)
def _(v):
    """Residuals, members and the log as streams bring them: half, then the rest with even iterations, which were wrong, written again, after a restart."""
    run, folder = tables.place(v.spark, "run"), tables.place(v.spark, "monitor")
    i = F.col("iteration").cast("int").alias("iteration")
    now = {
        "cluster_stats": v.cluster_stats.select("cluster", "num_rows", "num_cols", "residual", i),
        "iteration_stats": v.iteration_stats.join(v.statstypes, "statstype").select("category", "name", "score", i),
        "run_logs": v.runs.select("logtype", F.col("iteration").cast("int").alias("at"), "active", "scaling", i),
    }
    wrong = {"cluster_stats": ("num_rows", F.col("num_rows") + 7), "iteration_stats": ("score", F.col("score") - 1), "run_logs": ("active", 1 - F.col("active"))}
    for t, d in now.items():
        written(d.filter("iteration % 2 = 0").withColumn(*wrong[t]), run, t)
    Monitor(v.spark, run, folder).drain()
    for t, d in now.items():
        written(d, run, t)
    m = Monitor(v.spark, run, folder).drain()
    named = lambda kind, name, x: [F.lit(kind).alias("series"), name, F.col("iteration").cast("long").alias("iteration"), r6(x).alias("value")]
    residuals = m.table("iteration_stats").filter("name = 'median_residual'").select(*named("residual", F.col("name"), "score"))
    sizes = m.table("cluster_stats").groupBy("iteration").agg(F.avg("num_rows").alias("rows"), F.avg("num_cols").alias("cols"))
    log = R.run_log(m.table("run_logs").withColumn("rowid", F.lit(0)), ["view", "click"])
    out = residuals.unionByName(log.select(*named("log", F.col("logtype").alias("name"), "scaling")))
    for x in ("rows", "cols"):
        out = out.unionByName(sizes.select(*named("members", F.lit(x).alias("name"), x)))
    return out
