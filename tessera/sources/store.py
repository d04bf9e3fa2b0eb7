"""The result tables that a run wrote, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY_ITERATION = ("row_members", "column_members", "cluster_stats", "iteration_stats", "run_logs", "best_sets", "motif_infos", "motif_pssm_rows", "motif_annotations", "meme_motif_sites")


class Store:
    """Tables of a run's folder. One iteration of a table is a folder of its own, so that nothing else is read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, iteration: int | None = None) -> DataFrame:
        d = self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}" + ("" if iteration is None else f"/iteration={iteration}"))
        return d.withColumn("iteration", F.col("iteration").cast("long")) if name in BY_ITERATION else d

    def last_iteration(self) -> int:
        """The largest one with members; listed by its folder, no row is read."""
        return int(self.table("row_members").agg(F.max("iteration")).first()[0] or 0)

    def compact(self, target: str) -> None:
        """The last iteration of every table, and what has no iterations, in another folder."""
        last = self.last_iteration()
        for name in (*BY_ITERATION, "row_names", "column_names", "run_infos"):
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" + (f"/iteration={last}" if name in BY_ITERATION else ""))
            if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                d = self.table(name, last if name in BY_ITERATION else None)
                d.write.mode("overwrite").partitionBy(*(["iteration"] if name in BY_ITERATION else [])).parquet(f"{target}/{name}")
