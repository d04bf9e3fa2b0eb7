"""A live view of a run: streams over the files that iterations append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATS = "cluster LONG, num_rows LONG, num_cols LONG, residual DOUBLE, iteration INT"


def residuals(spark: SparkSession, path: str) -> DataFrame:
    """Mean residual and sizes by iteration, as files of ``cluster_stats`` come (output mode complete or update)."""
    s = spark.readStream.schema(STATS).parquet(path)
    return s.groupBy("iteration").agg(F.avg("residual").alias("residual"), F.avg("num_rows").alias("rows"), F.avg("num_cols").alias("cols"), F.count("*").alias("clusters"))


def late_log(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean scaling by log type and window of event time, events later than ``delay`` left out (append mode)."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "logtype").agg(F.count("*").alias("n"), F.avg("scaling").alias("scaling"))


#: Tables that a run writes by iteration, with the columns of their files.
TABLES = {
    "cluster_stats": STATS,
    "iteration_stats": "category STRING, name STRING, score DOUBLE, iteration INT",
    "run_logs": "logtype STRING, at INT, active INT, scaling DOUBLE, iteration INT",
}


class Monitor:
    """Follows the tables of a run's folder in a folder of its own, which has what came and how far each stream is.

    A run may write an iteration again: the last write's rows stand for it, and none of an earlier one that comes later. A monitor that was stopped or
    lost goes on where it was; a batch that is repeated replaces itself. Files that the run took away before they were read are left out.
    """

    def __init__(self, spark: SparkSession, run: str, folder: str, schemas: dict[str, str] | None = None):
        self.spark, self.run, self.folder, self.schemas = spark, run, folder, schemas or TABLES

    def follow(self, table: str, **trigger: object) -> StreamingQuery:
        """Starts a table's stream; ``availableNow=True`` ends it when all there is has come."""
        d = self.spark.readStream.schema(self.schemas[table]).option("ignoreMissingFiles", "true").parquet(f"{self.run}/{table}")
        # files of one write share the id in their names
        d = d.select("*", F.regexp_extract("_metadata.file_name", "^part-[0-9]+-([0-9a-f-]{36})", 1).alias("_write"), F.col("_metadata.file_modification_time").alias("_written"))
        path = f"{self.folder}/rows/{table}"

        def put(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

        return d.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/streams/{table}").trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def drain(self) -> Monitor:
        """Takes all there is of all tables."""
        for q in [self.follow(t, availableNow=True) for t in self.schemas]:
            q.awaitTermination()
        return self

    def table(self, table: str) -> DataFrame:
        """The rows that have come, of each iteration's last write."""
        d = self.spark.read.schema(f"{self.schemas[table]}, _write STRING, _written TIMESTAMP, batch LONG").parquet(f"{self.folder}/rows/{table}")
        last = d.groupBy("iteration").agg(F.max_by("_write", F.struct("_written", "_write")).alias("_write"))
        return d.join(last, ["iteration", "_write"], "left_semi").drop("_write", "_written", "batch")
