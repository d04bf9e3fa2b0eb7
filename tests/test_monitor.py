"""The live monitor: rewritten and late iterations, restarts and repeated batches."""

import os

from tessera.streaming.monitor import Monitor

SCHEMA = {"t": "name STRING, score DOUBLE, iteration INT"}


def put(spark, run, iteration, rows, parts=1):
    d = spark.createDataFrame(rows, "name string, score double")
    d.repartition(parts).write.mode("overwrite").parquet(f"{run}/t/iteration={iteration}")


def state(m):
    return sorted(tuple(r) for r in m.table("t").select("iteration", "name", "score").collect())


def test_last_writes_stand(spark, tmp_path):
    run, folder = str(tmp_path / "run"), str(tmp_path / "monitor")
    put(spark, run, 1, [("a", 1.0), ("b", 2.0), ("c", 3.0)], parts=3)
    put(spark, run, 2, [("a", 4.0), ("a", 4.0)], parts=2)  # repeated rows stay
    m = Monitor(spark, run, folder, SCHEMA).drain()
    assert state(m) == [(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (2, "a", 4.0), (2, "a", 4.0)]
    put(spark, run, 1, [("b", 9.0)])  # with fewer rows
    put(spark, run, 3, [("d", None)])
    m = Monitor(spark, run, folder, SCHEMA).drain()  # goes on, by its checkpoint
    assert state(m) == [(1, "b", 9.0), (2, "a", 4.0), (2, "a", 4.0), (3, "d", None)]
    batches = os.listdir(f"{folder}/rows/t")
    assert state(Monitor(spark, run, folder, SCHEMA).drain()) == state(m) and os.listdir(f"{folder}/rows/t") == batches


def test_an_earlier_write_that_comes_late_is_no_news(spark, tmp_path):
    run, folder = str(tmp_path / "run"), str(tmp_path / "monitor")
    put(spark, run, 1, [("new", 1.0)])
    m = Monitor(spark, run, folder, SCHEMA).drain()
    spark.createDataFrame([("old", 0.0)], "name string, score double").write.parquet(str(tmp_path / "other"))
    for f in os.listdir(tmp_path / "other"):
        if f.startswith("part-"):
            os.rename(tmp_path / "other" / f, f"{run}/t/iteration=1/{f}")
            os.utime(f"{run}/t/iteration=1/{f}", (1_000_000_000, 1_000_000_000))
    assert state(m.drain()) == [(1, "new", 1.0)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    """The driver is lost between a batch's rows and its commit."""
    run, folder = str(tmp_path / "run"), str(tmp_path / "monitor")
    put(spark, run, 1, [("a", 1.0), ("b", 2.0)], parts=2)
    m = Monitor(spark, run, folder, SCHEMA).drain()
    for f in os.listdir(f"{folder}/streams/t/commits"):
        os.remove(f"{folder}/streams/t/commits/{f}")
    assert state(Monitor(spark, run, folder, SCHEMA).drain()) == state(m) == [(1, "a", 1.0), (1, "b", 2.0)]
