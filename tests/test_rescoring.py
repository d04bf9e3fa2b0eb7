"""Change logs, scores of changed clusters only, and runs that are killed and go on."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tessera import tables
from tessera.operators import rescoring as R
from tessera.operators import scoring as S
from tessera.operators.networks import network_scores
from tessera.plans.config import Config
from tessera.plans.run import SCORERS, Run, _columns

MEMB = "gene long, slot long, cluster long"


def test_a_change_log(spark):
    before = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (2, 0, 6), (2, 1, 7), (3, 0, 7), (3, 1, 7), (None, 0, 4)], MEMB)
    now = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (2, 0, 8), (2, 1, 7), (3, 0, 7), (3, 1, 9)], MEMB)
    log = R.changes(now, before, "gene")
    assert sorted(log.filter("gene IS NOT NULL").collect()) == [(2, 6, -1), (2, 8, 1), (3, 9, 1)]  # another slot or one slot fewer is no change
    assert sorted(r[0] for r in R.changed(log, log.filter("cluster = 8")).collect()) == [4, 6, 8, 9]
    assert R.changes(now, now, "gene").count() == 0
    assert R.changes(now.limit(0), now, "gene").filter("change = 1").count() == 0 and R.changes(now, now.limit(0), "gene").count() == 5


def test_only_changed_clusters_are_scored(spark):
    before = spark.createDataFrame([(g, c, float(10 * g + c)) for g in (1, 2) for c in (1, 2, 3)], "gene long, cluster long, score double")
    clusters = spark.createDataFrame([(2,), (3,), (4,)], "cluster long")
    got = R.rescored(before, clusters, lambda k: k.filter("cluster <> 3").select(F.lit(1).cast("long").alias("gene"), "cluster", F.lit(0.5).alias("score")))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 11.0), (1, 2, 0.5), (1, 4, 0.5), (2, 1, 21.0)]  # 3 has nothing any more
    memb = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 0, 9)], MEMB)
    assert R.of(memb, clusters).count() == 1 and R.of(memb, None) is memb


def matrix(spark, rng, genes=18, conds=6):
    x = np.repeat([[2, 2, 2, -2, -2, -2], [-2, -2, -2, 2, 2, 2]], genes // 2, axis=0) + rng.normal(0, 0.3, (genes, conds))
    return spark.createDataFrame([(i, j, None if (i * j) % 17 == 5 else float(x[i, j])) for i in range(genes) for j in range(conds)], "gene long, cond long, value double")


def test_twenty_iterations_of_changed_clusters_equal_full_scoring(spark, tmp_path):
    """Rows, columns and networks after every change, and less is read the fewer clusters change; the last memberships leave a cluster empty."""
    gen, rng = np.random.default_rng(4), random.Random(4)
    m = matrix(spark, gen)
    edges = spark.createDataFrame([("a", i, (i * 5 + 1) % 18, 1.0 + i) for i in range(18)], "network string, src long, dst long, weight double")
    run = Run(spark, m, str(tmp_path / "run"), Config(num_iterations=20, clusters=6, per_row=1, per_col=3), edges=edges)
    rows, cols = {g: 1 + g % 6 for g in range(18)}, {(c, s): 1 + (c + s) % 6 for c in range(6) for s in range(3)}
    values = lambda d, *by: {tuple(r[x] for x in by): r["score"] for r in d.collect()}
    weights = spark.createDataFrame([("a", 1.0)], "network string, weight double")
    for i in range(1, 21):
        moved = rng.sample(range(18), (5, 2, 1, 0)[i % 4]) if i > 1 else []
        for g in moved:
            rows[g] = rng.randint(1, 6)
        if i % 5 == 0:
            cols[rng.randrange(6), rng.randrange(3)] = rng.randint(1, 6)
        if i == 20:
            rows = {g: 1 if k == 2 else k for g, k in rows.items()}
        run.rows = run.kept(spark.createDataFrame([(g, 0, k) for g, k in rows.items()], MEMB), f"rows-{i}")
        run.cols = run.kept(spark.createDataFrame([(c, s, k) for (c, s), k in cols.items()], "cond long, slot long, cluster long"), f"cols-{i}")
        run.now = i
        got = values(SCORERS["Rows"](run, i), "gene", "cluster"), values(SCORERS["Networks"](run, i), "gene", "cluster")
        want = values(S.row_scores(run.matrix, run.rows, run.cols), "gene", "cluster"), values(network_scores(edges, run.rows, run.genes, weights), "gene", "cluster")
        assert [x == pytest.approx(y, rel=1e-12, abs=1e-12) for x, y in zip(got, want, strict=True)] == [True, True]
        if i in (1, 2, 7, 20):
            _columns(run)
            assert values(run.scored["cells"][0], "cond", "cluster") == pytest.approx(values(S.column_scores(run.matrix, run.rows), "cond", "cluster"), rel=1e-12)
    read = {(name, i): n for name, i, n in run.read}
    assert len([1 for i in range(2, 21) if read["Rows", i] < 6]) >= 10 and read["Networks", 3] <= read["Rows", 3]
    assert all(read["Networks", i] == 0 for i in (3, 7, 11, 15, 19)) and run.scored["Networks"][0]._tessera_name == "Networks-20"


class Killed(Exception):
    pass


def made(spark, folder):
    """A run of two iterations, whose networks are scored in the first one only."""
    m = matrix(spark, np.random.default_rng(2))
    edges = spark.createDataFrame([("a", i, i + 1, 1.0) for i in range(17)], "network string, src long, dst long, weight double")
    c = Config(num_iterations=2, clusters=3, per_col=2, result_frequency=2, stats_frequency=1, postadjust=False, schedules={"Rows": "1,1", "Columns": "1,1", "Networks": "1"})
    return Run(spark, m, folder, c, edges=edges, functions=("Rows", "Networks"))


def goes_on(spark, folder, kill=None, after=False):
    """From the last save point to the end, unless killed before or after the write of a table; what was written."""
    run = made(spark, folder)
    done = run.resume()
    assert done == 1
    written, own = [], {x: getattr(DataFrameWriter, x) for x in ("parquet", "text")}

    def killing(kind):
        def write(self, path, *args, **more):
            if str(path).startswith(folder):
                written.append(path[len(folder) + 1 :])
                if written[-1] == kill and not after:
                    raise Killed
            own[kind](self, path, *args, **more)
            if path == f"{folder}/{kill}":
                raise Killed

        return write

    with pytest.MonkeyPatch.context() as patch:
        for x in own:
            patch.setattr(DataFrameWriter, x, killing(x))
        try:
            run.run(done + 1)
            run.finish()
        except Killed:
            assert kill == written[-1]
            return written
    assert kill is None
    return written


def contents(spark, folder):
    out = {}
    for t in ("row_members", "column_members", "cluster_stats", "iteration_stats", "run_logs", "rows-2", "cols-2", "Rows-2", "Columns-2"):
        out[t] = sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in spark.read.parquet(f"{folder}/{t}").collect())
    return out


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Folders of a run after its first iteration, and of one that was never interrupted."""
    at, end = (str(tmp_path_factory.mktemp(x) / "run") for x in ("first", "whole"))
    run = made(spark, end)
    m = run.matrix
    run.start(m.select("gene").distinct().select("gene", F.lit(0).cast("long").alias("slot"), (F.col("gene") % 3 + 1).alias("cluster")), m.select("cond").distinct().select("cond", F.lit(0).cast("long").alias("slot"), (F.col("cond") % 3 + 1).alias("cluster")))
    commit = Run.commit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Run, "commit", lambda run, i: (commit(run, i), shutil.copytree(end, at) if i == 1 else None))
        run.run()
    run.finish()
    return at, contents(spark, end), tables.names(spark, end)


@pytest.mark.parametrize("kill, after", [("Rows-2", True), ("cluster_stats/iteration=2", True), ("savepoints/iteration=2", False), ("savepoints/iteration=2", True)])
def test_a_killed_run_goes_on(spark, runs, tmp_path, kill, after):
    at, want, left = runs
    folder = str(tmp_path / "run")
    shutil.copytree(at, folder)
    goes_on(spark, folder, kill, after)
    points = [i for i in (1, 2) if "_SUCCESS" in tables.names(spark, f"{folder}/savepoints/iteration={i}")]
    assert max(points) == (2 if kill.startswith("save") and after else 1)
    again = made(spark, folder)
    done = again.resume()
    assert done == max(points)
    again.run(done + 1)
    again.finish()
    assert contents(spark, folder) == want and tables.names(spark, folder) == left
    assert tables.names(spark, f"{folder}/savepoints") == ["iteration=3"]


def test_a_start_forgets_save_points(spark, runs, tmp_path):
    folder = str(tmp_path / "run")
    shutil.copytree(runs[0], folder)
    run = made(spark, folder)
    assert run.resume() == 1 and run.scored["Rows"][1]._tessera_name == "rows-start" and set(run.cached) == {"Rows", "Networks", "Columns"}
    run.start(run.rows, run.cols)
    assert run.resume() == 0
