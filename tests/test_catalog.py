"""Every query with SQL agrees with it on the smallest tables."""

import os
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera import bindings, catalog
from tessera.operators.networks import network_score_means

SF = "/root/testdata/sf0.001"


def same(x):
    return None if x is None else repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted(str([same(x) for x in r]) for r in df.collect())
    assert rows == sorted(str([same(r[i]) for i in at]) for r in want.fetchall())


def test_bootstrap_query(spark, duck):
    """Each cell of a condition and a cluster has a p-value; a variance above all that were drawn has 1."""
    got = {(r["cond"], r["cluster"]): r["pvalue"] for r in catalog.QUERIES["bscm_pvalues"](spark, SF).collect()}
    x = {}
    for g, c, v in duck.sql(bindings.oracle("SELECT gene, cond, value FROM expr")).fetchall():
        x.setdefault(c, {})[g] = v
    members = {}
    for g, k in duck.sql(bindings.oracle("SELECT DISTINCT gene, cluster FROM row_memb")).fetchall():
        members.setdefault(k, set()).add(g)
    rng = np.random.default_rng(0)
    assert set(got) == {(c, k) for c in x for k in members if members[k] & set(x[c])}
    for (c, k), p in got.items():
        own = [x[c][g] for g in members[k] if g in x[c]]
        if len(own) == 1:
            assert p == 1
        else:
            every = np.array(list(x[c].values()))
            drawn = [np.var(rng.choice(every, len(own), replace=False)) for _ in range(800)]
            assert abs(p - np.mean(np.array(drawn) < np.var(own) - 1e-12)) < 0.12


def test_kmeans_query(spark, duck):
    """Every gene has one of four clusters, and no gene is nearer to another cluster's mean by much."""
    got = {r["gene"]: r["cluster"] for r in catalog.QUERIES["kmeans_seed"](spark, SF).collect()}
    rows = duck.sql(bindings.oracle("SELECT gene, cond, value FROM expr")).fetchall()
    conds = sorted({c for _, c, _ in rows})
    x = {g: np.zeros(len(conds)) for g in got}
    for g, c, v in rows:
        x[g][conds.index(c)] = v
    assert set(x) == {g for g, _, _ in rows} and set(got.values()) <= {1, 2, 3, 4}
    means = {k: np.mean([x[g] for g in x if got[g] == k], axis=0) for k in set(got.values())}
    assert all(min(means, key=lambda k: ((x[g] - means[k]) ** 2).sum()) == got[g] for g in x)


def test_run_query(spark, duck):
    """Sizes within the slots, twice the same; the first columns' numbers follow from the memberships that were given."""
    got = [tuple(r) for r in catalog.QUERIES["run_iterations"](spark, SF).orderBy("iteration", "cluster").collect()]
    again = [tuple(r) for r in catalog.QUERIES["run_iterations"](spark, SF).orderBy("iteration", "cluster").collect()]
    assert got == again and {r[0] for r in got} == {1, 2, 3}
    genes = duck.sql(bindings.oracle("SELECT count(*) FROM genes")).fetchall()[0][0]
    for i in (1, 2):
        assert 0 < sum(r[2] for r in got if r[0] == i) <= 2 * genes
    assert sum(r[2] for r in got if r[0] == 3) >= sum(r[2] for r in got if r[0] == 2)  # adjusting only adds
    assert all(0 <= r[4] <= 5 for r in got)


def test_a_run_reads_what_edges_and_sets_are_made_from_once(spark, tmp_path):
    """Iterations go on when the source is gone: they read the run's own tables."""
    from tessera.plans.run import Config, Run

    m = spark.createDataFrame([(g, c, float((g * 7 + c * 3) % 11)) for g in range(12) for c in range(5)], "gene long, cond long, value double")
    edges = spark.createDataFrame([("a", i, i + 1, 1.0 + i % 3) for i in range(11)], "network string, src long, dst long, weight double")
    sets = spark.createDataFrame([("t", f"s{i % 3}", i) for i in range(12)], "set_type string, set_name string, gene long")
    given = []
    for name, d in (("edges", edges), ("sets", sets)):
        d.write.parquet(str(tmp_path / "source" / name))
        given.append(spark.read.parquet(str(tmp_path / "source" / name)))
    c = Config(num_iterations=1, clusters=3, per_col=2, schedules={x: "1,1" for x in ("Rows", "Columns", "Networks", "SetEnrichment")})
    run = Run(spark, m, str(tmp_path / "run"), c, edges=given[0], sets=given[1], functions=("Rows", "Networks", "SetEnrichment"))
    shutil.rmtree(tmp_path / "source")
    run.start(run.genes.select("gene", F.lit(0).cast("long").alias("slot"), (F.col("gene") % 3 + 1).alias("cluster")), run.conds.select("cond", F.lit(0).cast("long").alias("slot"), (F.col("cond") % 3 + 1).alias("cluster")))
    run.run()
    got = {r["network"]: r["mean"] for r in network_score_means(edges, run.rows, run.genes).collect()}
    stats = spark.read.parquet(f"{run.folder}/iteration_stats/iteration=1").filter("category = 'network'").collect()
    assert {r["name"]: r["score"] for r in stats} == pytest.approx(got)


def test_the_others_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) <= {"bscm_pvalues", "kmeans_seed", "run_iterations", "discovered_motifs", "motif_likeness", "mismatch_motifs"}  # the last three: brute force in test_discovery and test_mismatches


def test_entry(spark, duck):
    assert __spark_entry__.entry(spark).count() > 0


def test_lines_without_an_order_are_written_side_by_side(spark):
    """Only lines that have places go into one file, and so through one task."""
    from tessera.catalog import files

    folder = files.lines_at(spark.range(0, 100, 1, 5).selectExpr("cast(id AS string) AS value"), "parts")
    assert len([x for x in os.listdir(folder.removeprefix("file:")) if x.endswith(".txt")]) == 5
    assert sorted(int(r[0]) for r in spark.read.text(folder).collect()) == list(range(100))


def test_lines_of_a_plot_search_no_list(spark):
    from tessera.sources import pages

    rows = [(1, 2, "upstream", f"g{i % 700}", 1, i, i % 3 == 0, 5) for i in range(1400)]
    d = pages.positions_svg(spark.createDataFrame(rows, "iteration long, cluster long, seqtype string, gene string, motif_num long, position long, reverse boolean, length long"))
    assert "array_position" not in d._jdf.queryExecution().analyzed().toString()
    names = sorted({f"g{i % 700}" for i in range(1400)})
    svg = d.collect()[0]["svg"]
    assert svg.count("<rect") == 1400
    assert f'<rect class="m1" x="699" y="{names.index("g699") * 10 + 5}" width="5"' in svg


def test_members_of_a_graph_are_counted_once_over_iterations(spark):
    """Iterations go before names are joined, in the only aggregate over the memberships."""
    from tessera.catalog.base import Views
    from tessera.operators import results as R

    v = Views(spark, SF)
    plan = R.graph_nodes(v.row_members, v.row_names, v.motif_infos)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "linenumber" in x]
