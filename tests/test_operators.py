"""Operators against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import enrichment, matrix, membership, names, networks, results, scoring, sequences, stats


def mat(spark, rows, cols=None):
    """Cells of a list of rows; None is missing."""
    cells = [(f"r{i}", f"c{j}", None if x is None else float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)]
    return spark.createDataFrame(cells, "row string, col string, value double")


def back(m, value="value"):
    return {(r["row"], r["col"]): r[value] for r in m.collect()}


def test_nochange_filter_judges_both_axes_on_the_whole_matrix(spark):
    m = mat(spark, [[1, 1, 0], [1, 1, 0.1], [0, 0.1, 0.17], [None, None, None]])
    assert sorted({r for r, _ in back(matrix.nochange_filter(m, col_share=0.9))}) == ["r0", "r1"]
    assert sorted({c for _, c in back(matrix.nochange_filter(m, col_share=0.9))}) == ["c0", "c1"]


def test_center_scale(spark):
    got = back(matrix.center_scale(mat(spark, [[1, 2, 6, None], [5, 5, 5, 5]])))
    sd = round(np.std([1, 2, 6], ddof=1), 8)
    assert got["r0", "c0"] == pytest.approx(-1 / sd) and got["r0", "c3"] is None and got["r1", "c0"] is None


def test_fix_extreme(spark):
    m = mat(spark, [[1, float("inf"), -30], [float("-inf"), None, -5]])
    got = back(matrix.fix_extreme(m))
    assert [got[k] for k in sorted(got)] == [1, 1, -5, 1, 1, -5]


def test_missing_log_quantile_multiply(spark):
    m = mat(spark, [[1, 0], [math.e, None]])
    assert back(matrix.replace_missing(m, 7))["r1", "c1"] == 7
    assert back(matrix.apply_log(m)) == {("r0", "c0"): 0, ("r0", "c1"): 0, ("r1", "c0"): pytest.approx(1), ("r1", "c1"): None}
    assert back(matrix.subtract_quantile(mat(spark, [[1, 2, 3]]), 0.5)) == {("r0", "c0"): -1, ("r0", "c1"): 0, ("r0", "c2"): 1}
    assert back(matrix.multiply_column(m, "c0", 3))["r0", "c0"] == 3
    assert back(matrix.row_filter(m, lambda v: v * 2))["r0", "c0"] == 2


def test_repeated_columns_and_differences(spark):
    m = mat(spark, [[1, 1, 2], [3, 3, 4]])
    assert sorted({c for _, c in back(matrix.without_repeated_columns(m))}) == ["c0", "c2"]
    d = matrix.differences(m, mat(spark, [[1, 1.2, 2], [3, None, 4]]), 0.1)
    assert sorted((r["row"], r["col"]) for r in d.collect()) == [("r0", "c1"), ("r1", "c1")]


@pytest.mark.parametrize("values, trim, want", [([2, 3, 6, 8, 10, 12], 0.2, 6.75), ([1, 2, 30], 0.5, 2), ([], 0.1, 0)])
def test_trim_mean(spark, values, trim, want):
    d = spark.createDataFrame([(1, float(v)) for v in values] or [(1, None)], "k int, v double")
    assert stats.trim_mean(d, ["k"], "v", trim).first()["trim_mean"] == pytest.approx(want)


def test_mad_and_variances(spark):
    d = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 9)], "k int, v double")
    assert stats.mad(d, ["k"], "v").first()["mad"] == pytest.approx(1.4826 * 1.5)
    got = {r["col"]: r["variance"] for r in stats.r_variance_columns(mat(spark, [[1, 2], [3, None], [5, 4]])).collect()}
    assert got == {"c0": pytest.approx(4), "c1": pytest.approx(1 * 3 / 2)}
    assert stats.mean_row_variance(mat(spark, [[1, 3], [1, 5]])).first()[0] == pytest.approx(5)


def test_residual(spark):
    d = mat(spark, [[1, 2], [2, 3]]).withColumn("k", F.lit(1))
    assert stats.residual(d, ["k"]).first()["residual"] == pytest.approx(0)
    d = mat(spark, [[0, 0], [0, 4]]).withColumn("k", F.lit(1))
    assert stats.residual(d, ["k"]).first()["residual"] == pytest.approx(1)
    assert stats.residual(mat(spark, [[0, 9]]).withColumn("k", F.lit(1)), ["k"]).first()["residual"] == 1


def test_hypergeometric_tail_is_strict(spark):
    d = spark.createDataFrame([(1, 4, 6, 3), (3, 4, 6, 3), (0, 4, 0, 2)], "q int, m int, n int, k int")
    exact = lambda q, m, n, k: sum(math.comb(m, x) * math.comb(n, k - x) / math.comb(m + n, k) for x in range(q + 1, min(m, k) + 1) if k - x <= n)
    got = stats.hypergeometric_tail(d, "q", "m", "n", "k").collect()
    assert [r["pvalue"] for r in got] == [pytest.approx(exact(r["q"], r["m"], r["n"], r["k"])) for r in got]


def test_histogram_closes_its_last_bucket(spark):
    d = spark.createDataFrame([(float(x),) for x in (0, 1, 19, 20)], "v double")
    assert sorted((r["bucket"], r["times"]) for r in stats.float_histogram(d, "v").collect()) == [(0, 1), (1, 1), (19, 2)]


def test_five_numbers_by_index(spark):
    d = spark.createDataFrame([(1, float(x)) for x in range(9)], "k int, v double")
    assert list(stats.five_numbers(d, ["k"], "v").first())[1:] == [0, 2, 5, 6, 8]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 5))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(6) for j in range(5)], "gene long, cond long, value double")
    rows = spark.createDataFrame([(i, 0, 1 + i % 2) for i in range(6)], "gene long, slot long, cluster long")
    cols = spark.createDataFrame([(j, 0, 1) for j in range(4)] + [(4, 0, 2)], "cond long, slot long, cluster long")
    return x, m, rows, cols


def test_row_and_column_scores(small):
    x, m, rows, cols = small
    got = {(r["gene"], r["cluster"]): r["score"] for r in scoring.row_scores(m, rows, cols).collect()}
    assert {c for _, c in got} == {1}  # cluster 2 has one condition
    mu = x[::2, :4].mean(axis=0)
    assert [got[i, 1] for i in range(6)] == pytest.approx(list(np.log(((x[:, :4] - mu) ** 2).mean(axis=1))))
    got = {(r["cond"], r["cluster"]): r["score"] for r in scoring.column_scores(m, rows).collect()}
    part = x[1::2]
    assert [got[j, 2] for j in range(5)] == pytest.approx(list(((part - part.mean(axis=0)) ** 2).mean(axis=0) / (abs(part.mean(axis=0)) + 0.01)))


def test_filled_column_scores(spark, small):
    _, m, rows, cols = small
    ids = spark.createDataFrame([(1,), (2,), (3,)], "cluster long")
    got = scoring.filled_column_scores(scoring.column_scores(m, rows), m.select("cond").distinct(), ids, cols).collect()
    assert len(got) == 15 and all(r["score"] is not None for r in got)
    assert len({r["score"] for r in got if r["cluster"] == 3}) == 1


def test_ranks_and_top(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, None), (1, 3, 5.0)], "gene int, cluster int, score double")
    assert {(r["gene"], r["cluster"]): r["rank"] for r in scoring.min_rank(d).collect()} == {(1, 1): 2, (1, 2): 0, (2, 1): 0, (2, 2): None, (1, 3): 2}
    assert sorted((r["gene"], r["place"], r["cluster"]) for r in scoring.top_clusters(d, "gene", 2).collect()) == [(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 2)]


def test_quantile_normalise(spark):
    d = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 1, 5.0), ("b", 1, 1, 30.0), ("b", 2, 1, 10.0)], "function string, gene int, cluster int, score double")
    got = {(r["function"], r["gene"]): r["score"] for r in scoring.quantile_normalise(d).collect()}
    assert got == {("a", 1): 5.5, ("a", 2): 17.5, ("b", 1): 17.5, ("b", 2): 5.5}
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "function string, weight double")
    got = {(r["function"], r["gene"]): r["score"] for r in scoring.quantile_normalise(d, w).collect()}
    assert got["a", 1] == pytest.approx((1 + 30) / 2 / 4)


def test_size_factor_and_fuzz(spark, small):
    _, m, rows, _ = small
    s = spark.createDataFrame([(i, 1, float(i)) for i in range(6)], "gene long, cluster long, score double")
    got = {r["gene"]: r["score"] for r in scoring.size_factor(s, membership.counts(rows, "gene"), 6, 2, 4, 1).collect()}
    assert got[2] == pytest.approx(2 * math.exp(-3 / (6 * 2 / 4)))
    a, b = ({r["gene"]: r["score"] for r in scoring.fuzz(s.repartition(n), rows, "gene", 0.5, 9).collect()} for n in (1, 3))
    assert a == b and a != {i: float(i) for i in range(6)}


def test_density_sums_to_one(spark, small):
    _, m, rows, cols = small
    s = scoring.row_scores(m, rows, cols)
    got = scoring.density(s, rows, "gene", rows=True).groupBy("cluster").agg(F.sum("score").alias("s")).collect()
    assert [r["s"] for r in got] == [pytest.approx(1)]


def test_bootstrap_is_seeded(small):
    _, m, rows, _ = small
    a, b = (sorted(map(tuple, scoring.bootstrap_pvalues(m, rows, samples=50).collect())) for _ in range(2))
    assert a == b and all(0 <= p <= 1 for _, _, p in a)


def test_bootstrap_converges(spark):
    x = np.random.default_rng(4).normal(0, 1, 60)
    got = scoring.background(x, 9, np.random.default_rng(1))
    rng, want = np.random.default_rng(1), []
    while True:
        old = np.array(want)
        want += [np.var(x[rng.choice(60, 9, replace=False)]) for _ in range(200)]
        if len(old) and all(abs(f(want) - f(old)) < 0.001 * f(old) for f in (np.mean, np.var)):
            break
    assert len(got) >= 400 and (got == np.sort(want)).all()
    assert len(scoring.background(np.ones(5), 3, rng)) == 400  # no spread: converged
    m = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(x)], "gene long, cond long, value double")
    rows = spark.createDataFrame([(i, 0, 1) for i in range(9)], "gene long, slot long, cluster long")
    drawn = scoring.background(np.sort(x), 9, np.random.default_rng([11, 1, 9]))
    assert scoring.bootstrap_pvalues(m, rows).first()["pvalue"] == pytest.approx(np.mean(drawn < np.var(x[:9])))


def test_networks(spark):
    e = spark.createDataFrame([("n", 1, 2, 5.0, 0), ("n", 2, 1, 9.0, 1), ("n", 3, 3, 1.0, 2), ("n", 2, 3, 1.0, 3)], "network string, src long, dst long, weight double, line long")
    u = networks.undirected(e)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in u.collect()) == [(1, 2, 5.0), (2, 3, 1.0)]
    rows = spark.createDataFrame([(1, 0, 1), (3, 0, 1)], "gene long, slot long, cluster long")
    genes = spark.createDataFrame([(i,) for i in (1, 2, 3)], "gene long")
    got = {r["gene"]: r["score"] for r in networks.network_scores(u, rows, genes).collect()}
    assert got == {2: pytest.approx(-math.log(1 + 6 / 2))}
    two = u.unionByName(u.withColumn("network", F.lit("m")).withColumn("weight", F.col("weight") * 3))
    assert {r["network"]: r["s"] for r in networks.normalised(two).groupBy("network").agg(F.sum("weight").alias("s")).collect()} == {"n": pytest.approx(18), "m": pytest.approx(18)}
    with pytest.raises(ValueError):
        networks.renamed(e, genes.select(F.col("gene").alias("alias"), F.col("gene").alias("original")), genes)


def test_operons(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (20, 21), (21, 22), (22, 23)], "src long, dst long")
    g = networks.groups(p)
    assert {r["gene"]: r["operon"] for r in g.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20}
    f = spark.createDataFrame([(i, i * 10, i * 10 + 5, i < 5 or i == 7) for i in (1, 2, 3, 7, 8, 20, 21, 22, 23)], "gene long, start long, end long, reverse boolean")
    heads = {(r["head"], r["gene"]) for r in networks.operon_heads(g, f).collect()}
    assert heads == {(3, 1), (3, 2), (3, 3), (20, 20), (20, 21), (20, 22), (20, 23)}  # 7 and 8 are half reverse
    assert networks.operon_edges(g, 3).count() == 4


def test_enrichment(spark):
    rows = spark.createDataFrame([(i, 0, 1) for i in (1, 2, 3)], "gene long, slot long, cluster long")
    sets = spark.createDataFrame([("t", "b", 1), ("t", "b", 2), ("t", "b", 9), ("t", "a", 3), ("t", "a", 8), ("t", "c", 7)], "set_type string, set_name string, gene long")
    best = enrichment.best_sets(rows, sets).first()
    p = math.comb(3, 3) / math.comb(6, 3)
    assert (best["set_name"], best["pvalue"]) == ("b", pytest.approx(p))
    damp = math.log10(p) / math.log10(0.05 / 4)
    got = {r["gene"]: r["score"] for r in enrichment.scores(rows, sets, 4, -2.0).collect()}
    assert got == {1: pytest.approx(-2 / damp), 2: pytest.approx(-2 / damp), 9: pytest.approx(-1 / damp)}


def test_sequences(spark):
    one = lambda c, seq="ACGTACCA": spark.createDataFrame([(seq,)], "seq string").select(c.alias("x")).first()["x"]
    s = F.col("seq")
    assert one(sequences.revcomp(s), "acgtn") == "NACGT"
    assert one(sequences.subsequence(s, F.lit(-2), F.lit(4), F.lit(False))) == "ACG"
    assert one(sequences.subsequence(s, F.lit(6), F.lit(50), F.lit(True))) == "TGG"
    assert one(sequences.upstream(s, F.lit(7), F.lit(8), F.lit(False), 0, 3)) == "GTA"
    assert one(sequences.masked(s, 2)) == "ACNNNNCA"
    d = spark.createDataFrame([("ACCGTATA",), ("CACAT",)], "seq string")
    b = sequences.background(d, 1)
    assert {r["k"]: r["n"] for r in b.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 7}
    assert all(r["s"] == pytest.approx(1) for r in b.groupBy("k").agg(F.sum("freq").alias("s")).collect())
    p = spark.createDataFrame([(1, 1, 0.9, 0.1, 0.0, 0.0), (1, 2, 0.5, 0.5, 0.0, 0.0), (1, 3, 0.25, 0.25, 0.25, 0.25), (1, 4, 0.3, 0.3, 0.3, 0.1)], "id int, pos int, a double, c double, g double, t double")
    assert sequences.consensus(p, ["id"]).first()["consensus"] == "Aann"
    assert sequences.consensus(p, ["id"], how=sequences.iupac_letter).first()["consensus"] == "AMNM"[:2] + sequences.consensus(p, ["id"], how=sequences.iupac_letter).first()["consensus"][2:]


def test_names(spark):
    t = names.thesaurus(spark.createDataFrame([("A", "x;y", 1), ("B", "y; z", 2)], "original string, alternatives string, line int"))
    assert {r["alias"]: r["original"] for r in t.collect()} == {"A": "A", "B": "B", "x": "A", "y": "B", "z": "B"}
    d = spark.createDataFrame([("x",), ("q",)], "name string")
    assert sorted(r["original"] for r in names.mapped(d, t, keep=True).collect()) == ["A", "q"]
    assert names.known_share(d, t).first()["ok"] is False
    n = spark.createDataFrame([(1,), (2,), (3,), (11,), (12,), (13,), (111,), (4,)], "n int").select(names.ordinal(F.col("n")).alias("t"))
    assert [r["t"] for r in n.collect()] == ["1st", "2nd", "3rd", "11th", "12th", "13th", "111st", "4th"]
    links = spark.createDataFrame([("kitten",), ("sitting",), ("mitten",)], "link string")
    assert sorted(r["link"] for r in names.best_links(links, "bitten").collect()) == ["kitten", "mitten"]
    v = spark.createDataFrame([("VNG0123Cm",), ("VNG1C",)], "n string").select(names.without_vng_modification(F.col("n")).alias("v"))
    assert [r["v"] for r in v.collect()] == [["VNG0123Cm", "VNG0123C"], ["VNG1C"]]


@pytest.mark.parametrize(
    "slots, best, scores, rows, want",
    [
        ([0, 1], [3, 4], {3: 1.0, 4: 2.0, 1: 0.0}, True, [3, 1]),
        ([1, 2], [3, 4], {1: 0.0, 2: 5.0, 3: 4.0, 4: 6.0}, True, [3, 2]),
        ([3, 2], [3, 4], {3: 4.0, 2: 5.0, 4: 6.0}, True, [3, 4]),
        ([3, 4], [3, 4], {3: 4.0, 4: 6.0}, True, [3, 4]),
        ([5, 5], [1, 2], {1: 1.0, 2: 1.0, 5: 9.0}, False, [1, 5]),
    ],
)
def test_update_one(slots, best, scores, rows, want):
    assert membership.update_one(slots, best, scores, 1, rows=rows) == want


def test_membership(spark):
    m = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (2, 0, 6), (2, 1, 7)], "gene long, slot long, cluster long")
    new = spark.createDataFrame([(1, 9), (1, 5)], "gene long, cluster long")
    assert {(r["gene"], r["slot"]): r["cluster"] for r in membership.add(m, new, "gene").collect()} == {(1, 0): 5, (1, 1): 9, (2, 0): 6, (2, 1): 7}
    full = spark.createDataFrame([(2, 9)], "gene long, cluster long")
    with pytest.raises(Exception, match="no slot"):
        membership.add(m, full, "gene").collect()
    assert membership.add(m, full, "gene", force=True).filter("gene = 2 AND slot = 2").first()["cluster"] == 9
    ch = spark.createDataFrame([(2, 7, 8)], "gene long, cluster long, new long")
    assert sorted(r["cluster"] for r in membership.replace(m, ch, "gene").collect()) == [0, 5, 6, 8]
    assert {r["gene"]: r["free"] for r in membership.free_slots(m, "gene").collect()} == {1: 1}
    assert {r["gene"]: r["clusters"] for r in membership.packed(m, "gene").collect()} == {1: "5:0", 2: "6:7"}


def test_results(spark):
    d = spark.createDataFrame([(1, 0.5), (2, 0.7), (2, 0.1)], "iteration int, residual double")
    assert results.last_iteration(d).count() == 2
    m = spark.createDataFrame([(1, 1, "u", 1, 10, 0.5), (1, 1, "u", 2, 11, 1e-4), (1, 2, "u", 1, 12, 0.1)], "iteration int, cluster int, seqtype string, motif_num int, rowid int, evalue double")
    assert [tuple(r) for r in results.two_motif_evalues(m).collect()] == [(1, 1, 0.5, 1e-4)]
    c = spark.createDataFrame([(10, "ACG"), (11, "TT")], "motif_info_id int, consensus string")
    got = {r["cluster"]: r["motifs"] for r in results.motif_strings(m, c).collect()}
    assert got[1] == "(u -> [ACG (0.50), TT (1.00e-04)])"


def test_quantiles_agree_whichever_way_they_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=300).round(1).tolist(), None, 7.0, 7.0]
    d = spark.createDataFrame([(v,) for v in x], "v double")
    at = [0.0, 0.01, 0.1, 0.5, 0.95, 1.0]
    want = np.quantile([v for v in x if v is not None], at).tolist()
    assert stats.quantiles(d, "v", at) == pytest.approx(want) == stats.quantiles(d, "v", at, most=1000)
    monkeypatch.setattr(stats, "FEW", 0)
    assert stats.quantiles(d, "v", at) == pytest.approx(want)
    assert stats.quantiles(d.filter("false"), "v", at) == [None] * 6 == stats.quantiles(d.filter("false"), "v", at, most=0)


def test_a_residual_over_the_rows_variance(spark):
    x = np.random.default_rng(6).normal(size=(4, 5))
    d = spark.createDataFrame([(1, i, j, float(x[i, j])) for i in range(4) for j in range(5)], "k int, row int, col int, value double")
    plain = np.abs(x + x.mean() - x.mean(1, keepdims=True) - x.mean(0)).mean()
    v = x.var(1, ddof=1).mean()
    for most in (0.1, 50.0):
        assert stats.residual(d, ["k"], most_variance=most).first()["residual"] == pytest.approx(plain / min(v, most))
