"""Motif discovery, scans and comparison against brute force; runs that search motifs."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import tables
from tessera.operators import discovery as D
from tessera.plans.config import Config
from tessera.plans.run import Run

BASE = np.array([0.3, 0.2, 0.2, 0.3])
TURN = str.maketrans("ACGT", "TGCA")


def revcomp(s: str) -> str:
    return s[::-1].translate(TURN)


def random_seq(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


def places(seq: str, width: int) -> list[tuple[str, int, bool]]:
    out = [(seq[i : i + width], i) for i in range(len(seq) - width + 1)]
    return [(s, i, r) for w, i in out if set(w) <= set("ACGT") for s, r in ((w, False), (revcomp(w), True))]


def prepared(seqs: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, owner, _, _ = D.windows(seqs, width)
    return codes, np.eye(4)[codes].reshape(len(codes), -1), np.flatnonzero(np.diff(owner, prepend=-1))


def test_a_step_equals_one_by_hand():
    rng = random.Random(1)
    seqs = [random_seq(rng, n) for n in (9, 14, 5, 20)] + ["ACNACGTTNA", "ACG"]
    width, share = 5, 0.4
    theta = np.random.default_rng(2).dirichlet([2] * 4, width)
    _, hot, first = prepared(seqs, width)
    new, next_share, _, value = D.step(hot, first, theta, share, BASE)
    counts, total, logs, used = np.zeros((width, 4)), 0.0, 0.0, 0
    for s in seqs:
        own = places(s, width)
        if not own:
            continue
        used += 1
        ratios = [math.prod(theta[k]["ACGT".index(x)] / BASE["ACGT".index(x)] for k, x in enumerate(w)) for w, _, _ in own]
        whole = 1 - share + share / len(own) * sum(ratios)
        logs += math.log(whole)
        for (w, _, _), r in zip(own, ratios, strict=True):
            z = share / len(own) * r / whole
            total += z
            for k, x in enumerate(w):
                counts[k]["ACGT".index(x)] += z
    assert np.allclose(new, (counts + D.PRIOR * BASE) / (counts.sum(1, keepdims=True) + D.PRIOR))
    assert next_share == pytest.approx(min(0.99, max(0.01, total / used)))
    assert value == pytest.approx(logs + D.PRIOR * (BASE * np.log(theta)).sum())


@pytest.mark.parametrize("seed", range(6))
def test_the_likelihood_never_falls(seed):
    rng = random.Random(seed)
    seqs = [random_seq(rng, rng.randint(20, 60)) for _ in range(12)]
    for width in (6, 11):
        codes, hot, first = prepared(seqs, width)
        theta, share, before = D.started("ACGTTA", width, BASE), 0.5, -math.inf
        for _ in range(30):
            theta, share, _, value = D.step(hot, first, theta, share, BASE)
            assert value >= before - 1e-9
            before = value
        course = D.fit(codes, first, ["ACGTTA", "CCCCCC"], BASE)[2]
        assert all(b >= a - 1e-9 for a, b in itertools.pairwise(course))


def test_tail_of_the_gamma_distribution():
    for x in (0.01, 0.5, 1.0, 3.0, 40.0, 400.0):
        q = {1.0: math.exp(-x), 0.5: math.erfc(math.sqrt(x))}
        for a in (1.0, 2.0, 3.0, 0.5, 1.5, 2.5):
            if a not in q:
                q[a] = q[a - 1] + math.exp((a - 1) * math.log(x) - x - math.lgamma(a))
            if q[a] > 1e-300:
                assert D.log_gamma_tail(a, x) == pytest.approx(math.log(q[a]), rel=1e-9, abs=1e-12)
    assert D.log_gamma_tail(9.0, 0.0) == 0.0


PLANTED = {1: "TGACGTCATT", 2: "GGATTACCAGGAT"}


@pytest.fixture(scope="module")
def planted(spark):
    """Two clusters with a motif on either strand in most sequences, one without, one of a single sequence, one of short ones."""
    rng, rows, at = random.Random(4), [], {}
    for cluster in (1, 2, 3):
        for i in range(20):
            s = random_seq(rng, 110)
            if cluster in PLANTED and i < 17:
                word = "".join(x if rng.random() < 0.93 else rng.choice("ACGT") for x in PLANTED[cluster])
                k, turned = rng.randrange(110 - len(word)), rng.random() < 0.5
                s = s[:k] + (revcomp(word) if turned else word) + s[k + len(word) :]
                at[cluster * 100 + i] = k, turned
            rows.append((cluster, cluster * 100 + i, s))
    rows += [(4, 400, random_seq(rng, 50)), (5, 500, "ACG"), (5, 501, ""), (5, 502, "NNNNNNNNNNNN")]
    return spark.createDataFrame(rows, "cluster long, id long, seq string").repartition(3), at


def test_planted_motifs_are_found_and_the_next_one_is_another(planted):
    seqs, at = planted
    base = D.base_frequencies(seqs)
    found = {(r["cluster"], r["motif_num"]): r for r in D.discover(seqs, base, 2).collect()}
    assert {c for c, _ in found} <= {1, 2, 3}
    for cluster, word in PLANTED.items():
        r = found[cluster, 1]
        consensus = "".join("ACGT"[int(np.argmax(x))] for x in r["pssm"])
        core = word[1:-1]
        assert core[:6] in consensus + revcomp(consensus) or core[-6:] in consensus + revcomp(consensus)
        assert r["evalue"] < 1e-6 < found[3, 1]["evalue"]
        hit = [s for s in r["sites"] if s["id"] in at and s["start"] - 1 < at[s["id"]][0] + len(word) and at[s["id"]][0] < s["start"] - 1 + r["width"]]
        assert len(hit) >= 15
        if (second := found.get((cluster, 2))) is not None:
            for s in second["sites"]:  # what was found is masked
                for t in r["sites"]:
                    assert s["id"] != t["id"] or s["start"] + second["width"] <= t["start"] or t["start"] + r["width"] <= s["start"]
    again = {(r["cluster"], r["motif_num"]): r for r in D.discover(seqs.repartition(7), base, 2).collect()}
    assert again == found


def test_base_frequencies_are_those_of_both_strands(planted):
    seqs, _ = planted
    text = "".join(r["seq"] for r in seqs.collect())
    text += text.translate(TURN) + "ACGT" * 2
    n = [text.count(x) for x in "ACGT"]
    assert list(D.base_frequencies(seqs).first()) == pytest.approx([x / sum(n) for x in n])


@pytest.mark.parametrize("width", range(1, 7))
def test_chances_of_scores_equal_those_of_all_words(width):
    scores = np.random.default_rng(width).integers(-30, 20, (width, 4))
    low, chance = D.tail(scores, BASE)
    of = defaultdict(float)
    for word in itertools.product(range(4), repeat=width):
        of[sum(scores[k][x] for k, x in enumerate(word))] += math.prod(BASE[x] for x in word)
    assert low == min(of)
    for s in range(low, low + len(chance)):
        assert chance[s - low] == pytest.approx(sum(p for x, p in of.items() if x >= s), abs=1e-12)


MATRICES = [
    (1, 1, [[0.7, 0.1, 0.1, 0.1], [0.0, 1.0, 0.0, 0.0], [0.1, 0.1, 0.7, 0.1]]),
    (1, 2, [[0.25] * 4, [0.0, 0.0, 0.5, 0.5]]),
    (2, 1, [[0.1, 0.2, 0.3, 0.4], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.5, 0.5, 0.0, 0.0], [0.2, 0.2, 0.2, 0.4]]),
]


def test_scan_equals_a_look_at_every_place(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 1)
    monkeypatch.setattr(D, "CHUNK", 64)
    rng = random.Random(6)
    seqs = [(i, random_seq(rng, rng.randint(0, 25))) for i in range(40)] + [(90, "ACNNACGTNN"), (91, "N" * 9), (92, ""), (93, "AC")]
    motifs = spark.createDataFrame(MATRICES, "cluster long, motif_num int, pssm array<array<double>>")
    base = spark.createDataFrame([tuple(BASE.tolist())], "a double, c double, g double, t double")
    hits = D.scan(motifs, spark.createDataFrame(seqs, "id long, seq string"), base)
    got = {(r["cluster"], r["motif_num"], r["id"]): r for r in hits.collect()}
    want = {}
    for cluster, num, pssm in MATRICES:
        p = np.array(pssm)
        scores = np.floor(np.log2((p + D.PSEUDO * BASE) / (p.sum(1, keepdims=True) + D.PSEUDO) / BASE) * D.SCALE + 0.5).astype(int)
        value = lambda w, m=scores: sum(int(m[k]["ACGT".index(x)]) for k, x in enumerate(w))
        words = [("".join(w), math.prod(BASE["ACGT".index(x)] for x in w)) for w in itertools.product("ACGT", repeat=len(pssm))]
        for i, s in seqs:
            own = [(-value(w), at, r) for w, at, r in places(s, len(pssm))]
            if own:
                best = min(own)
                hit = sum(p for w, p in words if value(w) >= -best[0])
                want[cluster, num, i] = (best[1] + 1, best[2], -best[0], hit, 1 - (1 - min(hit, 1)) ** len(own))
    assert got.keys() == want.keys()
    for k, (position, reverse, score, hit, whole) in want.items():
        r = got[k]
        assert (r["position"], r["reverse"], r["score"]) == (position, reverse, score)
        assert r["hit_pvalue"] == pytest.approx(hit) and r["pvalue"] == pytest.approx(whole)
    both = {(r["cluster"], r["id"]): r["pvalue"] for r in D.combined_pvalues(hits).collect()}
    for (cluster, i), p in both.items():
        own = [want[k][4] for k in want if (k[0], k[2]) == (cluster, i)]
        x = math.prod(own)
        assert p == pytest.approx(min(1.0, x * (1 - math.log(x)) if len(own) == 2 else x))


def test_scan_of_nothing(spark):
    base = spark.createDataFrame([tuple(BASE.tolist())], "a double, c double, g double, t double")
    motifs = spark.createDataFrame(MATRICES, "cluster long, motif_num int, pssm array<array<double>>")
    seqs = spark.createDataFrame([(1, "ACGT")], "id long, seq string")
    assert D.scan(motifs.filter("false"), seqs, base).collect() == [] == D.scan(motifs, seqs.filter("false"), base).collect()
    assert D.compare(motifs.select(F.lit(1).alias("id"), "pssm").filter("false"), base).collect() == []


def test_comparison_equals_all_sums_of_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 2)
    gen = np.random.default_rng(3)
    motifs = {i: gen.dirichlet([0.4] * 4, int(gen.integers(2, 5))) for i in range(6)}
    motifs[6] = motifs[0][::-1, ::-1].copy()  # the other strand of the first
    base = spark.createDataFrame([tuple(BASE.tolist())], "a double, c double, g double, t double")
    d = spark.createDataFrame([(i, m.tolist()) for i, m in motifs.items()], "id long, pssm array<array<double>>")
    got = {(r["motif_info_id1"], r["motif_info_id2"]): r for r in D.compare(d, base, threshold=1.0, overlap=2).collect()}
    own = {i: (m + D.PSEUDO * BASE) / (m.sum(1, keepdims=True) + D.PSEUDO) for i, m in motifs.items()}
    columns = [c for m in own.values() for c in [*m, *m[::-1, ::-1]]]
    dist = lambda a, b: int(math.sqrt(((a - b) ** 2).sum()) / math.sqrt(2) * D.LEVELS + 0.5)
    assert len(got) == 7 * 6
    for i, q in own.items():
        each = [[dist(c, x) for x in columns] for c in q]
        for j, t in own.items():
            if i == j:
                continue
            tries, least = [], min(2, len(q), len(t))
            for turned, m in ((False, t), (True, t[::-1, ::-1])):
                for shift in range(-len(t), len(q) + 1):
                    pairs = [(a, a - shift) for a in range(len(q)) if 0 <= a - shift < len(t)]
                    if len(pairs) >= least:
                        total = sum(dist(q[a], m[b]) for a, b in pairs)
                        sums = np.zeros(1, int)
                        for a, _ in pairs:
                            sums = np.add.outer(sums, each[a]).ravel()
                        tries.append(((sums <= total).mean(), -len(pairs), turned, shift))
            best = min(tries, key=lambda x: (round(x[0], 12), *x[1:]))
            r = got[i, j]
            assert r["pvalue"] == pytest.approx(1 - (1 - best[0]) ** len(tries), abs=1e-9)
            assert (r["overlap"], r["reverse"], r["shift"]) == (-best[1], best[2], best[3])
    assert got[0, 6]["reverse"] and got[0, 6]["shift"] == 0


# ---- runs


@pytest.fixture(scope="module")
def world(spark):
    rng, gen = random.Random(8), np.random.default_rng(8)
    x = np.repeat([[2, 2, 2, -2, -2, -2], [-2, -2, -2, 2, 2, 2]], 9, axis=0) + gen.normal(0, 0.3, (18, 6))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(18) for j in range(6)], "gene long, cond long, value double")
    seqs = []
    for i in range(18):
        s, word = random_seq(rng, 60), "TTGACGTCAA" if i < 9 else "GGGATTTCCC"
        seqs.append((i, f"g{i}", s[:20] + word + s[30:]))
    return m, spark.createDataFrame(seqs, "gene long, id string, seq string")


def begun(spark, world, folder, **more) -> Run:
    m, seqs = world
    own = dict(num_iterations=1, postadjust=False, clusters=2, per_row=1, per_col=2, result_frequency=1, stats_frequency=1, schedules={x: "1,1" for x in ("Rows", "Columns", "Motifs", "MEME")}, nmotifs="1", mask_sequences=False)
    run = Run(spark, m, folder, Config(**(own | more)), sequences=seqs, functions=("Rows", "Motifs"))
    rows = m.select("gene").distinct().select("gene", F.lit(0).cast("long").alias("slot"), F.when(F.col("gene") < 9, 1).otherwise(2).cast("long").alias("cluster"))
    cols = m.select("cond").distinct().select("cond", F.lit(0).cast("long").alias("slot"), (F.col("cond") % 2 + 1).alias("cluster"))
    run.start(rows, cols)
    return run


def test_a_run_with_sequences_searches_motifs_and_leaves_no_tables(spark, world, tmp_path):
    run = begun(spark, world, str(tmp_path / "run"))
    left = len(tables._made)
    run.run()
    run.finish()
    assert len(tables._made) == left
    table = lambda t: spark.read.parquet(f"{tmp_path}/run/{t}")
    infos = table("motif_infos").filter("iteration = 1")
    assert {r["cluster"] for r in infos.collect()} == {1, 2} and infos.filter("evalue < 0.001").count() == 2
    sites = table("meme_motif_sites").filter("iteration = 1").collect()
    assert len(sites) >= 14 and all(len(s["seq"]) >= 6 and len(s["flank_left"]) == 10 for s in sites)
    assert {f.name for f in (tmp_path / "run").iterdir() if f.name.startswith(("found-", "places-", "searched-"))} == {"found-1", "places-1", "searched-1"}


def test_a_search_of_changed_clusters_equals_a_search_of_all(spark, world, tmp_path, monkeypatch):
    m, seqs = world
    run, searched = begun(spark, world, str(tmp_path / "a")), []
    whole = D.discover
    monkeypatch.setattr(D, "discover", lambda s, *a: searched.append({r[0] for r in s.select("cluster").distinct().collect()}) or whole(s, *a))
    values = lambda p: sorted((r["cluster"], r["gene"], round(r["pvalue"], 12)) for r in p.collect())
    from tessera.plans.run import search_motifs

    for iteration, move in ((1, None), (2, None), (3, 4)):
        if move is not None:
            run.rows = run.kept(run.rows.withColumn("cluster", F.when(F.col("gene") == move, 2).otherwise(F.col("cluster"))), "moved")
        p, motifs = search_motifs(run, iteration)
        fresh = begun(spark, world, str(tmp_path / f"b{iteration}"))
        fresh.rows = run.rows
        q, others = search_motifs(fresh, iteration)
        assert values(p) == values(q)
        if iteration == 1:
            at = {(g, c): x for c, g, x in values(p)}
            assert all((at[g, 1] < at[g, 2]) == (g < 9) for g in range(18))
        assert sorted(map(str, motifs.collect())) == sorted(map(str, others.collect()))
    assert searched == [{1, 2}, {1, 2}, set(), {1, 2}, {1, 2}, {1, 2}]


def test_scopes_drop_what_is_made_inside(spark):
    outer = tables.keep(spark.range(3), "outer")
    before = list(tables._made)
    with tables.scope():
        tables.keep(spark.range(3), "inner")
        with tables.scope():
            tables.keep(spark.range(3), "innermost")
        assert len(tables._made) == len(before) + 1
    assert tables._made == before and outer.count() == 3
    tables.drop(outer)


def test_a_first_step_adds_up_over_parts(spark, monkeypatch):
    """A cluster is never one group: however its sequences are dealt, the sums are those of all of them."""
    monkeypatch.setattr(D, "PART", 3)
    rng = random.Random(9)
    rows = [(c, i, random_seq(rng, rng.randint(4, 30))) for c in (1, 2) for i in range(40)]
    seqs = spark.createDataFrame(rows, "cluster long, id long, seq string").repartition(5)
    base = spark.createDataFrame([tuple(BASE.tolist())], "a double, c double, g double, t double")
    word = {r["cluster"]: r["words"][0] for r in D.best_words(seqs, most=1).collect()}
    got = {(r["cluster"], r["pos"]): r for r in D.first_steps(seqs, base).collect()}
    for c in (1, 2):
        _, hot, first = prepared([s for k, _, s in rows if k == c], D.CORE)
        theta, share, _, _ = D.step(hot, first, D.started(word[c], D.CORE, BASE), 0.5, BASE)
        for k in range(D.CORE):
            assert [got[c, k + 1][x] for x in "acgt"] == pytest.approx(theta[k].tolist())
            assert got[c, k + 1]["share"] == pytest.approx(share)
    assert "MapInPandas" in D.first_steps(seqs, base)._jdf.queryExecution().toString()


def test_words_of_a_group_are_those_of_the_table(spark):
    rng = random.Random(11)
    rows = [(c, i % 9, random_seq(rng, rng.randint(0, 30)) + "NA") for c in (1, 2, 3) for i in range(12)]  # an id twice counts once
    want = {r["cluster"]: r["words"] for r in D.best_words(spark.createDataFrame(rows, "cluster long, id long, seq string")).collect()}
    for c in (1, 2, 3):
        assert D.shared_words([s for k, _, s in rows if k == c], [i for k, i, _ in rows if k == c]) == want[c]
    assert D.shared_words(["ACG", ""], [1, 2]) == []


@pytest.mark.parametrize("width", [6, 11])
def test_starts_together_lead_where_each_alone_does(width):
    rng = random.Random(width)
    codes, hot, first = prepared([random_seq(rng, rng.randint(20, 60)) for _ in range(15)], width)
    ends = []
    for w in (words := [random_seq(rng, 6) for _ in range(5)]):
        theta, share, course = D.started(w, width, BASE), 0.5, []
        for _ in range(D.TRIES):
            new, next_share, _, value = D.step(hot, first, theta, share, BASE)
            course.append(value)
            if len(course) > 1 and value - course[-2] < D.GAIN * abs(value):
                break
            theta, share = new, next_share
        ends.append((course[-1], theta, share))
    _, theta, share = max(ends, key=lambda x: x[0])
    got = D.ahead(hot, first, np.stack([D.started(w, width, BASE) for w in words]), BASE)
    assert np.allclose(got[0], theta) and got[1] == pytest.approx(share)


def test_a_cluster_is_searched_in_one_group(planted):
    seqs, _ = planted
    plan = D._models(seqs, BASE.tolist(), D.WIDTHS)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_classes_lose_no_link(spark, monkeypatch):
    """Pairs of classes, spelled out over their members, are the pairs of all motifs."""
    monkeypatch.setattr(D, "BLOCK", 1)
    gen = np.random.default_rng(5)
    kinds = [gen.dirichlet([0.4] * 4, int(gen.integers(3, 6))).tolist() for _ in range(4)]
    of = {i: i % 4 if i < 10 else 0 for i in range(14)}
    base = spark.createDataFrame([tuple(BASE.tolist())], "a double, c double, g double, t double")
    d = spark.createDataFrame([(i, kinds[k]) for i, k in of.items()], "id long, pssm array<array<double>>")
    want = {(r["motif_info_id1"], r["motif_info_id2"]): r for r in D.compare(d, base, threshold=0.9).collect()}
    rows = D.compare_classes(d, base, threshold=0.9).collect()
    own = {r["motif_info_id1"]: r["motif_info_id2"] for r in rows if r["kind"] == "member"}
    pairs = {(r["motif_info_id1"], r["motif_info_id2"]): r for r in rows if r["kind"] == "pair"}
    assert own == {i: min(j for j in of if of[j] == k) for i, k in of.items()}
    assert {(i, j) for i in of for j in of if i != j and (own[i], own[j]) in pairs} == want.keys()
    for (i, j), r in want.items():
        p = pairs[own[i], own[j]]
        assert (p["shift"], p["reverse"], p["overlap"]) == (r["shift"], r["reverse"], r["overlap"]) and p["pvalue"] == pytest.approx(r["pvalue"])


def test_groups_of_few_bytes_stay_apart(spark):
    d = tables.spread(spark.range(100).selectExpr("id", "id % 50 AS cluster"), "cluster").groupBy("cluster").count()
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
