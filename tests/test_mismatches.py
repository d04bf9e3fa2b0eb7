"""Words with mismatches against a look at every word and every place."""

import math
import random
from itertools import product

import numpy as np
import pytest

from tessera.operators import discovery as D
from tessera.operators import mismatches as X
from tests.test_discovery import places, random_seq, revcomp


def far(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def test_neighbours_of_a_word():
    for length, mismatches in ((4, 2), (6, 1), (5, 4)):
        own = X.number("ACGTA"[:length].ljust(length, "C"))
        for k, m in enumerate(X.masks(length, mismatches)):
            got = [X.spelled(int(own ^ x), length) for x in m]
            assert sorted(got) == sorted(w for w in map("".join, product("ACGT", repeat=length)) if far(w, X.spelled(own, length)) == k)


@pytest.mark.parametrize("length", [3, 4, 6])
def test_shares_of_near_words_equal_sums_over_all_words(length):
    rng = np.random.default_rng(length)
    context = rng.random(4**4) + 0.1
    context /= context.sum()
    every = X.extended(context, length)
    words = [X.spelled(i, length) for i in range(4**length)]
    assert every.sum() == pytest.approx(1)
    if length == 6:  # a chain of words of four letters
        part = lambda w: context[X.number(w)] / sum(context[X.number(w[:3] + x)] for x in "ACGT")
        for w in ("ACGTAC", "TTTTTT", "GATTAC"):
            assert every[X.number(w)] == pytest.approx(context[X.number(w[:4])] * part(w[1:5]) * part(w[2:6]))
    near = X.near_shares(every, length, 2)
    for w in random.Random(1).sample(words, 20):
        for e in range(3):
            assert near[e][X.number(w)] == pytest.approx(sum(every[X.number(u)] for u in words if far(u, w) <= e))


def brute(seqs, length, mismatches, shares, quorum):
    near = X.near_shares(X.extended(shares, length), length, mismatches)
    own = [[w for w, _, _ in places(s, length)] for s in seqs]
    own = [x for x in own if x]
    out = {}
    for w in map("".join, product("ACGT", repeat=length)):
        if w > revcomp(w):
            continue
        least = [min(far(w, x) for x in p) for p in own]
        hits = [(e, len(p)) for e, p in zip(least, own, strict=True) if e <= mismatches]
        if hits and len(hits) * 100 >= quorum * len(own):
            out[w] = len(hits), sum(e == 0 for e, _ in hits), sum(-math.log(1 - (1 - near[e][X.number(w)]) ** n) for e, n in hits)
    return out


def test_words_equal_a_look_at_every_place(spark):
    rng = random.Random(5)
    rows = [(c, i, random_seq(rng, rng.choice([14, 20, 31]))) for c in (1, 2, 3) for i in range(5)]
    rows += [(1, 5, "NNNNNNNN"), (1, 6, "ACG"), (2, 7, None), (2, 8, ""), (2, 9, "acgtnacgtacgta"), (2, 9, "acgtnacgtacgta"), (4, 1, "AC")]
    seqs = spark.createDataFrame(rows, "cluster long, id long, seq string")
    shares = X.word_background(seqs.filter("seq IS NOT NULL"))
    searched = ((5, 1), (5, 4), (4, 2), (6, 2))
    for quorum in (50, 100):
        got = {}
        for r in X.mismatch_words(seqs, shares, searched, quorum=quorum).collect():
            got.setdefault((r["cluster"], r["length"], r["mismatches"]), {})[r["word"]] = r["n"], r["exact"], r["score"]
        for c in (1, 2, 3, 4):
            own = [s.upper() for k, _, s in rows if k == c and s]
            for length, mismatches in searched:
                want = brute(own, length, mismatches, shares, quorum)
                have = got.get((c, length, mismatches), {})
                assert set(want) == set(have)
                for w, (n, exact, score) in want.items():
                    assert have[w][:2] == (n, exact) and have[w][2] == pytest.approx(score, rel=1e-9, abs=1e-9)
    assert not X.mismatch_words(seqs.limit(0), shares, searched).collect()
    best = X.mismatch_words(seqs, shares, ((6, 2),), most=3).filter("cluster = 1").collect()
    every = sorted(brute([s for k, _, s in rows if k == 1], 6, 2, shares, 50).items(), key=lambda x: (-x[1][2], x[0]))
    assert [r["word"] for r in best] == [w for w, _ in every[:3]]


def test_background_counts_both_strands(spark):
    rng = random.Random(7)
    texts = [random_seq(rng, 40) for _ in range(6)] + ["ACGNACGTTT", "ACG"]
    got = X.word_background(spark.createDataFrame(list(enumerate(texts)), "id int, seq string"), 4)
    counts = np.ones(256)
    for s in texts:
        for w, _, _ in places(s, 4):
            counts[X.number(w)] += 1
    assert np.allclose(got, counts / counts.sum()) and np.allclose(X.word_background(spark.createDataFrame([], "id int, seq string"), 3), 1 / 64)


def test_planted_words_become_motifs(spark):
    """Each sequence has two words with a letter or two changed; the best is found, masked, and then the other."""
    rng = random.Random(3)
    rows = []
    for c, planted in ((1, ("TTGACATC", "GGCCATAG")), (2, ("CATCGGTA", "TTTAGCGC"))):
        for i in range(16):
            s = random_seq(rng, 150)
            for at, w in zip((20, 90), planted, strict=True):
                k = rng.randrange(8)
                w = w[:k] + rng.choice("ACGT") + w[k + 1 :] if i % 2 else w
                s = s[:at] + (w if rng.random() < 0.5 else revcomp(w)) + s[at + len(w) :]
            rows.append((c, i, s))
    rows += [(3, 1, "ACGTACGTAC"), (4, 1, "NNN"), (4, 2, "NNNNNNNNNNN")]  # no motif in one sequence, or in none
    seqs = spark.createDataFrame(rows, "cluster long, id long, seq string")
    base = D.base_frequencies(seqs)
    got = X.word_motifs(seqs, base, background=X.word_background(seqs)).collect()
    assert {(r["cluster"], r["motif_num"]) for r in got} == {(c, i) for c in (1, 2) for i in (1, 2)}
    text = {(c, i): s for c, i, s in rows}
    for r in got:
        assert r["width"] == 8 and np.allclose(np.array(r["pssm"]).sum(1), 1)
        best = "".join("ACGT"[int(np.argmax(x))] for x in r["pssm"])
        assert {best, revcomp(best)} & {"TTGACATC", "GGCCATAG", "CATCGGTA", "TTTAGCGC"}
        assert len({s["id"] for s in r["sites"]}) == len(r["sites"]) >= 14 and r["evalue"] < 1e-3
        for s in r["sites"]:
            own = text[r["cluster"], s["id"]][s["start"] - 1 :][:8]
            assert s["seq"] == (revcomp(own) if s["reverse"] else own)
    hits = D.scan(spark.createDataFrame(got, X.word_motifs(seqs, base, background=X.word_background(seqs)).schema), seqs.select("id", "seq").filter("cluster = 1"), base)
    assert hits.filter("cluster = 1 AND motif_num = 1 AND hit_pvalue < 0.001").count() >= 12


def test_query_equals_a_look_at_every_word(spark):
    """The first motif's word of some runs has the best score of all words of eight letters."""
    import os

    from tessera import catalog
    from tessera.catalog.base import Views

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    rows = catalog.QUERIES["mismatch_motifs"](spark, sf).collect()
    seqs = {}
    for r in Views(spark, sf).seqs.collect():
        seqs.setdefault(r["id"] // 25, []).append((r["id"], r["seq"]))
    shares = X.word_background(Views(spark, sf).seqs)
    near = X.near_shares(X.extended(shares, 8), 8, 2)
    every = np.array(list(product(range(4), repeat=8)), np.int8)
    for c in sorted(seqs)[:2]:
        n, score = np.zeros(len(every)), np.zeros(len(every))
        for _, s in seqs[c]:
            own = np.array([["ACGT".index(x) for x in w] for w, _, _ in places(s, 8)], np.int8)
            least = np.full(len(every), 9)
            for w in own:
                least = np.minimum(least, (every != w).sum(1))
            hit = least <= 2
            n += hit
            score[hit] -= np.log(1 - (1 - near[least[hit], np.flatnonzero(hit)]) ** len(own))
        score[n * 2 < len(seqs[c])] = -1
        word = "".join("ACGT"[x] for x in every[np.argmax(score)])
        word = min(word, revcomp(word))
        sites = []
        for _, s in sorted(seqs[c]):
            nearest = min(places(s, 8), key=lambda p: (far(p[0], word), p[2], p[1]))[0]  # noqa: B023
            if far(nearest, word) <= 2:
                sites.append(nearest)
        own = sorted((r for r in rows if r["cluster"] == c and r["motif_num"] == 1), key=lambda r: r["pos"])
        assert {r["sites"] for r in own} == {len(sites)} and len(own) == 8
        for i, r in enumerate(own):
            shares_here = [sum(x[i] == b for x in sites) / len(sites) for b in "ACGT"]
            assert np.allclose([r[x] for x in "acgt"], shares_here, atol=0.5 / len(sites))


def test_a_run_searches_by_words(spark, tmp_path):
    """Where the pipeline names a class of that kind; its motifs' genes get the better p-values."""
    import json

    from tessera.plans.config import Config
    from tessera.plans.run import Run, search_words

    rng = random.Random(8)
    seqs = [(i, f"g{i}", (s := random_seq(rng, 60))[:20] + ("TTGACGTC" if i < 9 else "GGGATTTC") + s[28:]) for i in range(18)]
    m = spark.createDataFrame([(i, j, float((i < 9) == (j < 3)) + rng.random() / 10) for i in range(18) for j in range(6)], "gene long, cond long, value double")
    top = {"class": "x.ScoringFunctionCombiner", "args": {"functions": [{"id": "Rows", "class": "x.Rows"}, {"id": "Motifs", "class": "x.WeederScoringFunction"}]}}
    pipeline = json.dumps({"row-scoring": {"id": "combiner", "function": top, **top}, "column-scoring": {"id": "Columns"}})
    own = dict(num_iterations=1, postadjust=False, clusters=2, per_row=1, per_col=2, schedules={x: "1,1" for x in ("Rows", "Columns", "Motifs", "MEME")}, nmotifs="1", mask_sequences=False)
    run = Run.of_pipeline(pipeline, spark, m, str(tmp_path / "run"), Config(**own), sequences=spark.createDataFrame(seqs, "gene long, id string, seq string"))
    assert run.find_motifs is search_words
    rows = spark.createDataFrame([(i, 0, 1 if i < 9 else 2) for i in range(18)], "gene long, slot long, cluster long")
    run.start(rows, spark.createDataFrame([(j, 0, j % 2 + 1) for j in range(6)], "cond long, slot long, cluster long"))
    run.run()
    infos = spark.read.parquet(f"{tmp_path}/run/motif_infos").collect()
    assert {r["cluster"] for r in infos} == {1, 2}
    p = {(r["gene"], r["cluster"]): r["pvalue"] for r in run.pvalues.collect()}
    assert all((p[g, 1] < p[g, 2]) == (g < 9) for g in range(18))
