"""Mixing, exact dedup, near duplicates and sentence spans against brute force."""

import collections
import hashlib
import random
import re
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, golomb, metric_join, mixing, sentence_spans


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 1, 1 << 63, (1 << 64) - 1], sorted(np.random.default_rng(0).integers(0, 1 << 62, 70_000).tolist())])
def test_golomb_round_trip(values):
    v = np.array(values, np.uint64)
    coded = golomb.encode(v)
    assert (golomb.decode(coded) == v).all()
    if len(v) > 1000:
        assert len(coded) < 8 * len(v)


def water(sizes, weights, repeat):
    """Targets by giving and taking until none is above its cap."""
    total, targets, fixed = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(repeat * sizes[s] for s in fixed)
        share = sum(weights[s] for s in free)
        targets = {s: repeat * sizes[s] if s in fixed else left * weights[s] / share for s in sizes}
        over = [s for s in free if targets[s] > repeat * sizes[s]]
        if not over:
            return targets
        fixed |= set(over)


def test_mixing(docs, rows):
    got = mixing.pareto_mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.pareto_mix(docs.repartition(3)).collect()
    key = lambda rs: sorted(str((r["doc_id"], r["size"], r["taken"])) for r in rs)
    assert key(got) == key(again)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    targets = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    source = {(d, size(t)): s for d, t, _, s in rows}
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 or taken[s] == 3 * sizes[s]


def test_mixing_with_importance_and_nothing(spark, none):
    assert mixing.pareto_mix(none).count() == 0
    d = spark.createDataFrame([(i, "w " * 10, "a" if i < 900 else "b", float(i % 2)) for i in range(1000)], "doc_id long, text string, source string, imp double")
    got = mixing.pareto_mix(d, importance_col="imp", weights=(1, 1)).groupBy((F.col("doc_id") % 2).alias("odd"), "source_size").agg(F.sum("taken").alias("t")).collect()
    by = {(r["odd"], r["source_size"]): r["t"] for r in got}
    assert by[0, 9000] == 0 and by[1, 9000] > 4000  # no importance, no copy
    assert mixing.pareto_mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).first()["target"] == 0


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("owners", [1, 40])
def test_exact_dedup(docs, rows, owners):
    got = exact_dedup.exact_dedup(docs, owners=owners).collect() if owners > 1 else exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for d, t, _, _ in rows:
        groups[hashlib.sha256(normal(t).encode()).hexdigest()].append(d)
    kept = collections.Counter()
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_normalise_is_the_pattern():
    for t in ["", " ", "a", " a", "a\n\n b\x0b", "\x1c a", "x y  "]:
        assert exact_dedup.normalise(t.encode()).decode() == normal(t)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t, _, _ in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        k = find(i)
        least[k] = min((x for x in (least.get(k), d) if x is not None), default=None)
    return sorted(str((d, len(s), least[find(i)] if s else d)) for i, (d, s) in enumerate(sets))


def test_near_duplicates(docs, rows):
    got = metric_join.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_groups(rows)


@pytest.mark.parametrize("block", [2, 5])
def test_near_duplicates_recurses(docs, rows, monkeypatch, block):
    """Regions of a few sets are larger than a block, so rounds deal them to Voronoi regions."""
    rounds = []
    dealt_on = metric_join._dealt_on
    monkeypatch.setattr(metric_join, "_dealt_on", lambda *a: rounds.append(1) or dealt_on(*a))
    monkeypatch.setattr(metric_join, "BLOCK_SETS", block)
    monkeypatch.setattr(metric_join, "PIVOTS", 2)
    monkeypatch.setattr(metric_join, "CLOSING", 3)
    got = metric_join.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_groups(rows)
    assert len(rounds) >= (2 if block == 2 else 1)


def test_sketches_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        (x, least), (y, other) = metric_join.sketch(a), metric_join.sketch(b)
        assert len(np.intersect1d(x, y)) >= max(least, other) or len(np.intersect1d(x, y)) >= least


def test_a_chunk_goes_to_its_owners_in_one_batch():
    """A batch an owner would be as many batches as chunks times owners, which grows as the square of the input."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)) for _ in range(30)]
    sets += [np.unique(np.append(x[:390], x[390] + np.uint64(1 << 40))) for x in sets[:10]]
    keys = [metric_join.key_of(x) for x in sets]
    b = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "hashes": pa.array([x.tobytes() for x in sets], pa.binary())})
    got = list(metric_join._send(50, metric_join._whole)(iter([b])))
    assert [x.num_rows for x in got] == [50, 1]
    sent = [list(metric_join._own(7)(pa.Table.from_batches([pa.Table.from_batches(got).filter(pc.field("owner") == o).combine_chunks().to_batches()[0]])).to_batches()) for o in range(50)]
    assert all(len(x) <= 1 for x in sent)
    shared = collections.Counter()
    for r in (r for x in sent for y in x for r in y.to_pylist()):
        tags = metric_join._joined(r["low"], r["high"])
        assert (tags % np.uint64(7) == r["range"]).all()
        shared.update(dict(zip(tags.tolist(), np.frombuffer(r["counts"], "<u4").tolist(), strict=True)))
    every = collections.Counter(np.concatenate(sets).tolist())
    assert shared == {metric_join.tag_of(k): n for k, x in zip(keys, sets, strict=True) if (n := sum(every[h] > 1 for h in x.tolist()))}


def test_only_texts_that_may_link_are_taken_apart(monkeypatch):
    texts, seen = [f"one two three four five {i}" for i in range(40)], []
    digests = np.random.default_rng(6).integers(0, 1 << 62, (40, 2))
    bits = np.zeros(1 << 10, np.uint8)
    at = digests[7:9].view("<u4") & np.uint32(8 * len(bits) - 1)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    b = pa.RecordBatch.from_pydict({"text": pa.array([t.encode() for t in texts], pa.binary()), "a": pa.array(digests[:, 0]), "b": pa.array(digests[:, 1])})
    take_apart = metric_join.shingle_sets
    monkeypatch.setattr(metric_join, "shingle_sets", lambda x: seen.extend(x.to_pylist()) or take_apart(x))
    got = list(metric_join._survivors(types.SimpleNamespace(value=bits))(iter([b])))
    assert seen == [b"one two three four five 7", b"one two three four five 8"]
    assert [x["n"].to_pylist() for x in got] == [[2, 2]]


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 63, 64, 65, 300])
def test_word_hashes(size):
    """No two words share one, a word's doesn't depend on those beside it, and NULs at its end count."""
    rng = random.Random(size)
    words = sorted({bytes(rng.randrange(256) for _ in range(n)) for n in (size, size, size + 1, 3) for _ in range(200)} | {b"\0" * n for n in range(1, 80)})
    got = metric_join.word_hashes(pa.array(words, pa.large_binary()))
    assert len(set(got.tolist())) == len(words)
    assert [metric_join.word_hashes(pa.array([w], pa.large_binary()))[0] for w in words[:50]] == got[:50].tolist()
    assert metric_join.word_hashes(pa.array(words, pa.large_binary())[5:9]).tolist() == got[5:9].tolist()


def test_copies_in_several_parts_share_nothing(spark):
    """A sketch is asked for once a set, so texts without a like pass no filter however often they are repeated."""
    rng = random.Random(8)
    d = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))) for i in range(20)], "doc_id long, text string")
    d = d.crossJoin(spark.range(6)).selectExpr("doc_id + 100 * id AS doc_id", "text").repartition(8)
    kept = []
    keep = metric_join._kept
    with pytest.MonkeyPatch.context() as m:
        m.setattr(metric_join, "_kept", lambda *a: kept.append(keep(*a)) or kept[-1])
        m.setattr(metric_join.scratch, "drop", lambda *a: None)
        got = metric_join.near_duplicates(d).collect()
        assert [x.count() for x in kept] == [0, 0]
    assert len(got) == 120 and all(r["component_id"] == r["doc_id"] % 100 for r in got)


def drawn_sets(rng, n, bases, lose, words=50):
    """Sets near some bases, nearer and farther, and at the bases' edges."""
    every = [np.unique(rng.integers(0, 1 << 62, words).astype(np.uint64)) for _ in range(bases)]
    out = []
    for _ in range(n):
        base = every[int(rng.integers(bases))]
        keep = base[rng.random(len(base)) > rng.random() * lose]
        out.append(np.unique(np.concatenate([keep[:1], keep, rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64), every[0][: int(rng.integers(0, 9))]])))
    return out


def least_linked(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j], assume_unique=True))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n, bases, lose, first", [(1, 1, 0.3, 0), (12, 2, 0.4, None), (200, 1, 0.3, 0), (300, 20, 0.5, 7), (250, 250, 0.1, None), (300, 3, 0.9, 299)])
def test_join_region(n, bases, lose, first):
    sets = drawn_sets(np.random.default_rng(n + bases), n, bases, lose)
    want = least_linked(sets)
    got, looked = metric_join.join_region(np.arange(n), sets, first)
    assert got.tolist() == want
    assert looked == (n > 1) or n > metric_join.LEAF and looked > 1


def test_voronoi_regions_lose_no_linked_pair():
    """Of random points of the space any two within the threshold meet in a pivot's region and window, or are far both."""
    rng = np.random.default_rng(4)
    sets = drawn_sets(rng, 150, 12, 0.6)
    s = metric_join.Sets(np.arange(150), sets)
    pivots = [0, 11, 45, 99]
    away, _ = s.measured([s.own(i) for i in pivots], s.size[pivots], np.arange(150))
    for k, p in enumerate(pivots):
        assert away[k].tolist() == [1 - len(np.intersect1d(sets[p], x)) / len(np.union1d(sets[p], x)) for x in sets]
    inside, far = metric_join.voronoi(away)
    assert 0 < inside.sum() < 4 * 150 and far.any()
    for i in range(150):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
                assert (inside[:, i] & inside[:, j]).any() or far[i] and far[j]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows):
    order = lambda d: (1 << 63) - 1 if d is None else d
    seen, docs = {}, {}
    for d, t, _, _ in rows:
        docs.setdefault((order(d), sentence_spans._key((t or "").encode())), (d, sentence_spans.sentences((t or "").encode())))
    for (o, k), (_, parts) in docs.items():
        for i, j in sentence_spans.spans(parts):
            text = tuple(b" ".join(p.split()) for p in parts[i:j])
            seen.setdefault(text, []).append((o, k, i))
    gone = collections.defaultdict(set)
    for text, places in seen.items():
        for o, k, i in sorted(places)[1:]:
            gone[o, k] |= set(range(i, i + len(text)))
    out = []
    for d, t, _, _ in rows:
        key = (order(d), sentence_spans._key((t or "").encode()))
        parts = sentence_spans.sentences((t or "").encode())
        out.append(str((d, len(parts), sorted(gone[key]), b"".join(p for i, p in enumerate(parts) if i not in gone[key]).decode())))
    return sorted(out)


def test_sentence_spans(docs, rows):
    got = sentence_spans.dedup(docs).collect()
    assert sorted(str((r["doc_id"], r["n_sentences"], sorted(r["removed"]), r["text"])) for r in got) == brute_spans(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[151]["n_removed"] > 0 and sum(by[i]["n_removed"] > 3 for i in range(190, 200)) == 10


def every_run(texts):
    """Sentences that any run of 2 sentences and 16 words that occurred before covers; a list of sentences each text."""
    seen, gone = set(), [set() for _ in texts]
    for d, parts in enumerate(texts):
        for i in range(len(parts)):
            for j in range(i + 2, len(parts) + 1):
                run = tuple(parts[i:j])
                if sum(len(p.split()) for p in run) >= 16:
                    if run in seen:
                        gone[d] |= set(range(i, j))
                    seen.add(run)
    return gone


def test_sentence_spans_cover_every_repeated_run(spark):
    rng = random.Random(5)
    say = lambda n: " ".join([f"w{rng.randrange(10**9)}" for _ in range(n - 1)] + ["end."])
    passage = [say(20), say(6), say(6)]
    few = [say(n) for n in (1, 1, 2, 3, 5, 6, 9, 14, 20)]
    texts = [[say(9), *passage, say(9)], [say(5), *passage, say(12)]] + [[rng.choice(few) for _ in range(rng.randint(0, 14))] for _ in range(80)]
    want = every_run(texts)
    assert want[1] == {1, 2, 3}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: set(r["removed"]) for r in sentence_spans.dedup(d).collect()} == dict(enumerate(want))


def test_sentences_join_to_the_text():
    for t in ["", "A b. C d! E", "One.\nTwo\n\nThree?  ", ' "Hm." she said.', "no end"]:
        assert b"".join(sentence_spans.sentences(t.encode())) == t.encode()


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, metric_join.near_duplicates, sentence_spans.dedup])
def test_no_rows(none, f):
    assert f(none).count() == 0
