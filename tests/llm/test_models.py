"""Token files, pieces, languages, language models, pages, search and the pipeline."""

import collections
import itertools
import math
import random
import re
import time
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import arrow, log_bilinear, max_score, page_text, pieces, ppm_language, repair, scratch, token_files

from .conftest import prose

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n, kinds", [(0, 3), (1, 3), (5000, 3), (20_000, 1), (20_000, 40), (30_000, 40_000)])
def test_repair_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    ids[n // 2 :] = np.resize(ids[:17], n - n // 2) if n else ids
    g, starts = repair.load(repair.dump(repair.build(ids, 50_000), np.array([0, n // 3, n])))
    assert (g.expand(g.symbols) == ids).all() and starts.tolist() == [0, n // 3, n]
    for lo, hi in ((0, n // 3), (n // 3, n), (n // 2, n // 2)):
        assert (g.slice(lo, hi) == ids[lo:hi]).all()
    if kinds == 40:
        assert len(g.symbols) < n


@pytest.mark.parametrize("n, kinds, least, limit", [(3000, 3, 2, 1 << 16), (20_000, 30, 5, 1 << 16), (20_000, 1, 2, 1 << 16), (50_000, 400, 24, 1 << 16), (20_000, 30, 5, 130)])
def test_repair_leaves_no_frequent_pair(n, kinds, least, limit):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.geometric(0.2, n), kinds).astype(np.uint32)
    ids[n // 2 :] = np.resize(ids[:31], n - n // 2)
    g = repair.build(ids, 100 if kinds < 100 else 500, limit, least)
    assert (g.expand(g.symbols) == ids).all()
    s, seen, i = g.symbols.tolist(), collections.Counter(), 0
    while i < len(s) - 1:  # pairs as they could be replaced: those of a run don't overlap
        seen[s[i], s[i + 1]] += 1
        i += 2 if s[i] == s[i + 1] and i + 2 < len(s) and s[i + 2] == s[i] else 1
    if limit == 130:
        assert len(g.left) == 30
    else:
        assert max(seen.values()) < least
    assert min(collections.Counter(s).values()) >= 1 and len(set(zip(g.left.tolist(), g.right.tolist(), strict=True))) == len(g.left)


def test_token_files(spark, docs, rows):
    got = {}
    path = scratch.place(spark, "test")
    token_files.write(docs, path, BPE)
    t, at = Tokenizer.from_file(BPE), 0
    want = []
    for d, text, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.read_digests(spark, path).orderBy("start").collect()]
    assert got == want
    first = spark.read.parquet(path).orderBy("part", "shard").first()
    d = first["doc_ids"].index(5) if 5 in first["doc_ids"] else 0
    text = {r[0]: r[1] for r in rows}[first["doc_ids"][d]] or ""
    assert token_files.read_ids(spark, path, first["part"], first["shard"], d).tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_is_the_tokenizer():
    rng = random.Random(3)
    texts = ["", " ", "it's DON'T ", "<|endoftext|>x", "x́ ÉÀ. A.B, 12!", "İI ΣΑΣ"] + ["".join(rng.choice("abC .,'!é\n\t1²́") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for whole in (False, True):
        e = token_files.Encoder(BPE, whole)
        ids, n = e.encode([t.encode() for t in texts], 2)
        b = np.concatenate([[0], np.cumsum(n)])
        assert all(ids[b[i] : b[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts))


def test_pieces_are_sentencepiece(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_decode(docs, PIECES).collect()
    want = collections.Counter((d, tuple(sp.encode(t or ""))) for d, t, _, _ in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] for r in got)


def test_pieces_of_hard_texts():
    sp, e = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Encoder(PIECES)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a\n\nb", "\n x", "▁▁ a", "\x00", "é😀\t", "<s> <0x0A>"] + ["".join(rng.choice("abcdethinro ▁ \n,.éüß0 1") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    ids, n = e.encode(texts)
    b = np.concatenate([[0], np.cumsum(n)])
    assert [ids[b[i] : b[i + 1]].tolist() for i in range(len(texts))] == sp.encode(texts)
    back = e.pieces.decode(ids, n)
    assert all(x == t.encode() for x, t in zip(back, texts, strict=True) if "▁" not in t)


def slow_bits(model, samples, lang, text, order):
    """Code length by the recursion itself."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    fold = lambda t: bytes(model.classes[np.frombuffer(t, np.uint8)].astype(np.uint8))
    for t in map(fold, samples[lang]):
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                counts[k][t[i - k : i]][t[i]] += 1
    t, total = fold(text), 0.0
    for i in range(len(t)):
        for k in range(min(i, order), -1, -1):
            c = counts[k].get(t[i - k : i])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c and t[i]:
                total -= math.log2(c[t[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_ppm_code_lengths():
    samples = {"x": [b"the cat sat on the mat", b"then a cat"], "y": [b"el gato come pan", b"pan y gato"]}
    m = ppm_language.Model(samples)
    texts = [b"the gato", b"", b"ZZ top the", b"pan", "é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = m.bits(data, offsets)
    for i, t in enumerate(texts):
        for j, lang in enumerate(m.langs):
            assert got[i, j] == pytest.approx(slow_bits(m, samples, lang, t, m.order), rel=1e-5)


def test_languages(spark, none):
    rng = random.Random(4)
    words = {"aa": ["bom", "dim", "kolo", "zuri"], "bb": ["xel", "pru", "quay", "wex"]}
    rows = [(i, prose(rng, 12, words[k]), k) for i, k in enumerate(rng.choice(["aa", "bb"]) for _ in range(120))]
    rows += [(500, None, "aa"), (501, "12 ?", "bb"), (502, "", None), (None, "bom dim", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in ppm_language.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, k in rows[:120])
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (500, 501, 502))
    assert got[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got.values())
    assert ppm_language.identify(none).count() == 0
    assert {r["lang_pred"] for r in ppm_language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_log_bilinear(spark, docs, rows, none):
    got = log_bilinear.score(docs).collect()
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    count = collections.Counter()
    for d, t, _, _ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(tok(t))
    n, v = sum(count.values()), len(count)
    want = sorted(str((d, len(tok(t)), sum(count[w] > 0 for w in tok(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tok(t)), 6))) for d, t, _, _ in rows)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert log_bilinear.score(none).count() == 0
    alone = log_bilinear.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0)


def test_log_bilinear_learns_and_is_normalised():
    rng = np.random.default_rng(0)
    k = 12
    chain = np.array([rng.permutation(k) for _ in range(1)])[0]
    w = [0]
    for _ in range(60_000):
        w.append(int(chain[w[-1]]) if rng.random() < 0.8 else int(rng.integers(k)))
    w = np.array(w)
    triples = np.stack([w[:-2], w[1:-1], w[2:]], axis=1).astype("<u2")
    share = np.bincount(w, minlength=k) / len(w)
    m = log_bilinear.Model.start(share)
    for i in range(3):
        m.train(triples, share, i)
    m.normalise()
    v, u = np.meshgrid(range(k), range(k))
    total = sum(np.exp(m.log_probability(v.ravel(), u.ravel(), np.full(k * k, x))) for x in range(k))
    assert total == pytest.approx(np.ones(k * k), abs=1e-4)
    assert m.log_probability(*triples.T.astype(np.int64)).mean() > np.log(share[w[2:]]).mean() + 0.3


def test_log_bilinear_trains_on_every_position(rows):
    texts = [(t or "").encode() for _, t, _, _ in rows]
    tok = [re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    counts = dict(collections.Counter(w for t in tok for w in t).most_common())
    lexicon = log_bilinear.Lexicon(pa.array(counts, pa.large_binary()), np.array(list(counts.values())))
    lexicon.inner = 20  # the others go by their classes
    symbol = {w: 1 + log_bilinear.CLASSES + i if i < 20 else 1 + int(log_bilinear.endings(pa.array([w], pa.large_binary()))[0]) for i, w in enumerate(counts)}
    part = lambda i: [range(i, i + len(texts[i : i + 50]))] * 2 + [[True] * len(texts[i : i + 50])]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in part(i)] + [pa.array(texts[i : i + 50], pa.binary())], ["doc_id", "key", "learn", "text"]) for i in range(0, len(texts), 50)]
    got = collections.Counter()
    for b in log_bilinear._symbols(types.SimpleNamespace(value=lexicon))(log_bilinear._split(batches)):
        for x in b.column(1).to_pylist():
            got.update(map(tuple, log_bilinear._triples(np.frombuffer(x, "<u2")).tolist()))
    want = collections.Counter()
    for t in tok:
        s = [0, 0, *(symbol[w] for w in t), 0]
        want.update(zip(s, s[1:], s[2:], strict=False))
    assert got == want


def test_log_bilinear_scores_do_not_depend_on_the_dealing(docs, monkeypatch):
    monkeypatch.setattr(log_bilinear, "SHARD", 500)
    key = lambda d: sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 4)) for r in log_bilinear.score(d).collect())
    assert key(docs) == key(docs.repartition(2))


def test_log_bilinear_vocabulary_grows():
    def inner(k, n):
        return log_bilinear.Lexicon(pa.array([b"%d" % i for i in range(k)], pa.large_binary()), np.full(k, n)).inner

    assert [inner(k, n) for k, n in ((0, 1), (500, 1), (3000, 1), (3000, 100), (9000, 100))] == [0, 500, 1024, 1535, 1535]


def test_log_bilinear_classes():
    words = pa.array([b"", b"a", b"xa", b"walking", b"talking", b"king", "bé".encode()], pa.large_binary())
    got = log_bilinear.endings(words).tolist()
    assert got[3] == got[4] == got[5] and len(set(got)) >= 4 and 0 <= min(got) and max(got) < log_bilinear.CLASSES
    assert log_bilinear.endings(words.slice(2, 3)).tolist() == got[2:5] and len(log_bilinear.endings(words[:0])) == 0


def test_log_bilinear_steps_are_adagrad_on_the_contrastive_loss():
    """Against sums over all pairs in double precision, also for scores far beyond what e to them holds."""
    k, n = 40, 1500
    share = np.arange(1.0, k + 1) / np.arange(1.0, k + 1).sum()
    triples = np.random.default_rng(4).integers(0, k, (n, 3)).astype("<u2")
    for scale in (1, 300):
        model = log_bilinear.Model.start(share)
        model.target *= np.float32(scale)
        c, t, near, far, bias = (x.astype(float) for x in model.parts())
        sums = [np.full(x.shape, 1e-6) for x in (c, t, near, far, bias)]
        model.train(triples, share, [1, 2])
        rng = np.random.default_rng([1, 2])
        rows, log_noise = triples[rng.permutation(n)].astype(int), np.log(log_bilinear.NOISE * share)
        for i in range(0, n, log_bilinear.STEP):
            v, u, w = rows[i : i + log_bilinear.STEP].T
            noise = np.minimum(np.searchsorted(np.cumsum(share), rng.random(log_bilinear.NOISE) * np.cumsum(share)[-1]), k - 1)
            q = c[u] @ near + c[v] @ far
            a = 1 / (1 + np.exp(np.clip((q * t[w]).sum(1) + bias[w] - log_noise[w], -500, 500)))
            b = -1 / (1 + np.exp(np.clip(-(q @ t[noise].T + bias[noise] - log_noise[noise]), -500, 500)))
            dq = a[:, None] * t[w] + b @ t[noise]
            g = [np.zeros_like(x) for x in (c, t, near, far, bias)]
            np.add.at(g[0], u, dq @ near.T), np.add.at(g[0], v, dq @ far.T)
            np.add.at(g[1], w, a[:, None] * q), np.add.at(g[1], noise, b.T @ q)
            g[2], g[3] = c[u].T @ dq, c[v].T @ dq
            np.add.at(g[4], w, a), np.add.at(g[4], noise, b.sum(0))
            for x, s, d in zip((c, t, near, far, bias), sums, g, strict=True):
                d /= len(w)
                s += d * d
                x += log_bilinear.RATE * d / np.sqrt(s)
        for x, y in zip(model.parts(), (c, t, near, far, bias), strict=True):
            assert np.isfinite(x).all() and np.abs(x - y).max() < 0.01


def test_log_bilinear_packing_costs_little_more_than_splitting():
    """In CPU time, over words that are all distinct: they never become Python objects, which took nine times as long as splitting."""
    rng = random.Random(8)
    texts = pa.array([" ".join(f"{rng.randrange(1 << 30):x}" for _ in range(300)).encode() for _ in range(300)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), pa.array([True] * 300), texts], ["doc_id", "key", "learn", "text"])

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: list(log_bilinear._split(iter([batch])))) < 3 * least(lambda: arrow.split_words(texts))


def test_log_bilinear_packed_words_counts_and_places():
    words = pa.array([b"ab", b"", b"cde", "\u00e9".encode(), b"x" * 70_000], pa.large_binary())
    for i, n in itertools.product(range(6), range(6)):
        assert log_bilinear.joined(words.slice(i, n)) == b"".join(words.slice(i, n).to_pylist())
    rng = random.Random(9)
    texts = [[b"w%d" % rng.randrange(rng.choice([50, 90_000])) for _ in range(900)] for _ in range(120)]  # more distinct words than a batch of counts has
    parts = [texts[i : i + 40] for i in range(0, 120, 40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([i % 2 > 0 for i in range(40)]), pa.array([b" ".join(t) for t in p], pa.binary())], ["doc_id", "key", "learn", "text"]) for p in parts]
    packed = list(log_bilinear._split(iter(batches)))
    got, want = collections.Counter(), collections.Counter(w for p in parts for t in p[1::2] for w in t)
    want[b""] = 60
    for b in log_bilinear._count(iter(packed)):
        assert b.column(1).to_pylist() == log_bilinear.endings(b.column(0).cast(pa.large_binary())).tolist()
        got.update(dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)))
    assert got == want and len(want) > 16_384
    del want[b""]
    top = want.most_common()
    lexicon = log_bilinear.Lexicon(pa.array([w for w, _ in top], pa.large_binary()), np.array([n for _, n in top]))
    for _, _, _, distinct, _, _ in log_bilinear._rows(iter(packed)):
        place = {w: i for i, (w, _) in enumerate(top)}
        places = lexicon.places(distinct)
        assert places.tolist() == [place.get(w, -1) for w in distinct.to_pylist()]
        assert lexicon.symbols(distinct).tolist() == lexicon.symbols(distinct, places).tolist()
    assert lexicon.places(words[:0]).tolist() == [] and lexicon.symbols(words[:2]).tolist() == lexicon.symbols(words[:2], np.full(2, -1)).tolist()


def test_log_bilinear_trains_on_a_single_position():
    share = np.full(3000, 1 / 3000)
    model, new = log_bilinear.Model.start(share), log_bilinear.Model.start(share)
    new.train(np.array([[5, 7, 9]], "<u2"), share, [3])
    moved = [set(np.flatnonzero((x != y).reshape(len(x), -1).any(axis=1)).tolist()) for x, y in zip(model.parts(), new.parts(), strict=True)]
    noise = set(np.searchsorted(np.cumsum(share), (r := np.random.default_rng([3]), r.permutation(1), r.random(log_bilinear.NOISE))[2] * np.cumsum(share)[-1]).tolist())
    assert moved[0] == {5, 7} and moved[1] == moved[4] == noise | {9} and all(np.isfinite(x).all() for x in new.parts())
    before = new.flat()
    new.train(np.empty((0, 3), "<u2"), share, [3])
    assert (new.flat() == before).all()


def test_log_bilinear_words_of_a_class_and_what_is_unseen_sum_to_one(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.01)), 1499)] for _ in range(60))) for i in range(200)]
    d = spark.createDataFrame([*rows, *[(10_000 + i, w) for i, w in enumerate([*words, "w1500"])]], "doc_id long, text string")
    d = d.withColumn("doc_id", F.when(F.col("doc_id") >= 10_000, F.lit(None)).otherwise(F.col("doc_id")))  # scored, never learned from
    d = d.unionByName(spark.createDataFrame([(None, "")], "doc_id long, text string"))
    got = log_bilinear.score(d.filter("doc_id IS NULL").unionByName(d.filter("doc_id IS NOT NULL"))).filter("doc_id IS NULL").collect()
    seen = {w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()}
    one = [r for r in got if r["n_tokens"] == 2]
    assert len(one) == 1501 and sum(r["n_known"] == 2 for r in one) == len(seen)
    assert all(r["score"] < 0 for r in got)


def brute_top(rows, k, mod):
    v = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, q) in enumerate(v):
        if i % mod == 0:
            s = sorted((-sum(x * y for x, y in zip(q, c, strict=False)), j) for b, (j, c) in enumerate(v) if a != b)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("sparse", [False, True])
def test_max_score(spark, sparse, monkeypatch):
    monkeypatch.setattr(max_score, "SHARD_ROWS", 90)
    monkeypatch.setattr(max_score, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(max_score, "MERGE", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (400, 10)) * ((rng.random((400, 10)) < 0.2) if sparse else 1)
    x[100:140] = x[100]
    rows = [(i, [float(np.float32(a)) for a in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (1060, [float("inf")]), (1080, []), (1100, [0.5] * 14), (None, [1.0]), (20, rows[20][1]), (20, [0.25] * 10), (33, rows[33][1]), (1120, [1e9] * 3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = sorted(tuple(r) for r in max_score.top_k(d, k=5).collect())
    assert got == brute_top(rows, 5, 20)
    assert max_score.top_k(d.filter("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<!-- no --><header>Site</header><div class="ad">Buy</div><main><article><h1>Big &amp; <i>bo</i>ld</h1><p>One&nbsp; two<br>three<p>Four<aside>no</aside><form>no</form>
<div id="comments"><article>no</article></div><p hidden>no</p><p>a &lt; b &#233;</p></article></main><div class="cookie-notice">no</div><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    d = spark.createDataFrame([(1, "http://h/a", PAGE), (2, "http://h/b", None), (2, None, ""), (None, "x", "<article>cut off <b>he"), (4, "http://h/c", "<p>free text, all alone")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in page_text.extract(d).collect()))
    assert got == [(0, "cut off he", 10), (1, "Big & bold One two three Four a < b é", 37), (2, "", 0), (2, "", 0), (4, "free text, all alone", 20)]
    assert page_text.extract(d.filter("false")).count() == 0


def test_names_around_an_article_do_not_drop_it():
    def text(page):
        b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["http://h/"]), pa.array([page.encode()])], ["page_id", "url", "html"])
        return next(page_text._parse([b])).column("text")[0].as_py()

    body = "<article><div class='entry-header'><h1>Title</h1></div><p>Body</p><div class='comment-list'>no</div><div class='sidebar'>no</div></article>"
    for around in ('class="has-sidebar"', 'id="page" class="no-sidebar"', 'class="search-results"', 'class="social"', 'class="no-comments"'):
        assert text(f"<div {around}>{body}</div><div class='ad'>no</div>") == "Title Body"
    assert text("<main><article class='post social'>Body</article></main>") == "Body"
    assert text(f"<div class='related'><article>no</article></div>{body}") == "Title Body"


def test_suffix_array_of_a_host(spark):
    rng = random.Random(6)
    menu = prose(rng, 14)
    rows = [(i, f"https://h{i % 3}.org/{i}", f"<div>{menu}</div><p>page {i} " + " ".join(f"w{i}x{j}" for j in range(30)) + f"</p><div>{menu[::-1]}</div>") for i in range(30)]
    rows.append((99, "https://lone.org/", f"<div>{menu}</div>"))
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    near = sorted(tuple(r) for r in page_text.extract(d).collect())
    assert near == sorted(tuple(r) for r in page_text.extract(d, host_tokens=0).collect())
    text = {r[0]: r[2] for r in near}
    assert text[99] == menu and all(text[i].split()[-1] == f"w{i}x29" and menu not in text[i] for i in range(30))


def test_suffix_array_tells_teasers_from_a_page_s_own_articles(spark):
    """Without the array all articles of a page would stay; a page's only article and copies of pages stay whole."""
    rng = random.Random(16)
    tease, quote = prose(rng, 12), prose(rng, 20)
    own = [" ".join(f"o{i}x{j}" for j in range(20)) for i in range(6)]
    article = lambda *x: "".join(f"<article><p>{t}</p></article>" for t in x)
    rows = [(i, "http://h/", f"<main><h2>Latest</h2>{article(own[i], tease)}</main>") for i in range(3)]
    rows += [(3, "http://h/", article(f"{own[3]} {quote}")), (4, "http://h/", article(f"{own[4]} {quote}", own[5])), (5, "http://other/", article(own[0], tease))]
    rows += [(i, "http://h/", article(quote, quote[::-1])) for i in (6, 7)]
    want = {i: f"Latest {own[i]}" for i in range(3)} | {3: f"{own[3]} {quote}", 4: f"{own[4]} {quote} {own[5]}", 5: f"{own[0]} {tease}", 6: f"{quote} {quote[::-1]}", 7: f"{quote} {quote[::-1]}"}
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (page_text.HOST_TOKENS, 60):
        assert {r["page_id"]: r["text"] for r in page_text.extract(d, host_tokens=most).collect()} == want


def test_short_streams():
    for n in range(12):
        assert [x.tolist() for x in page_text.covered([["a"] * n])] == [[False] * n]


def test_arrays_of_parts_find_what_one_array_finds(spark):
    rng = random.Random(17)
    rows = [(i, "http://h/", f"<p>{' '.join(rng.choice('abc') for _ in range(rng.randint(0, 120)))}</p>") for i in range(40)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    on = page_text.covered([h[3:-4].split() for _, _, h in rows])
    want = {i: " ".join(w for w, c in zip(h[3:-4].split(), o, strict=True) if not c) for (i, _, h), o in zip(rows, on, strict=True)}
    assert len(set(want.values())) > 20
    for most in (10**6, 500, 0):
        assert {r["page_id"]: r["text"] for r in page_text.extract(d, host_tokens=most).collect()} == want


def test_covered_is_every_shared_run():
    rng = random.Random(8)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(6)]
    got = page_text.covered(streams, run=4)
    for p, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for i in range(len(s) - 3):
            if any(s[i : i + 4] == o[j : j + 4] for q, o in enumerate(streams) if q != p for j in range(len(o) - 3)):
                want[i : i + 4] = True
        assert (got[p] == want).all()


def test_pipeline(spark, docs, rows):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[-1][0]] == [5, "pieces"]
    from .test_rows import normal, shingles

    d = docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        d = scratch.keep(stage(spark, d, ""), name)
        out[name] = d
    for name in ("language", "exact-dedup", "near-dedup", "mixing"):
        assert out[name].columns == corpus_pipeline.DOCUMENTS
    kept = [(r["doc_id"], r["text"]) for r in out["language"].collect()]
    assert len(kept) >= 190 and not [t for _, t in kept if not re.search(r"[^\W\d_]", t or "")]
    once = [(r["doc_id"], r["text"]) for r in out["exact-dedup"].collect()]
    assert len({normal(t) for _, t in once}) == len(once) == len({normal(t) for _, t in kept})
    near = [shingles(r["text"]) for r in out["near-dedup"].collect()]
    assert len(near) < len(once)
    assert not [1 for i, a in enumerate(near) for b in near[:i] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    assert out["pieces"].count() == out["mixing"].count() and out["pieces"].filter("NOT round_trip").count() == 0


def test_near_copies_keep_what_links_to_nothing(spark):
    rng = random.Random(12)
    say = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
    x, y = say(), say()
    alone = [(None, say()), (None, say()), (None, "..."), (None, ""), (None, " "), (7, say()), (7, say()), (8, "")]
    rows = [*alone, (None, x + " more"), (3, x), (None, y), (None, y + " more")]
    d = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, d, "").collect())
    left = got - collections.Counter([*alone, (3, x)])
    assert sum(got.values()) == len(alone) + 2 and left in ({(None, y): 1}, {(None, y + " more"): 1})
