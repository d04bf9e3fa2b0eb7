"""What any table may hold: nulls, nothing, megabytes, bytes that are no UTF-8, ties, repeated rows, clashing columns; and the queries' SQL."""

import collections
import hashlib
import os
import random
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import exact_dedup, log_bilinear, max_score, metric_join, mixing, page_text, pieces, ppm_language, queries, sentence_spans, token_files

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ON_TEXTS = {
    "op1": mixing.pareto_mix,
    "op2": lambda d: token_files.round_trip(d, BPE),
    "op3": ppm_language.identify,
    "op4": log_bilinear.score,
    "op7": lambda d: pieces.encode_decode(d, PIECES),
    "op8": sentence_spans.dedup,
    "op9": exact_dedup.exact_dedup,
    "op10": metric_join.near_duplicates,
}


@pytest.mark.parametrize("name", [*ON_TEXTS, "pipeline"])
def test_empty_table(spark, none, name):
    if name == "pipeline":
        d = none.select(*corpus_pipeline.DOCUMENTS)
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "")
            assert d.count() == 0
    else:
        assert ON_TEXTS[name](none).count() == 0


@pytest.fixture(scope="module")
def broken(spark):
    """Texts that are no UTF-8, twice, beside ones that are."""
    rows = [(1, b"good words \xff\xfe here. And more \xc3\x28 of them."), (2, b"good words \xff\xfe here. And more \xc3\x28 of them."), (3, "gut é. Wörter".encode()), (4, b"\xff"), (5, b"\xe2\x82")]
    d = spark.createDataFrame([(i, bytearray(t), "en", "a", 1) for i, t in rows], "doc_id long, raw binary, lang string, source string, n_chars long")
    return d.select("doc_id", F.col("raw").cast("string").alias("text"), "lang", "source", "n_chars").repartition(2)


@pytest.mark.parametrize("name", [*ON_TEXTS, "pipeline"])
def test_bytes_that_are_no_utf8(spark, broken, name):
    if name == "pipeline":
        d = broken
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "")
        assert d.count() >= 1
        return
    got = ON_TEXTS[name](broken)
    assert got.count() == 5
    if name == "op9":
        assert {r["doc_id"]: r["keep_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    if name == "op7":
        sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        assert {r["doc_id"]: (r["ids"], r["round_trip"]) for r in got.collect()}[4] == (sp.encode("�"), False)
    if name == "op2":
        want = len(Tokenizer.from_file(BPE).encode("�", add_special_tokens=False).ids) + 1
        assert {r["doc_id"]: r["n_tokens"] for r in got.collect()}[4] == want


@pytest.fixture(scope="module")
def long(spark):
    """A text of some megabytes, a copy of it, and one that lost a few words."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    text = " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))
    rows = [(1, text), (2, text.replace(" ", "  ", 3)), (3, text[20_000:]), (4, "x" * 3_000_000), (5, "short one")]
    return spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(2)


@pytest.mark.parametrize("name", list(ON_TEXTS))
def test_megabytes(long, name):
    got = {r["doc_id"]: r for r in ON_TEXTS[name](long).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    texts = {r["doc_id"]: r["text"] for r in long.collect()}
    if name == "op1":
        assert got[1]["size"] == 400_000 and got[4]["size"] == 1
    if name == "op2":
        t = Tokenizer.from_file(BPE)
        assert all(got[i]["n_tokens"] == len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items())
    if name == "op4":
        assert got[1]["n_tokens"] == 400_001 and got[4]["n_tokens"] == 2
    if name == "op7":
        assert all(r["round_trip"] for r in got.values())
    if name == "op8":
        assert got[1]["n_removed"] == 0 and got[2]["text"].strip() == "" and got[3]["n_removed"] > 30_000
    if name == "op9":
        assert [got[i]["keep_id"] for i in range(1, 6)] == [1, 1, 3, 4, 5]
        assert got[4]["text_sha256"] == hashlib.sha256(texts[4].encode()).hexdigest()
    if name == "op10":
        assert [got[i]["component_id"] for i in range(1, 6)] == [1, 1, 1, 4, 5]


def test_long_page(spark):
    body = " ".join(f"word{i}" for i in range(300_000))
    d = spark.createDataFrame([(1, "http://h/", f"<nav>no</nav><article><p>{body}</p></article>"), (2, "http://h/", f"<p>{body}</p>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in page_text.extract(d).collect()} == {1: body, 2: body}


def test_long_vectors(spark):
    rows = [(20, [1.0] * 20_000), (1, [0.5] * 20_000), (2, [0.25] * 10)]
    got = [tuple(r) for r in max_score.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 64 * 32 * 20_000), (20, 2, 2, 64 * 16 * 10)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    same = lambda x: repr(x + 0.0) if isinstance(x, float) else str(x)
    at = [want.columns.index(c) for c in got.columns]
    assert collections.Counter(str([same(x) for x in r]) for r in got.collect()) == collections.Counter(str([same(r[i]) for i in at]) for r in want.fetchall())


def cut(text):
    """Sentences by a rule of its own: a character at a time."""
    out, now, i = [], "", 0
    while i < len(text):
        now += text[i]
        j = i + 1
        while j < len(text) and text[j] in " \t\x0b\x0c\r\n":
            j += 1
        gap = text[i + 1 : j]
        ended = re.search(r"[.!?][\"')\]]?$", now)
        if text[i] not in " \t\x0b\x0c\r\n" and gap and ("\n" in gap or ended):
            out.append(now + gap)
            now = ""
            i = j
        else:
            i += 1
    return [x for x in (*out, now) if x]


def test_sentences_by_another_rule():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", ".", "!", "?", '"', ")", " ", "  ", "\n", "\t", "é"]) for _ in range(rng.randint(0, 30)))
        t = t.lstrip(" \t\n")  # what stands before the first word goes with it or alone
        assert [x.decode() for x in sentence_spans.sentences(t.encode())] == cut(t), t
