"""Upsert, manifest and packing against brute force."""

import bisect
import hashlib
import itertools
import math
import os
import random
import zlib
from collections import defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import keyed_upsert, merkle, packing

SETS = ["source", "segment", "city", "balance"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


# ---- upsert


def upserted(clients: list[dict], changes: list[dict], columns: list[str]) -> list[tuple]:
    most = 1 + len(clients) // 1500
    start = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    firsts = [f[0]["client_id"] for f in files]
    rank = lambda c: tuple((c[k] is not None, c[k] or 0) for k in ("seq", "change_id"))
    wins: dict = {}
    for c in changes:
        if c["client_id"] is not None and (c["client_id"] not in wins or rank(c) > rank(wins[c["client_id"]])):
            wins[c["client_id"]] = c
    new, there = [list(map(dict, f)) for f in files], {r["client_id"] for r in start}
    for cid, c in wins.items() if files else ():
        home = max(bisect.bisect_right(firsts, cid) - 1, 0)
        h = crc(firsts[home]) % 10
        if h > 7:
            continue
        gone = c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h)
        values = {k: c[k] for k in SETS}
        if not gone and cid not in there:
            new[home].append(dict.fromkeys(columns) | {"client_id": cid} | values)
        for f in new:
            if gone:
                f[:] = [r for r in f if r["client_id"] != cid]
            elif cid in there:
                for r in f:
                    if r["client_id"] == cid:
                        r.update(values)
    out: list[tuple[list, bool]] = []
    for old, f in zip(files, new, strict=True):
        f.sort(key=lambda r: r["client_id"])
        if sorted(map(repr, old)) == sorted(map(repr, f)):
            out.append((f, False))
        elif f:
            n = -(-len(f) // most)
            sizes = [len(f) // n + (i < len(f) % n) for i in range(n)]
            out += [(f[e - s : e], True) for s, e in zip(sizes, itertools.accumulate(sizes), strict=True)]
    final: list[tuple[list, bool]] = []
    for f, w in out:
        if w and final and final[-1][1] and len(final[-1][0]) + len(f) <= most:
            final[-1] = (final[-1][0] + f, True)
        else:
            final.append((f, w))
    cents = lambda r: 0 if r["balance"] is None else math.floor(100 * r["balance"] + 0.5)
    return sorted((f[0]["client_id"], len(f), sum(map(cents, f)), sum(crc("|".join(r[c] or "" for c in SETS[:3])) for r in f), hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), ",".join(columns), w) for f, w in final)


def digest(rows) -> list[tuple]:
    return sorted((r["first_id"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["columns"], r["rewritten"]) for r in rows)


CLIENT = "client_id long, row string, source string, city string, segment string, balance double, file int"
CHANGE = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, home int"


@pytest.fixture(scope="module")
def shop(spark):
    """Columns named like the operator's own, repeated ids that span files, nulls, hot ids, many inserts behind the last file."""
    rng = random.Random(3)
    text = lambda: rng.choice(["a", "b|", "", None, "é"])
    clients = [(i, rng.choice(["x", None]), text(), text(), text(), rng.choice([None, 1.005, -2.5, rng.uniform(-9, 9)]), rng.randint(0, 3)) for i in range(2000) if i % 9]
    clients += [(1000, "again", "a", None, "s", float(i), 1) for i in range(7)] + [clients[5]] * 3 + [(None, "x", "a", "b", "c", 1.0, 1)] * 4
    ids = [*range(0, 2000, 2), *range(5000, 5400)]
    changes = [(rng.choice([None, rng.randint(0, 5000)]), rng.choice([7, 1000, None, *ids]), rng.choice([None, 1, 2, 3]), rng.choice("UUDI"), text(), text(), text(), rng.choice([None, rng.uniform(-9, 9)]), 0) for _ in range(2500)]
    seen: dict = {}
    changes = [seen.setdefault((c[1], c[2], c[0]), c) for c in changes]  # ties in both differ in nothing else
    return spark.createDataFrame(clients, CLIENT).repartition(3), spark.createDataFrame(changes, CHANGE).repartition(3)


def test_upsert_equals_brute_force(shop):
    clients, changes = shop
    got = keyed_upsert.upsert_clients(clients, changes).collect()
    want = upserted([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()], clients.columns)
    assert digest(got) == want
    assert {True, False} == {r["rewritten"] for r in got}
    paths = [urlparse(r["path"]).path for r in got]
    assert len(set(paths)) == len(paths)
    folder = os.path.dirname(paths[0])
    assert {f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")} == set(paths)
    for r, p in zip(got[:40], paths, strict=False):  # each is sorted, and holds the columns in order
        t = pq.read_table(p)
        ids = t["client_id"].to_pylist()
        assert t.column_names == clients.columns and ids == sorted(ids) and (ids[0], len(ids)) == (r["first_id"], r["n_rows"])


def test_upsert_runs_agree_and_use_new_folders(shop):
    clients, changes = shop
    a, b = (keyed_upsert.upsert_clients(c, d).collect() for c, d in ((clients, changes), (clients.repartition(5), changes.repartition(2))))
    assert digest(a) == digest(b) and not {r["path"] for r in a} & {r["path"] for r in b}


def test_upsert_of_empty_tables(shop):
    clients, changes = shop
    assert keyed_upsert.upsert_clients(clients.filter("false"), changes).collect() == []
    got = keyed_upsert.upsert_clients(clients, changes.filter("false")).collect()
    assert not any(r["rewritten"] for r in got)
    assert sum(r["n_rows"] for r in got) == clients.filter(F.crc32(F.col("client_id").cast("string").cast("binary")) % 7 > 3).count()


def test_upsert_that_deletes_all(spark):
    clients = spark.createDataFrame([(i, None, "a", "b", "c", 1.0, 0) for i in range(60)], CLIENT)
    changes = spark.createDataFrame([(i, i, 1, "D", None, None, None, None, 0) for i in range(60)], CHANGE)
    got = keyed_upsert.upsert_clients(clients, changes).collect()
    assert digest(got) == upserted([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()], clients.columns)
    assert len(got) < 30


def test_layout_equals_joining_piece_by_piece():
    rng = random.Random(1)
    for _ in range(3000):
        most = rng.randint(1, 9)
        homes = [(i, rng.choice([None, 0, rng.randint(0, most), rng.randint(0, 6 * most)])) for i in range(rng.randint(0, 12))]
        want: list[list] = []
        for file, n in homes:
            if n is None:
                want.append([None, 0])
            elif n:
                k = -(-n // most)
                for j in range(k):
                    size = n // k + (j < n % k)
                    if want and want[-1][0] is not None and want[-1][1] + size <= most:
                        want[-1][1] += size
                    else:
                        want.append([file, size])
        plan, files = keyed_upsert.layout(homes, most)
        got: dict[int, int] = defaultdict(int)
        for (file, large, larger, small, at), n in zip(plan, [n for _, n in homes if n], strict=True):
            pieces = -(-n // most)
            for j in range(pieces):
                got[at + j] += large if j < larger else small
        assert [got[i] for i in range(files)] == [s for f, s in want if f is not None]


# ---- manifest


def H(*x: bytes) -> bytes:
    return hashlib.sha256(b"".join(x)).hexdigest().encode()


def proven(rows: list[tuple]) -> list[tuple]:
    enc = lambda v: b"-" if v is None else str(len(b := str(v).encode())).encode() + b":" + b
    leaf = lambda r, text: H(*map(enc, (*r[:4], text)))

    def build(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def beside(tree, i):
        for level in tree[:-1]:
            s = i // 16 * 16
            yield level[s:i], level[i + 1 : s + 16]
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, leaf(r, r[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = build([x[1] for x in groups[s]])
    top = build([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (r, own) in enumerate(groups[s]):
            path = [*beside(trees[s], i), *beside(top, j)]
            text = r[4]
            if text is not None and r[0] is not None and crc(r[0]) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            up = leaf(r, text)
            for left, right in path:
                up = H(*left, up, *right)
            proof = H(*[x for left, right in path for x in left + right])
            out.append((r[0], *(x.decode() for x in (own, trees[s][-1][0], top[-1][0], proof, up)), up == top[-1][0]))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
order = lambda rows: sorted(rows, key=repr)


def made(docs) -> list[tuple]:
    return order(tuple(r) for r in merkle.proofs(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def listed(docs) -> list[tuple]:
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


def test_manifest_of_odd_documents(docs):
    got = made(docs)
    assert got == order(proven(listed(docs)))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_sizes_around_powers(spark):
    """A source of each size, more sources than a run, a source's rows in many parts."""
    rows = [(s * 1000 + i, f"s{s}" if s else None, "en", i, f"Text {i}") for s, n in enumerate([1, 2, 15, 16, 17, 33, 255, 256, 257, 273, 1, 1, 1, 1, 1, 1, 1, 16]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert made(docs) == order(proven(rows))


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "one", None, None, "A") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(docs) == order(proven(rows) if rows else [])


def test_a_path_holds_whole_preimages(docs):
    own = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("tree_key"), merkle.leaf(*map(F.col, FIELDS)).alias("leaf"))
    for r in merkle.manifest(own).collect():
        node = bytes(r["leaf"])
        for x in r["path"]:
            assert bytes(x["preimage"])[64 * x["slot"] : 64 * x["slot"] + 64] == node
            node = H(bytes(x["preimage"]))
        assert node == bytes(r["root"])


# ---- packing


def packed(docs, **how):
    return packing.pack(docs, TOKENIZER, **how).collect()


def assert_whole(pieces, texts: list[tuple], window: int) -> None:
    """Every id of every document lies in one piece; sequences have no gaps, and none needs padding."""
    from tokenizers import Tokenizer

    ids = [[*e.ids, 1] for e in Tokenizer.from_file(TOKENIZER).encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]]
        assert ends[-1] == window or (ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0)
    want = defaultdict(list)
    for (doc_id, _), x in zip(texts, ids, strict=True):
        want[doc_id, len(x)].append(np.array(x, "<u4"))
    assert by_doc.keys() == want.keys()
    for key, own in by_doc.items():
        covered = sorted((p["start"], p["length"]) for p in own)
        copies = len(want[key])
        assert sum(n for _, n in covered) == copies * key[1]
        if copies == 1:  # rows that share id and length can't be told apart here
            assert [s for s, _ in covered] == [0, *np.cumsum([n for _, n in covered])[:-1]]
            for p in own:
                assert p["ids_crc32"] == zlib.crc32(want[key][0][p["start"] : p["start"] + p["length"]])


@pytest.mark.parametrize("how", [{}, {"window": 64}, {"window": 64, "most": 3}, {"whole": True}])
def test_packing_holds_every_id_once(docs, rows, how):
    pieces = packed(docs, **how)
    assert_whole(pieces, [r[:2] for r in rows], how.get("window", 2048))
    assert {tuple(p) for p in packed(docs, **how)} == {tuple(p) for p in pieces}


def test_packing_of_nothing_and_of_a_long_text(spark, none):
    assert packed(none) == []
    texts = [(1, "word and more " * 120_000), (2, None), (2, None), (None, "x")]
    assert_whole(packed(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)), texts, 2048)


def test_a_document_goes_where_squares_are_least():
    rng, window = random.Random(5), 40
    counts: dict[int, int] = defaultdict(int)
    packer = packing.Packer(lambda pieces: None, window, 10**6)
    squares = lambda c: sum(n * n for n in c.values())
    for i in range(600):
        size = rng.randint(1, window - 1)
        after = []
        for level in [0, *[h for h, n in counts.items() if n and h + size <= window]]:
            c = defaultdict(int, counts)
            if level:
                c[level] -= 1
            if level + size < window:
                c[level + size] += 1
            after.append((squares(c), -level, c))
        counts = min(after, key=lambda x: x[:2])[2]
        packer.add(i, np.zeros(size, np.uint32))
        assert {h: len(x) for h, x in packer.levels.items() if x} == {h: n for h, n in counts.items() if n}
        assert packer.open == sum(counts.values())


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    rng, own = random.Random(2), Tokenizer.from_file(TOKENIZER)
    parts = [" ", " ", "\n", "  ", "\t", "a", "Foo", "it's", "'s", "12", "!?", ".", "é", "日本", "　", " ", "😀", "\x0b", "\x1c", "\x85", "<|endoftext|>", "_", "\r\n", "é", "​", "﻿", "\x00", "x" * 99]
    texts = ["".join(rng.choice(parts[: rng.choice([3, 12, 40])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [" ".join(rng.choice(parts[5:8]) + rng.choice(["", ".", ",\nAnd"]) for _ in range(20)) for _ in range(400)]
    ids, sizes = packing.Encoder(TOKENIZER).encode(pa.array(texts, pa.string()).cast(pa.binary()), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*e.ids, 1] for e in own.encode_batch(texts, add_special_tokens=False)]
