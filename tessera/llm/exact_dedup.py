"""Exact dedup by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, bloom, golomb, scratch

#: Fingerprints of a chunk, the unit in which tasks send them; of an owner, on average.
CHUNK_ROWS, OWNER_ROWS = 1 << 20, 250_000
#: Bytes of a fingerprint that choose its owner; the filter over suspects takes those behind them.
LEAD = 8

SENT = pa.schema([
    ("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sha", pa.binary()), ("here", pa.bool_()),
    ("owner", pa.int32()), ("slot", pa.int32()), ("coded", pa.binary()),
])
SENT_DDL = "chunk long, row long, doc_id long, text_hash long, sha binary, here boolean, owner int, slot int, coded binary"
TEXTS = pa.schema([("sha", pa.binary()), ("norm", pa.binary())])


def normalise(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] as one space, those at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    if text[0] in b" \t\n\x0b\x0c\r":
        out = b" " + out
    return out + b" " if text[-1] in b" \t\n\x0b\x0c\r" else out


def _send(owners: int):
    span = (1 << 64) // owners + 1

    def chunk(ids: list, hashes: list[int], shas: list[bytes]) -> Iterator[pa.RecordBatch]:
        fp = np.frombuffer(b"".join(x[:8] for x in shas), ">u8").astype(np.uint64)
        own, first, back, times = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
        owner = (own // np.uint64(span)).astype(np.int32)
        starts = np.searchsorted(owner, np.arange(owners + 1))
        key, n = uuid.uuid4().int >> 65, len(shas)
        none = pa.nulls
        for i in range(0, n, 4096):
            b = back[i : i + 4096]
            yield arrow.batch(
                SENT, chunk=np.full(len(b), key), row=np.arange(i, i + len(b)), doc_id=ids[i : i + 4096], text_hash=hashes[i : i + 4096], sha=shas[i : i + 4096], here=times[b] > 1,
                owner=owner[b], slot=(b - starts[owner[b]]).astype(np.int32), coded=none(len(b), pa.binary()),
            )
        for o in np.unique(owner):
            coded = golomb.encode(own[starts[o] : starts[o + 1]] - np.uint64(int(o) * span))
            yield arrow.batch(SENT, chunk=[key], row=none(1, pa.int64()), doc_id=none(1, pa.int64()), text_hash=none(1, pa.int64()), sha=none(1, pa.binary()), here=none(1, pa.bool_()), owner=[o], slot=none(1, pa.int32()), coded=[coded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, shas = [], [], []
        for b in arrow.full(batches):
            ids += b.column(0).to_pylist()
            hashes += b.column(2).to_pylist()
            shas += [hashlib.sha256(normalise(x)).digest() for x in b.column(1).to_pylist()]
            if len(shas) >= CHUNK_ROWS:
                yield from chunk(ids, hashes, shas)
                ids, hashes, shas = [], [], []
        if shas:
            yield from chunk(ids, hashes, shas)

    return run


def _own(sent: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: a bitmap for each chunk, its set bits the fingerprints that another chunk sent too."""
    lists = [golomb.decode(x) for x in sent["coded"]]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    maps = []
    for x in lists:
        bits = np.zeros(-(-len(x) // 64) * 64, np.uint8)
        if len(twice):
            at = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
            bits[: len(x)] = twice[at] == x
        maps.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "bits": maps})


def _suspects(filled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filled.value
        for b in arrow.full(batches):
            norms = [normalise(x) for x in b.column(0).to_pylist()]
            shas = [hashlib.sha256(x).digest() for x in norms]
            maybe = np.flatnonzero(bloom.holds(bits, bloom.words_of(shas, LEAD)))
            if len(maybe):
                yield arrow.batch(TEXTS, sha=[shas[i] for i in maybe], norm=[norms[i] for i in maybe])

    return run


def exact_dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Groups of texts that are equal after each run of ASCII white space became one space.

    1. Each task sorts the fingerprints of a chunk (64 bits of SHA-256), each once however often it
       occurs there, and sends each owner its range of them Golomb-coded. So an owner gets a
       fingerprint at most once from each chunk, even if a third of all rows share it.
    2. The owners answer with a bitmap a chunk: which of its fingerprints came from elsewhere too.
    3. Suspects pass a filter of at most bloom.BITS bits (where it is full it lets more through,
       never fewer), their texts are shuffled and compared byte by byte, pre-aggregated before the
       shuffle. Texts with the same SHA-256 that differ would end the job with an error.

    Only suspects are joined with their groups; a group of any size is one row there.

    Null text is empty, and empty texts are equal; a text of any length is hashed and compared whole. Ties: of rows with the
    group's smallest id (null ids come last) exactly one is kept, whichever came first to its task. An empty table gives none. Only the two columns are read; the id is a long.

    Columns: doc_id, keep_id, group_size, kept, text_sha256, text_hash (see arrow.text_hash).
    """
    spark = documents.sparkSession
    owners = owners or max(32, -(-documents.count() // OWNER_ROWS))
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), text=arrow.raw(F.col(text_col)), text_hash=arrow.text_hash(F.col(text_col)))
    sent = scratch.keep(docs.mapInArrow(_send(owners), SENT_DDL), "fingerprints")
    bitmaps = sent.filter("coded IS NOT NULL").select("chunk", "owner", "coded").groupBy("owner").applyInPandas(_own, "chunk long, owner int, bits array<long>")
    rows = sent.filter("coded IS NULL").drop("coded")
    bit = F.getbit(F.get("bits", F.shiftright("slot", 6)), F.col("slot").bitwiseAND(F.lit(63)))
    rows = rows.join(bitmaps, ["chunk", "owner"]).select("chunk", "row", "doc_id", "text_hash", "sha", (F.col("here") | (bit == 1)).alias("suspect"))
    rows = scratch.keep(rows, "suspects")

    suspects = rows.filter("suspect")
    groups = suspects.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "row")).alias("first"), F.count("*").alias("n"))
    groups = scratch.keep(groups, "groups")
    filled = bloom.build(groups.select("sha"), groups.count(), LEAD)
    maybe = arrow.narrowed(documents, text=arrow.raw(F.col(text_col))).mapInArrow(_suspects(spark.sparkContext.broadcast(filled)), "sha binary, norm binary")
    texts = maybe.groupBy("sha", "norm").agg(F.count("*").alias("m")).groupBy("sha").agg(F.count("*").alias("texts"), F.sum("m").alias("m"))
    proved = groups.join(texts, "sha", "left").withColumn(
        "same", F.when((F.col("texts") == 1) & (F.col("m") == F.col("n")), True).otherwise(F.raise_error(F.lit("texts with the same SHA-256 differ")).cast("boolean"))
    )
    proved = scratch.keep(proved.filter("same AND n > 1").select("sha", "first", "n"), "proved")  # a table, so that a join can split a hot group
    alone = F.col("n").isNull()
    kept = alone | ((F.col("first.chunk") == F.col("chunk")) & (F.col("first.row") == F.col("row")))
    scratch.drop(sent, groups)
    known = suspects.join(proved, "sha", "left").unionByName(rows.filter("NOT suspect"), allowMissingColumns=True)
    return known.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "text_hash",
    )
