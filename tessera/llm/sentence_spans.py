"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, bloom, scratch

#: A run has so many sentences and words at least.
SENTENCES, WORDS = 2, 16
END = re.compile(rb"(?:(?<=[.!?])|(?<=[.!?][\"')\]]))[ \t\x0b\x0c\r\n]+|[ \t\x0b\x0c\r]*\n[ \t\x0b\x0c\r\n]*")
LAST = (1 << 63) - 1

SPANS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.int32())), ("text", pa.string())])


def sentences(text: bytes) -> list[bytes]:
    """The text (UTF-8, or any bytes) cut behind the white space that ends each sentence or line: joined they are the text."""
    at = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def spans(parts: list[bytes]) -> list[tuple[int, int]]:
    """First sentence and the one after the last of each span: the shortest run from each sentence, then the shortest to each that is not among those."""
    words = [len(p.split()) for p in parts]
    out, j, held = [], 0, 0
    for i in range(len(parts)):
        while j < len(parts) and (j - i < SENTENCES or held < WORDS):
            held += words[j]
            j += 1
        if j - i < SENTENCES or held < WORDS:
            break
        out.append((i, j))
        held -= words[i]
    ending, i, held = [], 0, 0
    for j, n in enumerate(words, 1):
        held += n
        while j - i > SENTENCES and held - words[i] >= WORDS:
            held -= words[i]
            i += 1
        if j - i >= SENTENCES and held >= WORDS and out[i][1] != j:
            ending.append((i, j))
    return out + ending


def _key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 33


def _hash(shared: Broadcast | None = None):
    """128-bit hashes of all spans, their white space reduced, with the document and the place in it; those that a filter holds, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.full(batches):
            hashes, docs, places = [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = sentences(raw)
                own = [xxhash.xxh3_128_digest(b" ".join(p.split())) for p in parts]
                found = spans(parts)
                hashes += [xxhash.xxh3_128_digest(b"".join(own[i:j])) for i, j in found]
                docs += [doc] * len(found)
                key = _key(raw) << 32
                places += range(key, key + len(found))
            two = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = np.arange(len(two)) if shared is None else np.flatnonzero(bloom.holds(shared.value, two.view("<u4")))
            docs, places = np.array(docs, np.int64), np.array(places, np.int64)
            for i in range(0, len(at), 8192):
                x = at[i : i + 8192]
                yield arrow.batch(SPANS, h1=two[x, 0], h2=two[x, 1], doc_id=docs[x], place=places[x])

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow.full(batches):
        counts, gone, texts = [], [], []
        for text, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            parts = sentences(text)
            out = np.zeros(len(parts), bool)
            if again:
                own = spans(parts)
                for k in again:
                    out[slice(*own[k])] = True
                text = b"".join(p for p, o in zip(parts, out, strict=True) if not o)
            counts.append(len(parts))
            gone.append(np.flatnonzero(out).tolist())
            texts.append(text)
        left = pa.array(texts, pa.binary()).view(pa.string())
        yield arrow.batch(OUT, doc_id=b.column(0), n_sentences=counts, n_removed=[len(g) for g in gone], removed=gone, text=left)


def dedup(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each sentence covered by a run that occurred before.

    A run is of at least SENTENCES consecutive sentences with at least WORDS words. Runs are equal
    if their texts are, but for the amount of white space (128-bit hashes). Of equal runs the first
    by document id (null last) and place stays; the sentences of all others go, whatever else covers
    them. What a document is left with is as it was, byte by byte.

    Only the spans of a text are hashed: the shortest run from each sentence and the shortest to each. They
    cover what all runs cover: in a repeated run a sentence is in the shortest run from itself, or that
    would go beyond the end, and then the shortest run to the end begins before it. Whether a run is
    the shortest depends on nothing but itself, so equal spans are numbered in the order of their places.

    The hashes are pre-aggregated before they are shuffled, and only those that occur twice are joined
    back, so a passage that a third of all documents share is one row on one side of that join, a table of its
    own, so that Spark can split the other side. The texts are hashed again for that join, and only spans
    that a filter over the repeated hashes holds go to it: a table of all spans would be larger than the texts.

    Null and empty texts have no sentences; an empty table gives none. A text of fewer sentences or words has no
    span and stays; one of any length is cut whole. Equal places don't occur: ties are between rows that are alike. Bytes that
    are no UTF-8 stay as they are. Rows
    with the same id and the same text are one document, and get the same result each. Only the two
    columns are read; the id is a long.

    Columns: doc_id, n_sentences, n_removed, removed (numbers of sentences, from 0), text (what is left).
    """
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    docs = arrow.narrowed(documents, doc_id=order, text=arrow.raw(F.col(text_col)))
    ddl, at = "h1 long, h2 long, doc_id long, place long", F.struct("doc_id", "place")
    first = docs.mapInArrow(_hash(), ddl).groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    first = scratch.keep(first.filter("first <> last").select("h1", "h2", "first"), "repeated")
    filled = documents.sparkSession.sparkContext.broadcast(bloom.build(first.select("h1", "h2"), first.count()))
    found = docs.mapInArrow(_hash(filled), ddl)
    again = found.join(first, ["h1", "h2"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
    numbers = again.groupBy("doc_id", F.shiftright("place", 32).alias("key")).agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("again"))
    keyed = arrow.narrowed(documents, doc_id=order, own=F.col(id_col).cast("long"), text=arrow.raw(F.col(text_col)))
    keyed = keyed.mapInArrow(_keyed, "doc_id long, own long, key long, text binary")
    out = keyed.join(numbers, ["doc_id", "key"], "left").select("own", "text", "again")
    return out.mapInArrow(_rebuild, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow.full(batches):
        key = pa.array([_key(x) for x in b.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), key, b.column(2)], ["doc_id", "own", "key", "text"])
