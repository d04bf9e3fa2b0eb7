"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow

#: Labelled documents and bytes of a language that its model is fitted on, those of the smallest hash.
FIT_DOCS, FIT_BYTES = 400, 1 << 20
#: Longest context, in bytes.
ORDER = 3
#: A score is the posterior given the evidence of at most this many bytes at the text's mean cost.
EVIDENCE_BYTES = 64.0
UNKNOWN = "und"


class Model:
    """Frozen statistics of every language, as code lengths by context-tree node and byte.

    With escape method C, a byte seen n times after a context that was followed c times by d distinct
    bytes costs -log2 n / (c + d); any other byte escapes at -log2 d / (c + d) to the context shorter by
    its first byte, below the empty context to 1 / 256. A-Z count as a-z. Bytes that no language's sample has share the
    class 0: they are unseen in every context, so one class keeps the code lengths exact, and so does
    the start of a text. The nodes are the contexts seen in any language; ``node`` maps the last ORDER
    classes to the longest of them that is a suffix.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        if not samples:  # predicts nothing
            return
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t.lower(), np.uint8)] = True
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, int(seen.sum()) + 1)
        self.classes[ord("A") : ord("Z") + 1] = self.classes[ord("a") : ord("z") + 1]
        self.a = int(seen.sum()) + 1
        shift = [self.a**k for k in range(order + 2)]
        grams = [[self._grams(samples[lang], k) for lang in self.langs] for k in range(order + 1)]
        base = np.full((1, self.a, len(self.langs)), 8.0)  # order -1
        nodes_below, rows_below = np.zeros(1, np.int64), base  # contexts of the length before, sorted, and their costs
        tables, self.node = [], np.zeros(shift[order], np.int32)
        whole = np.arange(shift[order], dtype=np.int64)
        offset = 0
        for k in range(order + 1):
            nodes = np.unique(np.concatenate([g[0] // self.a for g in grams[k]])) if k else np.zeros(1, np.int64)
            below = rows_below[np.searchsorted(nodes_below, nodes % shift[k - 1])] if k else rows_below
            rows = below.copy()
            for j, (codes, counts) in enumerate(grams[k]):
                at = np.searchsorted(nodes, codes // self.a)
                total = np.bincount(at, counts, len(nodes))
                kinds = np.bincount(at, minlength=len(nodes))
                known = kinds > 0
                bits = -np.log2(kinds[known] / (total[known] + kinds[known]))
                rows[known, :, j] += bits[:, None]
                rows[at, codes % self.a, j] = -np.log2(counts / (total + kinds)[at])
            tables.append(rows)
            if len(nodes):
                tail = whole % shift[k]
                at = np.minimum(np.searchsorted(nodes, tail), len(nodes) - 1)
                hit = nodes[at] == tail
                self.node[hit] = at[hit] + offset
                offset += len(nodes)
            nodes_below, rows_below = nodes, rows
        self.costs = np.ascontiguousarray(np.concatenate(tables).reshape(-1, len(self.langs)), np.float32)

    def _grams(self, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of all runs of k + 1 classes within a text."""
        found = []
        for t in texts:
            c = self.classes[np.frombuffer(t, np.uint8)].astype(np.int64)
            if len(c) > k:
                code = np.zeros(len(c) - k, np.int64)
                for i in range(k + 1):
                    code = code * self.a + c[i : len(c) - k + i]
                found.append(code)
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of each text, between two offsets, under each language."""
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.langs)))
        if not len(data):
            return out
        c = self.classes[data]
        context = np.zeros(len(c), np.int32)
        starts = offsets[:-1][sizes > 0]
        for back in range(self.order, 0, -1):  # the oldest class first
            prior = np.zeros(len(c), np.int32)
            prior[back:] = c[:-back] if back < len(c) else []
            for i in range(back):  # nothing stands before a text
                near = starts + i
                prior[near[i < sizes[sizes > 0]]] = 0
            context *= self.a
            context += prior
        costs = self.costs[self.node[context].astype(np.int64) * self.a + c]
        out[sizes > 0] = np.add.reduceat(costs, starts, axis=0, dtype=np.float64)
        return out


def crc_remainder(key: Column, mod: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod))


def fit(documents: DataFrame, *, text_col: str, lang_col: str, id_col: str, train: Column, order: int = ORDER) -> Model:
    """A model from a bounded sample of the labelled documents in ``train``: of each language, those
    whose hashes of id and text come first, up to FIT_DOCS of them and FIT_BYTES in all."""
    d = documents.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit(29))
    counts = {r["lang"]: r["n"] for r in d.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    # keeps about twice the wanted documents of each language, all of a rare one; the rest is cut exactly below
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * FIT_DOCS + 100) / n)))])
    small = d.filter(F.pmod(rank, F.lit(1 << 30)) < F.element_at(share, F.col(lang_col)) * (1 << 30))
    rows = small.select(F.col(lang_col).alias("lang"), rank.alias("rank"), arrow.raw(F.col(text_col)).alias("text"), F.length(arrow.raw(F.col(text_col))).alias("n"))
    first = W.partitionBy("lang").orderBy(F.pmod("rank", F.lit(1 << 30)), "rank", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("i", F.row_number().over(first)).withColumn("upto", F.sum("n").over(first) - F.col("n"))
    rows = rows.filter((F.col("i") <= FIT_DOCS) & (F.col("upto") < FIT_BYTES)).select("lang", F.substring("text", 1, FIT_BYTES).alias("text"))
    got = rows.toArrow()
    samples: dict[str, list[bytes]] = {}
    for lang, text in zip(got["lang"].to_pylist(), got["text"].to_pylist(), strict=True):
        samples.setdefault(lang, []).append(text)
    return Model({k: v for k, v in samples.items() if any(v)}, order)


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in arrow.full(batches):
            text = b.column(1)
            offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] else np.empty(0, np.uint8)
            offsets -= offsets[0]
            sizes = np.diff(offsets)
            letters = np.array(b.column(2).to_pylist(), bool) & (len(model.langs) > 0)
            lang, score, rate = [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text))
            if letters.any():
                bits = model.bits(data, offsets)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                part = np.minimum(1.0, EVIDENCE_BYTES / np.maximum(1, sizes))
                score = np.where(letters, 1 / np.exp2((least[:, None] - bits) * part[:, None]).sum(axis=1), 0.0)
                rate = np.where(letters, least / np.maximum(1, sizes), 0.0)
                lang = [model.langs[k] if y else UNKNOWN for k, y in zip(best, letters, strict=True)]
            yield arrow.batch(OUT, doc_id=b.column(0), lang_pred=lang, score=score, bits_per_byte=rate)

    return run


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language under which each whole text is shortest; ties go to the first language by name.

    A text that is null, empty or without a letter is UNKNOWN with score 0; so is every text if nothing
    was learned. A text of any length is coded whole, a batch at a time. Rows with the same id stay rows of their own.
    An empty table gives none. Only the two columns are read.

    Columns: doc_id, lang_pred, score (of the posterior under equal priors, see EVIDENCE_BYTES), bits_per_byte.
    """
    text = F.col(text_col)
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), text=arrow.raw(text), letters=F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(documents: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, as they are, whose text has a predicted language with a score of at least ``least``."""
    arrow.bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.full(batches):
            text = b.column(at).cast(pa.binary()).fill_null(b"")
            letters = pa.array([any(map(str.isalpha, x.decode("utf-8", "ignore"))) for x in text.to_pylist()], pa.bool_())
            ids = pa.array(range(b.num_rows), pa.int64())
            for out in _predict(shared)(iter([pa.RecordBatch.from_arrays([ids, text, letters], ["doc_id", "text", "letters"])])):
                yield b.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def identify(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Fits on the documents whose crc32 of the id, modulo ``folds``, isn't ``held_out`` and predicts all.

    A null id is in no fold: it is neither learned from nor held out.
    """
    inside = crc_remainder(F.col(id_col), folds)
    model = fit(documents, text_col=text_col, lang_col=lang_col, id_col=id_col, train=F.coalesce(inside != held_out, F.lit(False)))
    found = predict(documents, model, id_col=id_col, text_col=text_col)
    return found.select("doc_id", F.coalesce(crc_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
