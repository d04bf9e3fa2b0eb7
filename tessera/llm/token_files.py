"""Token ids of texts as Re-Pair compressed shards, written in the order of the ids and read back."""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow, repair, scratch

#: Ids of a shard, and cores of words that a worker remembers.
SHARD_IDS, CACHE_CORES = 1 << 21, 500_000
#: Bytes of text encoded at once.
ENCODE_BYTES = 8 << 20
#: Cores given to the tokenizer as one text; what is plain: letters of Latin-1, which keep their kind in lower case, and a stop.
JOINED, STOPS = 64, ".,;:!?"
PLAIN = f"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<stop>[{STOPS}]?)$"

SHARDS_DDL = "part int, shard int, at long, n_tokens long, doc_ids array<long>, payload binary"
SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class _Words(dict):
    """Numbers of words, given as they come."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """The tokenizers library, asked once a batch for each word between ASCII white space, or its core.

    That gives the ids of the whole text if the tokenizer takes white space as a border: it splits
    there, drops it, and no normal form joins a character to one before it. ``whole`` is for others.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(self.size, bool)  # ids that end a piece
        if mark:
            self.closing[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(mark)]] = True
        self.stops = [np.array(x, np.uint32) for x in self._ids([b.encode() for b in STOPS])]
        self._clear()

    def _clear(self) -> None:
        self.cores, self.core_start, self.core_flat = _Words(), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, cores: list[bytes]) -> None:
        """Ids of new cores (letters only, so one piece each), JOINED in a text: the vocabulary marks the
        last id of a piece, so the pieces give the borders. Where there are not as many pieces as cores, one by one."""
        groups = [cores[i : i + JOINED] for i in range(0, len(cores), JOINED)]
        sizes, flat = [], []
        for group, ids in zip(groups, self._ids([b" ".join(g) for g in groups]), strict=True):
            x = np.array(ids, np.uint32)
            last = np.flatnonzero(self.closing[x]) + 1
            if len(last) == len(group) and last[-1] == len(x):
                sizes.append(np.diff(last, prepend=0))
                flat.append(x)
            else:
                for one in self._ids(group):
                    sizes.append(np.array([len(one)]))
                    flat.append(np.array(one, np.uint32))
        self.core_start = np.concatenate([self.core_start, self.core_start[-1] + np.cumsum(np.concatenate(sizes))])
        self.core_flat = np.concatenate([self.core_flat, *flat])

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has.

        A plain word is letters and perhaps one stop: the tokenizer splits between the two, and takes
        A-Z as a-z, so its ids are those of its core and of the stop. Other words are asked for as they are.
        """
        n = len(words)
        core, stop = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        if self.closing.any():
            found = pc.extract_regex(words.view(pa.large_string()), PLAIN)
            plain = found.is_valid().to_numpy(zero_copy_only=False)
            cores = pc.ascii_lower(pc.struct_field(found, "core").filter(found.is_valid())).dictionary_encode()
            names = cores.dictionary.cast(pa.large_binary()).to_pylist()
            core[plain] = np.fromiter(map(self.cores.__getitem__, names), np.int64, len(names))[cores.indices.to_numpy()]
            stops = pc.index_in(pc.struct_field(found, "stop"), pa.array(list(STOPS), pa.large_string())).fill_null(-1).to_numpy()
            stop[plain] = stops[plain]
            if self.cores.new:
                self._learn(self.cores.new)
                self.cores.new = []
        hard = np.flatnonzero(core < 0)
        own = self._ids(words.take(pa.array(hard)).to_pylist())
        core[hard] = len(self.core_start) - 1 + np.arange(len(hard))  # behind the cores, for now
        start = np.concatenate([self.core_start, self.core_start[-1] + np.cumsum([len(x) for x in own], dtype=np.int64)])
        flat = np.concatenate([self.core_flat, np.array([i for x in own for i in x], np.uint32)])
        tail_start = np.concatenate([[0], np.cumsum([len(x) for x in self.stops])])
        size, tail = start[core + 1] - start[core], np.where(stop >= 0, tail_start[stop + 1] - tail_start[stop], 0)
        begin = np.cumsum(size + tail) - size - tail
        out = np.empty(int((size + tail).sum()), np.uint32)
        for at, first, count, ids in ((begin, start[core], size, flat), (begin + size, tail_start[stop], tail, np.concatenate(self.stops))):
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(at, count) + inner] = ids[np.repeat(first, count) + inner]
        return out, size + tail

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each followed by ``end``, and the number of each text's ids."""
        if self.whole:
            ids = self._ids(texts)
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            return np.concatenate([np.array([*x, end], np.uint32) for x in ids]), sizes
        if len(self.cores) > CACHE_CORES:
            self._clear()
        distinct, index, counts = arrow.split_words(pa.array(texts, pa.large_binary()), lower=False)
        flat, sizes = self._word_ids(distinct)
        flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1).astype(np.int32)  # the end is one more word
        texts_end = np.cumsum(counts) + np.arange(len(counts))
        words = np.full(len(index) + len(counts), len(distinct), np.int32)
        words[np.delete(np.arange(len(words), dtype=np.int32), texts_end)] = index
        start = (np.cumsum(sizes) - sizes).astype(np.int32)  # a batch is far below 2**31 ids
        n = sizes[words]
        upto = np.cumsum(n, dtype=np.int32)
        place = np.repeat(start[words] - (upto - n), n)
        place += np.arange(len(place), dtype=np.int32)
        return flat[place], np.diff(upto[texts_end], prepend=0).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str, whole: bool = False) -> Encoder:
    """One a worker: it keeps its words over tasks."""
    return Encoder(path, whole)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    names, texts, held = [], [], 0
    for b in arrow.full(batches):
        names += b.column(0).to_pylist()
        new = arrow.valid(b.column(1)).to_pylist()
        texts += new
        held += sum(map(len, new))
        if held >= ENCODE_BYTES:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


def _write(path: str, end: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path, whole), TaskContext.get().partitionId()
        docs, ids, sizes, held, shard, at = [], [], [], 0, 0, 0

        def flush():
            grammar = repair.build(np.concatenate(ids), max(coder.size, end + 1))
            n = np.concatenate(sizes)
            payload = repair.dump(grammar, np.concatenate([[0], np.cumsum(n)]))
            return arrow.batch(SHARDS, part=[part], shard=[shard], at=[at], n_tokens=[held], doc_ids=[docs], payload=[payload])

        for names, texts in _gathered(batches):
            got, n = coder.encode(texts, end)
            docs += names
            ids.append(got), sizes.append(n)
            held += len(got)
            if held >= SHARD_IDS:
                yield flush()
                at, shard = at + held, shard + 1
                docs, ids, sizes, held = [], [], [], 0
        if held:
            yield flush()

    return run


def write(documents: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = 2, whole: bool = False) -> None:
    """Writes the ids of every document, then ``end``, in ascending order of the documents' ids.

    Ids are dealt by ranges, so a part holds a range and parts ascend; a part has shards of about
    SHARD_IDS ids, which hold whole documents; a long one makes its shard longer. Null and empty texts are their
    end alone, null ids come first, ties (rows with the same id) go by their texts; what is no UTF-8 counts as U+FFFD. An
    empty table makes no shard. Only the two columns are read.
    """
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), text=arrow.raw(F.col(text_col)))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    docs.mapInArrow(_write(tokenizer, end, whole), SHARDS_DDL).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow.full(batches):
        for part, at, docs, payload in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            grammar, starts = repair.load(payload)
            ids = grammar.expand(grammar.symbols).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield arrow.batch(READ, part=np.full(len(docs), part), doc_id=docs, at=at + starts[:-1], n_tokens=np.diff(starts), ids_crc32=crc)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of every document in the files: doc_id, start (ids before it in all), n_tokens, ids_crc32."""
    arrow.bound_batches(spark)
    files = spark.read.parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(before) - F.col("n")).alias("before"))
    docs = files.select("part", "at", "doc_ids", "payload").mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, part: int, shard: int, document: int) -> np.ndarray:
    """Ids of one document of a shard, decoded from the symbols that cover it only."""
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("shard") == shard)).select("payload").first()
    grammar, starts = repair.load(bytes(row["payload"]))
    return grammar.slice(int(starts[document]), int(starts[document + 1]))


def round_trip(documents: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    spark = documents.sparkSession
    path = scratch.place(spark, "tokens")
    write(documents, path, tokenizer, **columns)
    return read_digests(spark, path)
