"""Language-model scores: a log-bilinear model over frequent words and classes of the others, trained by noise-contrastive estimation."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow, scratch
from .ppm_language import crc_remainder

#: Symbols of the model: the end, classes of rarer words, and frequent words; of those so many at least, more if seen so often. MOST
#: symbols in all, because the normalisers are a square of them (36 MB).
CLASSES, FREQUENT_WORDS, OFTEN, MOST = 1536, 1024, 100, 3072
#: Dimensions (an even number), noise words of a step, positions of a step.
DIMENSIONS, NOISE, STEP = 24, 128, 1024
#: Positions of a shard, about, over which one task descends.
SHARD = 1 << 20
#: Rounds that share all training texts, each of which trains once; Adagrad's rate.
ROUNDS, RATE = 2, 0.1
#: Words whose counts every task knows; the others' counts are joined. Words a task counts before it passes them on.
FREQUENT, HELD = 150_000, 400_000
END = 0  # classes are from 1 on, frequent words behind them
NO_ID = 2
CHUNK = 1 << 12  # positions scored at a time, whose rows fit into a core's cache
PART, FAN = 4096, 64  # parameters in a row of an average, and shards that one task averages
PARAMETERS_DDL = "part int, shard int, n long, x binary"


@dataclass
class Model:
    """score(w | u, v) = (context[u] @ near + context[v] @ far) . target[w] + bias[w], u the word before, v the one before that."""

    context: np.ndarray
    target: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    norm: np.ndarray | None = field(default=None)

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 5) -> Model:
        """Near the unigram model, which is normalised."""
        rng, k, d = np.random.default_rng(seed), len(share), DIMENSIONS
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(k, d), draw(k, d), np.eye(d, dtype=np.float32), np.eye(d, dtype=np.float32) * np.float32(0.5), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.near, self.far, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def train(self, triples: np.ndarray, share: np.ndarray, seed: int | list[int]) -> None:
        """One pass over rows of (v, u, w), telling each w from NOISE words drawn by ``share``."""
        rng = np.random.default_rng(seed)
        items = lambda x: x.view(np.dtype((np.void, x.itemsize * x.shape[1])))[:, 0]  # noqa: E731 - rows that are moved as one item each
        triples = items(np.ascontiguousarray(triples)).take(rng.permutation(len(triples))).view(triples.dtype).reshape(-1, 3)
        cumulative = np.cumsum(share)
        log_noise = np.log(NOISE * share).astype(np.float32)
        k, d = self.target.shape
        drawn = rng.random((-(-len(triples) // STEP), NOISE)) * cumulative[-1]
        drawn = np.minimum(np.searchsorted(cumulative, drawn), k - 1)
        # the bias is a column behind the target, near stands above far; a column of zeros makes the columns even
        context, both = np.ascontiguousarray(self.context), np.concatenate([self.near, self.far])
        target = np.zeros((k, d + 2), np.float32)
        target[:, :d], target[:, d] = self.target, self.bias
        context_sums, target_sums, both_sums = (np.full(x.shape, 1e-6, np.float32) for x in (context, target, both))
        own, rows = np.ones((STEP, d + 1), np.float32), np.zeros((STEP + NOISE, d + 2), np.float32)

        def ascend(x: np.ndarray, sums: np.ndarray, at: np.ndarray, each: np.ndarray) -> None:
            """Adds up the rows of each place, and takes a step there; places that don't occur have no gradient and stay."""
            order = np.argsort(at.astype(np.uint16, copy=False), kind="stable")  # two bytes hold a symbol, and are sorted by radix
            at = at.take(order)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            at = at.take(first).astype(np.intp)
            g = np.add.reduceat(each.view(np.complex64).take(order, axis=0), first, axis=0).view(np.float32)  # two columns are added at a time
            g /= size
            now = sums.take(at, axis=0)
            now += g * g
            items(sums)[at] = items(now)
            g *= np.float32(RATE)
            g /= np.sqrt(now, out=now)
            g += x.take(at, axis=0)
            items(x)[at] = items(g)

        for i, noise in zip(range(0, len(triples), STEP), drawn, strict=True):
            before, w = triples[i : i + STEP, 1::-1].ravel(), triples[i : i + STEP, 2]
            n, size = len(w), np.float32(len(w))
            c = context.take(before, axis=0).reshape(n, 2 * d)  # of u and of v
            q = own[:n]  # and a one, for the bias
            np.matmul(c, both, out=q[:, :d])
            tw, tn = target.take(w, axis=0), target.take(noise, axis=0)
            real = np.einsum("ij,ij->i", q, tw[:, :-1]) - log_noise.take(w)
            a = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # raises the score of what is there
            # a step's largest array, of positions by noise words, is passed through as few times as can be
            less = -tn[:, :-1]
            less[:, d] += log_noise.take(noise)
            b = q @ less.T
            with np.errstate(over="ignore"):  # 1 over infinity is 0
                np.exp(b, out=b)
            b += 1
            np.divide(-1, b, out=b)
            dq = b @ tn[:, :d]
            dq += a[:, None] * tw[:, :d]
            np.multiply(a[:, None], q, out=rows[:n, :-1])
            np.matmul(b.T, q[:, :d], out=rows[n : n + NOISE, :d])
            np.matmul(q[:, d], b, out=rows[n : n + NOISE, d])
            ascend(target, target_sums, np.concatenate([w, noise.astype(w.dtype)]), rows[: n + NOISE])
            ascend(context, context_sums, before, (dq @ both.T).reshape(2 * n, d))
            g = c.T @ dq
            g /= size
            both_sums += g * g
            both += np.float32(RATE) * g / np.sqrt(both_sums)
        self.context, self.target, self.bias = context, target[:, :d].copy(), target[:, d].copy()
        self.near, self.far = both[:d].copy(), both[d:].copy()

    def normalise(self) -> Model:
        """Log of the sum over all symbols for every two words before, by matrix products."""
        near, far = self.context @ self.near, self.context @ self.far
        by_near = near @ self.target.T + self.bias  # u, w
        by_far = far @ self.target.T  # v, w
        top_near, top_far = by_near.max(axis=1), by_far.max(axis=1)
        norm = np.exp(by_far - top_far[:, None]) @ np.exp(by_near - top_near[:, None]).T  # by v, u
        low = np.argwhere(norm < 1e-25)  # where the product may have lost what counts
        with np.errstate(divide="ignore"):
            norm = np.log(norm) + top_far[:, None] + top_near
        for v, u in low:
            x = by_near[u] + by_far[v]
            norm[v, u] = x.max() + np.log(np.exp(x - x.max()).sum())
        self.norm, self.by_near, self.by_far = norm, near, far
        return self

    def log_probability(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logs, normalised."""
        out, norm, k = np.empty(len(w)), self.norm.ravel(), len(self.bias)
        for i in range(0, len(w), CHUNK):
            a, b, c = v[i : i + CHUNK], u[i : i + CHUNK], w[i : i + CHUNK]
            q = self.by_near.take(b, axis=0)
            q += self.by_far.take(a, axis=0)
            out[i : i + CHUNK] = np.einsum("ij,ij->i", q, self.target.take(c, axis=0)) + self.bias.take(c) - norm.take(a * k + b)
        return out


WORDS_DDL = "ids binary, keys binary, learn binary, counts binary, index binary, lengths binary, words binary"
WORDS = pa.schema([(n, pa.binary()) for n in ("ids", "keys", "learn", "counts", "index", "lengths", "words")])


def _narrow(distinct: int) -> str:
    return "<u2" if distinct <= 1 << 16 else "<u4"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a batch of texts, packed: ids, keys, whether to learn from it (NO_ID without an id), how many words each text has, each
    word's place among the distinct ones, and those."""
    for b in arrow.full(batches):
        distinct, index, counts = arrow.split_words(b.column(3))
        lengths = pc.binary_length(distinct).to_numpy().astype("<u4")
        learn = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        learn[b.column(0).is_null().to_numpy(zero_copy_only=False)] = NO_ID
        packed = (b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy(), learn, counts.astype("<u4"), index.astype(_narrow(len(distinct))), lengths)
        yield arrow.batch(WORDS, **{n: [x.tobytes()] for n, x in zip(WORDS.names, packed, strict=False)}, words=[joined(distinct)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Ids, keys, whether learned from, distinct words, places of the words, and how many each text has."""
    for b in arrow.full(batches):
        for i in range(b.num_rows):
            kinds = ("<i8", "<i8", "u1", "<u4", _narrow(len(b.column(5)[i].as_buffer()) // 4), "<u4")
            ids, keys, learn, counts, index, lengths = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(b.columns, kinds, strict=False))
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            distinct = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), b.column(6)[i].as_buffer()])
            yield pa.array(ids, mask=learn == NO_ID), keys, learn == 1, distinct, index, counts.astype(np.int64)


def joined(words: pa.Array) -> bytes:
    """All words in a row, as they lie in the array."""
    if not len(words):
        return b""
    ends = np.frombuffer(words.buffers()[1], np.int64)[[words.offset, words.offset + len(words)]].tolist()
    return words.buffers()[2][slice(*ends)].to_pybytes() if ends[0] < ends[1] else b""


def endings(words: pa.Array) -> np.ndarray:
    """The class of each word, by its last three bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] is not None else np.empty(0, np.uint8)
    data = np.append(data, np.uint8(0))
    out = np.zeros(len(words), np.uint32)
    for k in (1, 2, 3):
        at = offsets[1:] - k
        out = out * np.uint32(257) + np.where(at >= offsets[:-1], data[np.maximum(at, 0)], 0).astype(np.uint32)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of training texts, their classes and counts, the end as the empty word; summed here as far as memory is bounded."""
    words, counts_, size, ends = [], [], 0, 0

    def summed() -> Iterator[pa.RecordBatch]:
        found = pa.concat_arrays(words).dictionary_encode()
        n = np.bincount(found.indices.to_numpy(), np.concatenate(counts_), len(found.dictionary)).astype(np.int64)  # exact below 2 ** 53
        for i in range(0, len(n), 16384):
            word = found.dictionary.slice(i, 16384)
            yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(endings(word), pa.int32()), pa.array(n[i : i + 16384])], ["word", "class", "n"])
        words.clear(), counts_.clear()

    for _, _, learn, distinct, index, counts in _rows(batches):
        n = np.bincount(index[np.repeat(learn, counts)], minlength=len(distinct))
        own = np.flatnonzero(n)
        words.append(distinct.take(pa.array(own))), counts_.append(n[own])
        ends += int(learn.sum())
        size += len(own)
        if size > HELD:
            yield from summed()
            size = 0
    if ends:
        words.append(pa.array([b""], pa.large_binary())), counts_.append(np.array([ends]))
    if words:
        yield from summed()


class Lexicon:
    """Frequent words in falling order of their counts, the first ``inner`` of which are symbols of their own."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        own = pc.not_equal(words, pa.scalar(b"", words.type))
        self.words, self.counts = words.filter(own), counts[own.to_numpy(zero_copy_only=False)]
        self.end = int(counts.sum() - self.counts.sum())  # counts of the end, the empty word
        often = int((self.counts >= OFTEN).sum())
        self.inner = min(len(self.words), max(FREQUENT_WORDS, min(MOST - CLASSES - 1, often)))
        self.size = 1 + CLASSES + self.inner
        self.totals, self.kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)

    def classed(self, classes: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> Lexicon:
        """With the counts and the numbers of all words by class; those that are symbols of their own are none of them."""
        inner = endings(self.words.slice(0, self.inner))
        self.totals[classes], self.kinds[classes] = totals, kinds
        np.subtract.at(self.totals, inner, self.counts[: self.inner])
        np.subtract.at(self.kinds, inner, 1)
        return self

    def share(self) -> np.ndarray:
        """Of each symbol its share of the training tokens, with one more each."""
        n = np.concatenate([[self.end + 1.0], self.totals + 1.0, self.counts[: self.inner] + 1.0])
        return n / n.sum()

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Of each of the distinct words its place, -1 if it isn't frequent. Frequent words are looked up in those of a batch, which mostly are fewer."""
        at = pc.index_in(self.words, value_set=distinct).fill_null(-1).to_numpy()
        out, found = np.full(len(distinct), -1), np.flatnonzero(at >= 0)
        out[at[found]] = found
        return out

    def symbols(self, distinct: pa.Array, places: np.ndarray | None = None) -> np.ndarray:
        """Of each word its symbol; without the places only words that are symbols of their own are looked up."""
        if places is None:
            places = pc.index_in(distinct, value_set=self.words.slice(0, self.inner)).fill_null(-1).to_numpy()
        return np.where((places >= 0) & (places < self.inner), 1 + CLASSES + places, 1 + endings(distinct))


def _sequence(number: np.ndarray, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols of all texts, each closed by the end, with the two before each and where each text starts."""
    w = np.insert(number[index], np.cumsum(counts), END)
    u, v = np.concatenate([[END], w[:-1]]), np.concatenate([[END, END], w[:-2]])[: len(w)]
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    v[first[:-1]] = END
    return v, u, w, first


def _symbols(shared: Broadcast):
    """Each training text as symbols, closed by the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for _, keys, learn, distinct, index, counts in _rows(batches):
            _, _, w, first = _sequence(lexicon.symbols(distinct), index, counts)
            w = w.astype("<u2")
            own = np.flatnonzero(learn)
            symbols = [w[first[i] : first[i + 1]].tobytes() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(symbols, pa.binary())], ["key", "symbols"])

    return run


def _triples(w: np.ndarray) -> np.ndarray:
    """Rows of (v, u, w) of texts in a row, each closed by the end."""
    end = np.array([END], w.dtype)
    u, v = np.concatenate([end, w[:-1]]), np.concatenate([end, end, w[:-2]])[: len(w)]
    return np.stack([np.where(u == END, end, v), u, w], axis=1)


def _train(shared: Broadcast, turn: int):
    """Of each shard, whose texts come in the order of their keys, the parameters after a descent over them."""

    def descent(shard: int, texts: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        start, share = shared.value
        model, seen, held, size = start.filled(start.flat()), 0, [], 0

        def step() -> None:
            model.train(_triples(np.concatenate(held)), share, [turn, shard, seen])
            held.clear()

        for x in texts:
            t = np.frombuffer(x, "<u2")
            held.append(t)
            size, seen = size + len(t), seen + len(t)
            if size >= 1 << 21:
                step()
                size = 0
        if held:
            step()
        flat = model.flat().astype("<f8")
        parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), shard, np.int32)), pa.array(np.full(len(parts), seen, np.int64)), pa.array(parts, pa.binary())], ["part", "shard", "n", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in arrow.full(batches) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for shard, own in itertools.groupby(rows, key=lambda x: x[0]):
            yield from descent(shard, (x for _, x in own))

    return run


def _mean(rows: pa.Table) -> pa.Table:
    """One part's mean over a group of shards in the order of their numbers, weighted by positions."""
    rows = rows.sort_by("shard")
    n = rows["n"].to_numpy()
    total = np.zeros(len(rows["x"][0].as_py()) // 8)
    for k, x in zip(n.tolist(), rows["x"].to_pylist(), strict=True):
        total += k * np.frombuffer(x, "<f8")
    return pa.table({"part": rows["part"][:1], "shard": pa.array([rows["shard"][0].as_py() // FAN], pa.int32()), "n": pa.array([int(n.sum())]), "x": pa.array([(total / n.sum()).astype("<f8").tobytes()], pa.binary())})


def _averaged(got: DataFrame, shards: int) -> np.ndarray | None:
    """Mean of the shards' parameters, FAN shards at a time, so that no task has more of them; in the order of the shards, so the same each time."""
    while True:
        got = got.withColumn("_g", F.floor(F.col("shard") / FAN)).groupBy("part", "_g").applyInArrow(lambda _, rows: _mean(rows), PARAMETERS_DDL)
        shards = -(-shards // FAN)
        if shards == 1:
            break
    rows = got.toArrow().sort_by("part")
    return np.concatenate([np.frombuffer(x, "<f8") for x in rows["x"].to_pylist()]) if rows.num_rows else None


SCORED = pa.schema([
    ("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()),
    ("rare_logs", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())),
])
SCORED_DDL = "chunk long, row long, doc_id long, n_tokens long, n_known long, logs double, rare_logs double, model double, words array<binary>, times array<int>"


def _score(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon = shared.value
        chunk, row = uuid.uuid4().int >> 65, 0
        for ids, _, _, distinct, index, counts in _rows(batches):
            places = lexicon.places(distinct)
            number = lexicon.symbols(distinct, places)
            v, u, w, first = _sequence(number, index, counts)
            own = np.add.reduceat(model.log_probability(v, u, w), first[:-1]) / np.log(10)
            of_class = np.concatenate([[0.0], np.log10(lexicon.totals + lexicon.kinds + 1.0), np.zeros(lexicon.inner)])  # what a word's count plus one is a share of
            own -= np.add.reduceat(of_class[w], first[:-1])
            # counts of the frequent words; the others go along for a join
            known = places >= 0
            logs = np.zeros(len(places))
            logs[known] = np.log10(lexicon.counts[places[known]] + 1.0)
            doc = np.repeat(np.arange(len(counts)), counts)
            sum_of = lambda x: np.bincount(doc, x, len(counts))
            rare = number <= CLASSES
            far = ~known[index]
            key, times = np.unique(doc[far] * len(distinct) + index[far], return_counts=True)
            at = np.searchsorted(key, np.arange(len(counts) + 1) * len(distinct))
            offsets = pa.array(at.astype(np.int32))
            words = pa.ListArray.from_arrays(offsets, distinct.take(pa.array(key % max(1, len(distinct)))).cast(pa.binary()))
            yield arrow.batch(
                SCORED, chunk=np.full(len(counts), chunk), row=np.arange(row, row + len(counts)), doc_id=ids, n_tokens=counts + 1,
                n_known=sum_of(known[index]).astype(np.int64) + (lexicon.end > 0), logs=sum_of(logs[index]) + np.log10(lexicon.end + 1.0),
                rare_logs=sum_of(np.where(rare, logs, 0.0)[index]), model=own, words=words, times=pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            )
            row += len(counts)

    return run


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """log10 probabilities of every whole text, under counts and under the model.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end a text. Counts cover all
    training documents (those whose crc32 of the id modulo ``folds`` isn't ``held_out``). The model predicts
    one of up to MOST symbols (the end, the most frequent words, a class of rarer words) from the two before, in which rarer
    words count as their classes too. Classes are by the last three bytes of a word; a rarer word's
    probability within its class is by its count plus one, with one more for all unseen words, so the probabilities of all
    tokens sum to one. Training is spread: texts are dealt by their hash to rounds
    and to shards of about SHARD positions, a task descends over a shard, and shards' parameters are averaged in the
    cluster, round by round. Every position of every training text trains once, and the model doesn't depend on
    how rows were dealt to tasks. The normaliser of each two preceding symbols is computed once.

    Texts are split into words once, into a table by which they are counted, learned from and scored.

    Null and empty texts are just the end; a text of any length is read whole, a batch of its own if it is long. Words of equal
    count are in order of their bytes. A null id is in no fold: neither learned from nor held out. Repeated
    rows count as often as they occur. Without training documents every count is 0. An empty table gives none.
    Only the two columns are read; the id is a long.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = documents.sparkSession
    inside = F.coalesce(crc_remainder(F.col(id_col), folds) != held_out, F.lit(False))
    text = arrow.raw(F.col(text_col))
    docs = arrow.narrowed(documents, doc_id=F.col(id_col).cast("long"), key=F.xxhash64(F.col(id_col).cast("long"), text), learn=inside, text=text)
    words = scratch.keep(docs.mapInArrow(_split, WORDS_DDL), "words", packed=True)
    counts = scratch.keep(words.mapInArrow(_count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "word").limit(FREQUENT).toArrow().combine_chunks()
    found = pa.chunked_array(top["word"]).combine_chunks() if top.num_rows else pa.array([], pa.binary())
    lexicon = Lexicon(found.cast(pa.large_binary()), top["n"].to_numpy())
    by_class = counts.filter(F.length("word") > 0).groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()  # CLASSES rows
    lexicon = lexicon.classed(by_class["class"].to_numpy(), by_class["n"].to_numpy(), by_class["kinds"].to_numpy())
    share = lexicon.share()
    model = Model.start(share)

    sc = spark.sparkContext
    texts = scratch.keep(words.mapInArrow(_symbols(sc.broadcast(lexicon)), "key long, symbols binary"), "positions")
    shards = max(1, round(total / ROUNDS / SHARD))
    for turn in range(ROUNDS):
        shared = sc.broadcast((model, share))
        mine = texts.filter(F.pmod("key", F.lit(ROUNDS)) == turn).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        dealt = mine.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "symbols").select("shard", "symbols")
        flat = _averaged(dealt.mapInArrow(_train(shared, turn), PARAMETERS_DDL), shards)
        if flat is not None:
            model = model.filled(flat)
        shared.unpersist()
    scratch.drop(texts)
    model.normalise()

    own = scratch.keep(words.mapInArrow(_score(sc.broadcast((model, lexicon))), SCORED_DDL), "scores")
    scratch.drop(words)
    far = own.select("chunk", "row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("chunk", "row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    far = far.join(counts.drop("class"), "word").groupBy("chunk", "row").agg(F.sum("times").alias("far_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("far_logs"))
    out = own.drop("words", "times").join(far, ["chunk", "row"], "left")
    known, logs = F.coalesce("far_known", F.lit(0)), F.coalesce("far_logs", F.lit(0.0))
    return out.select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("logs") + logs - F.col("n_tokens") * float(np.log10(total + kinds + 1.0))).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + logs).alias("score"),
    )
