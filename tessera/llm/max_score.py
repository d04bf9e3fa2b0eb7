"""Exact top-k inner products of integer vectors by MaxScore over postings of their dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow, scratch

#: Vectors of a shard, queries of a block, and how many shards' answers one merge takes.
SHARD_ROWS, BLOCK_QUERIES, MERGE = 8192, 1024, 64
SEEDS = 96
LARGEST = (1 << 63) - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is or holds null or a non-finite one."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(v.isNotNull() & fine, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


class Shard:
    """Postings by dimension: the rows with a component other than 0, and its values."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: list[np.ndarray]):
        order = np.lexsort((keys, ids))
        self.ids, self.keys = ids[order], keys[order]
        width = max((len(v) for v in vectors), default=0)
        dense = np.zeros((width, len(ids)), np.int64)
        for j, i in enumerate(order.tolist()):
            dense[: len(vectors[i]), j] = vectors[i]
        self.most = int(np.abs(dense.astype(float)).max(initial=0.0))
        self.rows, self.values, self.high, self.low = [], [], [], []
        for d in range(width):
            rows = np.flatnonzero(dense[d])
            whole = len(rows) * 2 > len(ids)  # most rows: a value for each is shorter than rows and values
            self.rows.append(None if whole else rows)
            self.values.append(dense[d].copy() if whole else dense[d][rows])
            self.high.append(max(0, int(dense[d].max(initial=0))))
            self.low.append(min(0, int(dense[d].min(initial=0))))

    def _probe(self, d: int, at: np.ndarray) -> np.ndarray:
        rows, values = self.rows[d], self.values[d]
        if rows is None:
            return values[at]
        if not len(rows):
            return np.zeros(len(at), np.int64)
        place = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
        return np.where(rows[place] == at, values[place], 0)

    def _exact(self, terms: list[tuple[int, int]], at: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(at), kind)
        for d, q in terms:
            out += q * self._probe(d, at).astype(kind)
        return out

    def search(self, own: int, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows but the query's own (by its key), ties to the smaller id."""
        n = len(self.ids)
        terms = [(d, q) for d, q in enumerate(query[: len(self.values)]) if q and (self.high[d] or self.low[d])]
        kind = np.int64 if sum(abs(q) for _, q in terms) * self.most < 1 << 62 else object  # beyond 64 bits by whole numbers of any size
        bound = {d: max(q * self.high[d], q * self.low[d]) for d, q in terms}
        terms.sort(key=lambda t: -bound[t[0]])
        mine = self.keys == own
        # a first threshold: exact scores of the rows that are best in the strongest dimensions
        least = None
        seeds = []
        for d, q in terms[:3]:
            values = self.values[d] * (1 if q > 0 else -1)
            m = min(SEEDS // 3, len(values))
            top = np.argpartition(values, len(values) - m)[len(values) - m :]
            seeds.append(top if self.rows[d] is None else self.rows[d][top])
        if seeds:
            first = np.unique(np.concatenate(seeds))
            first = first[~mine[first]]
            if len(first) >= k:
                least = np.sort(self._exact(terms, first, kind))[-k]
        # non-essential: the weakest dimensions that together stay below the threshold
        split, rest = len(terms), 0
        while split and least is not None and rest + bound[terms[split - 1][0]] < least:
            split -= 1
            rest += bound[terms[split][0]]
        score = np.zeros(n, kind)
        seen = np.zeros(n, bool) if split < len(terms) else None
        for d, q in terms[:split]:
            rows, values = self.rows[d], self.values[d]
            if rows is None:
                score += q * values.astype(kind, copy=False)
                if seen is not None:
                    seen |= values != 0
            else:
                score[rows] += q * values.astype(kind, copy=False)
                if seen is not None:
                    seen[rows] = True
        if seen is None:
            at = np.flatnonzero(~mine)
            got = score[at]
        else:
            at = np.flatnonzero(seen & ~mine)
            got = score[at]
        for d, q in terms[split:]:
            stay = got + rest >= least
            at, got = at[stay], got[stay]
            got = got + q * self._probe(d, at).astype(kind)
            rest -= bound[d]
        if least is not None:
            stay = got >= least
            at, got = at[stay], got[stay]
        order = np.lexsort((self.ids[at], -got))[:k] if kind is np.int64 else np.array(sorted(range(len(at)), key=lambda i: (-got[i], self.ids[at[i]]))[:k], np.int64)
        return self.ids[at[order]], np.array([max(-LARGEST - 1, min(LARGEST, int(x))) for x in got[order]], np.int64)


FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _vectors(lists: pa.Array) -> list[np.ndarray]:
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for b in arrow.full(batches):
            for row in range(b.num_rows):
                number, *lists = b.column(0)[row].as_py(), *[c[row].values for c in b.columns[1:]]
                ids, keys, vectors, asked_ids, asked_keys, asked = lists
                if number != last:
                    last, shard = number, Shard(ids.to_numpy(), keys.to_numpy(), _vectors(vectors))
                queries, names, found, scores = [], [], [], []
                for own, name, vector in zip(asked_keys.to_pylist(), asked_ids.to_pylist(), _vectors(asked), strict=True):
                    v, s = shard.search(own, vector.tolist(), k)
                    queries.append(np.full(len(v), own)), names.append(np.full(len(v), name)), found.append(v), scores.append(s)
                if queries and sum(map(len, found)):
                    got = np.concatenate(queries)
                    yield arrow.batch(FOUND, query=got, query_id=np.concatenate(names), shard=np.full(len(got), number), vec_id=np.concatenate(found), score=np.concatenate(scores))

    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The k highest integer inner products of each row whose id is divisible by ``query_mod``.

    Every query meets every shard of SHARD_ROWS vectors, in blocks of queries, so a task holds one shard
    and one block. In a shard the dimensions are terms; a term's bound is the most it can add. Terms in
    order of their bounds, the weakest ones whose bounds sum to less than the threshold are non-essential:
    a row in none of the essential postings can't enter. Essential postings are added up, the rest
    probed while a row's score with all that may still come reaches the threshold. Shards' answers merge in steps.

    Vectors that are null or hold a null or a non-finite component, and rows without an id, take no part.
    Vectors may differ in length, be empty or very long: what is missing counts as 0, and an empty one scores 0. Rows that
    share an id are rows of their own, as queries (each has its k) and as candidates, also of each other. Ties go to the
    smaller id. Scores beyond a long are cut to its range. An empty table gives none.

    Columns: query_id, rank (from 1), vec_id, score.
    """
    arrow.bound_batches(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    v = scratch.keep(v.withColumn("key", F.monotonically_increasing_id()), "vectors")
    queries = v.filter(F.col("id") % query_mod == 0)
    shards = max(1, -(-v.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    part = F.struct("id", "key", "v")
    data = v.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").agg(F.collect_list(part).alias("rows"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks))).groupBy("block").agg(F.collect_list(part).alias("asked"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    pairs = data.join(asked, "shard").repartition(shards * blocks, "shard", "block")
    columns = [F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in ("rows", "asked") for c in ("id", "key", "v")]
    found = pairs.select("shard", *columns).mapInArrow(_search(k), "query long, query_id long, shard long, vec_id long, score long")
    best = [F.col("score").desc(), "vec_id"]
    while shards > MERGE:
        found = found.withColumn("shard", F.floor(F.col("shard") / MERGE))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("query", "shard").orderBy(*best))).filter(F.col("rank") <= k).drop("rank")
        shards = -(-shards // MERGE)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
