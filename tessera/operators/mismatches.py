"""Words that a cluster's sequences share with some letters changed, and motifs made of the best of them.

A word counts for a sequence if a place on either strand differs from it in no more than so many letters. A letter is
two bits of a word's number, so all words at a distance come from one by exclusive or with fixed masks: only words
that occur are taken apart, and what they reach is marked in a table of all words, sequence by sequence.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from . import discovery as D
from .sequences import revcomp

#: Letters of the words whose counts are the background; longer words follow from these as a chain.
CONTEXT = 6
#: Lengths of words and changed letters that are searched together (short, then long), and percent of the sequences that must have a word.
SEARCHED, QUORUM = ((6, 1), (8, 2), (10, 3)), 50


def word_background(seqs: DataFrame, context: int = CONTEXT) -> np.ndarray:
    """Shares of all words of so many letters on both strands of (id, seq), each counted once more; a fixed number of rows comes to the driver."""
    starts = F.sequence(F.lit(1), F.length("seq") - context + 1)
    d = seqs.filter(F.length("seq") >= context).select(F.explode(F.transform(starts, lambda i: F.substring(F.upper("seq"), i, F.lit(context)))).alias("word"))
    d = d.filter(F.col("word").rlike("^[ACGT]+$")).groupBy("word").agg(F.count("*").alias("n"))
    counts = np.ones(4**context)
    for word, other, n in d.select("word", revcomp(F.col("word")), "n").collect():  # at most 4 ** context
        counts[number(word)] += n
        counts[number(other)] += n
    return counts / counts.sum()


def number(word: str) -> int:
    return sum(D.LETTERS.index(x) << 2 * i for i, x in enumerate(reversed(word)))


def spelled(n: int, length: int) -> str:
    return "".join(D.LETTERS[n >> 2 * i & 3] for i in reversed(range(length)))


def numbers(codes: np.ndarray) -> np.ndarray:
    """Of words as rows of letters."""
    return (codes.astype(np.int64) << 2 * np.arange(codes.shape[1])[::-1]).sum(1)


@cache
def masks(length: int, mismatches: int) -> tuple[np.ndarray, ...]:
    """By number of changed letters: what turns a word's number into those of all words so far from it."""
    return tuple(
        np.array([sum(v << 2 * i for i, v in zip(at, by, strict=True)) for at in combinations(range(length), k) for by in product((1, 2, 3), repeat=k)], np.int64)
        for k in range(mismatches + 1)
    )


def extended(shares: np.ndarray, length: int) -> np.ndarray:
    """Shares of all words of a length from those of shorter words as a chain; of the first letters, if the length is less."""
    context = int(round(math.log(len(shares), 4)))
    if length <= context:
        return shares.reshape(4**length, -1).sum(1)
    before = shares.reshape(-1, 4)
    follows = before / before.sum(1, keepdims=True)  # the next letter behind all but the first of a word
    out = shares
    for _ in range(length - context):
        tail = np.arange(len(out)) % len(follows)
        out = (out[:, None] * follows[tail]).ravel()
    return out


def near_shares(shares: np.ndarray, length: int, mismatches: int) -> np.ndarray:
    """(mismatches + 1, 4 ** length): the share of words that differ from each word in at most so many letters."""
    at = np.zeros((mismatches + 1, *[4] * length))
    at[0] = shares.reshape([4] * length)
    for axis in range(1, length + 1):
        other = at.sum(axis, keepdims=True) - at  # the letter here is another
        at[1:] += other[:-1]
    return np.minimum(1, np.cumsum(at.reshape(mismatches + 1, -1), axis=0))


def reached(words: np.ndarray, length: int, mismatches: int) -> np.ndarray:
    """Of all words: the least number of letters in which one of the given differs, or mismatches + 1."""
    out = np.full(4**length, mismatches + 1, np.int8)
    for k, m in reversed(list(enumerate(masks(length, mismatches)))):
        for part in np.array_split(words, max(1, len(words) * len(m) >> 22)):
            out[(part[:, None] ^ m).ravel()] = k
    return out


def scored(codes: np.ndarray, first: np.ndarray, near: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: sequences that have it, those that have it unchanged, and its score, a sum over the sequences of minus
    the log of the chance that as many places have it with as few changes as are found there. codes, first: places as in ``discovery.step``."""
    n, exact, score = np.zeros(4**length, np.int32), np.zeros(4**length, np.int32), np.zeros(4**length)
    logs = np.log1p(-np.minimum(near, 1 - 1e-12))
    words = numbers(codes)
    for i, j in zip(first, [*first[1:], len(words)], strict=True):
        least = reached(np.unique(words[i:j]), length, len(near) - 1)
        at = np.flatnonzero(least < len(near))
        n[at] += 1
        exact += least == 0
        score[at] -= np.log(-np.expm1((j - i) * logs[least[at], at]))
    return n, exact, score


def _own(length: int) -> np.ndarray:
    """Words that are not behind their reverse complement."""
    every = np.arange(4**length)
    other = np.zeros_like(every)
    for i in range(length):
        other = other << 2 | (3 - (every >> 2 * i & 3))
    return every <= other


def mismatch_words(seqs: DataFrame, background: np.ndarray, searched: tuple[tuple[int, int], ...] = SEARCHED, *, quorum: int = QUORUM, most: int | None = None) -> DataFrame:
    """Words that ``quorum`` percent of a cluster's sequences have within a number of changed letters: cluster, length, mismatches, word, n
    (sequences), exact (those with it unchanged), score; the best ``most`` of each length, or all.

    seqs: (cluster, id, seq), a cluster a group (see ``cluster_sequences`` for its bound) for each length; sequences without a place (shorter, or with other
    letters throughout) don't count. A word stands for its reverse complement too. Ties by word. background: see ``word_background``.
    """
    kind = dict(seqs.dtypes)["cluster"]
    columns = ["cluster", "length", "mismatches", "word", "n", "exact", "score"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        length, mismatches = int(p["length"].iloc[0]), int(p["mismatches"].iloc[0])
        codes, owner, _, _ = D.windows(p.sort_values("id")["seq"].tolist(), length)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(first):
            return pd.DataFrame(columns=columns)
        n, exact, score = scored(codes, first, _near(background, length, mismatches), length)
        at = np.flatnonzero((n * 100 >= quorum * len(first)) & (n > 0) & _own(length))
        at = at[np.lexsort((at, -score[at]))][:most]
        return pd.DataFrame({"cluster": p["cluster"].iloc[0], "length": length, "mismatches": mismatches, "word": pd.Series([spelled(x, length) for x in at], dtype=object), "n": n[at], "exact": exact[at], "score": score[at]}, columns=columns)

    d = seqs.filter("seq IS NOT NULL").select("cluster", "id", F.upper("seq").alias("seq"))
    lengths = F.explode(F.array(*[F.struct(F.lit(a).alias("length"), F.lit(b).alias("mismatches")) for a, b in searched]))
    d = d.withColumn("_l", lengths).select("cluster", "id", "seq", "_l.length", "_l.mismatches")
    return tables.spread(d, "cluster", "length", "mismatches").groupBy("cluster", "length", "mismatches").applyInPandas(run, f"cluster {kind}, length int, mismatches int, word string, n int, exact int, score double")


_NEAR: dict[tuple[bytes, int, int], np.ndarray] = {}


def _near(background: np.ndarray, length: int, mismatches: int) -> np.ndarray:
    """Kept in a Python worker, for the groups that follow: of one background only."""
    key = (background.tobytes(), length, mismatches)
    if key not in _NEAR:
        if any(k[0] != key[0] for k in _NEAR):
            _NEAR.clear()
        _NEAR[key] = near_shares(extended(background, length), length, mismatches)
    return _NEAR[key]


def _models(seqs: DataFrame, base: list[float], background: np.ndarray, length: int, mismatches: int, quorum: int) -> DataFrame:
    """Of each cluster the matrix of its best word's nearest places, one a sequence that has it, in the columns of ``discovery._models``."""
    own = np.array(base)
    columns = ["cluster", "width", "evalue", "llr", "pssm", "sites"]

    def model(p: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=columns)
        p = p.sort_values("id", ignore_index=True)
        codes, owner, start, reverse = D.windows(p["seq"].tolist(), length)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first) < 2:
            return none
        n, _, score = scored(codes, first, _near(background, length, mismatches), length)
        at = np.flatnonzero((n * 100 >= quorum * len(first)) & (n > 1) & _own(length))
        if not len(at):
            return none
        word = np.array([D.LETTERS.index(x) for x in spelled(at[np.argmax(score[at])], length)])
        far = (codes != word).sum(1)
        ends = [*first[1:], len(codes)]
        best = np.array([i + far[i:j].argmin() for i, j in zip(first, ends, strict=True)])
        near = far[best] <= mismatches
        best, places = best[near], np.diff([*first, len(codes)])[near]
        counts = np.stack([(codes[best] == b).sum(0) for b in range(4)], 1)
        theta = (counts + D.PRIOR * own) / (len(best) + D.PRIOR)
        logs, ratio = D.log_evalue(codes[best], places, len(first), own)
        sites = [
            {"id": p["id"].iloc[owner[i]], "start": int(start[i]) + 1, "reverse": bool(reverse[i]), "weight": 1 - far[i] / length, "seq": "".join(D.LETTERS[c] for c in codes[i])}
            for i in best.tolist()
        ]
        return pd.DataFrame([[p["cluster"].iloc[0], length, math.exp(min(logs, 700)), ratio, theta.tolist(), sites]], columns=columns)

    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema}
    ddl = f"cluster {kinds['cluster']}, width int, evalue double, llr double, pssm array<array<double>>, sites array<{D.SITE.format(id=kinds['id'])}>"
    return tables.spread(seqs, "cluster").groupBy("cluster").applyInPandas(model, ddl)


def word_motifs(seqs: DataFrame, base: DataFrame, motifs: int = 2, *, background: np.ndarray, length: int = 8, mismatches: int = 2, quorum: int = QUORUM) -> DataFrame:
    """Motifs as ``discovery.discover`` gives them, from the best word of each cluster and, with its places masked, the best of what is left.

    A motif's sites are the nearest places to the word (ties: on the given strand first, then the leftmost), one in each sequence that has it; the weight of
    a site is its share of unchanged letters. A cluster without a word in two sequences, and in ``quorum`` percent of them, has no motif.
    """
    row = list(base.first())
    d = seqs.filter("seq IS NOT NULL").select("cluster", "id", F.upper("seq").alias("seq"))
    return D.in_turn(d, motifs, lambda s: _models(s, row, background, length, mismatches, quorum))
