"""Motifs of clusters by expectation maximisation, their best places in all sequences with exact p-values, and likeness between motifs.

Sequences have at most one site of a motif, on either strand. A cluster is a group (it has at most MOST sequences): the words that
many of its sequences share are counted, and from them a model is fitted for each width. Scans deal blocks of motifs times chunks of sequences.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables
from .sequences import revcomp

LETTERS = "ACGT"
#: Widths that are tried (each about the square root of two times the one before), letters of the words to start from, and words a cluster.
WIDTHS, CORE, STARTS = (6, 8, 11, 15, 21), 6, 8
#: Letters of the background added to a column's counts; steps from each start, steps from the best of them, gain at which these end.
PRIOR, TRIES, STEPS, GAIN = 0.5, 3, 40, 1e-5
#: Integer scores in a bit, and how much of the background is mixed into a matrix before its logarithms.
SCALE, PSEUDO = 10, 0.01
#: Motifs of a block; letters of a chunk of sequences.
BLOCK, CHUNK = 32, 1 << 18


def base_frequencies(seqs: DataFrame) -> DataFrame:
    """One row: a, c, g, t of both strands, with one of each letter more."""
    count = lambda x: F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(x))))
    n = seqs.agg(*[F.coalesce(count(x), F.lit(0)).alias(x) for x in LETTERS])
    weak, total = F.col("A") + F.col("T") + 2, 2 * (F.col("A") + F.col("C") + F.col("G") + F.col("T") + 4)
    return n.select((weak / total).alias("a"), (0.5 - weak / total).alias("c"), (0.5 - weak / total).alias("g"), (weak / total).alias("t"))


def words(seqs: DataFrame, length: int = CORE) -> DataFrame:
    """Words of A, C, G, T in (cluster, id, seq), each as the smaller of itself and its reverse complement: cluster, word, n (sequences that have it)."""
    starts = F.sequence(F.lit(1), F.length("seq") - length + 1)
    d = seqs.filter(F.length("seq") >= length).select("cluster", "id", F.explode(F.transform(starts, lambda i: F.substring(F.upper("seq"), i, F.lit(length)))).alias("word"))
    d = d.filter(F.col("word").rlike("^[ACGT]+$")).select("cluster", "id", F.least("word", revcomp(F.col("word"))).alias("word")).distinct()
    return d.groupBy("cluster", "word").agg(F.count("*").alias("n"))


def best_words(seqs: DataFrame, length: int = CORE, most: int = STARTS) -> DataFrame:
    """(cluster, words): those that most sequences have, ties alphabetical."""
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "word"))
    d = words(seqs, length).withColumn("_i", place).filter(F.col("_i") <= most)
    return d.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]).alias("words"))


def shared_words(seqs: list[str], ids: list, length: int = CORE, most: int = STARTS) -> list[str]:
    """``best_words`` of one cluster, where its sequences are."""
    codes, owner, _, reverse = windows(seqs, length)
    place = 4 ** np.arange(length)[::-1]
    forward = codes[~reverse].astype(np.int64)
    word = np.minimum(forward @ place, (3 - forward[:, ::-1]) @ place)
    number = {x: i for i, x in enumerate(ids)}
    own = np.array([number[x] for x in ids], np.int64)[owner[~reverse]]
    found, n = np.unique(np.unique(own * 4**length + word) % 4**length, return_counts=True)
    return ["".join(LETTERS[w // k % 4] for k in place) for w in found[np.lexsort((found, -n))][:most].tolist()]


def coded(seq: str) -> np.ndarray:
    table = np.full(256, 4, np.int8)
    table[[ord(x) for x in LETTERS]] = np.arange(4)
    return table[np.frombuffer(seq.upper().encode("ascii", "replace"), np.uint8)]


def windows(seqs: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places of a motif, on both strands, where no other letter stands: letters (n, width), sequence, start (from 0), reverse; by sequence."""
    codes, owner, start, reverse = [], [], [], []
    for i, s in enumerate(seqs):
        if len(s) < width:
            continue
        w = np.lib.stride_tricks.sliding_window_view(coded(s), width)
        at = np.flatnonzero((w < 4).all(1))
        codes += [w[at], 3 - w[at][:, ::-1]]
        owner.append(np.full(2 * len(at), i))
        start += [at, at]
        reverse += [np.zeros(len(at), bool), np.ones(len(at), bool)]
    if not codes:
        return np.empty((0, width), np.int8), *(np.empty(0, t) for t in (np.int64, np.int64, bool))
    return np.concatenate(codes), np.concatenate(owner), np.concatenate(start), np.concatenate(reverse)


def step(hot: np.ndarray, first: np.ndarray, theta: np.ndarray, share: float, base: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float]:
    """One step of expectation maximisation: the new matrix, the new share of sequences with a site, weights of places under the
    old ones, and the old ones' log likelihood ratio to the background with the prior's part. hot: places with a
    letter as four numbers; first: the first place of each sequence; sequences count alike however many places they have."""
    counts, weights, whole = expected(hot, first, theta, share, base)
    value = float(np.log(whole).sum() + PRIOR * (base * np.log(theta)).sum())
    new = (counts + PRIOR * base) / (counts.sum(1, keepdims=True) + PRIOR)
    return new, float(np.clip(weights.sum() / len(first), 0.01, 0.99)), weights, value


def expected(hot: np.ndarray, first: np.ndarray, theta: np.ndarray, share: float, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a step sums over sequences, so parts of them can be added up: letters of the sites, places' weights, likelihood ratios of the sequences."""
    places = np.diff([*first, len(hot)])
    ratio = np.exp(hot @ np.log(theta / base).ravel())
    prior = np.repeat(share / places, places)
    whole = 1 - share + np.add.reduceat(prior * ratio, first)
    weights = prior * ratio / np.repeat(whole, places)
    return (weights @ hot).reshape(-1, 4), weights, whole


#: Sequences of a part in which first steps are taken.
PART = 500


def first_steps(seqs: DataFrame, base: DataFrame) -> DataFrame:
    """(cluster, pos, a, c, g, t, share): one step from each cluster's best word. A cluster may have any number of sequences (cluster, id, seq): they are
    taken where they are, in parts, and only sums of letters and weights meet."""
    own = np.array(list(base.first()))
    kind = dict(seqs.dtypes)["cluster"]

    def sums(batches):
        held: dict = {}
        for p in batches:
            for (cluster, word), g in p.groupby(["cluster", "word"], dropna=False):
                theta = started(word, CORE, own)
                for i in range(0, len(g), PART):
                    codes, owner, _, _ = windows(g["seq"].iloc[i : i + PART].tolist(), CORE)
                    first = np.flatnonzero(np.diff(owner, prepend=-1))
                    if len(first):
                        counts, weights, _ = expected(np.eye(4)[codes].reshape(len(codes), -1), first, theta, 0.5, own)
                        old = held.get(cluster, (0, 0, 0))
                        held[cluster] = old[0] + counts, old[1] + weights.sum(), old[2] + len(first)
        rows = [(c, k + 1, *counts[k].tolist(), float(mass), n) for c, (counts, mass, n) in held.items() for k in range(CORE)]
        yield pd.DataFrame(rows, columns=["cluster", "pos", *"acgt", "mass", "n"])

    start = best_words(seqs, most=1).select("cluster", F.col("words")[0].alias("word"))
    d = seqs.filter("seq IS NOT NULL").select("cluster", "seq").join(F.broadcast(start), "cluster")  # a row a cluster
    d = d.mapInPandas(sums, f"cluster {kind}, pos long, a double, c double, g double, t double, mass double, n long")
    d = d.groupBy("cluster", "pos").agg(*[F.sum(x).alias(x) for x in ("a", "c", "g", "t", "mass", "n")])
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t") + PRIOR
    letters = [((F.col(x) + PRIOR * float(b)) / total).alias(x) for x, b in zip("acgt", own, strict=True)]
    return d.select("cluster", "pos", *letters, F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("mass") / F.col("n"))).alias("share"))


def started(word: str, width: int, base: np.ndarray) -> np.ndarray:
    """A matrix that has the word in its middle (or the word's middle) and the background around."""
    codes = coded(word)[max(0, (len(word) - width) // 2) :][:width]
    theta = np.tile(base, (width, 1))
    at = (width - len(codes)) // 2
    theta[at : at + len(codes)] *= 0.4
    theta[np.arange(at, at + len(codes)), codes] += 0.6
    return theta


def fit(codes: np.ndarray, first: np.ndarray, starts: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The matrix, the places' weights and the course of the likelihood from the start that is ahead after TRIES steps."""
    width = codes.shape[1]
    hot = np.eye(4)[codes].reshape(len(codes), -1)

    def climb(theta: np.ndarray, share: float, steps: int) -> tuple[np.ndarray, float, np.ndarray, list[float]]:
        course: list[float] = []
        for _ in range(steps):
            new, next_share, weights, value = step(hot, first, theta, share, base)
            course.append(value)
            if len(course) > 1 and value - course[-2] < GAIN * abs(value):
                break
            theta, share = new, next_share
        return theta, share, weights, course

    theta, share = ahead(hot, first, np.stack([started(w, width, base) for w in starts]), base)
    theta, _, weights, course = climb(theta, share, STEPS)
    return theta, weights, course


def ahead(hot: np.ndarray, first: np.ndarray, thetas: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, float]:
    """The matrix and the share that lead after TRIES steps from each of the matrices; all of them take a step (see ``step``) in one product."""
    m, width, _ = thetas.shape
    places = np.diff([*first, len(hot)])
    each = np.repeat(1 / places, places)
    shares, values, climbing = np.full(m, 0.5), np.full(m, -np.inf), np.ones(m, bool)
    for _ in range(TRIES):
        weights = np.exp(np.log(thetas / base).reshape(m, -1) @ hot.T)
        weights *= shares[:, None] * each
        whole = (1 - shares)[:, None] + np.add.reduceat(weights, first, axis=1)
        value = np.log(whole).sum(1) + PRIOR * (base * np.log(thetas)).sum((1, 2))
        weights /= np.repeat(whole, places, axis=1)
        counts = (weights @ hot).reshape(m, width, 4)
        with np.errstate(invalid="ignore"):
            on = climbing & ~(value - values < GAIN * np.abs(value))
        values = np.where(climbing, value, values)
        climbing = on
        thetas = np.where(on[:, None, None], (counts + PRIOR * base) / (counts.sum(2, keepdims=True) + PRIOR), thetas)
        shares = np.where(on, np.clip(weights.sum(1) / len(first), 0.01, 0.99), shares)
    best = int(np.argmax(values))
    return thetas[best], float(shares[best])


def log_gamma_tail(a: float, x: float) -> float:
    """Natural log of the upper tail of the gamma distribution of shape a, beyond x."""
    if x <= 0:
        return 0.0
    lead = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # by the series of the lower part
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return math.log1p(-min(math.exp(lead) * total, 1 - 1e-16))
    b = x + 1 - a  # by the continued fraction
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead + math.log(h)


def log_evalue(codes: np.ndarray, places: np.ndarray, sequences: int, base: np.ndarray) -> tuple[float, float]:
    """Natural log of the number of such motifs expected by chance, and the sites' log likelihood ratio (natural).

    Twice the ratio of sites to the background is taken as chi-square with three degrees a column; times the ways to choose
    the sequences and a place in each. codes: letters of the sites; places: how many places each one's sequence has.
    """
    n, width = codes.shape
    share = np.stack([(codes == b).sum(0) for b in range(4)], 1) / n
    ratio = float(n * np.where(share > 0, share * np.log(np.where(share > 0, share, 1) / base), 0).sum())
    ways = math.lgamma(sequences + 1) - math.lgamma(n + 1) - math.lgamma(sequences - n + 1)
    return log_gamma_tail(1.5 * width, ratio) + float(np.log(places).sum()) + ways, ratio


SITE = "struct<id:{id},start:int,reverse:boolean,weight:double,seq:string>"


def _models(seqs: DataFrame, base: list[float], widths: tuple[int, ...]) -> DataFrame:
    """(cluster, width, evalue, llr, pssm, sites): of each cluster and width the best model, where two sequences or more have a site."""
    own = np.array(base)
    columns = ["cluster", "width", "evalue", "llr", "pssm", "sites"]

    def models(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", ignore_index=True)
        seqs, ids = p["seq"].tolist(), p["id"].tolist()
        starts = shared_words(seqs, ids)
        found = [model(seqs, ids, starts, w) for w in widths] if starts else []
        return pd.DataFrame([[p["cluster"].iloc[0], *x] for x in found if x], columns=columns)

    def model(seqs: list[str], ids: list, starts: list[str], width: int) -> list | None:
        codes, owner, start, reverse = windows(seqs, width)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(first) < 2:
            return None
        theta, weights, _ = fit(codes, first, starts, own)
        ends = [*first[1:], len(codes)]
        best = np.array([i + weights[i:j].argmax() for i, j in zip(first, ends, strict=True)])
        mass = np.add.reduceat(weights, first)
        best, places = best[mass > 0.5], np.diff([*first, len(codes)])[mass > 0.5]
        if len(best) < 2:
            return None
        logs, ratio = log_evalue(codes[best], places, len(first), own)
        text = lambda i: "".join(LETTERS[c] for c in codes[i])
        sites = [{"id": ids[owner[i]], "start": int(start[i]) + 1, "reverse": bool(reverse[i]), "weight": float(weights[i]), "seq": text(i)} for i in best.tolist()]
        return [width, math.exp(min(logs, 700)), ratio, theta.tolist(), sites]

    kinds = {f.name: f.dataType.simpleString() for f in seqs.schema}
    ddl = f"cluster {kinds['cluster']}, width int, evalue double, llr double, pssm array<array<double>>, sites array<{SITE.format(id=kinds['id'])}>"
    return tables.spread(seqs.filter("seq IS NOT NULL").select("cluster", "id", "seq"), "cluster").groupBy("cluster").applyInPandas(models, ddl)


def masked_sites(seqs: DataFrame, found: DataFrame) -> DataFrame:
    """Sequences with found sites as N."""
    d = found.select("cluster", "width", F.explode("sites").alias("s")).select("cluster", F.col("s.id").alias("id"), F.col("s.start").alias("_at"), "width")
    cut = F.overlay("seq", F.repeat(F.lit("N"), F.col("width")), F.col("_at"))
    return seqs.join(d, ["cluster", "id"], "left").select("cluster", "id", F.coalesce(cut, "seq").alias("seq"))


def discover(seqs: DataFrame, base: DataFrame, motifs: int = 2, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Up to so many motifs of each cluster of (cluster, id, seq): cluster, motif_num, width, evalue, llr, pssm (rows of a, c, g, t), sites.

    Of the widths the one of least e-value is kept; its sites are masked before the next motif. base: one row of a, c, g, t.
    A cluster has at most as many sequences as ``cluster_sequences`` lets through; one without a site in two has no motif.
    """
    row = list(base.first())
    return in_turn(seqs.select("cluster", "id", F.upper("seq").alias("seq")), motifs, lambda s: _models(s, row, widths))


def in_turn(seqs: DataFrame, motifs: int, models: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best model of each cluster, then, with its sites masked, the next one; models: cluster, width, evalue, llr, pssm, sites."""
    out = []
    for i in range(motifs):
        place = F.row_number().over(W.partitionBy("cluster").orderBy("evalue", "width"))
        found = models(seqs).withColumn("_i", place).filter("_i = 1").drop("_i")
        found = tables.keep(found.withColumn("motif_num", F.lit(i + 1)), "motifs")
        out.append(found)
        if i + 1 < motifs:
            seqs = tables.keep(masked_sites(seqs.join(found.select("cluster"), "cluster", "left_semi"), found), "masked")
    return reduce(DataFrame.unionByName, out).select("cluster", "motif_num", "width", "evalue", "llr", "pssm", "sites")


# ---- scanning


def integer_matrices(motifs: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``scores``: log2 of each number of ``pssm`` to its background, in SCALE parts of a bit, rounded."""
    b = F.array("a", "c", "g", "t")

    def row(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda x, y: x + y) + PSEUDO
        return F.transform(F.arrays_zip(r.alias("p"), F.col("_b").alias("b")), lambda x: F.floor(F.log2((x["p"] + PSEUDO * x["b"]) / total / x["b"]) * SCALE + 0.5).cast("int"))

    return motifs.crossJoin(F.broadcast(base.select(b.alias("_b")))).withColumn("scores", F.transform("pssm", row)).drop("_b")  # one row


def tail(scores: np.ndarray, base: np.ndarray) -> tuple[int, np.ndarray]:
    """The least score of a word, and for each score from it on the chance that a random word has it or a higher one."""
    low, chance = 0, np.ones(1)
    for r in scores:
        new = np.zeros(len(chance) + int(r.max() - r.min()))
        for s, b in zip((r - r.min()).tolist(), base.tolist(), strict=True):
            new[s : s + len(chance)] += b * chance
        low, chance = low + int(r.min()), new
    return low, np.cumsum(chance[::-1])[::-1]


def scan(motifs: DataFrame, seqs: DataFrame, base: DataFrame) -> DataFrame:
    """The best place of each motif (cluster, motif_num, pssm) in each sequence (id, seq) in which it has one: cluster, motif_num, id,
    position (from 1), reverse, score, hit_pvalue (of the place), pvalue (that the best of so many places scores so). Of equal places the
    first, forward before reverse. Every motif meets every sequence, as asked for: blocks of motifs times chunks of sequences."""
    own = np.array(list(base.first()))
    motifs = tables.keep(integer_matrices(motifs.select("cluster", "motif_num", "pssm"), base).drop("pssm"), "matrices")
    blocks = max(1, -(-motifs.count() // BLOCK))
    chunks = max(1, -(-(seqs.agg(F.sum(F.length("seq"))).first()[0] or 0) // CHUNK))
    left = motifs.withColumn("block", F.pmod(F.xxhash64("cluster", "motif_num"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = seqs.select("id", "seq").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    names = ["cluster", "motif_num", "id", "position", "reverse", "score", "hit_pvalue", "pvalue"]

    def best(m: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        matrices = [np.array([list(r) for r in x], np.int64) for x in m["scores"]]
        for width in sorted({len(x) for x in matrices} - {0}):
            codes, owner, start, reverse = windows(s["seq"].tolist(), width)
            if not len(codes):
                continue
            order = np.lexsort((reverse, start, owner))
            codes, owner, start, reverse = codes[order], owner[order], start[order], reverse[order]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            places = np.diff([*first, len(codes)])
            columns = np.ascontiguousarray(codes.T)
            for i, x in enumerate(matrices):
                if len(x) != width:
                    continue
                score = sum(r.take(c) for r, c in zip(x, columns, strict=True))
                top = np.maximum.reduceat(score, first)
                where = np.flatnonzero(score == np.repeat(top, places))
                where = where[np.searchsorted(where, first)]
                low, chance = tail(x, own)
                p = np.minimum(chance[top - low], 1)
                with np.errstate(divide="ignore"):
                    whole = -np.expm1(places * np.log1p(-p))
                out.append(pd.DataFrame({"cluster": m["cluster"].iloc[i], "motif_num": m["motif_num"].iloc[i], "id": s["id"].to_numpy()[owner[where]], "position": start[where] + 1, "reverse": reverse[where], "score": top, "hit_pvalue": p, "pvalue": whole}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    kinds = {f.name: f.dataType.simpleString() for d in (motifs, seqs) for f in d.schema}
    ddl = f"cluster {kinds['cluster']}, motif_num {kinds['motif_num']}, id {kinds['id']}, position int, reverse boolean, score int, hit_pvalue double, pvalue double"
    left, right = tables.spread(left, "block", "chunk"), tables.spread(right, "block", "chunk")
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(best, ddl)


def combined_pvalues(hits: DataFrame) -> DataFrame:
    """(cluster, id, pvalue): the chance that a cluster's motifs have so small a product of p-values in a sequence by chance."""
    d = hits.groupBy("cluster", "id").agg(F.sum(F.ln("pvalue")).alias("_s"), F.count("*").alias("_n"))
    term = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_n")), F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("t")), lambda a, i: F.struct((a["sum"] + a["t"]).alias("sum"), (a["t"] * -F.col("_s") / i).alias("t")))
    return d.select("cluster", "id", F.least(F.lit(1.0), F.exp("_s") * term["sum"]).alias("pvalue"))


def as_results(found: DataFrame, hits: DataFrame, seqs: DataFrame, genes: DataFrame) -> DataFrame:
    """Motifs as ``results.motif_tables`` takes them: annotations are hits by gene (genes: id, gene), sites have ten letters of
    their sequence (seqs: cluster, id, seq) on each side, as the site is read."""
    place = F.struct("gene", "position", "reverse", F.col("hit_pvalue").alias("pvalue"))
    own = hits.join(genes, "id").groupBy("cluster", "motif_num").agg(F.sort_array(F.collect_list(place)).alias("annotations"))  # a gene at most once
    d = found.select("cluster", "motif_num", "width", F.explode("sites").alias("s")).select("cluster", "motif_num", "width", "s.*").withColumnRenamed("seq", "site")
    d = d.join(seqs.select("cluster", "id", "seq"), ["cluster", "id"])
    before = F.expr("substring(seq, greatest(start - 10, 1), least(start - 1, 10))")
    behind = F.expr("substring(seq, start + width, 10)")
    sides = [F.when(F.col("reverse"), revcomp(b)).otherwise(a) for a, b in ((before, behind), (behind, before))]
    at = hits.select("cluster", "motif_num", "id", F.col("hit_pvalue").alias("pvalue"))
    site = F.struct(F.col("id").cast("string").alias("name"), "reverse", "start", F.coalesce("pvalue", F.lit(1.0)).alias("pvalue"), sides[0].alias("left"), F.col("site").alias("seq"), sides[1].alias("right"))
    sites = d.join(at, ["cluster", "motif_num", "id"], "left").groupBy("cluster", "motif_num").agg(F.sort_array(F.collect_list(site)).alias("sites"))  # of a cluster's sequences
    none = lambda c, d: F.coalesce(c, F.array().cast(d.schema[c].dataType)).alias(c)
    out = found.drop("sites").join(own, ["cluster", "motif_num"], "left").join(sites, ["cluster", "motif_num"], "left")
    return out.select("cluster", "motif_num", "evalue", "pssm", none("annotations", own), none("sites", sites))


# ---- comparison


def _columns(motifs: DataFrame, base: DataFrame) -> DataFrame:
    """Motifs with their columns as shares, the background mixed in by PSEUDO."""
    b = F.array("a", "c", "g", "t")

    def row(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda x, y: x + y) + PSEUDO
        return F.transform(F.arrays_zip(r.alias("p"), F.col("_b").alias("b")), lambda x: (x["p"] + PSEUDO * x["b"]) / total)

    return motifs.crossJoin(F.broadcast(base.select(b.alias("_b")))).withColumn("rows", F.transform("pssm", row)).drop("_b", "pssm")  # one row


#: Levels of a distance between columns, columns that must lie over each other.
LEVELS, OVERLAP = 100, 4


def distances(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Euclidean distance of all pairs of columns, in whole LEVELS of the greatest there is."""
    d = np.sqrt(((query[:, None, :] - target[None, :, :]) ** 2).sum(2))
    return np.floor(d / math.sqrt(2) * LEVELS + 0.5).astype(np.int64)


def overlaps(query: int, target: int, least: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Places of a target on a query: first column of either, and length; the least is cut to the shorter motif."""
    least = min(least, query, target)
    out = []
    for shift in range(least - target, query - least + 1):
        i, j = max(0, shift), max(0, -shift)
        out.append((i, j, min(query - i, target - j)))
    return out


def nulls(table: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Of every run of the query's columns (first, length) the chance of each sum of distances or a smaller one, a target's column being
    any of the targets' alike. table: (query's columns, levels): how often each distance occurs."""
    chance = table / table.sum(1, keepdims=True)
    out = {}
    for i in range(len(chance)):
        now = np.ones(1)
        for j in range(i, len(chance)):
            now = np.convolve(now, chance[j])
            out[i, j - i + 1] = np.minimum(np.cumsum(now), 1)
    return out


def compare(motifs: DataFrame, base: DataFrame, *, threshold: float = 0.5, overlap: int = OVERLAP) -> DataFrame:
    """Likeness of motifs (id, pssm) to each other: motif_info_id1 (the query), motif_info_id2, pvalue up to ``threshold``, shift (columns from
    the query's begin to the target's), reverse (the target's other strand), overlap.

    Columns are compared by Euclidean distance, their sum over an overlap has a p-value under the query's own null, in which all columns of
    all motifs, on both strands, are alike probable; the least of all places counts, corrected for how many there are. Of
    equal ones the longer overlap, forward, the smaller shift. The null needs only counts of distances: a row a query's column and level.
    Queries and targets meet in blocks of 4 BLOCK by 4 BLOCK. A column ``copies`` says for how many motifs a matrix stands: its columns count so
    often, and of more than one there is a pair of the matrix with itself.
    """
    copies = F.col("copies") if "copies" in motifs.columns else F.lit(1).cast("long")
    made = tables.keep(_columns(motifs.filter(F.size("pssm") > 0).select("id", "pssm", copies.alias("copies")), base), "columns")
    blocks = max(1, -(-made.count() // (4 * BLOCK)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    kind = dict(made.dtypes)["id"]
    left, right = made.withColumn("q", block).withColumn("t", every), made.withColumn("t", block).withColumn("q", every)
    matrix = lambda x: np.array([list(r) for r in x], float)
    both = lambda p: [(i, [m, m[::-1, ::-1]]) for i, m in ((i, matrix(r)) for i, r in zip(p["id"], p["rows"], strict=True))]

    def count(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=["id", "col", "counts"])
        targets = np.concatenate([m for _, strands in both(t) for m in strands])
        times = np.repeat(t["copies"].to_numpy(), [2 * len(r) for r in t["rows"]])
        out = []
        for i, (m, _) in both(q):
            d = distances(m, targets)
            out += [(i, c, np.bincount(d[c], weights=times, minlength=LEVELS + 1).astype(np.int64).tolist()) for c in range(len(m))]
        return pd.DataFrame(out, columns=["id", "col", "counts"])

    met = lambda a, b: tables.spread(a, "q", "t").groupBy("q", "t").cogroup(tables.spread(b, "q", "t").groupBy("q", "t"))
    counts = met(left, right).applyInPandas(count, f"id {kind}, col int, counts array<long>")
    level = counts.select("id", "col", F.posexplode("counts").alias("level", "n")).groupBy("id", "col", "level").agg(F.sum("n").alias("n"))
    column = level.groupBy("id", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "n"))), lambda x: x["n"]).alias("n"))
    table = column.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "n"))), lambda x: x["n"]).alias("null"))  # a motif's columns
    left = tables.keep(made.join(table, "id"), "nulls").withColumn("q", block).withColumn("t", every)
    names = ["motif_info_id1", "motif_info_id2", "pvalue", "shift", "reverse", "overlap"]

    def match(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        """A query against all targets of a width at once."""
        out = [pd.DataFrame(columns=names)]
        by_width: dict[int, list] = {}
        for j, strands in both(t):
            by_width.setdefault(len(strands[0]), []).append((j, strands))
        stacked = {w: (np.array([j for j, _ in x], object), [np.stack([s[k] for _, s in x]) for k in (0, 1)]) for w, x in by_width.items()}
        for i, m, n, times in zip(q["id"], q["rows"], q["null"], q["copies"], strict=True):
            m, chances = matrix(m), nulls(matrix(n))
            for width, (ids, strands) in stacked.items():
                places = overlaps(len(m), width, overlap)
                best = np.full(len(ids), np.inf)
                how = np.zeros((len(ids), 3), np.int64)  # shift, reverse, overlap
                for reverse, targets in enumerate(strands):
                    d = distances(m, targets.reshape(-1, 4)).reshape(len(m), len(ids), width)
                    for a, b, k in sorted(places, key=lambda x: (-x[2], x[0] - x[1])):
                        p = chances[a, k][d[np.arange(a, a + k), :, np.arange(b, b + k)].sum(0)]
                        better = (p < best * (1 - 1e-12)) | ((p <= best * (1 + 1e-12)) & (k > how[:, 2]))
                        best[better], how[better] = p[better], (a - b, reverse, k)
                with np.errstate(divide="ignore"):
                    p = -np.expm1(2 * len(places) * np.log1p(-np.minimum(best, 1)))
                keep = (p <= threshold) & ((ids != i) | (times > 1))
                out.append(pd.DataFrame({"motif_info_id1": i, "motif_info_id2": ids[keep], "pvalue": p[keep], "shift": how[keep, 0], "reverse": how[keep, 1] > 0, "overlap": how[keep, 2]}))
        out = [x for x in out if len(x)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    ddl = f"motif_info_id1 {kind}, motif_info_id2 {kind}, pvalue double, shift int, reverse boolean, overlap int"
    return met(left, right).applyInPandas(match, ddl)


def compare_classes(motifs: DataFrame, base: DataFrame, **more) -> DataFrame:
    """``compare`` with motifs of the same matrix as one: pairs of classes under their smallest ids (kind "pair"; of a class with itself where it has
    several motifs), and each motif (motif_info_id1) with its class (motif_info_id2; kind "member"). Motifs are like each other where their classes are."""
    motifs = tables.keep(motifs.select("id", "pssm").filter(F.size("pssm") > 0), "motifs")
    classes = tables.keep(motifs.groupBy("pssm").agg(F.min("id").alias("class"), F.count("*").alias("copies")), "classes")
    pairs = compare(classes.withColumnRenamed("class", "id"), base, **more)
    members = motifs.join(classes, "pssm").select(F.lit("member").alias("kind"), F.col("id").alias("motif_info_id1"), F.col("class").alias("motif_info_id2"))
    return pairs.withColumn("kind", F.lit("pair")).unionByName(members, allowMissingColumns=True)
