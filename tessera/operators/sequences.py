"""DNA sequences (id, seq), k-mers, backgrounds and position-specific matrices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters that stand for several bases, and the first of the bases each stands for.
DEGENERATE = {"R": "G", "Y": "T", "K": "G", "M": "A", "S": "G", "W": "A", "N": "G"}
#: Two and three bases as one letter.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B"}


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def subsequence(seq: Column, start: Column, stop: Column, reverse: Column) -> Column:
    """From start (1-based) to before stop, both cut to the sequence, reversed and complemented if asked."""
    first, last = F.greatest(start, F.lit(1)), F.least(stop, F.length(seq) + 1)
    part = F.when(last > first, F.substring(seq, first.cast("int"), (last - first).cast("int"))).otherwise("")
    return F.when(reverse, revcomp(part)).otherwise(part)


def upstream(seq: Column, start: Column, end: Column, reverse: Column, near: int, far: int) -> Column:
    """The window from ``near`` to ``far`` before a gene: behind its end on the reverse strand."""
    a = F.when(reverse, end + 1 + near).otherwise(start - 1 - far)
    b = F.when(reverse, end + 1 + far).otherwise(start - 1 - near)
    return subsequence(seq, a, b, reverse)


def downstream(seq: Column, start: Column, end: Column, reverse: Column, near: int, far: int) -> Column:
    """The window from ``near`` to ``far`` after a gene: before its start on the reverse strand."""
    a = F.when(reverse, start - far).otherwise(end + near)
    b = F.when(reverse, start - near).otherwise(end + far)
    return subsequence(seq, a, b, reverse)


def masked(seq: Column, distance: int) -> Column:
    """Four letters from ``distance`` on as N."""
    return F.when(F.length(seq) >= distance + 4, F.overlay(seq, F.lit("NNNN"), F.lit(distance + 1))).otherwise(seq)


def unique_sequences(seqs: DataFrame, by: str = "cluster") -> DataFrame:
    """Of a cluster's equal sequences the one of the smallest id."""
    first = F.row_number().over(W.partitionBy(by, "seq").orderBy("id"))
    return seqs.withColumn("_i", first).filter("_i = 1").drop("_i")


def concrete(seq: Column) -> Column:
    """Degenerate letters as the first base they stand for; white space gone at the ends."""
    return F.translate(F.regexp_replace(F.upper(seq), r"^\s+|\s+$", ""), "".join(DEGENERATE), "".join(DEGENERATE.values()))


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """All words of k letters (place from 0, kmer), in alphabetical order: a place's digits to base four."""
    d = spark.range(4**k).withColumnRenamed("id", "place")
    digit = lambda i: F.substring(F.lit("ACGT"), (F.shiftright("place", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return d.select("place", F.concat(*[digit(i) for i in range(k - 1, -1, -1)]).alias("kmer"))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """Counts of all windows of k letters: k, kmer, times."""
    d = seqs.filter(F.length("seq") >= k).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring(F.col("seq"), i, F.lit(k)))).alias("kmer"))
    return d.groupBy("kmer").agg(F.count("*").alias("times")).select(F.lit(k).cast("long").alias("k"), "kmer", "times")


def background(seqs: DataFrame, order: int, *, both_strands: bool = False) -> DataFrame:
    """Markov background: frequencies of all k-mers for k from 1 to order + 1, within their k."""
    d = seqs.select("seq")
    if both_strands:
        d = d.distinct().unionByName(d.distinct().select(revcomp(F.col("seq")).alias("seq")))
    d = d.withColumn("seq", concrete(F.col("seq")))
    counts = kmers(d, 1)
    for k in range(2, order + 2):
        counts = counts.unionByName(kmers(d, k))
    total = counts.groupBy("k").agg(F.sum("times").alias("_t"))
    return counts.join(total, "k").select("k", "kmer", (F.col("times") / F.col("_t")).alias("freq"))


def fasta_lines(seqs: DataFrame) -> DataFrame:
    return seqs.filter(F.length("seq") > 0).select("id", F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.col("seq")).alias("text"))


def letter(a: Column, c: Column, g: Column, t: Column) -> Column:
    """The largest base of a row, the first of equals; n below 0.4, small below 0.7."""
    top = F.greatest(a, c, g, t)
    base = F.when(a == top, "A").when(c == top, "C").when(g == top, "G").otherwise("T")
    return F.when(top < 0.4, "n").when(top < 0.7, F.lower(base)).otherwise(base)


def largest_letter(a: Column, c: Column, g: Column, t: Column) -> Column:
    top = F.greatest(a, c, g, t)
    return F.when(a == top, "A").when(c == top, "C").when(g == top, "G").otherwise("T")


def consensus(rows: DataFrame, by: list[str], pos: str = "pos", how=letter) -> DataFrame:
    d = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), how(F.col("a"), F.col("c"), F.col("g"), F.col("t")).alias("l")))).alias("_l"))
    return d.select(*by, F.array_join(F.transform("_l", lambda x: x["l"]), "").alias("consensus"), F.size("_l").cast("long").alias("length"))


def iupac_letter(a: Column, c: Column, g: Column, t: Column, two: float = 0.6, three: float = 0.8) -> Column:
    """One base if it has ``two`` of the weight, else the letter of the two largest if they do, of the three if they have ``three``, else N."""
    s = F.sort_array(F.array(*[F.struct(-x, F.lit(b).alias("b"), x.alias("w")) for x, b in ((a, "A"), (c, "C"), (g, "G"), (t, "T"))]))
    of = lambda n: F.array_join(F.array_sort(F.transform(F.slice(s, 1, n), lambda x: x["b"])), "")
    weight = lambda n: sum((F.element_at(s, i)["w"] for i in range(2, n + 1)), F.element_at(s, 1)["w"])
    names = F.create_map(*[F.lit(x) for p in IUPAC.items() for x in p])
    return F.when(weight(1) >= two, of(1)).when(weight(2) >= two, F.element_at(names, of(2))).when(weight(3) >= three, F.element_at(names, of(3))).otherwise("N")


def log_odds(p: Column, freq: Column) -> Column:
    """round(log2(p / freq)), p = 0 as 0.01."""
    return F.round(F.log2(F.when(p == 0, 0.01).otherwise(p) / freq))


def low_complexity_masked(seqs: DataFrame, window: int = 64, level: float = 2.0) -> DataFrame:
    """Sequences with stretches of few different triplets as N: windows in which the pairs of equal triplets,
    over the number of triplets less one, are more than ``level``."""

    def mask(seq: str) -> str:
        out = list(seq)
        for start in range(0, max(1, len(seq) - window // 2), window // 2):
            part = seq[start : start + window].upper()
            n = len(part) - 2
            if n < 2:
                continue
            counts: dict[str, int] = {}
            for i in range(n):
                counts[part[i : i + 3]] = counts.get(part[i : i + 3], 0) + 1
            if sum(c * (c - 1) / 2 for c in counts.values()) / (n - 1) > level:
                out[start : start + window] = "N" * len(part)
        return "".join(out)

    def masked_(s: pd.Series) -> pd.Series:
        return s.map(lambda x: mask(x) if isinstance(x, str) else None)

    return seqs.withColumn("seq", F.pandas_udf(masked_, "string", F.PandasUDFType.SCALAR)("seq"))
