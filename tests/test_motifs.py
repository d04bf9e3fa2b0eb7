"""Motif scores, external tools and sequences of clusters."""

import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import membership, motifs, sequences
from tessera.sources import motifs as files


def test_mast_text():
    doc = """SECTION III: ANNOTATED SEQUENCES
**********


g1
  upstream of g1
  LENGTH = 250  COMBINED P-VALUE = 1.19e-02  E-VALUE =      4.8
  DIAGRAM: 9-[+1]-20-[-2]-200

              [+1]      [-2]
              4.2e-06   1.0e-05
              ACGTA     TTTTT
              +++++     +++++
1    CCCCCCCCCACGTACCCCCTTTTTCC

g2
  LENGTH = 250  COMBINED P-VALUE = 5.0e-01  E-VALUE =      99
  DIAGRAM: 250
"""
    got = files.mast_text(doc)
    assert [(r["gene"], r["pvalue"], r["motif_num"], r["position"]) for r in got] == [("g1", 0.0119, 1, 10), ("g1", 0.0119, -2, 20), ("g2", 0.5, None, None)]


def test_gene_and_cluster_sequences(spark):
    genes = spark.createDataFrame([("a",), ("b",), ("zz",)], "gene string")
    t = spark.createDataFrame([("a", "f1"), ("b", "f2")], "alias string, original string")
    f = spark.createDataFrame([("f1", "c", 6, 8, False), ("f2", "c", 2, 4, True)], "id string, contig string, start int, end int, reverse boolean")
    c = spark.createDataFrame([("c", "AACCGGTTAC")], "contig string, seq string")
    assert {r["gene"]: r["seq"] for r in motifs.gene_sequences(genes, t, f, c, 0, 3).collect()} == {"a": "ACC", "b": "ACC"}
    heads = spark.createDataFrame([("f1", "f2")], "head string, gene string")
    assert {r["gene"]: r["id"] for r in motifs.gene_sequences(genes, t, f, c, 0, 3, heads).collect()} == {"a": "f1", "b": "f1"}
    rows = spark.createDataFrame([(g, 0, k) for g, k in (("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 1))], "gene string, slot int, cluster long")
    s = spark.createDataFrame([("a", "1", "AA"), ("b", "2", "AC"), ("c", "3", "AG"), ("d", "4", "AA"), ("e", "5", "AA")], "gene string, id string, seq string")
    d = motifs.cluster_sequences(rows, s)
    assert sorted((r["cluster"], r["id"]) for r in d.collect()) == [(1, "1"), (1, "2"), (1, "3")]
    assert motifs.changed(d, d).count() == 0 and motifs.changed(d, d.filter("id <> '1'")).count() == 1


def test_external_tool(spark):
    d = spark.createDataFrame([(1, "s1", "ACGT"), (1, "s2", "GG"), (2, "s3", "A")], "cluster long, id string, seq string")
    parse = lambda out: [{"n": int(x)} for x in out.split()]
    command = [sys.executable, "-c", "import sys; print(open(sys.argv[1]).read().count('>'))", "{fasta}"]
    assert sorted(tuple(r) for r in motifs.run_tool(d, command, parse, "n int").collect()) == [(1, 2), (2, 1)]
    assert motifs.run_tool(d, ["no-such-tool"], parse, "n int").count() == 0
    assert motifs.run_tool(d, [sys.executable, "-c", "raise SystemExit(3)"], parse, "n int").count() == 0


def test_resumed_and_resplit(spark):
    m = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 2, 2), (2, 3, 1), (2, 1, 2)], "iteration int, cluster long, order_num int")
    n = spark.createDataFrame([(1, "abc"), (2, "Def")], "order_num int, name string")
    w = spark.createDataFrame([("ABC",), ("Def",), ("def",)], "gene string")
    assert sorted(tuple(r) for r in membership.resumed(m, n, w, "gene").collect()) == [("ABC", 0, 1), ("ABC", 1, 3), ("Def", 0, 1), ("Def", 1, 2)]
    p = spark.createDataFrame([(1, 5, 0.01), (1, 3, 0.05), (1, 4, 0.2)], "cond long, cluster long, pvalue double")
    assert sorted(tuple(r) for r in membership.resplit(p).collect()) == [(1, 0, 3), (1, 1, 5)]


def test_masks_and_scalars(spark):
    d = spark.createDataFrame([("A" * 80,), ("ACGTTGCAAGTCCATGACTGATCGTACGGATCCTAGCTTACGA",), (None,)], "seq string")
    got = [r["seq"] for r in sequences.low_complexity_masked(d).collect()]
    assert set(got[0]) == {"N"} and got[1].startswith("ACGT") and got[2] is None
    x = spark.range(1).select(
        scalars.log_clipped(F.lit(5000.0)).alias("a"), scalars.number_or_zero(F.lit(float("nan"))).alias("b"), scalars.outer(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)), lambda p, q: p * q).alias("c")
    ).first()
    assert x["a"] == pytest.approx(6.907755) and x["b"] == 0 and x["c"] == [[3], [6]]


def test_commands_of_the_tools(spark):
    assert motifs.meme_command("a.fa", "a.bg", 2)[:7] == ["meme", "a.fa", "-bfile", "a.bg", "-nmotifs", "2", "-maxw"]
    assert motifs.meme_command("a.fa", "a.bg", 1, seed="ACGT")[-2:] == ["-cons", "ACGT"]
    old, new = motifs.mast_command("4.3.0", "m", "s", "b", "o"), motifs.mast_command("4.11.4", "m", "s", "b", "o")
    assert old[:4] == ["mast", "m", "-d", "s"] and "-oc" not in old and new[:3] == ["mast", "m", "s"] and new[-2:] == ["-oc", "o"]
    assert "-q-thresh" in motifs.tomtom_command("4.8.1", "m") and motifs.tomtom_command("4.3.0", "m")[-4:] == ["-target", "m", "-query", "m"]
    assert {"-thresh", "-motif-pseudo"} <= set(motifs.tomtom_command("4.11.4", "m"))
    runs = motifs.weeder_commands("a.fa", "HS", analysis="extra", frequencies="ff")
    assert len(runs) == 5 and runs[-1] == ["adviser", "a.fa"] and runs[3][runs[3].index("-W") + 1] == "12" and runs[0][-2:] == ["-F", "ff"]
    d = spark.createDataFrame([(1, 1, 0.5, "acg"), (1, 2, 0.05, "ttg"), (2, 1, 0.2, "aaa")], "cluster int, motif_num int, evalue double, consensus string")
    assert [tuple(r) for r in motifs.seed_consensus(d).collect()] == [(1, "TTG")]
    w = spark.createDataFrame([(1, 1, [[0.25] * 4] * 6), (1, 2, [[0.25] * 4] * 8)], "cluster int, motif_num int, pssm array<array<double>>")
    assert [(r["cluster"], r["motif_num"]) for r in motifs.words_of(w).collect()] == [(1, 1)]
    hits = spark.createDataFrame([(1, "f1", 0.5), (1, "f1", 0.1), (1, "f9", 0.2)], "cluster int, id string, pvalue double")
    assert [tuple(r) for r in motifs.least_pvalues(hits, spark.createDataFrame([("f1", "g1")], "id string, name string")).collect()] == [(1, "g1", 0.1)]
