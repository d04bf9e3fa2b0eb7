"""Readers, writers, configuration and the loop; files of the fixtures are read where they exist."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import __main__ as command
from tessera.operators import enrichment, scoring
from tessera.plans.config import Config, Schedule, default_clusters, fuzzy_coefficient, scaling, vector
from tessera.plans.run import Run, functions_of
from tessera.sources import motifs, store, text, writers
from tessera.streaming import monitor


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_delimited(spark, tmp_path):
    p = put(tmp_path, "a.ssv", '# note\n\nh1;h2\n"v1";v"2\n   \n')
    got = text.delimited(spark, p, ";", header=True, comment="#", quote='"').orderBy("line").collect()
    assert [r["fields"] for r in got] == [["v1", "v2"]]
    assert text.delimited_header(spark, p, ";", comment="#", quote='"') == ["h1", "h2"]
    with gzip.open(tmp_path / "b.tsv.gz", "wt") as f:
        f.write("a\tb\nc\td\n")
    assert text.delimited(spark, str(tmp_path / "b.tsv.gz")).count() == 2


def test_matrix_round_trip(spark, tmp_path):
    p = put(tmp_path, "m.tsv", "\tx\ty\nb\t1.5\tNA\na\tNaN\t-2\n")
    m = text.matrix(spark, p, case_sensitive=False)
    assert {(r["row"], r["col"]): r["value"] for r in m.collect()} == {("B", "x"): 1.5, ("B", "y"): None, ("A", "x"): None, ("A", "y"): -2}
    writers.write_matrix(m, str(tmp_path / "out"), ["x", "y"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][0].startswith("x\ty")
    with pytest.raises(ValueError):
        text.matrix(spark, "http://host/m.tsv")


@pytest.mark.parametrize("gzipped", [False, True])
def test_matrix_in_parts(spark, tmp_path, gzipped):
    """Parts in order of the rows, one header; what is read is what was written, also where a part has the header alone or a folder has headers throughout."""
    cells = [(f"r{i:03}", c, None if (i + j) % 7 == 0 else i / 8 - j) for i in range(200) for j, c in enumerate("xyz")]
    m, out = spark.createDataFrame(cells, "row string, col string, value double"), str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_matrix(m, out, list("xyz"), gzip=gzipped)
        memb = spark.createDataFrame([(f"g{i:03}", s, i % 5 + s) for i in range(300) for s in (0, 1)], "gene string, slot long, cluster long")
        writers.write_memberships(memb, str(tmp_path / "memb"), "gene")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(x for x in (tmp_path / "out").iterdir() if x.name.startswith("part-"))
    assert len(parts) > 2 and len([x for x in (tmp_path / "memb").iterdir() if x.name.startswith("part-")]) > 2
    texts = [(gzip.decompress(x.read_bytes()) if gzipped else x.read_bytes()).decode().splitlines() for x in parts]
    flat = [y for t in texts for y in t]
    assert flat[0] == "x\ty\tz" and [y.split("\t")[0] for y in flat[1:]] == [f"r{i:03}" for i in range(200)]
    assert [r["text"] for r in text.ordered_lines(spark, out).collect()] == flat
    assert sorted(map(str, map(tuple, text.matrix(spark, out).collect()))) == sorted(map(str, cells))
    read = [r["text"].split("\t") for r in text.ordered_lines(spark, str(tmp_path / "memb")).collect()]
    assert read == [[f"g{i:03}", f"{i % 5}:{i % 5 + 1}"] for i in range(300)]
    assert sorted(map(tuple, text.memberships(spark, str(tmp_path / "memb"), "\t").collect())) == sorted(map(tuple, memb.collect()))
    if not gzipped:
        alone = tmp_path / "alone"  # the header has a part of its own
        alone.mkdir()
        (alone / "part-0").write_text("x\ty\n"), (alone / "part-1").write_text("a\t1\t2\n"), (alone / "part-2").write_text("b\t3\tNA\n")
        each = tmp_path / "each"
        each.mkdir()
        (each / "a.tsv").write_text("x\ty\na\t1\t2\n"), (each / "b.tsv").write_text("x\ty\nb\t3\tNA\n")
        for folder in (alone, each):
            assert sorted(map(str, map(tuple, text.matrix(spark, str(folder)).collect()))) == ["('a', 'x', 1.0)", "('a', 'y', 2.0)", "('b', 'x', 3.0)", "('b', 'y', None)"]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1 note\nACG\nTX\n>empty\n>s2\nGG\n")
    assert {r["id"]: r["seq"] for r in text.fasta(spark, p).collect()} == {"s1": "ACGTX", "s2": "GG"}
    t = spark.createDataFrame([("s1", "gene1")], "alias string, original string")
    assert [tuple(r) for r in text.fasta_source(spark, p, t).collect()] == [("gene1", "ACGTN")]


def test_sets_and_memberships(spark, tmp_path):
    p = put(tmp_path, "s.json", '{"a": ["g1", "g2"], "b": ["g1"]}')
    assert text.gene_sets(spark, p, "t").count() == 3
    assert text.gene_sets(spark, put(tmp_path, "s.csv", "a,g1;g2\nb,g3\n"), "t").count() == 3
    with pytest.raises(ValueError):
        text.gene_sets(spark, put(tmp_path, "w.csv", "a,g1,0.5\n"), "t")
    m = text.memberships(spark, put(tmp_path, "m.tsv", "gene\tcluster\n\"g1\"\t3:4\ng2\t5\n"), "\t")
    assert sorted(tuple(r) for r in m.collect()) == [("g1", 0, 3), ("g1", 1, 4), ("g2", 0, 5)]


def test_string_and_taxonomy(spark, tmp_path):
    p = put(tmp_path, "s.tsv", "64091.A\t64091.B\t700\n83333.C\t83333.D\t1\n")
    assert [(r["src"], r["dst"], r["weight"]) for r in text.string_network(spark, p, prefix="64091.").collect()] == [("A", "B", 700.0)]
    assert text.taxonomy(spark, put(tmp_path, "t.tsv", "# x\nT1\teco\t511145\tE. coli\n"), ["tid", "code", "ncbi", "species"]).first()["code"] == "eco"


def test_feature_and_operon_files(spark, tmp_path):
    head = "-- dump\n" + "".join(f"-- field {i}\t{n}\n" for i, n in enumerate(["id", "type", "strand", "name", "contig", "end_pos", "start_pos"], 1)) + "-- header\n"
    p = put(tmp_path, "features", head + "f1\tCDS\tR\tgene1\tc1\t>812\t<363\nf2\ttRNA\tD\tgene2\tc1\t90\t10\n")
    got = {r["id"]: r for r in text.features(spark, p).collect()}
    assert (got["f1"]["start"], got["f1"]["end"], got["f1"]["reverse"], got["f2"]["reverse"], got["f2"]["name"]) == (363, 812, True, False, "gene2")
    with pytest.raises(ValueError):
        text.features(spark, put(tmp_path, "bare", "f1\tCDS\n"))
    p = put(tmp_path, "operons", "Gene1\tGene2\tSysName1\tSysName2\tbOp\n1\t2\ta\tb\tTRUE\n2\t3\tb\tc\tFALSE\n")
    assert [tuple(r) for r in text.operon_predictions(spark, p).collect()] == [("a", "b")]


RULE = "-" * 80
MEME = """
{rule}
MOTIF {first}\twidth =    4  sites =   3  llr = 35  E-value = 2.3e-002
{rule}
{rule}
\tMotif {name} sites sorted by position p-value
{rule}
Sequence name            Strand  Start   P-value             Site
--------------           ------  ----- ---------            ----
s1                           +     14  8.55e-05 TGACGATGGA ATTA GGCTACCGCG
s2                           -      1  1.00e-04            ATTT CCTCGGGCTT
s3                           +     47  1.71e-04 AGTCGGGCTG TTTA
{rule}

{rule}
\tMotif {name} position-specific probability matrix
{rule}
letter-probability matrix: alength= 4 w= 4 nsites= 3 E= 2.3e-002
 0.666667  0.000000  0.000000  0.333333
 0.000000  0.000000  0.000000  1.000000
 0.000000  0.000000  0.000000  1.000000
 0.666667  0.000000  0.000000  0.333333
{rule}
"""


@pytest.mark.parametrize("first, name", [("  1", "1"), ("ATTW MEME-1", "ATTW MEME-1")])
def test_meme(spark, tmp_path, first, name):
    p = put(tmp_path, "meme.txt", MEME.format(rule=RULE, first=first, name=name) + MEME.format(rule=RULE, first=first.replace("1", "2"), name=name))
    got = motifs.read(spark, p, motifs.meme, motifs.MOTIFS_DDL).orderBy("motif_num").collect()
    assert [(r["motif_num"], r["width"], r["num_sites"], r["llr"], r["evalue"]) for r in got] == [(1, 4, 3, 35, 0.023), (2, 4, 3, 35, 0.023)]
    assert [(s["name"], s["reverse"], s["start"], s["left"], s["seq"], s["right"]) for s in got[0]["sites"]] == [
        ("s1", False, 14, "TGACGATGGA", "ATTA", "GGCTACCGCG"), ("s2", True, 1, "", "ATTT", "CCTCGGGCTT"), ("s3", False, 47, "AGTCGGGCTG", "TTTA", ""),
    ]
    assert got[0]["pssm"][1] == [0, 0, 0, 1] and len(got[0]["pssm"]) == 4


WEEDER = """Your sequences:

Sequence 1 : >p0
Sequence 2 : >p1

 *** Interesting motifs (highest-ranking) seem to be :

GGGGGC

2 redundant motifs found:
CCGGGG - CAGGGG -

Best occurrences:
Seq  St  oligo  pos  match
  1 + [GGTGGC]  122  (89.33)
  2 -  GGGGGC   453  (100.00)

                   Frequency Matrix
      All Occurrences            Best Occurrences
    A     C     G     T            A     C     G     T
1    1     1     8     0            0     0    57     0
2    0     0     5     5            0     0    42    15

==========================================

 *** Interesting motifs (not highest-ranking) can also be :

ACGTAC

1 redundant motifs found:
CCGGGG -

Best occurrences:
Seq  St  oligo  pos  match
  1 +  ACGTAC   3  (90.00)

                   Frequency Matrix
      All Occurrences            Best Occurrences
    A     C     G     T            A     C     G     T
1    1     0     0     0            1     0     0     0

==========================================
"""


def test_weeder_and_pssm(spark, tmp_path):
    got = motifs.read(spark, put(tmp_path, "a.wee", WEEDER), motifs.weeder, motifs.WEEDER_DDL).orderBy("motif_num").collect()
    assert [(r["name"], r["highest"], len(r["sites"])) for r in got] == [("GGGGGC", True, 2), ("ACGTAC", False, 1)]
    assert got[0]["pssm"] == [[0.1, 0.1, 0.8, 0], [0, 0, 0.5, 0.5]]
    assert [(s["name"], s["reverse"], s["seq"], s["start"], s["match"]) for s in got[0]["sites"]] == [("p0", False, "GGTGGC", 122, 89.33), ("p1", True, "GGGGGC", 453, 100)]
    p = put(tmp_path, "a.pssm", ">m1\n0.8 0.1\n0.1 0.1\n0.1 0.1\n0 0.7\n>m2\n1\n0\n0\n0\n")
    assert [(r["name"], r["pssm"]) for r in motifs.read(spark, p, motifs.pssm, motifs.PSSM_DDL).collect()] == [("m1", [[0.8, 0.1, 0.1, 0], [0.1, 0.1, 0.1, 0.7]]), ("m2", [[1, 0, 0, 0]])]


def test_mast_xml():
    doc = """<mast><motifs><motif id="m1" alt=""/><motif id="m2" alt=""/></motifs><sequences><sequence name="g1"><score combined_pvalue="1e-5" evalue="0.1"/>
    <seg><hit pos="10" pvalue="1e-6" motif="m2" strand="reverse"/></seg></sequence><sequence name="g2"><score combined_pvalue="0.5" evalue="9"/></sequence></sequences></mast>"""
    got = motifs.mast_xml(doc)
    assert [(r["gene"], r["motif_num"], r["position"]) for r in got] == [("g1", -2, 12), ("g2", None, None)]
    new = motifs.mast_xml('<mast><motifs><motif id="A"/></motifs><sequences><sequence name="g"><score combined_pvalue="1" evalue="1"/><seg><hit pos="0" pvalue="0.1" idx="0" rc="n"/></seg></sequence></sequences></mast>')
    assert (new[0]["motif_num"], new[0]["position"]) == (1, 2)


def test_schedules_and_scalings():
    assert [i for i in range(1, 12) if Schedule("2,4")(i)] == [2, 6, 10]
    assert [i for i in range(1, 9) if Schedule("3:5:1,6")(i)] == [1, 3, 5, 7]
    assert vector("c(1, rep(2, 3), 10/4)", 9) == [1, 2, 2, 2, 2.5]
    assert vector("seq(0, 1, length=num_iterations/2) * 2", 10) == pytest.approx([0, 0.5, 1, 1.5, 2])
    assert scaling("c(1, 2)", 5)(9) == 2
    with pytest.raises(ValueError):
        vector("1 2", 3)
    assert default_clusters(400, 80) == (40, 20) and default_clusters(400, 30)[1] == 27
    assert fuzzy_coefficient(0, 100) == 0.75


def test_config(tmp_path):
    p = put(tmp_path, "a.ini", "[General]\nnum_iterations = 7\nquantile = yes\n[Rows]\nschedule = 1,3\n")
    c = Config.read(p, clusters=4)
    assert (c.num_iterations, c.quantile, c.schedules["Rows"], c.clusters) == (7, True, "1,3", 4)
    c.write(str(tmp_path / "b.ini"))
    assert Config.read(str(tmp_path / "b.ini")).num_iterations == 7


#: Scores of one cluster's column, its members, the bandwidth of all scores, and their density scores.
SCORES = [0.389499250196493, 0.284819551440473, 0.601320719052627, 0.00618865129293001, 0.213883951343353]
MEMBERS, BANDWIDTH = [1, 2, 3], 0.786828704721797
DENSITY = [0.18467792824393023, 0.20242802043706126, 0.14903394703069142, 0.24940650529450745, 0.21445359899380953]


def test_density_is_that_of_r(spark):
    cells = [(i, 1, x) for i, x in enumerate(SCORES)] + [(0, 2, min(SCORES)), (1, 2, min(SCORES) + 100 * BANDWIDTH)]
    d = spark.createDataFrame(cells, "cond long, cluster long, score double")
    memb = spark.createDataFrame([(i, 0, 1) for i in MEMBERS], "cond long, slot long, cluster long")
    got = {(r["cluster"], r["cond"]): r["score"] for r in scoring.density(d, memb, "cond", rows=False).collect()}
    assert [got[1, i] for i in range(5)] == [pytest.approx(x, abs=1e-11) for x in DENSITY]
    assert got[2, 0] == got[2, 1] == 0.5  # without members


def test_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = np.repeat([[2, 2, 2, -2, -2, -2], [-2, -2, -2, 2, 2, 2]], 10, axis=0)
    x = base + rng.normal(0, 0.3, base.shape)
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(6)], "gene long, cond long, value double")
    c = Config(num_iterations=2, clusters=3, per_col=2, result_frequency=1)
    run = Run(spark, m, str(tmp_path / "run"), c, functions=("Rows",))
    run.seed()
    run.run()
    run.finish()
    assert run.rows.filter("slot < 2").groupBy("gene").count().filter("count <> 2").count() == 0
    got = spark.read.parquet(str(tmp_path / "run/cluster_stats"))
    assert got.select("iteration").distinct().count() == 3 and got.filter("residual < 0").count() == 0
    q = monitor.residuals(spark, str(tmp_path / "run/cluster_stats")).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").count() == 3


PIPELINE = {
    "row-scoring": {"id": "combiner", "function": {"module": "x", "class": "ScoringFunctionCombiner"}, "args": {"functions": [{"id": x, "function": {}} for x in ("Rows", "Networks", "Motifs", "SetEnrichment")]}},
    "column-scoring": {"id": "Columns", "function": {}},
}


def test_run_of_a_pipeline_stores_its_results(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.repeat([[2, 2, 2, -2, -2, -2], [-2, -2, -2, 2, 2, 2]], 8, axis=0) + rng.normal(0, 0.3, (16, 6))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(16) for j in range(6)], "gene long, cond long, value double")
    edges = spark.createDataFrame([(n, i, i + 1, 1.0) for n in ("a", "b") for i in range(15)], "network string, src long, dst long, weight double")
    sets = spark.createDataFrame([("t", f"s{i % 2}", i) for i in range(12)], "set_type string, set_name string, gene long")
    searched = []

    def find(run, iteration):
        searched.append(iteration)
        motif = "cluster long, motif_num int, evalue double, pssm array<array<double>>, annotations array<struct<gene:long,position:int,reverse:boolean,pvalue:double>>, sites array<struct<name:string,reverse:boolean,start:int,pvalue:double,left:string,seq:string,right:string>>"
        found = [(1, 1, 0.5, [[1.0, 0.0, 0.0, 0.0], [0.25] * 4], [(3, 7, True, 0.01), (99, 1, False, 0.5)], [("g3", False, 4, 0.02, "AC", "GT", "")])]
        return spark.createDataFrame([(1, 3, 0.001), (2, 4, 0.0)], "cluster long, gene long, pvalue double"), spark.createDataFrame(found, motif)

    c = Config(num_iterations=3, clusters=3, per_col=2, result_frequency=2, stats_frequency=1, schedules={"Rows": "1,1", "MEME": "1,2", "Networks": "2,2"})
    folder = str(tmp_path / "run")
    run = Run.of_pipeline(json.dumps(PIPELINE), spark, m, folder, c, edges=edges, sets=sets, find_motifs=find)
    assert run.functions == ("Rows", "Networks", "Motifs", "SetEnrichment")
    run.start(m.select("gene").distinct().select("gene", F.lit(0).cast("long").alias("slot"), (F.col("gene") % 3 + 1).alias("cluster")), m.select("cond").distinct().select("cond", F.lit(0).cast("long").alias("slot"), (F.col("cond") % 3 + 1).alias("cluster")))
    run.run()
    run.finish()
    table = lambda t: spark.read.parquet(f"{folder}/{t}")
    assert searched == [1, 3, 4]
    assert {r[0] for r in table("row_members").select("iteration").distinct().collect()} == {1, 2, 3, 4}
    stats = {(r["iteration"], r["category"], r["name"]): r["score"] for r in table("iteration_stats").collect()}
    assert stats[1, "main", "fuzzy_coeff"] == pytest.approx(fuzzy_coefficient(1, 3)) and {(2, "network", "a"), (2, "scoring", "SetEnrichment"), (3, "main", "median_residual"), (2, "seqtype", "upstream")} <= set(stats)
    logs = {(r["logtype"], r["at"]): r["active"] for r in table("run_logs").collect()}
    assert (logs["Networks", 1], logs["Networks", 2], logs["Networks", 3]) == (0, 1, 0) and ("Rows", 4) in logs
    info = table("run_infos").first()
    assert (info["last_iteration"], info["num_rows"], info["num_clusters"]) == (4, 16, 3) and info["finish_time"] is not None
    assert table("motif_pssm_rows").filter("iteration = 4").count() == 2 and table("meme_motif_sites").filter("iteration = 4").first()["seq"] == "GT"
    assert [(r["gene_num"], r["position"]) for r in table("motif_annotations").filter("iteration = 4").collect()] == [(3, 7)]
    best = table("best_sets")
    assert best.filter("iteration = 2").count() == best.filter("iteration = 2").select("cluster").distinct().count() > 0
    line = enrichment.best_set_lines(best, 3, "set_name").filter("iteration = 2").first()["line"]
    assert line.startswith("2,") and line.count(",") == 3
    left = {f.name for f in (tmp_path / "run").iterdir()}
    assert {"rows-1", "rows-2", "rows-3", "rows-4", "Rows-4", "Motifs-4"} <= left and not {"Rows-1", "Rows-2", "pvalues-1"} & left
    with pytest.raises(ValueError, match="Other"):
        functions_of({**PIPELINE, "column-scoring": {"id": "Other"}})


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([(1, "g", "c", 0.5)], "cluster int, gene string, cond string, value double")
    assert writers.expression_json(e).first()["value"] == '[{"gene":"g","condition":"c","value":0.5}]'
    r = spark.createDataFrame([(1, ["g"], ["c"])], "cluster int, genes array<string>, conds array<string>")
    assert "<li>g</li>" in writers.microformats(r).first()["value"]
    b = spark.createDataFrame([(1, "A", 0.25)], "k long, kmer string, freq double")
    assert [x["value"] for x in writers.background_lines(b, 0).collect()] == ["# 0 order Markov background model", "A 0.25000000"]
    m = spark.createDataFrame([(f"r{i}", f"c{j}", 1.0) for i in range(3) for j in range(6)], "row string, col string, value double")
    p = writers.matrix_parts(m, 4, 2, 3)
    assert all(2 <= x["n"] <= 3 for x in p.groupBy("part").agg(F.count_distinct("col").alias("n")).collect())


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.repeat([[2, 2, -2, -2], [-2, -2, 2, 2]], 6, axis=0) + rng.normal(0, 0.3, (12, 4))
    body = "\n".join([f"g{i}\t" + "\t".join(f"{v:.5f}" for v in r) for i, r in enumerate(x)])
    ratios = put(tmp_path, "ratios.tsv", "\ta\tb\tc\td\n" + body + "\n")
    edges = put(tmp_path, "string.tsv", "".join(f"g{i}\tg{i + 1}\t{i}.5\n" for i in range(11)))
    sets = put(tmp_path, "sets.json", json.dumps({"one": ["g0", "g1", "g2"], "two": ["g9", "g8"]}))
    ini = put(tmp_path, "own.ini", "[General]\nstats_frequency = 1\n[Rows]\nschedule = 1,1\nscaling_const = 2\n")
    out = str(tmp_path / "out")
    run = command.main([ratios, "--out", out, "--config", ini, "--num-iterations", "2", "--num-clusters", "2", "--string", edges, "--sets", f"t={sets}", "--no-normalise"], spark)
    assert run.functions == ("Rows", "Networks", "SetEnrichment") and run.config.scalings["Rows"] == "2" and run.config.clusters == 2
    s = store.Store(spark, out)
    assert s.last_iteration() == 3 and {r["gene_num"] if "gene_num" in r else r["order_num"] for r in s.table("row_members", 3).collect()} <= set(range(12))
    assert Config.read(f"{out}/final.ini").num_iterations == 2
    s.compact(str(tmp_path / "small"))
    small = store.Store(spark, str(tmp_path / "small"))
    assert small.table("cluster_stats").select("iteration").distinct().count() == 1 and small.table("row_names").count() == 12
    with pytest.raises(SystemExit):
        command.arguments([])


def test_late_events_are_left_out(spark, tmp_path):
    import datetime

    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    path, ddl = str(tmp_path / "events"), "ts timestamp, logtype string, scaling double"
    q = None
    for k, rows in enumerate(([(at(1, 5), "Rows", 1.0), (at(1, 50), "Rows", 3.0)], [(at(4, 0), "Rows", 9.0)], [(at(1, 20), "Rows", 100.0), (at(9, 0), "Rows", 9.0)], [(at(12, 0), "Rows", 9.0)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
        if q is None:
            q = monitor.late_log(spark.readStream.schema(ddl).parquet(path)).writeStream.format("memory").queryName("late").outputMode("append").start()
        q.processAllAvailable()
    q.stop()
    got = {r["window"]["start"].hour: (r["n"], r["scaling"]) for r in spark.table("late").collect()}
    assert got[1] == (2, 2.0) and got[4] == (1, 9.0)  # what came at the end for the first hour was too late


def test_fetched_once(tmp_path):
    source = tmp_path / "names.txt"
    source.write_text("first")
    path = text.fetched(source.as_uri(), str(tmp_path / "copy.txt"))
    source.write_text("second")
    assert open(text.fetched(source.as_uri(), path)).read() == "first"
