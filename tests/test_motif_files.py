"""The data source for motif tools' files; its five kinds are held against SQL in test_catalog."""

import gzip

import pytest

from tessera.sources import motif_files, motifs

ONE = ">m1\n0.1 0.2\n0.3 0.4\n0.5 0.3\n0.1 0.1\n>m2\n1\n0\n0\n0\n"


@pytest.fixture
def source(spark):
    return motif_files.registered(spark).read.format("motif_files")


def test_a_partition_a_file(source, spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text(ONE)
    with gzip.open(tmp_path / "a" / "deep" / "two.gz", "wt") as f:
        f.write(ONE.replace("m1", "m3"))
    for hidden in ("_SUCCESS", ".one.txt.crc"):
        (tmp_path / "a" / hidden).write_text(">no\n1\n1\n1\n1\n")
    (tmp_path / "a" / "empty.txt").write_text("")
    d = source.option("kind", "pssm").load(str(tmp_path / "a"))
    assert d.rdd.getNumPartitions() == 3
    got = {(r["path"].split("/")[-1], r["name"]): [list(x) for x in r["pssm"]] for r in d.collect()}
    assert set(got) == {("one.txt", "m1"), ("one.txt", "m2"), ("two.gz", "m3"), ("two.gz", "m2")}
    assert got["one.txt", "m1"] == [[0.1, 0.3, 0.5, 0.1], [0.2, 0.4, 0.3, 0.1]]
    for path in (f"file://{tmp_path}/a", f"file:{tmp_path}/a"):
        assert source.option("kind", "pssm").load(path).count() == 4
    assert source.option("kind", "pssm").load(str(tmp_path / "a" / "one.txt")).count() == 2
    same = motifs.read(spark, str(tmp_path / "a" / "one.txt"), motifs.pssm, motifs.PSSM_DDL)
    assert sorted(str(r["pssm"]) for r in same.collect()) == sorted(str(r["pssm"]) for r in d.filter("path LIKE '%one.txt'").collect())


def test_picked_columns(source, tmp_path):
    (tmp_path / "one.txt").write_text(ONE)
    d = source.option("kind", "pssm").schema("name string").load(str(tmp_path))
    assert d.columns == ["name"] and sorted(r[0] for r in d.collect()) == ["m1", "m2"]
    with pytest.raises(Exception, match="these files have no evalue"):
        source.option("kind", "pssm").schema("evalue double").load(str(tmp_path)).collect()


def test_what_is_not_there(source, tmp_path):
    with pytest.raises(Exception, match="no kind of motif files"):
        source.load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        source.option("kind", "pssm").load(str(tmp_path / "none")).collect()
    (tmp_path / "empty").mkdir()
    assert source.option("kind", "meme").load(str(tmp_path / "empty")).collect() == []


def test_many_files_share_partitions(source, tmp_path):
    """Tasks follow bytes, not files, once there are many; every file is read once."""
    for i in range(600):
        (tmp_path / f"{i:03}.txt").write_text(ONE.replace("m1", f"a{i}").replace("m2", f"b{i}"))
    d = source.option("kind", "pssm").load(str(tmp_path))
    assert 100 < d.rdd.getNumPartitions() <= 300
    assert sorted(r["name"] for r in d.select("name").collect()) == sorted(f"{x}{i}" for x in "ab" for i in range(600))
    every = [i for a, b in motif_files.dealt([5] * 300 + [10**9] * 3 + [0] * 300) for i in range(a, b)]
    assert every == list(range(603))


def test_few_files_of_many_rows(spark):
    """A file holds some megabytes, and both layouts are there from a thousand rows on."""
    import os

    from pyspark.sql import functions as F

    from tessera.catalog import motif_files as M

    rows = spark.range(0, 20000).select(F.col("id").alias("rowid"))
    views = type("V", (), {"motif_annotations": rows})()
    d = M.sites(views).select("file", F.col("rowid").alias("order"), F.col("site").alias("text"))
    folder = M.files(d, "few", "head\n")
    names = [x for _, _, y in os.walk(folder.removeprefix("file:")) for x in y if x.endswith(".txt")]
    assert len(names) == 2
