"""Copy-on-write upsert of a table kept as sorted files, by set algebra over rows.

A key belongs to the last starting file that begins at or below it (its home), else to the first. Deletes are an
anti join, updates an inner join, inserts an anti join the other way; EXCEPT ALL in both directions between the rows that
changes touch before and after tells the dirty homes, and only those are written again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow, order, scratch

#: Starting files of a table: rows of a file follow from it, so what goes to the driver by file has a bound.
FILES = 1500
#: Marks of a change.
DELETE, SET = "D", "S"


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def _ties(df: DataFrame) -> Column:
    """Orders rows of one key, whatever their columns; rows that agree in all may go in any order."""
    return F.xxhash64(*[df["row"][c] for c in df.schema["row"].dataType.names])


def write_base(rows: DataFrame, path: str, *, key: str, rows_per_file: int) -> int:
    """Writes rows (null keys go) sorted by their integer key, so many a file, the last the rest; returns the files' number, 0 if no rows."""
    packed = rows.select(_row(rows)).filter(F.col("row")[key].isNotNull())
    table = order.sorted_table(packed, [packed["row"][key], _ties(packed)], "base")
    n = -(-table.count() // rows_per_file)
    if n:
        dealt = order.placed(table).withColumn("file", F.floor(F.col("_place") / rows_per_file).cast("int"))
        dealt.repartitionById(n, "file").sortWithinPartitions("_place").select("row.*").write.mode("append").parquet(path)
    scratch.drop(table)
    return n


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """The starting files' rows: row, file (its number), path."""
    df = spark.read.parquet(path)
    meta = df.metadataColumn("_metadata")
    return df.select(_row(df), F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).cast("int").alias("file"), meta["file_path"].alias("path"))


def latest(changes: DataFrame, *, key: str, by: list[str]) -> DataFrame:
    """Of each key the change that is highest in ``by`` (null lowest; then in its other columns): key, change. Null keys go."""
    rest = [F.col(f"`{c}`") for c in by] + [F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("change")]
    best = changes.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("key")).agg(F.max(F.struct(*rest)).alias("best"))
    return best.select("key", F.col("best.change").alias("change"))


def _homed(changes: DataFrame, firsts: list[int]) -> DataFrame:
    """Adds home, the number of the key's file, and first, where that file begins; at most FILES numbers go to the tasks."""
    starts = np.array(firsts, np.int64)

    @F.pandas_udf("home int, first long")
    def homes(keys: pd.Series) -> pd.DataFrame:
        at = np.maximum(np.searchsorted(starts, keys.to_numpy(), "right") - 1, 0)
        return pd.DataFrame({"home": at.astype(np.int32), "first": starts[at]})

    return changes.withColumn("at", homes("key")).select("key", "change", "at.home", "at.first")


def layout(homes: list[tuple[int, int | None]], most: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Files of rewritten homes, from (file, rows after) in order, None for those that stay: of each the file, the rows of a
    larger piece, how many such, the rows of a smaller one, the number of its first new file; and the new files' number.

    Two pieces of one home hold more than ``most`` rows, so only a home's first piece can join what stands left of it.
    """
    out, files, left = [], 0, None
    for file, n in homes:
        if n is None:
            left = None
        elif n:
            pieces = -(-n // most)
            small, larger = divmod(n, pieces)
            first = small + (larger > 0)
            joins = left is not None and left + first <= most
            at = files - 1 if joins else files
            out.append((file, small + 1, larger, small, at))
            left, files = small if pieces > 1 else first + (left if joins else 0), at + pieces
    return out, files


def _delete(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def upsert(spark: SparkSession, path: str, changes: DataFrame, *, key: str, sets: list[str], rows_per_file: int, decide: Callable[[Column, Column], Column]) -> list[str]:
    """Applies changes (key, change: one a key) to the table that write_base() made in ``path``; returns the files that stayed.

    ``decide`` takes a change and its home's first key and says DELETE, SET, or anything else for no effect. SET gives a key's
    rows the columns ``sets`` of the change, nulls too, or inserts one, null elsewhere. Repeated keys in the table change alike.
    A home that ends with other rows than before (nulls equal) is written as the fewest sorted files of at most rows_per_file
    rows, sizes at most one apart, larger first; then each new file joins the one left of it if that is new too and both fit.
    New files are written before old ones go, by the writer's own commit, so a lost executor repeats tasks only; a driver lost
    between the two leaves both, and the folder is to be made anew. Without a starting file no key has a home: nothing happens.
    To the driver go a number and a path a starting file, FILES at most if rows_per_file exceeds rows / FILES.
    """
    base = read_base(spark, path)
    names, types = base.schema["row"].dataType.names, {f.name: f.dataType for f in base.schema["row"].dataType}
    base = base.withColumn("key", base["row"][key].cast("long"))
    homes = base.groupBy("file", "path").agg(F.min("key").alias("first")).orderBy("file").collect()
    base = base.select("key", "row", "file")

    acts = _homed(changes, [h["first"] for h in homes])
    acts = acts.withColumn("act", decide(F.col("change"), F.col("first"))).filter(F.col("act").isin(DELETE, SET))
    acts = scratch.keep(acts.select("key", "act", "home", F.struct(*[F.col("change")[c].cast(types[c]).alias(c) for c in sets]).alias("new")), "acts")
    deletes, puts = acts.filter(F.col("act") == DELETE).select("key"), acts.filter(F.col("act") == SET).select("key", "home", "new")

    before = scratch.keep(base.join(acts.select("key"), "key", "left_semi"), "before")
    updated = before.join(deletes, "key", "left_anti").join(puts, "key")
    updated = updated.select("key", F.struct(*[F.col("new" if c in sets else "row")[c].alias(c) for c in names]).alias("row"), "file")
    inserted = puts.join(before.select("key"), "key", "left_anti")
    fresh = [F.col("new")[c].alias(c) if c in sets else (F.col("key") if c == key else F.lit(None)).cast(types[c]).alias(c) for c in names]
    inserted = inserted.select("key", F.struct(*fresh).alias("row"), F.col("home").alias("file"))
    after = scratch.keep(updated.unionByName(inserted), "after")

    dirty = before.exceptAll(after).unionByName(after.exceptAll(before)).select("file").distinct()
    dirty = {r["file"] for r in dirty.collect()}  # of the starting files
    mine = F.broadcast(spark.createDataFrame([(f,) for f in sorted(dirty)], "file int"))
    untouched = base.join(mine, "file").join(acts.select("key"), "key", "left_anti")
    rows = untouched.select("key", "row", "file").unionByName(after.join(mine, "file").select("key", "row", "file"))
    table = order.sorted_table(rows, [F.col("file"), F.col("key"), _ties(rows)], "rewritten")
    table = order.placed(table)
    spans = {r["file"]: r for r in table.groupBy("file").agg(F.min("_place").alias("at"), F.count("*").alias("n")).collect()}
    plan, n = layout([(h["file"], (spans[h["file"]]["n"] if h["file"] in spans else 0) if h["file"] in dirty else None) for h in homes], rows_per_file)
    if n:
        pieces = spark.createDataFrame([(f, spans[f]["at"], *x) for f, *x in plan], "file int, start long, large long, larger long, small long, first long")
        at, head = F.col("_place") - F.col("start"), F.col("large") * F.col("larger")
        piece = F.when(at < head, F.floor(at / F.col("large"))).otherwise(F.col("larger") + F.floor((at - head) / F.col("small")))
        dealt = table.join(F.broadcast(pieces), "file").withColumn("out", (F.col("first") + piece).cast("int"))
        dealt.repartitionById(n, "out").sortWithinPartitions("_place").select("row.*").write.mode("append").parquet(path)
    for h in homes:
        if h["file"] in dirty:
            _delete(spark, h["path"])
    scratch.drop(acts, before, after)
    return [h["path"] for h in homes if h["file"] not in dirty]


def _hash_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each file's comma-joined keys, from rows sorted by file and place; holds one state, whatever a file's size."""
    path, state = None, None
    schema = pa.schema([("path", pa.string()), ("ids_sha256", pa.string())])
    for b in arrow.full(batches):
        paths, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
        for i, j in zip(edges, edges[1:], strict=False):
            joined = ",".join(map(str, keys[i:j].tolist())).encode()
            if paths[i] == path:
                state.update(b"," + joined)
                continue
            if state is not None:
                yield arrow.batch(schema, path=[path], ids_sha256=[state.hexdigest()])
            path, state = paths[i], hashlib.sha256(joined)
    if state is not None:
        yield arrow.batch(schema, path=[path], ids_sha256=[state.hexdigest()])


def digests(spark: SparkSession, path: str, *, key: str, sums: dict[str, Column], stayed: list[str]) -> DataFrame:
    """Of each file in the folder, as read from it: first_id, n_rows, ``sums``, ids_sha256, columns, path, rewritten."""
    df = spark.read.parquet(path)
    meta = df.metadataColumn("_metadata")
    rows = df.select(meta["file_path"].alias("path"), meta["row_index"].alias("at"), df[key].cast("long").alias("key"), *[c.alias(n) for n, c in sums.items()])
    whole = rows.groupBy("path").agg(F.min("key").alias("first_id"), F.count("*").alias("n_rows"), *[F.sum(n).alias(n) for n in sums])
    hashed = rows.select("path", "key", "at").repartition("path").sortWithinPartitions("path", "at").select("path", "key").mapInArrow(_hash_keys, "path string, ids_sha256 string")
    old = F.broadcast(spark.createDataFrame([(p, True) for p in stayed], "path string, stayed boolean"))
    out, uri = whole.join(hashed, "path").join(old, "path", "left"), F.regexp_replace("path", "^file:/(?!/)", "file:///")
    return out.select("first_id", "n_rows", *sums, "ids_sha256", F.lit(",".join(df.columns)).alias("columns"), uri.alias("path"), F.col("stayed").isNull().alias("rewritten"))


def crc(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def upsert_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Starts a table from a part of clients in a new folder of the shared one, upserts changes, and digests its files; the folder stays."""
    spark = clients.sparkSession
    path, size = f"{scratch.root(spark)}/upsert-{scratch.fresh()}", 1 + clients.count() // FILES
    start = clients.filter(crc(F.col("client_id")) % 7 > 3)
    if not write_base(start, path, key="client_id", rows_per_file=size):
        names = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"
        return spark.createDataFrame([], names)

    def decide(change: Column, first: Column) -> Column:
        h = crc(first) % 10
        gone = (change["op"] == "D") | (crc(change["change_id"]) % 8 < h)
        return F.when(h <= 7, F.when(F.coalesce(gone, F.lit(False)), DELETE).otherwise(SET))

    stayed = upsert(spark, path, latest(changes, key="client_id", by=["seq", "change_id"]), key="client_id", sets=["source", "segment", "city", "balance"], rows_per_file=size, decide=decide)
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")]
    sums = {"cents": F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0).cast("long")), "rows_crc": crc(F.concat(text[0], F.lit("|"), text[1], F.lit("|"), text[2]))}
    return digests(spark, path, key="client_id", sums=sums, stayed=stayed)
