"""A Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups; proofs and what they fold to.

A parent stores its children's hashes one after another (its preimage). A row's proof is what its ancestors'
preimages hold beside the 64 characters of the node on its path; put other characters there and hash
upwards, and the root that a changed row would have comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order, scratch

FANOUT, WIDTH = 16, 64
PATH = "array<struct<slot:int,preimage:binary>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes of its UTF-8 text, ``:`` and the text; as bytes."""
    raw = value.cast("string").cast("binary")
    return F.when(value.isNull(), F.lit(b"-")).otherwise(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(b":"), raw))


def leaf(*values: Column) -> Column:
    """Lowercase hex sha256, as bytes."""
    return F.sha2(F.concat(*map(encoded, values)), 256).cast("binary")


def _up(nodes: DataFrame) -> DataFrame:
    """The parents of nodes (tree, at, hash, n: nodes of the tree on this level); a tree's last node stays itself, with a null preimage."""
    own = F.sort_array(F.collect_list(F.struct((F.col("at") % FANOUT).alias("slot"), "hash")))  # FANOUT at most
    runs = nodes.groupBy("tree", F.floor(F.col("at") / FANOUT).alias("parent")).agg(F.max("n").alias("n"), own.alias("own"))
    joined = F.aggregate(F.col("own.hash"), F.lit(b""), lambda a, x: F.concat(a, x))
    runs = runs.select("tree", F.col("parent").alias("at"), F.when(F.col("n") > 1, joined).alias("preimage"), F.col("own")[0]["hash"].alias("only"), F.ceil(F.col("n") / FANOUT).alias("n"))
    return runs.select("tree", "at", "preimage", F.coalesce(F.sha2("preimage", 256).cast("binary"), "only").alias("hash"), "n")


def levels(nodes: DataFrame, most: int, tag: str) -> list[DataFrame]:
    """Tables of parents up to the level on which every tree is one node; ``most``: nodes of the largest tree."""
    out = []
    while most > 1:
        nodes = scratch.keep(_up(nodes), tag)
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def _down(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes with their paths, from those of parents, which have their own preimage beside the path above them."""
    slot = (F.col("at") % FANOUT).cast("int")
    here = F.array(F.struct(slot.alias("slot"), F.col("_preimage").alias("preimage")))
    above = parents.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("preimage").alias("_preimage"), "path", "subroot", "root")
    path = F.when(F.col("_preimage").isNull(), F.col("path")).otherwise(F.concat(here, F.col("path")))
    return nodes.join(above, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("at") / FANOUT) == F.col("_at"))).withColumn("path", path).drop("_tree", "_at", "_preimage")


def siblings(path: Column) -> Column:
    """The others of each run on the path, left to right, from the leaf to the root."""
    cut = lambda a, x: F.concat(a, F.substring(x["preimage"], F.lit(1), x["slot"] * WIDTH), F.substring(x["preimage"], x["slot"] * WIDTH + WIDTH + 1, F.length(x["preimage"])))
    return F.aggregate(path, F.lit(b""), cut)


def folded(path: Column, hash_: Column) -> Column:
    """The root that the path gives with this hash in the leaf's place."""
    splice = lambda a, x: F.sha2(F.concat(F.substring(x["preimage"], F.lit(1), x["slot"] * WIDTH), a, F.substring(x["preimage"], x["slot"] * WIDTH + WIDTH + 1, F.length(x["preimage"]))), 256).cast("binary")
    return F.aggregate(path, hash_, splice)


def manifest(rows: DataFrame) -> DataFrame:
    """The trees over rows (id, tree_key, leaf as bytes, and any other columns, which stay): adds leaf's path, subroot and root.

    Leaves of a tree ascend by id (null first), then leaf, so repeated rows are leaves of their own and equal ids go by their
    leaf; trees by their key, bytewise, null first. An empty table gives no rows. Every run of FANOUT nodes becomes a parent, a
    last short run too; one node alone is the tree's root. A tree is dealt by ranges, so it may have any share of the rows.
    """
    keys = [F.col("tree_key").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    table = order.sorted_table(rows, keys, "leaves")
    # where each tree's rows begin in each part, and how many it has in parts before: a row a part and a tree more at most
    before = W.partitionBy("tree_key").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = table.groupBy("_part", "tree_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    pieces = pieces.withColumn("_shift", F.sum("_rows").over(before) - F.col("_rows") - F.col("_first"))
    trees = order.sorted_table(pieces.groupBy("tree_key").agg(F.sum("_rows").alias("n")), keys[:1], "trees")
    trees = order.placed(trees).withColumnRenamed("_place", "tree")
    sizes = trees.agg(F.max("n"), F.count("*")).first()
    if not sizes[1]:
        return rows.select("*", F.lit(None).cast(PATH).alias("path"), F.lit(b"").alias("subroot"), F.lit(b"").alias("root")).filter("false")
    same = F.col("tree_key").eqNullSafe(F.col("_tree_key"))
    pieces = pieces.join(trees.select(F.col("tree_key").alias("_tree_key"), "tree", "n"), same).select(F.col("_part").alias("_piece"), "_tree_key", "_shift", "tree", "n")
    leaves = table.join(pieces, (F.col("_part") == F.col("_piece")) & same)
    leaves = scratch.keep(leaves.withColumn("at", F.col("_at") + F.col("_shift")).select(*rows.columns, "tree", "at", "n"), "placed")

    own = levels(leaves.select("tree", "at", F.col("leaf").alias("hash"), "n"), max(sizes[0], 2), "level")  # at least one level: a row there for each tree
    tops = own[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("hash"), F.lit(sizes[1]).cast("long").alias("n"))
    over = levels(tops, sizes[1], "roots")
    if over:
        paths = over[-1].select("tree", "at", "preimage", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("hash").alias("root"))
        for nodes in reversed(over[:-1]):
            paths = _down(nodes.select("tree", "at", "preimage"), paths)
        above = _down(tops, paths).select(F.col("at").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    else:  # one tree
        above = tops.select(F.col("at").alias("tree"), F.array().cast(PATH).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    paths = own[-1].select("tree", "at", "preimage").join(above, "tree")
    for nodes in reversed(own[:-1]):
        paths = _down(nodes.select("tree", "at", "preimage"), paths)
    return _down(leaves, paths).drop("tree", "at", "n")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def proofs(documents: DataFrame) -> DataFrame:
    """The manifest of documents, a tree a source, with each row's proof and the root that it gives for the row after tampering.

    Where 5 divides crc32(doc_id as text) the tampered text has a-z for A-Z; null ids and null texts stay as they are.
    Only the five columns are read; texts are read and hashed once, and only hashes are shuffled. verified is false
    where the tampered leaf differs, up to collisions of sha256.
    """
    own = {c: F.col(c) for c in FIELDS}
    marked = F.coalesce(F.crc32(own["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(marked & F.col("text").rlike("[A-Z]"), leaf(*(own | {"text": lower}).values()))
    leaves = scratch.keep(documents.select(own["doc_id"].alias("id"), own["source"].alias("tree_key"), leaf(*own.values()).alias("leaf"), tampered.alias("tampered")), "hashes")
    made = manifest(leaves)
    text = lambda c: F.col(c).cast("string").alias(c)
    proof, again = F.sha2(siblings(F.col("path")), 256), folded(F.col("path"), F.coalesce("tampered", "leaf")).cast("string")
    out = made.select(F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), proof.alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
