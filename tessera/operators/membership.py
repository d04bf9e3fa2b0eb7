"""Memberships in a fixed number of slots a gene or condition: (name, slot, cluster), cluster 0 being a free slot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scoring import members, top_clusters
from .stats import quantile

#: Share of a cluster's members' scores that opens it, candidates beyond which it stays as it is, and those it takes.
CUTOFF, MOST_CANDIDATES, TAKES = 0.33, 100, 50


def padded(memb: DataFrame, names: DataFrame, name: str, slots: int) -> DataFrame:
    """All slots of all names, free ones as 0."""
    grid = names.select(name).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return grid.join(memb, [name, "slot"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0).cast("long")))


def counts(memb: DataFrame, name: str) -> DataFrame:
    return members(memb, name).groupBy("cluster").agg(F.count("*").alias("n"))


def free_slots(memb: DataFrame, name: str) -> DataFrame:
    return memb.filter("cluster = 0").groupBy(name).agg(F.count("*").alias("free"), F.min("slot").alias("first"))


def clusters_of(memb: DataFrame, name: str) -> DataFrame:
    return members(memb, name).groupBy(name).agg(F.sort_array(F.collect_set("cluster")).alias("clusters"))


def add(memb: DataFrame, new: DataFrame, name: str, *, force: bool = False) -> DataFrame:
    """Puts new members (name, cluster) into free slots in order of the clusters. A name without a free slot
    is an error unless ``force``, which gives it further slots."""
    new = new.select(name, "cluster").distinct().join(members(memb, name), [name, "cluster"], "left_anti")
    ordered = new.withColumn("_i", F.row_number().over(W.partitionBy(name).orderBy("cluster")))
    free = memb.filter("cluster = 0").withColumn("_i", F.row_number().over(W.partitionBy(name).orderBy("slot"))).select(name, "_i", "slot")
    top = memb.groupBy(name).agg(F.max("slot").alias("_top"), F.count(F.when(F.col("cluster") == 0, 1)).alias("_free"))
    placed = ordered.join(free, [name, "_i"], "left").join(top, name, "left")
    beyond = F.coalesce("_top", F.lit(-1)) + F.col("_i") - F.coalesce("_free", F.lit(0))
    slot = F.coalesce("slot", beyond if force else F.raise_error(F.lit("no slot is free")).cast("long"))
    placed = placed.select(name, slot.cast("long").alias("slot"), "cluster")
    return memb.join(placed.select(name, "slot"), [name, "slot"], "left_anti").unionByName(placed)


def replace(memb: DataFrame, changes: DataFrame, name: str) -> DataFrame:
    """Changes are (name, cluster, new): the first slot of the cluster gets the new one."""
    first = memb.join(changes, [name, "cluster"]).groupBy(name, "cluster", "new").agg(F.min("slot").alias("slot"))
    d = memb.join(first.select(name, "slot", "new"), [name, "slot"], "left")
    return d.withColumn("cluster", F.coalesce("new", "cluster")).drop("new")


def update_one(slots: list[int], best: list[int], scores: dict[int, float], changes: int, *, rows: bool) -> list[int]:
    """New slots of one name given its best clusters (rows: by id; columns: by score).

    Rows: a free slot takes best[slot] unless that is there; else the slot with the largest gain
    score[best[i]] - score[slot[i]], gains of slots whose cluster is among the best counting 0, unless the
    new one is there already. Columns: the same, but a cluster that fills several slots gives its first one first.
    """
    slots = list(slots)
    at = lambda i: best[min(i, len(best) - 1)]
    for _ in range(changes):
        if 0 in slots:
            i = slots.index(0)
            if at(i) not in slots or not rows:
                slots[i] = at(i)
            continue
        if not rows:
            twice = [i for i, c in enumerate(slots) if slots.count(c) > 1]
            if twice:
                slots[twice[0]] = at(twice[0])
                continue
        gain = [0.0 if c in best else scores.get(at(i), np.nan) - scores.get(c, np.nan) for i, c in enumerate(slots)]
        gain = [0.0 if np.isnan(g) else g for g in gain]
        i = int(np.argmax(gain))
        if at(i) not in slots:
            slots[i] = at(i)
    return slots


def update(memb: DataFrame, scores: DataFrame, name: str, n: int, *, rows: bool, probability: float = 1.0, changes: int = 1, seed: int = 3) -> DataFrame:
    """Moves names to clusters of higher score; a name is one group of its slots and its n best clusters, with their scores and no others.

    A name changes with ``probability``, drawn by (seed, name).
    """
    best = top_clusters(scores, name, n).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("place", "cluster", "score"))).alias("best"))
    slots_ = memb.select(name, "slot", "cluster").join(scores.select(name, "cluster", "score"), [name, "cluster"], "left")
    held = slots_.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("slot", "cluster", "score"))).alias("slots"))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col(name)), F.lit(1 << 30)) / float(1 << 30)) < probability
    d = held.join(best, name).withColumn("moves", draw)

    def step(batches):
        for p in batches:
            out = []
            for key, slots, best_, moves in zip(p[name], p["slots"], p["best"], p["moves"], strict=True):
                now = [int(s["cluster"]) for s in slots]
                if moves:
                    ids = [int(b["cluster"]) for b in best_]
                    now = update_one(now, sorted(ids) if rows else ids, {int(s["cluster"]): float("nan") if s["score"] is None else s["score"] for s in (*slots, *best_)}, changes, rows=rows)
                out += [(key, i, c) for i, c in enumerate(now)]
            yield pd.DataFrame(out, columns=[name, "slot", "cluster"])

    kinds = dict(memb.dtypes)
    return d.mapInPandas(step, f"{name} {kinds[name]}, slot {kinds['slot']}, cluster {kinds['cluster']}")


def candidates(memb: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """Non-members below their cluster's cut-off of members' scores, in clusters with 1 to MOST_CANDIDATES of
    them, the TAKES of highest score: (name, cluster, score)."""
    own = members(memb, name)
    cut = scores.join(own, [name, "cluster"], "left_semi").groupBy("cluster").agg(quantile("score", CUTOFF).alias("_cut"))
    d = scores.join(own, [name, "cluster"], "left_anti").join(cut, "cluster").filter(F.col("score") < F.col("_cut")).drop("_cut")
    few = d.groupBy("cluster").agg(F.count("*").alias("_n")).filter(F.col("_n") <= MOST_CANDIDATES).select("cluster")
    d = d.join(few, "cluster", "left_semi")  # from here on MOST_CANDIDATES a cluster at most
    return d.withColumn("_i", F.row_number().over(W.partitionBy("cluster").orderBy(F.col("score").desc(), name))).filter(F.col("_i") <= TAKES).drop("_i")


def postadjust(memb: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    return add(memb, candidates(memb, scores, name), name, force=True)


def packed(memb: DataFrame, name: str, sep: str = ":") -> DataFrame:
    d = memb.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("slot", "cluster"))).alias("_s"))
    return d.select(name, F.array_join(F.transform("_s", lambda x: x["cluster"].cast("string")), sep).alias("clusters"))


def differing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Clusters that only one of two memberships gives a name."""
    x, y = clusters_of(a, name).withColumnRenamed("clusters", "a"), clusters_of(b, name).withColumnRenamed("clusters", "b")
    none = F.array().cast("array<bigint>")
    d = x.join(y, name, "full_outer").select(name, F.array_except(F.coalesce("a", none), F.coalesce("b", none)).alias("only_a"), F.array_except(F.coalesce("b", none), F.coalesce("a", none)).alias("only_b"))
    return d.filter((F.size("only_a") > 0) | (F.size("only_b") > 0))


def from_lists(spread: DataFrame, name: str, lists: str = "clusters", sep: str = ":") -> DataFrame:
    """Slots of lists like 1:7:3."""
    return spread.select(name, F.posexplode(F.split(lists, sep)).alias("slot", "cluster")).select(name, F.col("slot").cast("long"), F.col("cluster").cast("long"))


def seed_kmeans(m: DataFrame, clusters: int, conds: list, seed: int = 1, iterations: int = 20) -> DataFrame:
    """Genes' first slots by k-means over their rows, missing cells as 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    w = m.groupBy("gene").pivot("cond", conds).agg(F.first("value"))
    v = w.select("gene", array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in conds])).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=iterations).fit(v)
    return model.transform(v).select("gene", F.lit(0).cast("long").alias("slot"), (F.col("prediction") + 1).cast("long").alias("cluster"))


def resumed(members_: DataFrame, names: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Slots from a result table (iteration, cluster, order_num) at its last iteration, for the names of the matrix.

    A stored name stands for the wanted one that is equal, else for its upper, else for its lower case form.
    Slots are in order of the clusters, as many as a name needs.
    """
    last = members_.join(members_.agg(F.max("iteration").alias("iteration")), "iteration", "left_semi")
    d = last.join(names, "order_num").select(F.col("name").alias("_stored"), "cluster").distinct()
    w = wanted.select(F.col(name).alias("_w")).distinct()
    for i, form in enumerate((F.col("_stored"), F.upper("_stored"), F.lower("_stored"))):
        d = d.withColumn(f"_f{i}", form).join(w.select(F.col("_w").alias(f"_f{i}"), F.col("_w").alias(f"_m{i}")), f"_f{i}", "left")
    d = d.withColumn(name, F.coalesce("_m0", "_m1", "_m2")).filter(F.col(name).isNotNull()).select(name, "cluster").distinct()
    return d.select(name, (F.row_number().over(W.partitionBy(name).orderBy("cluster")) - 1).cast("long").alias("slot"), "cluster")


def resplit(pvalues: DataFrame, level: float = 0.05) -> DataFrame:
    """Columns' memberships by p-value alone: (cond, slot, cluster) of those up to a level."""
    d = pvalues.filter(F.col("pvalue") <= level).select("cond", "cluster").distinct()
    return d.select("cond", (F.row_number().over(W.partitionBy("cond").orderBy("cluster")) - 1).cast("long").alias("slot"), "cluster")
