"""Scores of clusters whose members changed; those of the others are kept.

A cluster's row scores, column scores, network scores and residual follow from its own members alone, so what was
scored before holds for every cluster that the change log does not name. Changed clusters are scored from the matrix again
instead of by adding and subtracting, which would leave rounding where a score is the logarithm of nearly nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import members


def changes(now: DataFrame, before: DataFrame, name: str) -> DataFrame:
    """The change log between two memberships: (name, cluster, change), 1 for who came and -1 for who left.

    Slots don't count: a name that has a cluster in another slot than before is no change.
    """
    a, b = members(now, name), members(before, name)
    came = a.join(b, [name, "cluster"], "left_anti").withColumn("change", F.lit(1))
    return came.unionByName(b.join(a, [name, "cluster"], "left_anti").withColumn("change", F.lit(-1)))


def changed(*logs: DataFrame) -> DataFrame:
    """The clusters that any of the logs names, once."""
    first, *others = [d.select("cluster") for d in logs]
    for d in others:
        first = first.unionByName(d)
    return first.distinct()


def of(memb: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """Memberships in some clusters; without any given, in all."""
    return memb if clusters is None else memb.join(clusters, "cluster", "left_semi")


def rescored(before: DataFrame, clusters: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``score`` gives for changed clusters, and for the rest what was there before. A changed cluster for which it gives nothing has nothing."""
    return before.join(clusters, "cluster", "left_anti").select(before.columns).unionByName(score(clusters))
