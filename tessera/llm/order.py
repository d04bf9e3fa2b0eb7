"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

#: monotonically_increasing_id() has a row's place in its partition in so many low bits.
LOW = 33


def sorted_table(df: DataFrame, keys: list[Column], tag: str) -> DataFrame:
    """The rows dealt by ranges of the keys and sorted, as a table with ``_part`` (parts ascend) and ``_at`` (from 0 in each)."""
    number = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return scratch.keep(dealt.withColumns({"_part": F.shiftright(number, LOW).cast("int"), "_at": number.bitwiseAND(F.lit((1 << LOW) - 1))}), tag)


def placed(table: DataFrame) -> DataFrame:
    """A sorted_table with ``_place``, from 0 in all. What is broadcast has a row for each part of the shuffle."""
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = table.groupBy("_part").count().select("_part", (F.sum("count").over(upto) - F.col("count")).alias("_before"))
    return table.join(F.broadcast(parts), "_part").withColumn("_place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
