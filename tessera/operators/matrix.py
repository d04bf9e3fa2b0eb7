"""Filters and transformations of matrices in long form: (row, col, value), a missing cell being NULL or absent."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell is quiet up to this absolute value; a row, a column goes if so much of it is quiet.
QUIET, ROW_SHARE, COL_SHARE = 0.17, 0.98, 0.1


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a table that is one row by construction (an aggregate without keys)."""
    return df.crossJoin(F.broadcast(one.limit(1)))


def no_nan(m: DataFrame, value: str = "value") -> DataFrame:
    """NaN as NULL: Spark would take NaN for the largest number."""
    return m.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def nochange_filter(m: DataFrame, row: str = "row", col: str = "col", value: str = "value", *, quiet: float = QUIET, row_share: float = ROW_SHARE, col_share: float = COL_SHARE) -> DataFrame:
    """Drops rows and columns in which hardly anything changes, both judged on the whole matrix.

    The share counts all cells of the grid, so an absent cell is as quiet as a NULL one.
    """
    loud = F.sum(F.coalesce((F.abs(value) > quiet).cast("long"), F.lit(0)))
    rows, cols = m.groupBy(row).agg(loud.alias("loud")), m.groupBy(col).agg(loud.alias("loud"))
    size = rows.agg(F.count("*").alias("n_rows")).crossJoin(cols.agg(F.count("*").alias("n_cols")))
    live = lambda d, n, share: with_row(d, size).filter((F.col(n) - F.col("loud")) / F.col(n) < share).drop("loud", "n_rows", "n_cols")
    return m.join(live(rows, "n_cols", row_share), row, "left_semi").join(live(cols, "n_rows", col_share), col, "left_semi")


def center_scale(m: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """(value - median of its row) / sample sd of its row, the sd rounded to 8 decimals; NULL where that is 0."""
    stats = m.groupBy(row).agg(F.expr(f"percentile({value}, 0.5)").alias("_mid"), F.round(F.stddev_samp(value), 8).alias("_sd"))
    return m.join(stats, row).withColumn(value, F.try_divide(F.col(value) - F.col("_mid"), F.col("_sd"))).drop("_mid", "_sd")


def replace_missing(m: DataFrame, by: float, value: str = "value") -> DataFrame:
    return m.withColumn(value, F.coalesce(F.col(value), F.lit(float(by))))


def apply_log(m: DataFrame, value: str = "value") -> DataFrame:
    """Natural log of cells other than 0, which stay."""
    return m.withColumn(value, F.when(F.col(value) != 0, F.ln(value)).otherwise(F.col(value)))


def subtract_quantile(m: DataFrame, q: float, value: str = "value") -> DataFrame:
    return with_row(m, m.agg(F.expr(f"percentile({value}, {q})").alias("_q"))).withColumn(value, F.col(value) - F.col("_q")).drop("_q")


def _finite(value: str) -> Column:
    return F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))


def extremes(least: float, value: str) -> list[Column]:
    """Aggregates: the largest finite value, and the smallest finite one that is not below ``least``."""
    finite = _finite(value)
    return [F.max(finite).alias("_top"), F.min(F.when(finite >= least, finite)).alias("_low")]


def without_extremes(value: str, least: float, top: Column, low: Column) -> Column:
    finite = _finite(value)
    return F.when(finite.isNull(), top).when(finite < least, low).otherwise(finite)


def fix_extreme(m: DataFrame, least: float = -20.0, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Infinities of either sign and missing cells become the largest finite value, values below
    ``least`` the smallest finite one that is not; both of the matrix, or of each group of ``by``."""
    bounds = extremes(least, value)
    m2 = m.join(m.groupBy(*by).agg(*bounds), by) if by else with_row(m, m.agg(*bounds))
    return m2.withColumn(value, without_extremes(value, least, F.col("_top"), F.col("_low"))).drop("_top", "_low")


def submatrix(m: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, row: str = "row", col: str = "col") -> DataFrame:
    """Cells whose row and column are named; unknown names are left out."""
    if rows is not None:
        m = m.join(rows.select(row).distinct(), row, "left_semi")
    return m if cols is None else m.join(cols.select(col).distinct(), col, "left_semi")


def row_values(m: DataFrame, name: object, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """One row's cells; the filter is on a stored column, so it reaches the scan."""
    return m.filter(F.col(row) == F.lit(name)).select(col, value)


def column_values(m: DataFrame, name: object, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    return m.filter(F.col(col) == F.lit(name)).select(row, value)


def index_of(names: DataFrame, wanted: DataFrame, name: str = "name", index: str = "index") -> DataFrame:
    """Positions of wanted names, -1 for unknown ones."""
    return wanted.join(names.select(name, index), name, "left").withColumn(index, F.coalesce(index, F.lit(-1)))


def multiply_column(m: DataFrame, name, factor: float, col: str = "col", value: str = "value") -> DataFrame:
    return m.withColumn(value, F.when(F.col(col) == name, F.col(value) * factor).otherwise(F.col(value)))


def row_filter(m: DataFrame, f: Callable[[pd.Series], pd.Series], row: str = "row", value: str = "value") -> DataFrame:
    """Applies a function of a row's values, in pandas, to each row."""
    return m.groupBy(row).applyInPandas(lambda p: p.assign(**{value: f(p[value])}), m.schema)


def wide(m: DataFrame, names: list, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """One row for each matrix row, a column for each of the names; give them, else Spark runs a job to find them."""
    return m.groupBy(row).pivot(col, names).agg(F.first(value))


def long(w: DataFrame, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    return w.unpivot(row, [c for c in w.columns if c != row], col, value)


def without_repeated_columns(m: DataFrame, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Of columns with the same values in all rows, the first by name."""
    prints = m.groupBy(col).agg(F.sum(F.xxhash64(row, value).cast("decimal(38,0)")).alias("_a"), F.sum(F.xxhash64(value, F.lit(1), row).cast("decimal(38,0)")).alias("_b"), F.count("*").alias("_n"))
    return m.join(prints.groupBy("_a", "_b", "_n").agg(F.min(col).alias(col)).select(col), col, "left_semi")


def invalid_numbers(lines: DataFrame, text: str = "text", line: str = "line") -> DataFrame:
    """Lines whose text is no number."""
    return lines.filter(F.col(text).isNotNull() & F.expr(f"try_cast({text} AS DOUBLE)").isNull()).select(line)


def clean_name(name: Column) -> Column:
    """Without quotes, dots as dashes, without a leading X."""
    return F.regexp_replace(F.translate(F.regexp_replace(name, '"', ""), ".", "-"), "^X", "")


def differences(a: DataFrame, b: DataFrame, eps: float, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Cells that differ by more than eps, or are missing on one side only."""
    x, y = a.select(row, col, F.col(value).alias("a")), b.select(row, col, F.col(value).alias("b"))
    both = x.join(y, [row, col], "full_outer")
    return both.filter((F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > eps))
