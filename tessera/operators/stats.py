"""Statistics of matrices and groups; missing values are NULL and never count."""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import tables

#: Cells of which one task may hold the counts by value (some 50 MB).
FEW = 1 << 20
#: Makes the median absolute deviation an estimate of a normal distribution's sd.
MAD_SCALE = 1.4826


def r_stddev(value: str) -> Column:
    return F.round(F.stddev_samp(value), 8)


def quantile(value: str, p: float) -> Column:
    """Linear between the two nearest ranks."""
    return F.expr(f"percentile({value}, {p})")


def counted(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A table of the distinct values (of each group), NULL left out: by, value, n (times), low (cells of smaller values).

    Nothing sorts all cells in one task: cells are counted by value, the distinct values are dealt by
    range, and each range starts behind the counts of those before it.
    """
    by = by or []
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    dealt = tables.keep(n.repartitionByRange(*by, value).withColumn("_p", F.spark_partition_id()), "values")
    sums = dealt.groupBy(*by, "_p").agg(F.sum("n").alias("_t"))
    before = sums.withColumn("_b", F.sum("_t").over(W.partitionBy(*by).orderBy("_p")) - F.col("_t")).drop("_t")  # a row for each range
    inside = F.sum("n").over(W.partitionBy(*by, "_p").orderBy(value)) - F.col("n")
    return dealt.withColumn("_i", inside).join(before, [*by, "_p"]).select(*by, value, "n", (F.col("_i") + F.col("_b")).alias("low"))


def quantiles(df: DataFrame, value: str, at: list[float], most: int | None = None) -> list[float | None]:
    """Quantiles of all cells as numbers, linear between the two nearest ranks; None without cells.

    most: a number of cells that there can't be more of, where it is known. Up to FEW cells are counted in one pass, in a map of at most so many values. Beyond that they are dealt by range (see
    ``counted``), and at most two values for each quantile come to the driver.
    """
    some = df.select(value).filter(F.col(value).isNotNull())
    if most is None:
        most = some.agg(F.count("*")).first()[0]
    if most <= FEW:
        got = some.agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in at]))).first()[0]
        return [None] * len(at) if got is None else list(got)
    with tables.scope():
        d = counted(df, value)
        total = d.agg(F.max(F.col("low") + F.col("n"))).first()[0]
        if not total:
            return [None] * len(at)
        ranks = [p * (total - 1) for p in at]
        wanted = sorted({f(r) for r in ranks for f in (math.floor, math.ceil)})
        holds = functools.reduce(operator.or_, [(F.col("low") <= r) & (F.col("low") + F.col("n") > r) for r in wanted])
        rows = d.filter(holds).select(value, "n", "low").collect()
    value_at = {r: next(x[0] for x in rows if x["low"] <= r < x["low"] + x["n"]) for r in wanted}
    return [value_at[math.floor(r)] if r == math.floor(r) else (math.ceil(r) - r) * value_at[math.floor(r)] + (r - math.floor(r)) * value_at[math.ceil(r)] for r in ranks]


def trim_mean(df: DataFrame, by: list[str], value: str, trim: float, name: str = "trim_mean") -> DataFrame:
    """Mean of each group without its floor(trim * n) lowest and highest values; 0.5 is the median, none 0."""
    if trim >= 0.5:
        return df.groupBy(*by).agg(F.coalesce(quantile(value, 0.5), F.lit(0.0)).alias(name))
    w = W.partitionBy(*by)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))).withColumn("_n", F.count(value).over(w))
    k = F.floor(F.col("_n") * trim)
    inside = F.when((F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k), F.col(value))
    return d.groupBy(*by).agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias(name))


def mad(df: DataFrame, by: list[str], value: str, name: str = "mad") -> DataFrame:
    mid = df.groupBy(*by).agg(quantile(value, 0.5).alias("_mid"))
    away = df.join(mid, by).withColumn("_away", F.abs(F.col(value) - F.col("_mid")))
    return away.groupBy(*by).agg((quantile("_away", 0.5) * MAD_SCALE).alias(name))


def r_variance_columns(m: DataFrame, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Variance of each column's values times N / (N - 1), N the number of all rows, missing or not."""
    n = m.agg(F.count_distinct(row).alias("_n"))
    v = m.groupBy(col).agg(F.var_pop(value).alias("variance"))
    return v.crossJoin(F.broadcast(n)).withColumn("variance", F.try_divide(F.col("variance") * F.col("_n"), F.col("_n") - 1)).drop("_n")


def mean_row_variance(m: DataFrame, row: str = "row", value: str = "value") -> DataFrame:
    """One row: the mean of the rows' sample variances."""
    return m.groupBy(row).agg(F.var_samp(value).alias("v")).agg(F.avg("v").alias("row_variance"))


def residual(m: DataFrame, by: list[str], row: str = "row", col: str = "col", value: str = "value", most_variance: float | None = None) -> DataFrame:
    """Mean of |x + mu - row mean - column mean| in each submatrix, mu the mean of the row means; 1 for one row or column.

    With ``most_variance`` over the mean of the rows' sample variances, that being at most so much (and so much where it is missing).
    """
    rows = m.groupBy(*by, row).agg(F.avg(value).alias("_r"))
    cols = m.groupBy(*by, col).agg(F.avg(value).alias("_c"))
    size = rows.groupBy(*by).agg(F.avg("_r").alias("_mu"), F.count("*").alias("n_rows")).join(cols.groupBy(*by).agg(F.count("*").alias("n_cols")), by)
    d = m.join(rows, [*by, row]).join(cols, [*by, col]).join(size, by)
    away = F.avg(F.abs(F.col(value) + F.col("_mu") - F.col("_r") - F.col("_c")))
    if most_variance is not None:
        own = m.groupBy(*by, row).agg(F.var_samp(value).alias("_v")).groupBy(*by).agg(F.avg("_v").alias("_v"))
        d = d.join(own, by)
        away = away / F.coalesce(F.least(F.nanvl(F.max("_v"), F.lit(most_variance)), F.lit(most_variance)), F.lit(most_variance))
    return d.groupBy(*by).agg(F.when(F.least(F.max("n_rows"), F.max("n_cols")) <= 1, 1.0).otherwise(away).alias("residual"))


def hypergeometric_tail(df: DataFrame, q: str, m: str, n: str, k: str, name: str = "pvalue") -> DataFrame:
    """P(X > q) for X white among k drawn of m white and n black ones, strictly more, in logarithms from term to term."""

    def choose(a: float, b: float) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def one(q: int, m: int, n: int, k: int) -> float:
        low, high = max(q + 1, k - n, 0), min(m, k)
        if high < low:
            return 0.0
        x = np.arange(low, high, dtype=float)
        steps = np.log((m - x) * (k - x)) - np.log((x + 1) * (n - k + x + 1))
        return float(np.exp(choose(m, low) + choose(n, k - low) - choose(m + n, k) + np.concatenate([[0.0], np.cumsum(steps)])).sum())

    @F.pandas_udf("double")
    def tail(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([one(*map(int, x)) for x in zip(q, m, n, k, strict=True)], dtype=float)

    return df.withColumn(name, tail(*(F.coalesce(F.col(x).cast("long"), F.lit(0)) for x in (q, m, n, k))))


def repeated(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values that a group has more than once."""
    return df.groupBy(*by, value).agg(F.count("*").alias("times")).filter("times > 1")


def int_histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("times"))


def float_histogram(df: DataFrame, value: str, buckets: int = 20) -> DataFrame:
    """Equal buckets from least to most, the last one closed: bucket (from 0), low (its edge), times."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / buckets
    bucket = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_a")) / F.greatest(width, F.lit(1e-300))))).otherwise(0).cast("long")
    d = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bucket", bucket)
    return d.groupBy("bucket").agg(F.max(F.col("_a") + F.col("bucket") * width).alias("low"), F.count("*").alias("times"))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Least, quartiles and most by index: r[n / 4], r[n / 2 + n % 2] (the last if beyond) and r[-(n / 4 + 1)]; groups are a cluster's size."""
    d = df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_r")).withColumn("_n", F.size("_r"))
    q, mid = F.floor(F.col("_n") / 4).cast("int"), F.floor(F.col("_n") / 2 + F.col("_n") % 2).cast("int")
    at = lambda i: F.get("_r", i.cast("int"))
    return d.select(
        *by, at(F.lit(0)).alias("least"), at(q).alias("lower"), at(F.least(mid, F.col("_n") - 1)).alias("middle"), at(F.col("_n") - q - 1).alias("upper"), at(F.col("_n") - 1).alias("most")
    )
