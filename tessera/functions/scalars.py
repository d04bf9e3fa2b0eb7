"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.names import ordinal, patched, without_vng_modification
from ..operators.results import format_float
from ..operators.sequences import concrete, downstream, iupac_letter, largest_letter, letter, log_odds, masked, revcomp, subsequence, upstream

__all__ = [
    "concrete", "downstream", "format_float", "iupac_letter", "largest_letter", "letter", "log_clipped", "log_odds", "masked", "number_or_zero", "ordinal", "outer", "patched",
    "revcomp", "standard_fuzzy", "subsequence", "upstream", "without_vng_modification",
]


def log_clipped(x: Column, low: float = 1e-20, high: float = 1000.0) -> Column:
    return F.ln(F.least(F.greatest(x, F.lit(low)), F.lit(high)) + 1e-99)


def number_or_zero(x: Column) -> Column:
    """NaN and NULL as 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def outer(x: Column, y: Column, f) -> Column:
    """f of every pair of two arrays, an array for each element of the first."""
    return F.transform(x, lambda a: F.transform(y, lambda b: f(a, b)))


def standard_fuzzy(iteration: Column, num_iterations: int) -> Column:
    return 0.7 * F.exp(-iteration / (num_iterations / 3)) + 0.05
