"""Ratios and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; the job fails with ``message`` where it does not."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 when there is nothing to divide by; a negative numerator fails the job."""
    quotient = F.when(denominator <= 0, 0.0).otherwise(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    return _checked(numerator >= 0, quotient, "safe_ratio: the numerator is negative")


def coverage_ratio(documented: Column, total: Column) -> Column:
    """Documented share, 1.0 when there is nothing to document."""
    quotient = F.when(total <= 0, 1.0).otherwise(F.try_divide(documented.cast("double"), total.cast("double")))
    return _checked(
        (documented >= 0) & ((total <= 0) | (documented <= total)),
        quotient,
        "coverage_ratio: documented is outside 0..total",
    )


def per_kloc(count: Column, lines: Column) -> Column:
    """Occurrences per thousand lines, 0.0 for an empty file."""
    rate = F.when(lines == 0, 0.0).otherwise(F.try_divide(count.cast("double"), lines.cast("double")) * 1000.0)
    return _checked((count >= 0) & (lines >= 0), rate, "per_kloc: negative input")
