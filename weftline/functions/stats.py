"""Statistics as column expressions: cardinality buckets, proportions, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The half-open cardinality ranges and their names.
BUCKETS = [(0, 1, "0"), (1, 2, "1"), (2, 5, "2-4"), (5, 10, "5-9"), (10, 20, "10-19"), (20, 50, "20-49"), (50, 100, "50-99"), (100, 1000, "100-999")]
EXACT_BELOW = 20
# Row counts up to which a table is sampled at a rate.
RATES = [(10_000, 1.0), (1_000_000, 0.1), (100_000_000, 0.01)]


def cardinality_bucket(n: Column) -> Column:
    """Name of the range a distinct count lies in; unknown for null and negative counts."""
    out = F.when(n.isNull() | (n < 0), "unknown")
    for low, high, name in BUCKETS:
        out = out.when((n >= low) & (n < high), name)
    return out.otherwise("1000+")


def exact_distinct(n: Column) -> Column:
    """The count itself, kept only where it is small."""
    return F.when(n < EXACT_BELOW, n)


def percent(part: Column, total: Column) -> Column:
    """part / total * 100; null for a null or zero total."""
    return F.try_divide(part.cast("double"), F.nullif(total, F.lit(0)).cast("double")) * 100


def sample_rate(row_count: int | None) -> float:
    """The share of rows to profile for a table of the given size."""
    if not row_count:
        return 0.1
    return next((rate for below, rate in RATES if row_count < below), 0.001)


def extrapolated_nulls(sampled: int, sampled_non_null: int, rate: float, total: int) -> tuple[int, int]:
    """(non-null, null) counts of the whole table from a sample at ``rate``."""
    non_null = round(sampled_non_null / rate)
    return non_null, max(0, total - non_null)


def distinct_from_ratio(n_distinct: float, rows: int) -> int:
    """A catalog's distinct estimate: below zero it is minus the share of rows."""
    return round(-n_distinct * rows) if n_distinct < 0 else round(n_distinct)
