"""Statistics of price series as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUNK_CENTS, COHORT_LEAST, SUSPECT_SPREAD = 50, 4, 8.0


def usd(cents: Column) -> Column:
    """Dollars to the cent; half a cent goes up."""
    return F.floor(cents + 0.5) / 100.0


def rounded(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10.0**digits


def grade_label() -> Column:
    grade = F.regexp_replace(F.col("grade").cast("string"), r"\.0$", "")
    return F.coalesce(F.concat("grader", F.lit(" "), grade), F.col("grader"), F.lit("Raw"))


def priced() -> Column:
    return F.col("price_cents").isNotNull() & (F.col("currency") == "USD")


def ask_only() -> Column:
    return (F.col("best_offer") == 1) & (F.coalesce("offer_status", F.lit("")) != "found")


def nearest_rank(values: Column, share: float) -> Column:
    """Element at round((n - 1) * share) of a sorted array, halves to the even rank; null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.least(n - 1, F.rint((n - 1) * share).cast("int")) + 1))


def floor_rank(values: Column, share: float) -> Column:
    """Element at floor((n - 1) * share) of a sorted array; null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.floor((n - 1) * share).cast("int") + 1))


def middle(values: Column) -> Column:
    """Mean of the two middle elements of an array, sorted here."""
    s = F.array_sort(values)
    n = F.size(s)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.element_at(s, half + 1).cast("double")).when(n > 0, (F.element_at(s, half) + F.element_at(s, half + 1)) / 2.0)


def trend(values: Column) -> Column:
    """Percent from the median of the older half to that of the newer, of an array in the order of time."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    old, new = middle(F.slice(values, 1, half)), middle(F.slice(values, half + 1, F.greatest(n - half, F.lit(0))))
    return change(old, new, n)


def change(old: Column, new: Column, n: Column) -> Column:
    """Percent from ``old`` to ``new``; null where fewer than four prices stand behind them or the old one is zero."""
    return F.when((n >= COHORT_LEAST) & (old != 0), rounded(100.0 * (new - old) / old, 1))


def spread(values: Column) -> Column:
    """Ratio of the 90th to the 10th percentile of a cohort."""
    s = F.array_sort(values)
    low = nearest_rank(s, 0.1)
    return F.when(low != 0, rounded(nearest_rank(s, 0.9) / low.cast("double"), 2))


def quality(numberless: Column, spread_: Column) -> Column:
    return F.when(numberless, "bucket").when(spread_.isNull(), "unproven").when(spread_ >= SUSPECT_SPREAD, "suspect").otherwise("clean")
