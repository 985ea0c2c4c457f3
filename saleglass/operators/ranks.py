"""Exact order statistics of groups of any size, without gathering a group's values.

Values are counted first. Counts are summed in cells of neighbouring values, running sums over a group's cells tell which
cell holds a rank, and running sums within that cell tell the value. A task thus holds the cells of a group or the values
of a cell, both bounded by the range of values, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 4096

#: Places in a sorted group of n values, from 0; halves go to the even place in ``nearest``.
LOWER_MIDDLE = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE = lambda n: F.floor(n / 2)


def nearest(share: float) -> Callable[[Column], Column]:
    return lambda n: F.rint((n - 1) * share)


def floored(share: float) -> Callable[[Column], Column]:
    return lambda n: F.floor((n - 1) * share)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls equal to nulls; the keys stay once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    meet = F.lit(True)
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, meet, how).drop(*(f"_r_{k}" for k in keys))


def profile(rows: DataFrame, keys: list[str], value: str | Column, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row a group of ``keys``: rows, valued, total, low, high of an integer ``value``, and for each pick the value at
    the place that it names among the sorted values (null where a group has none). Null keys make a group."""
    value = F.col(value) if isinstance(value, str) else value
    counts = rows.groupBy(*keys, F.floor(value / CELL).alias("_cell"), value.alias("_value")).agg(F.count("*").alias("_n"))
    held = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)
    whole = counts.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.sum(held).alias("valued"), F.sum(F.col("_value") * F.col("_n")).alias("total"),
        F.min("_value").alias("low"), F.max("_value").alias("high"),
    )
    group = Window.partitionBy(*keys)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum(held).alias("_m")).select(
        *keys, "_cell", "_m", F.sum("_m").over(group.orderBy("_cell")).alias("_upto"), F.sum("_m").over(group).alias("_all")
    )
    places = F.array(*(F.struct(F.lit(name).alias("pick"), place(F.col("_all")).cast("long").alias("place")) for name, place in picks.items()))
    wanted = cells.select(*keys, "_cell", (F.col("_upto") - F.col("_m")).alias("_before"), "_upto", F.inline(places))
    wanted = wanted.where((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_upto")))
    wanted = wanted.select(*keys, "_cell", "pick", (F.col("place") - F.col("_before")).alias("_place"))
    within = Window.partitionBy(*keys, "_cell").orderBy("_value")
    values = counts.select(*keys, "_cell", "_value", "_n", F.sum(held).over(within).alias("_upto"))
    found = same(values, wanted, [*keys, "_cell"]).where((F.col("_place") >= F.col("_upto") - F.col("_n")) & (F.col("_place") < F.col("_upto")))
    found = found.groupBy(*keys).agg(*(F.max(F.when(F.col("pick") == name, F.col("_value"))).alias(name) for name in picks))
    return same(whole, found, keys, "left")


def numbered(rows: DataFrame, key: str, day: str, order: str) -> DataFrame:
    """``rows`` with their place ``nth`` (from 1) in the order of (day, order) of their key, and the key's count ``of``.
    Days are counted first, so that a task orders one day of a key."""
    days = rows.groupBy(key, day).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    days = days.select(key, day, (F.sum("_n").over(whole.orderBy(day)) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("of"))
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, day).orderBy(order)))
    return same(placed, days, [key, day]).withColumn("nth", F.col("nth") + F.col("_before")).drop("_before")
