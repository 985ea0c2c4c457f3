"""Known names met by word windows: of a bounded roster inside the row, of a larger one by joins."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleglass.functions.text import folded_person
from saleglass.sources.files import new_path

#: Names of a roster that stands in the plan, some 0.5 MB; longer rosters meet the windows by joins.
IN_ROW = 20_000
#: Letters of the shortest folded name that counts as a second one.
LEAST = 8


def spellings(roster: DataFrame) -> DataFrame:
    """name (lower case) and fold of every known name; of one fold the longest spelling, then the first."""
    each = roster.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct().withColumn("fold", folded_person("name"))
    best = each.where(F.length("fold") >= LEAST).groupBy("fold").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("best"))
    return each.join(best, "fold", "left")


def few(names: DataFrame, in_row: int = IN_ROW) -> bool:
    """Whether ``names`` are ``in_row`` or fewer, whatever the table they come from."""
    return names.limit(in_row + 1).count() <= in_row


def short(names: DataFrame) -> DataFrame:
    """``names`` to be sent to all tasks if they are few; else as they are."""
    return F.broadcast(names) if few(names) else names


def _hashed(keys: DataFrame, cells: int) -> Column:
    """A short table of (key, value) as one constant array of cells, found by the key's hash."""
    held: list[list] = [[] for _ in range(cells)]
    for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(cells)).alias("cell"), "key", "value").orderBy("key").collect():
        held[r["cell"]].append([r["key"], r["value"]])
    return F.from_json(F.lit(json.dumps(held)), "array<array<array<string>>>")


def _found(cells: Column, n: int, key: Column) -> Column:
    """The value of a key, null without one."""
    near = F.filter(F.get(cells, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), lambda e: e[0] == key)
    return F.get(near, F.lit(0))[1]


def looked_up(keys: DataFrame) -> Callable[[Column], Column]:
    """What gives the value of a key of ``keys`` (key, value; few) within a row, null without one."""
    cells = 1 << max(keys.count() - 1, 1).bit_length()
    held = _hashed(keys, cells)
    return lambda key: _found(held, cells, key)


def with_known(df: DataFrame, roster: DataFrame, windows: str, folds: str, hit: str, also: str, in_row: int = IN_ROW) -> DataFrame:
    """``df`` with the first of its ``windows`` (texts) that is a known name, as said, and all known names of its ``folds``
    (folded texts), in their longest spelling. A null window is none. ``roster`` has a column ``name``."""
    known = spellings(roster)
    n = known.count()
    if n > in_row:
        return _joined(df, known, windows, folds, hit, also)
    cells = 1 << max(n - 1, 1).bit_length()
    by_name = _hashed(known.select(F.col("name").alias("key"), F.col("name").alias("value")), cells)
    by_fold = _hashed(known.where("best is not null").select(F.col("fold").alias("key"), F.col("best").alias("value")).distinct(), cells)
    first = F.get(F.filter(windows, lambda w: _found(by_name, cells, F.lower(w)).isNotNull()), F.lit(0))
    names = F.array_compact(F.transform(F.array_distinct(folds), lambda w: _found(by_fold, cells, w)))
    return df.withColumns({hit: first, also: F.array_distinct(names)})


def _joined(df: DataFrame, known: DataFrame, windows: str, folds: str, hit: str, also: str) -> DataFrame:
    path = new_path(df.sparkSession, "roster-rows")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    said = rows.select("_row", F.posexplode(windows).alias("_at", "_w")).join(known.select(F.col("name").alias("_name")), F.lower("_w") == F.col("_name"))
    first = said.groupBy("_row").agg(F.min_by("_w", "_at").alias(hit))
    heard = rows.select("_row", F.explode(F.array_distinct(folds)).alias("_w")).join(known.where("best is not null").select(F.col("fold").alias("_w"), "best").distinct(), "_w")
    names = heard.groupBy("_row").agg(F.collect_set("best").alias(also))  # windows of one title
    none = F.array().cast("array<string>")
    return rows.join(first, "_row", "left").join(names, "_row", "left").withColumn(also, F.coalesce(also, none)).drop("_row")
