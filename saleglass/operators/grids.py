"""One table of titles parsed under several configurations, and how each one does."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.functions import text as x
from saleglass.functions.text import folded_person, same_person
from saleglass.operators.partitions import settled
from saleglass.operators.titles import Vocabulary, numbers_of, shaped, with_read, worded, works_of

#: Share of a card's sales that name others than its leader, from which it counts as contradictory.
DISSENT = 0.1


def parse_grid(titles: DataFrame, configs: Iterable[tuple[str, Vocabulary, DataFrame | None]], sport: str = "football") -> DataFrame:
    """config, item_id, player, card_key of each title (item_id, title) under each (name, vocabulary, roster). What no
    vocabulary decides is read once, and so is what is left of equal titles."""
    rows = settled(shaped(titles), "shaped")
    early = numbers_of(rows)
    works, each = works_of(early), []
    for name, vocabulary, roster in configs:
        p = with_read(rows, worded(early, vocabulary, roster, works)).withColumns({"sport": F.lit(sport), "print_run": F.col("print_run").cast("string")})
        each.append(p.select(F.lit(name).alias("config"), "item_id", "player", x.card_key(sport).alias("card_key")))
    return functools.reduce(DataFrame.unionByName, each)


def by_leader(rows: DataFrame, keys: tuple[str, ...] = ("card_key",)) -> DataFrame:
    """(keys, folded name, n) with the most frequent folded name of the keys; ties to the shortest, then the first."""
    k = rows.withColumn("fold", folded_person("name")).groupBy(*keys, "fold").agg(F.count("*").alias("n"))
    top = k.groupBy(*keys).agg(F.min_by("fold", F.struct(-F.col("n"), F.length("fold"), "fold")).alias("leader"))
    return k.join(top, list(keys))


def contradictory(led: DataFrame, keys: tuple[str, ...] = ("card_key",)) -> DataFrame:
    """Keys with sales and dissent: sales that name somebody else than the leader, a ``DISSENT`` of all or more."""
    d = led.groupBy(*keys).agg(F.sum("n").alias("sales"), F.sum(F.when(~same_person(F.col("fold"), F.col("leader")), F.col("n"))).alias("dissent"))
    return d.where((F.col("dissent") > 0) & (F.col("dissent") / F.col("sales") >= DISSENT))


def scored(parsed: DataFrame) -> DataFrame:
    """config, keyed, groups, grouped (cards of several sales), grouped_sales, rate (share of cards of one sale) and wrong
    (sales of contradictory cards) of ``parse_grid``."""
    keyed = parsed.where("card_key is not null")
    n = keyed.groupBy("config", "card_key").agg(F.count("*").alias("n")).groupBy("config").agg(
        F.sum("n").alias("keyed"), F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("grouped"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("grouped_sales")
    )
    keys = ("config", "card_key")
    wrong = contradictory(by_leader(keyed.where("player is not null").withColumn("name", F.col("player")), keys), keys).groupBy("config").agg(F.sum("sales").alias("wrong"))
    all_ = parsed.select("config").distinct().join(n, "config", "left").join(wrong, "config", "left").fillna(0)
    return all_.withColumn("rate", stats.rounded((F.col("groups") - F.col("grouped")) / F.nullif("groups", F.lit(0)), 4))


def delta(scores: DataFrame, before: str, after: str) -> DataFrame:
    """metric, before, after and verdict of two configurations. More keyed, grouped and sharing sales are better, a smaller
    share of cards seen once is; a change of that share below 0.0005 is none."""
    metrics = ("keyed", "grouped", "grouped_sales", "rate")
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")
    both = scores.select("config", long).groupBy("m.metric").agg(*(F.max(F.when(F.col("config") == c, F.col("m.value"))).alias(name) for c, name in ((before, "before"), (after, "after"))))
    gain = F.when(F.col("metric") == "rate", F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    small = F.when(F.col("metric") == "rate", 0.0005).otherwise(0.5)
    return both.withColumn("verdict", F.when(F.abs(gain) < small, "no change").when(gain > 0, "better").otherwise("worse"))
