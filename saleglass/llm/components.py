"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleglass.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): node and component (the smallest node of it), for every node that has a link.

    Each round joins a node's neighbours to the smallest of them (first the larger neighbours, then the smaller ones),
    until nothing changes; rounds grow with the logarithm of the longest chain. Aggregates stay partial before each
    shuffle, and a node's neighbours are never gathered in one row.
    """

    def larger_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    edges, before = keep(larger_first(links), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = larger_first(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(larger_first(small.unionByName(low.select("a", F.col("m").alias("b")))), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(roots.select("component", "component").toDF("node", "component").distinct())
