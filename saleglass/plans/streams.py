"""Streaming jobs; each equals its batch twin on the same input."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.operators import catalogue as cat
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, flat, sales, table
from saleglass.sources.files import new_path
from saleglass.streaming import jobs

WC = f"WITH {FLAT_SQL}, {cat.CATALOGUE_SQL}"


def _landed(spark, df, name):
    """The rows as files that a stream picks up, as many as the rows need."""
    path = new_path(spark, name)
    df.write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return path


@query("stream_ingest_dedupe", f"WITH {FLAT_SQL} SELECT item_id, price_cents + CASE WHEN price_cents % 3 = 0 THEN 7 ELSE 0 END AS price_cents FROM flat")
def stream_ingest_dedupe(spark, sf):
    s = sales(spark, sf).select("item_id", "price_cents", F.lit(1).alias("seq"))
    again = s.where("price_cents % 3 = 0").select("item_id", (F.col("price_cents") + 7).alias("price_cents"), F.lit(2).alias("seq"))
    stream = jobs.file_stream(spark, _landed(spark, s.unionByName(again), "landed"), 4)
    return jobs.last_of_each(stream, new_path(spark, "sales"), "item_id", "seq").select("item_id", "price_cents")


@query("stream_daily_volume", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(user_id) AS top FROM events GROUP BY 1", dates="day")
def stream_daily_volume(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    stream = jobs.file_stream(spark, _landed(spark, rows, "events"))
    return jobs.windowed(stream, new_path(spark, "volume"), "ts", [], [F.count("*").alias("n"), F.max("user_id").alias("top")])


@query("stream_usage_quota", "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS requests, count(*) > 5 AS over FROM events GROUP BY 1, 2", dates="day")
def stream_usage_quota(spark, sf, quota=5):
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    stream = jobs.file_stream(spark, _landed(spark, rows, "events"))
    return jobs.windowed(stream, new_path(spark, "quota"), "ts", ["user_id"], [F.count("*").alias("requests")]).withColumn("over", F.col("requests") > quota)


@query("stream_touched_catalogue", f"{WC} SELECT card_key, sales, median_cents FROM cat")
def stream_touched_catalogue(spark, sf):
    """Cards touched by a micro-batch are computed anew from their sales so far, which stand in partitions by card."""
    rows = flat(spark, sf).where("card_key is not null")
    stream = jobs.file_stream(spark, _landed(spark, rows, "landed"), 4)
    cards = jobs.per_key(stream, new_path(spark, "cards"), "item_id", "card_key", cat.catalogue)
    return cards.select("card_key", "sales", "median_cents")
