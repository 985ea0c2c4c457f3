"""Sales, cards, runs and the like as views over the raw tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """A sale and its parsed attributes in one row. Lines meet suppliers where they are read, orders and parts by a shuffle, where
    sizes don't let the optimizer do without. ``dealt``: lines are dealt by order in any case (a given table may be one row group,
    that is one task), by the shuffle that large orders are met by."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = (rows.repartition("l_orderkey") if dealt else rows).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    c = F.col
    offer = c("l_discount") >= 0.05
    grader = F.when(c("l_returnflag") == "A", "PSA").when(c("l_returnflag") == "R", "BGS")
    rows = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("item_id"),
        F.to_date("l_shipdate").alias("sold_date"),
        F.round(c("l_extendedprice") * 100).cast("long").alias("price_cents"),
        F.when(c("l_suppkey") % 9 != 0, F.round(c("l_tax") * 10000).cast("long")).alias("shipping_cents"),
        F.when(c("o_orderstatus") == "P", "CAD").otherwise("USD").alias("currency"),
        offer.cast("int").alias("best_offer"),
        F.when(offer & (c("l_linenumber") % 3 == 0), "found").when(offer & (c("l_linenumber") % 3 == 1), "error").alias("offer_status"),
        F.when(offer & (c("l_linenumber") % 3 == 0), F.round(c("l_extendedprice") * 100).cast("long") + 1000).alias("ask_cents"),
        F.when(c("l_suppkey") % 2 == 0, c("l_quantity").cast("int")).alias("bids"),
        F.when(c("l_suppkey") % 2 == 0, "auction").otherwise("fixed").alias("listing_format"),
        F.when(c("l_suppkey") % 4 != 0, F.concat(F.lit("https://img/"), "l_partkey", F.lit("-"), "l_linenumber")).alias("image_url"),
        F.when(c("l_suppkey") % 11 != 0, F.concat(F.lit("q"), c("l_suppkey") % 7)).alias("query_id"),
        F.when(c("l_partkey") % 3 != 0, F.when(c("l_partkey") % 2 == 0, "football").otherwise("basketball")).alias("sport"),
        F.when(c("l_partkey") % 13 != 0, F.concat(F.lit("k"), "l_partkey")).alias("card_key"),
        F.concat("p_name", F.lit(" "), c("l_linenumber") % 3).alias("card_name"),
        c("p_name").alias("player"),
        F.regexp_replace("p_brand", "#", "").alias("set_name"),
        c("p_type").alias("parallel"),
        (c("p_size") + 1990).cast("int").alias("year"),
        c("n_name").alias("team"),
        F.when(c("l_partkey") % 5 != 0, c("l_partkey").cast("string")).alias("card_number"),
        grader.alias("grader"),
        F.when(grader.isNotNull() & (c("l_linenumber") != 7), F.when(c("l_linestatus") == "O", 10.0).otherwise(9.5)).alias("grade"),
        (c("l_linenumber") / 10.0).alias("confidence"),
        (c("l_linestatus") == "O").cast("int").alias("is_auto"),
        (c("p_size") <= 5).cast("int").alias("is_rookie"),
        (c("p_size") >= 45).cast("int").alias("is_relic"),
    )
    return rows.withColumn("title", F.concat_ws(" ", "year", "set_name", "player", F.concat(F.lit("#"), "card_number"), "grader", F.when(F.col("grade").isNotNull(), F.format_string("%.1f", "grade"))))


SALE = ["item_id", "title", "sold_date", "price_cents", "shipping_cents", "currency", "best_offer", "offer_status", "ask_cents", "bids", "listing_format", "image_url", "query_id", "sport"]
CARD = ["item_id", "card_key", "card_name", "player", "set_name", "parallel", "year", "team", "card_number", "grader", "grade", "confidence", "is_auto", "is_rookie", "is_relic"]


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).select(*SALE)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order's lines aren't parsed yet, so that joins have rows without a partner."""
    return flat(spark, sf_dir).where(~F.col("item_id").startswith("7")).select(*CARD)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as a price series with junk prices: card_key, grade label, price in cents, day, order."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("card_key"), F.col("event_type").alias("grade_label"), F.round(F.col("value") * 100).cast("long").alias("price_cents"),
        F.to_date("ts").alias("sold_date"), F.col("event_id").cast("string").alias("item_id"), F.col("event_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    r = e.groupBy(F.col("d").alias("target_date")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("items_seen"))
    day = F.dayofmonth("target_date")
    return r.select(
        F.date_format("target_date", "yyyyMMdd").alias("run_id"), "target_date", "started_at", "finished_at", "items_seen",
        F.floor(F.col("items_seen") / 10).cast("long").alias("pages_fetched"), (F.col("items_seen") - day).cast("long").alias("items_new"),
        F.when(day % 5 == 0, "partial").when(day % 7 == 0, "running").otherwise("ok").alias("status"),
    )


STATUSES = ("done", "capped", "unreached", "incomplete", "failed", "retrying")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("d", F.to_date("ts")).withColumn("band", F.floor(F.col("value") / 50).cast("int"))
    s = e.groupBy("d", "event_type", "band").agg(F.count("*").alias("items"), F.min("user_id").alias("u"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("u") % 6 + 1).cast("int"))
    return s.select(
        F.date_format("d", "yyyyMMdd").alias("run_id"), F.concat_ws("-", "event_type", "band").alias("segment_id"), F.col("event_type").alias("query_id"),
        (F.col("band") * 50.0).alias("price_lo"), (F.col("band") * 50.0 + 50).alias("price_hi"), status.alias("status"),
        F.floor(F.col("items") / 10 + 1).cast("long").alias("pages"), "items",
        F.when((status == "capped") & (F.col("band") % 2 == 0), "still capped at max depth 3").alias("note"),
    )


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0")
    return p.select(
        (F.col("p_size") + 1990).cast("int").alias("year"), F.regexp_replace("p_brand", "#", "").alias("set_name"), F.col("p_partkey").cast("string").alias("card_number"),
        F.col("p_name").alias("player"), F.col("p_type").alias("parallel"), F.when(F.col("p_partkey") % 6 == 1, "Inserts").alias("subset"), (F.col("p_partkey") % 100).cast("int").alias("print_run"),
        F.concat(F.lit("k"), "p_partkey").alias("card_key"),
    )


#: The same views for DuckDB.
FLAT_SQL = """
flat AS (
  SELECT *, concat_ws(' ', year, set_name, player, '#' || card_number, grader, format('{:.1f}', grade)) AS title FROM (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS item_id,
    CAST(l_shipdate AS DATE) AS sold_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
    CASE WHEN l_suppkey % 9 <> 0 THEN CAST(round(l_tax * 10000) AS BIGINT) END AS shipping_cents,
    CASE WHEN o_orderstatus = 'P' THEN 'CAD' ELSE 'USD' END AS currency, CAST(l_discount >= 0.05 AS INT) AS best_offer,
    CASE WHEN l_discount >= 0.05 AND l_linenumber % 3 = 0 THEN 'found' WHEN l_discount >= 0.05 AND l_linenumber % 3 = 1 THEN 'error' END AS offer_status,
    CASE WHEN l_discount >= 0.05 AND l_linenumber % 3 = 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) + 1000 END AS ask_cents,
    CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS INT) END AS bids, CASE WHEN l_suppkey % 2 = 0 THEN 'auction' ELSE 'fixed' END AS listing_format,
    CASE WHEN l_suppkey % 4 <> 0 THEN 'https://img/' || l_partkey || '-' || l_linenumber END AS image_url,
    CASE WHEN l_suppkey % 11 <> 0 THEN 'q' || (l_suppkey % 7) END AS query_id,
    CASE WHEN l_partkey % 3 <> 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'football' ELSE 'basketball' END END AS sport,
    CASE WHEN l_partkey % 13 <> 0 THEN 'k' || l_partkey END AS card_key, p_name || ' ' || (l_linenumber % 3) AS card_name, p_name AS player,
    replace(p_brand, '#', '') AS set_name, p_type AS parallel, CAST(p_size + 1990 AS INT) AS year, n_name AS team,
    CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS card_number,
    CASE l_returnflag WHEN 'A' THEN 'PSA' WHEN 'R' THEN 'BGS' END AS grader,
    CASE WHEN l_returnflag IN ('A', 'R') AND l_linenumber <> 7 THEN CASE WHEN l_linestatus = 'O' THEN 10.0::DOUBLE ELSE 9.5::DOUBLE END END AS grade,
    (l_linenumber / 10.0)::DOUBLE AS confidence, CAST(l_linestatus = 'O' AS INT) AS is_auto, CAST(p_size <= 5 AS INT) AS is_rookie, CAST(p_size >= 45 AS INT) AS is_relic
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
), cards AS (SELECT * FROM flat WHERE NOT starts_with(item_id, '7')),
labelled AS (SELECT *, coalesce(grader || ' ' || regexp_replace(CAST(grade AS VARCHAR), '\\.0$', ''), grader, 'Raw') AS grade_label FROM flat)
"""

RUNS_SQL = """
runs AS (
  SELECT strftime(target_date, '%Y%m%d') AS run_id, target_date, started_at, finished_at, items_seen, CAST(floor(items_seen / 10.0) AS BIGINT) AS pages_fetched,
    CAST(items_seen - day(target_date) AS BIGINT) AS items_new, CASE WHEN day(target_date) % 5 = 0 THEN 'partial' WHEN day(target_date) % 7 = 0 THEN 'running' ELSE 'ok' END AS status
  FROM (SELECT CAST(ts AS DATE) AS target_date, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS items_seen FROM events GROUP BY 1)
), segments AS (
  SELECT strftime(d, '%Y%m%d') AS run_id, event_type || '-' || band AS segment_id, event_type AS query_id, (band * 50.0)::DOUBLE AS price_lo, (band * 50.0 + 50)::DOUBLE AS price_hi,
    ['done', 'capped', 'unreached', 'incomplete', 'failed', 'retrying'][u % 6 + 1] AS status, CAST(floor(items / 10.0 + 1) AS BIGINT) AS pages, items,
    CASE WHEN u % 6 = 1 AND band % 2 = 0 THEN 'still capped at max depth 3' END AS note
  FROM (SELECT CAST(ts AS DATE) AS d, event_type, CAST(floor(value / 50) AS INT) AS band, count(*) AS items, min(user_id) AS u FROM events GROUP BY 1, 2, 3)
)
"""

SERIES_SQL = """
series AS (SELECT CAST(user_id AS VARCHAR) AS card_key, event_type AS grade_label, CAST(round(value * 100) AS BIGINT) AS price_cents, CAST(ts AS DATE) AS sold_date, event_id FROM events)
"""

CHECKLIST_SQL = """
checklist AS (SELECT CAST(p_size + 1990 AS INT) AS year, replace(p_brand, '#', '') AS set_name, CAST(p_partkey AS VARCHAR) AS card_number, p_name AS player, p_type AS parallel,
  CASE WHEN p_partkey % 6 = 1 THEN 'Inserts' END AS subset, CAST(p_partkey % 100 AS INT) AS print_run, 'k' || p_partkey AS card_key FROM part WHERE p_partkey % 4 <> 0)
"""
