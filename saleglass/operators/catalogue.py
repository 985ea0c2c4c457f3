"""The catalogue: one row a card, and its market by grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saleglass.functions import stats


def group_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Most frequent name of each key; ties go to the shortest, then the alphabetically first."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.length(name), F.col(name))).alias(name))


def newest(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct("sold_date", "item_id"))).alias(column)


def cohorts(rows: DataFrame) -> DataFrame:
    """Judging cohort of each card_key: prices in order of time of its largest grade, junk prices left out.

    ``rows``: card_key, grade_label, price_cents, sold_date, item_id. Ties go to the grade whose first sale, junk
    included, is the earliest. Cards without a grade of four prices have no row. An array holds one card and grade.
    """
    real = F.col("price_cents") >= stats.JUNK_CENTS
    by_grade = rows.groupBy("card_key", "grade_label").agg(
        F.min(F.struct("sold_date", "item_id")).alias("first"),
        F.array_sort(F.collect_list(F.when(real, F.struct("sold_date", "item_id", "price_cents")))).alias("sales"),
    )
    # of equal sizes the earliest first sale: min_by over (-size, first)
    best = by_grade.where(F.size("sales") >= stats.COHORT_LEAST).groupBy("card_key").agg(F.min_by("sales", F.struct(-F.size("sales"), F.col("first"))).alias("sales"))
    return best.select("card_key", F.transform("sales", lambda s: s["price_cents"]).alias("prices"))


def judged(rows: DataFrame) -> DataFrame:
    """card_key, spread, trend_pct, trend_sales of cards with a cohort."""
    c = cohorts(rows)
    return c.select("card_key", stats.spread(F.col("prices")).alias("spread"), stats.trend(F.col("prices")).alias("trend_pct"), F.size("prices").cast("long").alias("trend_sales"))


def usable(flat: DataFrame) -> DataFrame:
    return flat.where(stats.priced() & F.col("card_key").isNotNull() & F.col("sold_date").isNotNull()).withColumn("grade_label", stats.grade_label())


def truncated_median(column: str = "price_cents") -> Column:
    return F.median(column).cast("long")


def catalogue(flat: DataFrame, grades: bool = False) -> DataFrame:
    """One row a card, with ``grades`` an array of its rows of ``card_grades`` too. Sales are dealt by card once; names and medians, grades and cards are all settled where a card's sales lie, so
    no partial result is shuffled."""
    raw = F.col("grade_label") == "Raw"
    image = F.when(F.col("image_url") != "", F.col("image_url"))
    attributes = ("player", "team", "set_name", "parallel", "year", "card_number", "sport")
    dealt = usable(flat).select(
        "card_key", "grade_label", "card_name", "price_cents", "sold_date", "item_id", *attributes, image.alias("image_url"), "is_auto", "is_rookie", "is_relic"
    ).repartition("card_key")
    card = Window.partitionBy("card_key")
    dealt = dealt.withColumn("_named", F.count("card_name").over(Window.partitionBy("card_key", "card_name")))
    dealt = dealt.withColumns({"_median": F.median("price_cents").over(card), "_raw_median": F.median(F.when(raw, F.col("price_cents"))).over(card)})
    when = F.struct("sold_date", "item_id")
    name, real = F.col("card_name"), F.col("price_cents") >= stats.JUNK_CENTS
    by_grade = dealt.groupBy("card_key", "grade_label").agg(
        F.min(when).alias("first"), F.array_sort(F.collect_list(F.when(real, F.struct("sold_date", "item_id", "price_cents")))).alias("prices"),
        F.min(F.when(name.isNotNull(), F.struct(-F.col("_named"), F.length(name), name.alias("name")))).alias("_name"),
        *(F.max(F.when(F.col(c).isNotNull(), F.struct("sold_date", "item_id", F.col(c).alias("value")))).alias(c) for c in attributes),
        F.min(F.when(F.col("image_url").isNotNull(), F.struct("sold_date", "item_id", F.col("image_url").alias("value")))).alias("image_url"),
        *(F.max(c).alias(c) for c in ("is_auto", "is_rookie", "is_relic")),
        F.count("card_number").alias("_numbers"), F.count("*").alias("sales"), F.max("_median").alias("_median"), F.max("_raw_median").alias("_raw_median"),
        F.min("price_cents").alias("low_cents"), F.max("price_cents").alias("high_cents"), F.max("sold_date").alias("last_sold"),
        *([truncated_median().alias("median_cents")] if grades else []),
    )
    size = F.size("prices")
    base = by_grade.groupBy("card_key").agg(
        F.min("_name")["name"].alias("card_name"), *(F.max(c)["value"].alias(c) for c in attributes), F.min("image_url")["value"].alias("image_url"),
        *(F.max(c).alias(c) for c in ("is_auto", "is_rookie", "is_relic")),
        (F.sum("_numbers") == 0).alias("numberless"), F.sum("sales").alias("sales"), F.max("_median").cast("long").alias("median_cents"), F.min("low_cents").alias("low_cents"), F.max("high_cents").alias("high_cents"),
        F.sum(F.when(raw, F.col("sales")).otherwise(0)).alias("raw_sales"), F.max("_raw_median").cast("long").alias("raw_median_cents"),
        F.min("first")["sold_date"].alias("first_sold"), F.max("last_sold").alias("last_sold"),
        *([F.collect_list(F.struct("grade_label", "sales", "median_cents", "low_cents", "high_cents", "last_sold")).alias("grades")] if grades else []),
        # of equal sizes the earliest first sale
        F.min(F.when(size >= stats.COHORT_LEAST, F.struct((-size).alias("n"), "first", F.transform("prices", lambda s: s["price_cents"]).alias("prices"))))["prices"].alias("_prices"),
    )
    out = base.withColumns({"spread": stats.spread(F.col("_prices")), "trend_pct": stats.trend(F.col("_prices")), "trend_sales": F.when(F.col("_prices").isNotNull(), F.size("_prices")).otherwise(0).cast("long")})
    return out.select(
        "card_key", F.coalesce("card_name", "card_key").alias("name"), *base.columns[2:-1],
        "trend_pct", "trend_sales", "spread", stats.quality(F.col("numberless"), F.col("spread")).alias("quality"),
    )


def card_grades(flat: DataFrame) -> DataFrame:
    return usable(flat).groupBy("card_key", "grade_label").agg(
        F.count("*").alias("sales"), truncated_median().alias("median_cents"), F.min("price_cents").alias("low_cents"), F.max("price_cents").alias("high_cents"), F.max("sold_date").alias("last_sold")
    )


#: The catalogue for DuckDB, over ``labelled``.
CATALOGUE_SQL = """
u AS (SELECT * FROM labelled WHERE price_cents IS NOT NULL AND currency = 'USD' AND card_key IS NOT NULL),
nm AS (SELECT card_key, card_name FROM (SELECT card_key, card_name, row_number() OVER (PARTITION BY card_key ORDER BY count(*) DESC, length(card_name), card_name) AS r FROM u GROUP BY 1, 2) WHERE r = 1),
g AS (SELECT card_key, grade_label, min(strftime(sold_date, '%Y-%m-%d') || '|' || item_id) AS f, list(price_cents ORDER BY sold_date, item_id) FILTER (WHERE price_cents >= 50) AS ps FROM u GROUP BY 1, 2),
co AS (SELECT card_key, ps FROM (SELECT *, row_number() OVER (PARTITION BY card_key ORDER BY len(ps) DESC, f) AS r FROM g WHERE len(ps) >= 4) WHERE r = 1),
ju AS (SELECT card_key, len(ps)::BIGINT AS trend_sales,
    list_sort(ps)[least(len(ps) - 1, round_even((len(ps) - 1) * 0.9, 0)::INT) + 1] AS p90, list_sort(ps)[least(len(ps) - 1, round_even((len(ps) - 1) * 0.1, 0)::INT) + 1] AS p10,
    list_median(ps[1:len(ps) // 2]) AS a, list_median(ps[len(ps) // 2 + 1:]) AS b FROM co),
jd AS (SELECT card_key, trend_sales, CASE WHEN p10 <> 0 THEN floor(p90 / p10::DOUBLE * 100 + 0.5) / 100.0 END AS spread, CASE WHEN a <> 0 THEN floor(100.0 * (b - a) / a * 10 + 0.5) / 10.0 END AS trend_pct FROM ju),
cat AS (
  SELECT card_key, any_value(coalesce(nm.card_name, card_key)) AS name,
    arg_max(player, (sold_date, item_id)) AS player, arg_max(team, (sold_date, item_id)) AS team, arg_max(set_name, (sold_date, item_id)) AS set_name, arg_max(parallel, (sold_date, item_id)) AS parallel,
    arg_max(year, (sold_date, item_id)) AS year, arg_max(u.card_number, (sold_date, item_id)) AS card_number, arg_max(sport, (sold_date, item_id)) AS sport,
    arg_min(image_url, (sold_date, item_id)) FILTER (WHERE image_url <> '') AS image_url, max(is_auto) AS is_auto, max(is_rookie) AS is_rookie, max(is_relic) AS is_relic,
    count(u.card_number) = 0 AS numberless, count(*) AS sales, trunc(median(price_cents))::BIGINT AS median_cents, min(price_cents) AS low_cents, max(price_cents) AS high_cents,
    count(*) FILTER (WHERE grade_label = 'Raw') AS raw_sales, trunc(median(price_cents) FILTER (WHERE grade_label = 'Raw'))::BIGINT AS raw_median_cents,
    min(sold_date) AS first_sold, max(sold_date) AS last_sold, any_value(trend_pct) AS trend_pct, coalesce(any_value(trend_sales), 0) AS trend_sales, any_value(spread) AS spread,
    CASE WHEN count(u.card_number) = 0 THEN 'bucket' WHEN any_value(spread) IS NULL THEN 'unproven' WHEN any_value(spread) >= 8.0 THEN 'suspect' ELSE 'clean' END AS quality
  FROM u LEFT JOIN nm USING (card_key) LEFT JOIN jd USING (card_key) GROUP BY card_key)
"""
