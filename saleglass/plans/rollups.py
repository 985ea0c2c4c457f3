"""Daily, player, set, grade and card rollups, leaderboards and catalogue pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.operators import catalogue as cat
from saleglass.operators import ranks
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, RUNS_SQL, SERIES_SQL, flat, runs, series

W = f"WITH {FLAT_SQL}"
WC = f"WITH {FLAT_SQL}, {cat.CATALOGUE_SQL}"
USD_MEDIAN = "floor(median(price_cents) + 0.5) / 100.0"
OK = "price_cents IS NOT NULL AND currency = 'USD'"


MIDDLE = {"lower": ranks.LOWER_MIDDLE, "upper": ranks.UPPER_MIDDLE}


def middle():
    return (F.col("lower") + F.col("upper")) / 2.0


def day_prices(rows):
    """Counts, total and ranked dollar prices of each day."""
    ok = F.when(stats.priced(), F.col("price_cents"))
    return ranks.profile(rows, ["sold_date"], ok, MIDDLE | {"p90": ranks.nearest(0.9)})


def day_rollup(rows):
    """One row a day: all sales, priced ones, their median, 90th percentile and total in dollars."""
    return day_prices(rows).select(
        "sold_date",
        F.col("rows").alias("n"),
        F.col("valued").alias("priced"),
        stats.usd(middle()).alias("median"),
        stats.usd(F.col("p90")).alias("p90"),
        (F.coalesce("total", F.lit(0)) / 100.0).alias("total"),
    )


P90_SQL = "list_sort(list(price_cents) FILTER (WHERE {ok}))[CAST(round_even((count(*) FILTER (WHERE {ok}) - 1) * 0.9, 0) AS INT) + 1]".format(ok=OK)


@query("a_daily", f"""{W} SELECT * FROM (SELECT sold_date, count(*) AS n, count(*) FILTER (WHERE {OK}) AS priced, floor(median(price_cents) FILTER (WHERE {OK}) + 0.5) / 100.0 AS median,
  floor({P90_SQL} + 0.5) / 100.0 AS p90, coalesce(sum(price_cents) FILTER (WHERE {OK}), 0)::BIGINT / 100.0 AS total FROM flat GROUP BY sold_date) ORDER BY sold_date DESC LIMIT 400""", dates="sold_date")
def a_daily(spark, sf):
    return daily(flat(spark, sf))


def daily(rows):
    return day_rollup(rows).orderBy(F.desc("sold_date")).limit(400).orderBy("sold_date")


@query("a_daily_cents", f"""{W} SELECT sold_date, count(*) AS n, count(*) FILTER (WHERE {OK}) AS priced, trunc(median(price_cents) FILTER (WHERE {OK}))::BIGINT AS median_cents,
  {P90_SQL} AS p90_cents, (sum(price_cents) FILTER (WHERE {OK}))::BIGINT AS total_cents FROM flat WHERE sold_date >= DATE '1998-01-01' GROUP BY sold_date""", dates="sold_date")
def a_daily_cents(spark, sf, since="1998-01-01"):
    return day_prices(flat(spark, sf).where(F.col("sold_date") >= F.lit(since).cast("date"))).select(
        "sold_date",
        F.col("rows").alias("n"),
        F.col("valued").alias("priced"),
        middle().cast("long").alias("median_cents"),
        F.col("p90").alias("p90_cents"),
        F.col("total").alias("total_cents"),
    )


@query("a_daily_served", f"{W} SELECT sold_date, count(*) AS n, sum(price_cents)::BIGINT AS total_cents FROM flat WHERE {OK} GROUP BY 1 ORDER BY 1 DESC LIMIT 30", dates="sold_date")
def a_daily_served(spark, sf, days=30):
    return flat(spark, sf).where(stats.priced()).groupBy("sold_date").agg(F.count("*").alias("n"), F.sum("price_cents").alias("total_cents")).orderBy(F.desc("sold_date")).limit(days)


@query("a_daily_summary", f"""{W} SELECT sold_date, count(*) AS n, sum(best_offer)::BIGINT AS best_offers, floor(sum(price_cents)::DOUBLE / count(price_cents) + 0.5) / 100.0 AS avg_usd, max(price_cents) / 100.0 AS max_usd
  FROM flat WHERE sold_date = DATE '1998-06-01' GROUP BY 1""", dates="sold_date")
def a_daily_summary(spark, sf, day="1998-06-01"):
    return flat(spark, sf).where(F.col("sold_date") == F.lit(day).cast("date")).groupBy("sold_date").agg(
        F.count("*").alias("n"), F.sum("best_offer").alias("best_offers"), stats.usd(F.sum("price_cents").cast("double") / F.count("price_cents")).alias("avg_usd"), (F.max("price_cents") / 100.0).alias("max_usd")
    )


@query("a_players", f"""{W}, p AS (SELECT * FROM flat WHERE {OK} AND confidence >= 0.5),
  t AS (SELECT player, team FROM (SELECT player, team, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, length(team), team) AS r FROM p GROUP BY 1, 2) WHERE r = 1)
  SELECT player, any_value(t.team) AS team, count(*) AS n, {USD_MEDIAN} AS median, max(price_cents) / 100.0 AS max, sum(price_cents)::BIGINT / 100.0 AS total FROM p JOIN t USING (player)
  GROUP BY player ORDER BY n DESC, median DESC, player LIMIT 250""")
def a_players(spark, sf):
    return players(flat(spark, sf))


def players(rows):
    p = rows.where(stats.priced() & (F.col("confidence") >= 0.5) & F.col("player").isNotNull())
    out = p.groupBy("player").agg(F.count("*").alias("n"), stats.usd(F.median("price_cents")).alias("median"), (F.max("price_cents") / 100.0).alias("max"), (F.sum("price_cents") / 100.0).alias("total"))
    return out.join(cat.group_name(p, "player", "team"), "player", "left").orderBy(F.desc("n"), F.desc("median"), "player").limit(250).select("player", "team", "n", "median", "max", "total")


@query("a_players_served", f"""{W} SELECT player, count(*) AS n, trunc(sum(price_cents)::DOUBLE / count(*))::BIGINT AS avg_cents, max(price_cents) AS max_cents FROM flat
  WHERE price_cents IS NOT NULL AND player ILIKE '%ring%' GROUP BY player ORDER BY n DESC, player LIMIT 200""")
def a_players_served(spark, sf, q="ring"):
    return flat(spark, sf).where(F.col("price_cents").isNotNull() & F.col("player").ilike(f"%{q}%")).groupBy("player").agg(
        F.count("*").alias("n"), (F.sum("price_cents").cast("double") / F.count("*")).cast("long").alias("avg_cents"), F.max("price_cents").alias("max_cents")
    ).orderBy(F.desc("n"), "player").limit(200)


@query("a_players_avg", f"{W} SELECT player, count(*) AS n, floor(sum(price_cents)::DOUBLE / count(*) + 0.5) / 100.0 AS avg_usd FROM flat WHERE price_cents IS NOT NULL GROUP BY player ORDER BY n DESC, player LIMIT 10")
def a_players_avg(spark, sf):
    return flat(spark, sf).where("price_cents is not null").groupBy("player").agg(F.count("*").alias("n"), stats.usd(F.sum("price_cents").cast("double") / F.count("*")).alias("avg_usd")).orderBy(F.desc("n"), "player").limit(10)


@query("a_sets", f"{W} SELECT set_name, count(*) AS n, {USD_MEDIAN} AS median FROM flat WHERE {OK} GROUP BY 1 ORDER BY n DESC, set_name LIMIT 60")
def a_sets(spark, sf):
    return sets(flat(spark, sf))


def sets(rows):
    return rows.where(stats.priced()).groupBy("set_name").agg(F.count("*").alias("n"), stats.usd(F.median("price_cents")).alias("median")).orderBy(F.desc("n"), "set_name").limit(60)


@query("a_grades", f"{W} SELECT grade_label, count(*) AS n, {USD_MEDIAN} AS median FROM labelled WHERE {OK} GROUP BY 1 ORDER BY n DESC, grade_label LIMIT 24")
def a_grades(spark, sf):
    return grades(flat(spark, sf))


def grades(rows):
    rows = rows.where(stats.priced()).withColumn("grade_label", stats.grade_label())
    return rows.groupBy("grade_label").agg(F.count("*").alias("n"), stats.usd(F.median("price_cents")).alias("median")).orderBy(F.desc("n"), "grade_label").limit(24)


@query("x_grade_label", f"{W} SELECT item_id, grade_label FROM labelled")
def x_grade_label(spark, sf):
    return flat(spark, sf).select("item_id", stats.grade_label().alias("grade_label"))


@query("a_catalogue", f"{WC} SELECT * FROM cat", dates="first_sold last_sold")
def a_catalogue(spark, sf):
    return cat.catalogue(flat(spark, sf))


@query("a_card_grades", f"{W} SELECT card_key, grade_label, count(*) AS sales, trunc(median(price_cents))::BIGINT AS median_cents, min(price_cents) AS low_cents, max(price_cents) AS high_cents, max(sold_date) AS last_sold FROM labelled WHERE {OK} AND card_key IS NOT NULL GROUP BY 1, 2", dates="last_sold")
def a_card_grades(spark, sf):
    return cat.card_grades(flat(spark, sf))


@query("a_set_menu", f"{WC} SELECT year, set_name, count(*) AS cards, sum(sales)::BIGINT AS sales FROM cat WHERE quality = 'clean' GROUP BY 1, 2 ORDER BY sales DESC, year, set_name LIMIT 100")
def a_set_menu(spark, sf):
    return cat.catalogue(flat(spark, sf)).where("quality = 'clean'").groupBy("year", "set_name").agg(F.count("*").alias("cards"), F.sum("sales").alias("sales")).orderBy(F.desc("sales"), "year", "set_name").limit(100)


@query("a_quality_counts", f"{WC} SELECT quality, count(*) AS cards, sum(sales)::BIGINT AS sales FROM cat GROUP BY 1")
def a_quality_counts(spark, sf):
    return cat.catalogue(flat(spark, sf)).groupBy("quality").agg(F.count("*").alias("cards"), F.sum("sales").alias("sales"))


def histories(rows, most):
    """The ``most`` cards with most sales (two at least), with all their sales in order of time. Sales are listed for
    these cards alone."""
    u = cat.usable(rows)
    top = u.groupBy("card_key").agg(
        F.count("*").alias("n"),
        stats.usd(F.median("price_cents")).alias("median"),
        (F.min("price_cents") / 100.0).alias("low"),
        (F.max("price_cents") / 100.0).alias("high"),
        F.min("sold_date").alias("first_sold"),
        F.max("sold_date").alias("last_sold"),
    )
    top = top.where("n >= 2").orderBy(F.desc("n"), F.desc("median"), "card_key").limit(most)
    shown = u.join(F.broadcast(top.select("card_key")), "card_key", "left_semi")
    sale = F.struct("sold_date", "item_id", (F.col("price_cents") / 100.0).alias("price"), "grade_label")
    points = shown.groupBy("card_key").agg(F.array_sort(F.collect_list(sale)).alias("points"))
    return top.join(points, "card_key").join(cat.judged(shown), "card_key", "left")


def cards(rows):
    return histories(rows, 2500)


@query("a_card_histories", f"""{WC}, h AS (SELECT card_key, count(*) AS n, {USD_MEDIAN} AS median, min(price_cents) / 100.0 AS low, max(price_cents) / 100.0 AS high, min(sold_date) AS first_sold, max(sold_date) AS last_sold,
   md5(string_agg(strftime(sold_date, '%Y-%m-%d') || ' ' || price_cents || ' ' || grade_label, ',' ORDER BY sold_date, item_id)) AS points_md5 FROM u GROUP BY 1 HAVING count(*) >= 2)
  SELECT h.*, spread, trend_pct FROM h LEFT JOIN jd USING (card_key) ORDER BY n DESC, median DESC, card_key LIMIT 2500""", dates="first_sold last_sold")
def a_card_histories(spark, sf):
    line = F.transform("points", lambda p: F.concat_ws(" ", F.date_format(p["sold_date"], "yyyy-MM-dd"), F.round(p["price"] * 100).cast("long").cast("string"), p["grade_label"]))
    return histories(flat(spark, sf), 2500).select("card_key", "n", "median", "low", "high", "first_sold", "last_sold", F.md5(F.array_join(line, ",")).alias("points_md5"), "spread", "trend_pct")


@query("a_card_history", f"""{W} SELECT grade_label, count(*) AS n, min(sold_date) AS first_sold, max(sold_date) AS last_sold, min(price_cents) / 100.0 AS low, max(price_cents) / 100.0 AS high, {USD_MEDIAN} AS median,
  string_agg(price_cents, ',' ORDER BY sold_date, item_id) AS points FROM labelled WHERE card_key = 'k7' AND price_cents IS NOT NULL AND NOT (best_offer = 1 AND coalesce(offer_status, '') <> 'found') GROUP BY 1""", dates="first_sold last_sold")
def a_card_history(spark, sf, key="k7"):
    rows = flat(spark, sf).where((F.col("card_key") == key) & F.col("price_cents").isNotNull() & ~stats.ask_only()).withColumn("grade_label", stats.grade_label())
    return rows.groupBy("grade_label").agg(
        F.count("*").alias("n"), F.min("sold_date").alias("first_sold"), F.max("sold_date").alias("last_sold"), (F.min("price_cents") / 100.0).alias("low"), (F.max("price_cents") / 100.0).alias("high"),
        stats.usd(F.median("price_cents")).alias("median"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sold_date", "item_id", "price_cents"))), lambda s: s["price_cents"].cast("string")), ",").alias("points"),
    )


@query("a_top_cards", f"""{WC} SELECT u.card_key, any_value(nm.card_name) AS name, count(*) AS n, trunc(sum(price_cents)::DOUBLE / count(*))::BIGINT AS avg_cents, max(price_cents) AS max_cents FROM u JOIN nm USING (card_key)
  WHERE sold_date > DATE '2001-01-01' - 365 AND sold_date <= DATE '2001-01-01' GROUP BY 1 ORDER BY n DESC, avg_cents DESC, card_key LIMIT 50""")
def a_top_cards(spark, sf, as_of="2001-01-01", days=365):
    u = cat.usable(flat(spark, sf))
    day = F.lit(as_of).cast("date")
    top = u.where((F.col("sold_date") > F.date_sub(day, days)) & (F.col("sold_date") <= day)).groupBy("card_key").agg(F.count("*").alias("n"), (F.sum("price_cents").cast("double") / F.count("*")).cast("long").alias("avg_cents"), F.max("price_cents").alias("max_cents"))
    top = top.orderBy(F.desc("n"), F.desc("avg_cents"), "card_key").limit(50)
    names = cat.group_name(u.join(F.broadcast(top.select("card_key")), "card_key", "left_semi"), "card_key", "card_name")
    return top.join(names, "card_key").select("card_key", F.col("card_name").alias("name"), "n", "avg_cents", "max_cents")


_STATS = "count(*) AS n, list_sort(list(price_cents))[floor((count(*) - 1) * 0.5)::INT + 1] AS median_cents, list_sort(list(price_cents))[floor((count(*) - 1) * 0.1)::INT + 1] AS p10_cents, list_sort(list(price_cents))[floor((count(*) - 1) * 0.9)::INT + 1] AS p90_cents, floor(sum(price_cents)::DOUBLE / count(*) + 0.5)::BIGINT AS mean_cents, min(price_cents) AS low_cents, max(price_cents) AS high_cents"


@query("a_price_stats", f"""{W} SELECT best_offer = 1 AND coalesce(offer_status, '') <> 'found' AS is_ask, {_STATS} FROM flat WHERE price_cents IS NOT NULL AND player ILIKE '%widget%' AND grader = 'PSA' GROUP BY 1""")
def a_price_stats(spark, sf, player="widget", grader="PSA"):
    rows = flat(spark, sf).where(F.col("price_cents").isNotNull() & F.col("player").ilike(f"%{player}%") & (F.col("grader") == grader))
    picks = {"median_cents": ranks.floored(0.5), "p10_cents": ranks.floored(0.1), "p90_cents": ranks.floored(0.9)}
    found = ranks.profile(rows.withColumn("is_ask", stats.ask_only()), ["is_ask"], "price_cents", picks)
    return found.select(
        "is_ask",
        F.col("rows").alias("n"),
        *picks,
        F.floor(F.col("total").cast("double") / F.col("rows") + 0.5).alias("mean_cents"),
        F.col("low").alias("low_cents"),
        F.col("high").alias("high_cents"),
    )


@query("a_meta", f"""{W} SELECT count(*) AS total, count(*) FILTER (WHERE {OK}) AS priced, sum(best_offer)::BIGINT AS best_offers, count(*) FILTER (WHERE currency <> 'USD') AS non_usd, count(*) FILTER (WHERE confidence >= 0.5) AS confident,
  count(DISTINCT sold_date) AS days, min(sold_date) AS first_day, max(sold_date) AS last_day, count(*) FILTER (WHERE sold_date = (SELECT max(sold_date) FROM flat)) AS latest_sales, floor(median(price_cents) FILTER (WHERE {OK}) + 0.5) / 100.0 AS median FROM flat""", dates="first_day last_day")
def a_meta(spark, sf):
    return meta(flat(spark, sf))


def meta(rows):
    ok = F.when(stats.priced(), F.col("price_cents"))
    by_day = rows.groupBy("sold_date").agg(
        F.count("*").alias("total"),
        F.sum("best_offer").alias("best_offers"),
        F.count_if(F.col("currency") != "USD").alias("non_usd"),
        F.count_if(F.col("confidence") >= 0.5).alias("confident"),
    )
    whole = by_day.agg(
        *(F.sum(c).alias(c) for c in ("total", "best_offers", "non_usd", "confident")),
        F.count("sold_date").alias("days"),
        F.min("sold_date").alias("first_day"),
        F.max("sold_date").alias("last_day"),
        F.max_by("total", "sold_date").alias("latest_sales"),
    )
    prices = ranks.profile(rows, [], ok, MIDDLE).select(F.col("valued").alias("priced"), stats.usd(middle()).alias("median"))
    return whole.crossJoin(prices)  # one row each


@query("a_summary_served", f"{W} SELECT count(*) AS total, count(price_cents) AS priced, sum(best_offer)::BIGINT AS best_offers, min(sold_date) AS first_day, max(sold_date) AS last_day FROM flat", dates="first_day last_day")
def a_summary_served(spark, sf):
    return flat(spark, sf).agg(F.count("*").alias("total"), F.count("price_cents").alias("priced"), F.sum("best_offer").alias("best_offers"), F.min("sold_date").alias("first_day"), F.max("sold_date").alias("last_day"))


@query("st_median_usd", f"{W} SELECT set_name, {USD_MEDIAN} AS median FROM flat GROUP BY 1")
def st_median_usd(spark, sf):
    return flat(spark, sf).groupBy("set_name").agg(stats.usd(F.median("price_cents")).alias("median"))


@query("st_p90_nearest", f"{W} SELECT set_name, list_sort(list(price_cents))[CAST(round_even((count(*) - 1) * 0.9, 0) AS INT) + 1] AS p90 FROM flat GROUP BY 1")
def st_p90_nearest(spark, sf):
    return ranks.profile(flat(spark, sf), ["set_name"], "price_cents", {"p90": ranks.nearest(0.9)}).select("set_name", "p90")


@query("st_pct_floor", f"{W} SELECT set_name, list_sort(list(price_cents))[floor((count(*) - 1) * 0.5)::INT + 1] AS p50 FROM flat GROUP BY 1")
def st_pct_floor(spark, sf):
    return ranks.profile(flat(spark, sf), ["set_name"], "price_cents", {"p50": ranks.floored(0.5)}).select("set_name", "p50")


_S = f"""WITH {SERIES_SQL}, g AS (SELECT card_key, grade_label, min(lpad(CAST(event_id AS VARCHAR), 12, '0')) AS f, list(price_cents ORDER BY sold_date, event_id) FILTER (WHERE price_cents >= 50) AS ps FROM series GROUP BY 1, 2),
  co AS (SELECT card_key, grade_label, ps FROM (SELECT *, row_number() OVER (PARTITION BY card_key ORDER BY len(ps) DESC, f) AS r FROM g WHERE len(ps) >= 4) WHERE r = 1)"""


def _cohorts(spark, sf):
    return cat.cohorts(series(spark, sf).withColumn("item_id", F.lpad("item_id", 12, "0")))


@query("largest_cohort", f"{_S} SELECT card_key, len(ps)::BIGINT AS n, array_to_string(ps, ',') AS prices FROM co")
def largest_cohort(spark, sf):
    return _cohorts(spark, sf).select("card_key", F.size("prices").cast("long").alias("n"), F.array_join(F.transform("prices", lambda x: x.cast("string")), ",").alias("prices"))


_D = "list_sort(ps)[least(len(ps) - 1, round_even((len(ps) - 1) * {p}, 0)::INT) + 1]"


@query("price_dispersion", f"{_S} SELECT card_key, floor({_D.format(p=0.9)} / {_D.format(p=0.1)}::DOUBLE * 100 + 0.5) / 100.0 AS spread FROM co")
def price_dispersion(spark, sf):
    return _cohorts(spark, sf).select("card_key", stats.spread(F.col("prices")).alias("spread"))


_T = "floor(100.0 * (list_median(ps[len(ps) // 2 + 1:]) - list_median(ps[1:len(ps) // 2])) / list_median(ps[1:len(ps) // 2]) * 10 + 0.5) / 10.0"


@query("price_trend", f"WITH {SERIES_SQL}, co AS (SELECT card_key, list(price_cents ORDER BY sold_date, event_id) AS ps FROM series GROUP BY 1) SELECT card_key, CASE WHEN len(ps) >= 4 THEN {_T} END AS trend_pct FROM co")
def price_trend(spark, sf):
    rows = ranks.numbered(series(spark, sf), "card_key", "sold_date", "event_id")
    halves = rows.withColumn("newer", F.col("nth") > F.floor(F.col("of") / 2))
    found = ranks.profile(halves, ["card_key", "newer"], "price_cents", MIDDLE).withColumn("middle", middle())
    both = found.groupBy("card_key").agg(
        F.sum("rows").alias("n"), F.max(F.when(F.col("newer"), F.col("middle"))).alias("new"), F.max(F.when(~F.col("newer"), F.col("middle"))).alias("old")
    )
    return both.select("card_key", stats.change(F.col("old"), F.col("new"), F.col("n")).alias("trend_pct"))


@query("grade_trend", f"{_S} SELECT k.card_key, CASE WHEN ps IS NOT NULL THEN {_T} END AS trend_pct, coalesce(len(ps), 0)::BIGINT AS trend_sales FROM (SELECT DISTINCT card_key FROM series) k LEFT JOIN co USING (card_key)")
def grade_trend(spark, sf):
    keys = series(spark, sf).select("card_key").distinct()
    judged = _cohorts(spark, sf).select("card_key", stats.trend(F.col("prices")).alias("trend_pct"), F.size("prices").cast("long").alias("n"))
    return keys.join(judged, "card_key", "left").select("card_key", "trend_pct", F.coalesce("n", F.lit(0).cast("long")).alias("trend_sales"))


@query("card_quality", f"{WC} SELECT card_key, quality FROM cat")
def card_quality(spark, sf):
    return cat.catalogue(flat(spark, sf)).select("card_key", "quality")


@query("w_group_name", f"{WC} SELECT card_key, card_name FROM nm")
def w_group_name(spark, sf):
    return cat.group_name(cat.usable(flat(spark, sf)), "card_key", "card_name")


@query("w_first_last_non_null", f"{WC} SELECT card_key, arg_max(sport, (sold_date, item_id)) AS sport, arg_min(image_url, (sold_date, item_id)) FILTER (WHERE image_url <> '') AS image_url FROM u GROUP BY 1")
def w_first_last_non_null(spark, sf):
    image = F.when(F.col("image_url") != "", F.struct("sold_date", "item_id"))
    return cat.usable(flat(spark, sf)).groupBy("card_key").agg(cat.newest("sport"), F.min_by("image_url", image).alias("image_url"))


_PAGE = ["card_key", "name", "sales", "median_cents", "trend_pct", "last_sold", "year", "quality"]
_COLS = ", ".join(_PAGE)
#: Columns of each sort; a minus means falling order. Nulls come first when rising and last when falling.
SORTS = {
    "traded": ["-sales", "-median_cents"], "value": ["-median_cents", "-sales"], "cheapest": ["median_cents", "-sales"], "rising": ["-trend_pct", "-sales"], "falling": ["trend_pct", "-sales"],
    "recent": ["-last_sold", "-sales"], "newest": ["-year", "-sales"], "oldest": ["year", "-sales"], "name": ["name"],
}


def sorted_page(catalogue, sort, limit=50):
    rows = catalogue.where("trend_pct is not null") if sort in ("rising", "falling") else catalogue
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in [*SORTS[sort], "card_key"]]
    return rows.orderBy(*order).limit(limit)


for _sort, _columns in SORTS.items():
    _where = "WHERE trend_pct IS NOT NULL" if _sort in ("rising", "falling") else ""
    _order = ", ".join(f"{c[1:]} DESC NULLS LAST" if c[0] == "-" else f"{c} ASC NULLS FIRST" for c in [*_columns, "card_key"])
    query(f"w_sort_{_sort}", f"{WC} SELECT {_COLS} FROM cat {_where} ORDER BY {_order} LIMIT 50", dates="last_sold")(lambda spark, sf, s=_sort: sorted_page(cat.catalogue(flat(spark, sf)), s).select(*_PAGE))


@query("w_movers", f"{WC} SELECT {_COLS} FROM cat WHERE trend_sales >= 10 AND trend_pct IS NOT NULL AND quality = 'clean' ORDER BY trend_pct DESC, sales DESC, card_key LIMIT 25", dates="last_sold")
def w_movers(spark, sf):
    return sorted_page(cat.catalogue(flat(spark, sf)).where("trend_sales >= 10 and quality = 'clean'"), "rising", 25).select(*_PAGE)


@query("w_cheap_rookies", f"{WC} SELECT {_COLS} FROM cat WHERE is_rookie = 1 AND median_cents <= 4000000 AND sales >= 5 ORDER BY sales DESC, median_cents DESC, card_key LIMIT 25", dates="last_sold")
def w_cheap_rookies(spark, sf, most_cents=4_000_000):
    rows = cat.catalogue(flat(spark, sf)).where((F.col("is_rookie") == 1) & (F.col("median_cents") <= most_cents) & (F.col("sales") >= 5))
    return sorted_page(rows, "traded", 25).select(*_PAGE)


@query("w_player_value", f"{WC} SELECT {_COLS} FROM cat WHERE player = 'small ring' AND quality IN ('clean', 'unproven') ORDER BY median_cents DESC, sales DESC, card_key LIMIT 25", dates="last_sold")
def w_player_value(spark, sf, player="small ring"):
    return sorted_page(cat.catalogue(flat(spark, sf)).where((F.col("player") == player) & F.col("quality").isin("clean", "unproven")), "value", 25).select(*_PAGE)


@query("w_recent", f"{W} SELECT item_id, sold_date, price_cents FROM flat ORDER BY sold_date DESC, price_cents DESC, item_id LIMIT 1500", dates="sold_date")
def w_recent(spark, sf):
    return recent(flat(spark, sf))


def recent(rows):
    return rows.orderBy(F.desc("sold_date"), F.desc("price_cents"), "item_id").limit(1500).select("item_id", "sold_date", "price_cents")


@query("w_top_sales", f"{W} SELECT item_id, sold_date, price_cents FROM flat WHERE {OK} ORDER BY price_cents DESC, item_id LIMIT 100", dates="sold_date")
def w_top_sales(spark, sf):
    return top(flat(spark, sf))


def top(rows):
    return rows.where(stats.priced()).orderBy(F.desc("price_cents"), "item_id").limit(100).select("item_id", "sold_date", "price_cents")


@query("w_latest_runs", f"WITH {RUNS_SQL} SELECT run_id, status, pages_fetched FROM runs ORDER BY target_date DESC LIMIT 7")
def w_latest_runs(spark, sf):
    return runs(spark, sf).orderBy(F.desc("target_date")).limit(7).select("run_id", "status", "pages_fetched")


@query("w_resumable_run", f"WITH {RUNS_SQL} SELECT target_date, max(run_id) AS run_id FROM runs WHERE status = 'running' GROUP BY 1", dates="target_date")
def w_resumable_run(spark, sf):
    return runs(spark, sf).where("status = 'running'").groupBy("target_date").agg(F.max_by("run_id", "started_at").alias("run_id"))


@query("w_halves", f"""WITH {SERIES_SQL} SELECT card_key, event_id, r <= n // 2 AS older FROM (SELECT card_key, event_id, row_number() OVER (PARTITION BY card_key ORDER BY sold_date, event_id) AS r, count(*) OVER (PARTITION BY card_key) AS n FROM series)""")
def w_halves(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("card_key")
    nth = F.row_number().over(w.orderBy("sold_date", "event_id"))
    return series(spark, sf).select("card_key", "event_id", (nth <= F.floor(F.count("*").over(w) / 2)).alias("older"))


@query("w_keyset_page", f"{WC} SELECT card_key, median_cents FROM cat WHERE (median_cents, card_key) < (5000000, 'k5') ORDER BY median_cents DESC, card_key DESC LIMIT 40")
def w_keyset_page(spark, sf, after=(5_000_000, "k5"), size=40):
    rows = cat.catalogue(flat(spark, sf)).select("card_key", "median_cents")
    return rows.where(F.struct("median_cents", "card_key") < F.struct(F.lit(after[0]).cast("long"), F.lit(after[1]))).orderBy(F.desc("median_cents"), F.desc("card_key")).limit(size)


@query("w_has_more", f"{W}, p AS (SELECT item_id, price_cents, row_number() OVER (ORDER BY price_cents DESC, item_id) AS r FROM flat WHERE set_name = 'Brand1' ORDER BY r LIMIT 26) SELECT item_id, price_cents, (SELECT count(*) > 25 FROM p) AS has_more FROM p WHERE r <= 25")
def w_has_more(spark, sf, size=25):
    page = flat(spark, sf).where("set_name = 'Brand1'").orderBy(F.desc("price_cents"), "item_id").limit(size + 1).select("item_id", "price_cents")
    held = page.agg(F.array_sort(F.collect_list(F.struct((-F.col("price_cents")).alias("k"), "item_id", "price_cents"))).alias("rows"))  # a page
    return held.select(F.explode(F.slice("rows", 1, size)).alias("r"), (F.size("rows") > size).alias("has_more")).select("r.item_id", "r.price_cents", "has_more")


@query("w_offer_queue", f"""{W} SELECT item_id, card_key, ask_cents, price_cents FROM flat WHERE best_offer = 1 AND coalesce(offer_status, '') <> 'found' AND sold_date >= DATE '2001-06-01' - 85 AND sold_date <= DATE '2001-06-01'
  ORDER BY card_key IS NOT NULL DESC, coalesce(ask_cents, price_cents) DESC, item_id LIMIT 500""")
def w_offer_queue(spark, sf, as_of="2001-06-01"):
    day = F.lit(as_of).cast("date")
    rows = flat(spark, sf).where(stats.ask_only() & F.col("sold_date").between(F.date_sub(day, 85), day))
    return rows.orderBy(F.col("card_key").isNotNull().desc(), F.desc(F.coalesce("ask_cents", "price_cents")), "item_id").limit(500).select("item_id", "card_key", "ask_cents", "price_cents")


@query("w_sample", f"{W} SELECT item_id, card_key FROM flat WHERE card_key IS NOT NULL AND confidence >= 0.4 ORDER BY md5(item_id || ':1'), item_id LIMIT 100")
def w_sample(spark, sf, n=100, seed=1):
    rows = flat(spark, sf).where(F.col("card_key").isNotNull() & F.col("sold_date").isNotNull() & (F.col("confidence") >= 0.4))
    return rows.orderBy(F.md5(F.concat("item_id", F.lit(f":{seed}"))), "item_id").limit(n).select("item_id", "card_key")
