"""Collection runs: lost segments, pace and cost, thin and missing days, query yields, offers, quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, RUNS_SQL, flat, runs, segments, table

W = f"WITH {FLAT_SQL}"
WR = f"WITH {RUNS_SQL}"
LOST = ("capped", "unreached", "incomplete", "failed")


@query("a_leak_status", f"{WR} SELECT status, count(*) AS segments, sum(items)::BIGINT AS items FROM segments GROUP BY 1")
def a_leak_status(spark, sf):
    return segments(spark, sf).groupBy("status").agg(F.count("*").alias("segments"), F.sum("items").alias("items"))


@query("a_leak_query", f"{WR} SELECT query_id, count(*) AS segments, sum(items)::BIGINT AS items, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in LOST) + " FROM segments GROUP BY 1")
def a_leak_query(spark, sf):
    return segments(spark, sf).groupBy("query_id").agg(F.count("*").alias("segments"), F.sum("items").alias("items"), *(F.count_if(F.col("status") == s).alias(s) for s in LOST)).orderBy(F.desc("items"), "query_id")


@query("a_leak_worst", f"{WR} SELECT run_id, segment_id, items FROM segments WHERE note LIKE '%still capped%' ORDER BY items DESC, run_id, segment_id LIMIT 20")
def a_leak_worst(spark, sf):
    return segments(spark, sf).where("note like '%still capped%'").orderBy(F.desc("items"), "run_id", "segment_id").limit(20).select("run_id", "segment_id", "items")


@query("a_leak_days", f"{WR} SELECT r.target_date, count(*) FILTER (WHERE s.status IN ('capped', 'unreached', 'incomplete')) AS lost_segments, count(*) FILTER (WHERE s.status = 'failed') AS failed_segments, count(*) AS segments, sum(s.items)::BIGINT AS items FROM segments s JOIN runs r USING (run_id) GROUP BY 1", dates="target_date")
def a_leak_days(spark, sf):
    s = segments(spark, sf).join(runs(spark, sf).select("run_id", "target_date"), "run_id")
    return s.groupBy("target_date").agg(F.count_if(F.col("status").isin(*LOST[:3])).alias("lost_segments"), F.count_if(F.col("status") == "failed").alias("failed_segments"), F.count("*").alias("segments"), F.sum("items").alias("items"))


@query("a_incomplete_days", f"{WR} SELECT r.target_date, count(*) AS segments, string_agg(DISTINCT s.query_id, ',' ORDER BY s.query_id) AS queries FROM segments s JOIN runs r USING (run_id) WHERE s.status = 'incomplete' GROUP BY 1", dates="target_date")
def a_incomplete_days(spark, sf):
    s = segments(spark, sf).where("status = 'incomplete'").join(runs(spark, sf).select("run_id", "target_date"), "run_id")
    return s.groupBy("target_date").agg(F.count("*").alias("segments"), F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias("queries"))


@query("a_uncredited", f"{W} SELECT count(*) FILTER (WHERE query_id IS NULL) AS uncredited, count(*) AS sales FROM flat WHERE sold_date IS NOT NULL")
def a_uncredited(spark, sf):
    return flat(spark, sf).where("sold_date is not null").agg(F.count_if(F.col("query_id").isNull()).alias("uncredited"), F.count("*").alias("sales"))


@query("a_query_yield", f"{W} SELECT query_id, count(*) AS sales, floor(count(*) / sum(count(*)) OVER () * 10000 + 0.5) / 10000.0 AS share, min(sold_date) AS first_sold, max(sold_date) AS last_sold FROM flat WHERE query_id IS NOT NULL GROUP BY 1", dates="first_sold last_sold")
def a_query_yield(spark, sf):
    rows = flat(spark, sf).where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("sales"), F.min("sold_date").alias("first_sold"), F.max("sold_date").alias("last_sold"))
    total = rows.agg(F.sum("sales").alias("total"))
    return rows.crossJoin(total).select("query_id", "sales", stats.rounded(F.col("sales") / F.col("total"), 4).alias("share"), "first_sold", "last_sold")  # one row


@query("a_pace", f"""{WR}, r AS (SELECT *, epoch_ms(finished_at) - epoch_ms(started_at) AS ms FROM runs ORDER BY target_date DESC LIMIT 14)
  SELECT count(*) AS runs, sum(pages_fetched)::BIGINT AS pages, sum(items_seen)::BIGINT AS items, floor(sum(ms) FILTER (WHERE ms > 0) / 1000.0 / sum(pages_fetched) FILTER (WHERE ms > 0) * 100 + 0.5) / 100.0 AS seconds_per_page FROM r""")
def a_pace(spark, sf, last=14):
    r = runs(spark, sf).orderBy(F.desc("target_date")).limit(last).withColumn("ms", F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")))
    timed = F.col("ms") > 0
    per = F.sum(F.when(timed, F.col("ms"))) / 1000.0 / F.sum(F.when(timed, F.col("pages_fetched")))
    return r.agg(F.count("*").alias("runs"), F.sum("pages_fetched").alias("pages"), F.sum("items_seen").alias("items"), stats.rounded(per, 2).alias("seconds_per_page"))


def cost_by_query(s):
    per = s.groupBy("query_id").agg(F.sum("pages").alias("pages"), F.count("*").alias("bands"), F.sum("items").alias("sales"))
    total = per.agg(F.sum("pages").alias("all_pages"), F.sum("sales").alias("all_sales"))
    per = per.crossJoin(total)  # one row
    page_share, sale_share = F.col("pages") / F.col("all_pages"), F.col("sales") / F.col("all_sales")
    return per.select(
        "query_id", "pages", "bands", "sales", stats.rounded(page_share, 4).alias("page_share"), stats.rounded(sale_share, 4).alias("sale_share"),
        stats.rounded(sale_share / page_share, 3).alias("value"), stats.rounded(F.col("pages") / F.col("sales"), 4).alias("pages_per_sale"),
    )


@query("a_cost_by_query", f"""{WR}, p AS (SELECT query_id, sum(pages)::BIGINT AS pages, count(*) AS bands, sum(items)::BIGINT AS sales FROM segments GROUP BY 1), t AS (SELECT sum(pages)::DOUBLE AS ap, sum(sales)::DOUBLE AS asl FROM p)
  SELECT query_id, pages, bands, sales, floor(pages / ap * 10000 + 0.5) / 10000.0 AS page_share, floor(sales / asl * 10000 + 0.5) / 10000.0 AS sale_share, floor((sales / asl) / (pages / ap) * 1000 + 0.5) / 1000.0 AS value, floor(pages / sales::DOUBLE * 10000 + 0.5) / 10000.0 AS pages_per_sale FROM p, t""")
def a_cost_by_query(spark, sf):
    return cost_by_query(segments(spark, sf)).orderBy("value", "query_id")


@query("a_band_efficiency", f"{WR} SELECT segment_id, sum(items)::BIGINT AS items, sum(pages)::BIGINT AS pages, floor(sum(items) / sum(pages) * 100 + 0.5) / 100.0 AS per_page FROM segments GROUP BY 1 HAVING sum(items) < 5 * sum(pages)")
def a_band_efficiency(spark, sf, least=5):
    s = segments(spark, sf).groupBy("segment_id").agg(F.sum("items").alias("items"), F.sum("pages").alias("pages"))
    return s.where(F.col("items") < least * F.col("pages")).withColumn("per_page", stats.rounded(F.col("items") / F.col("pages"), 2))


@query("a_savings", f"{WR} SELECT sum(pages) FILTER (WHERE query_id IN ('error', 'view'))::BIGINT AS pages_saved, floor(sum(pages) FILTER (WHERE query_id IN ('error', 'view')) * 3.0 / 60 * 10 + 0.5) / 10.0 AS minutes_saved, sum(items) FILTER (WHERE query_id IN ('error', 'view'))::BIGINT AS sales_lost FROM segments")
def a_savings(spark, sf, drop=("error", "view"), seconds=3.0):
    pages = F.sum(F.when(F.col("query_id").isin(*drop), F.col("pages")))
    return segments(spark, sf).agg(pages.alias("pages_saved"), stats.rounded(pages * seconds / 60, 1).alias("minutes_saved"), F.sum(F.when(F.col("query_id").isin(*drop), F.col("items"))).alias("sales_lost"))


def week(day):
    """Year and Monday-first week of the year; days before the first Monday are in week 00."""
    d = F.col(day)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("string"), 2, "0"))


@query("x_week", "SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-W%W') AS week FROM lineitem")
def x_week(spark, sf):
    return table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct().select(F.date_format("d", "yyyy-MM-dd").alias("day"), week("d").alias("week"))


@query("a_offer_weekly", f"{W} SELECT strftime(sold_date, '%Y-W%W') AS week, count(*) AS sales, sum(best_offer)::BIGINT AS best_offers, floor(100.0 * sum(best_offer) / count(*) * 10 + 0.5) / 10.0 AS pct FROM flat GROUP BY 1 ORDER BY 1 DESC LIMIT 8")
def a_offer_weekly(spark, sf):
    rows = flat(spark, sf).groupBy(week("sold_date").alias("week")).agg(F.count("*").alias("sales"), F.sum("best_offer").alias("best_offers"))
    return rows.withColumn("pct", stats.rounded(100.0 * F.col("best_offers") / F.col("sales"), 1)).orderBy(F.desc("week")).limit(8)


@query("a_offer_backlog", f"{W} SELECT count(*) FILTER (WHERE coalesce(offer_status, '') <> 'found') AS pending, count(*) FILTER (WHERE offer_status = 'found') AS found FROM flat WHERE best_offer = 1 AND sold_date > DATE '2001-06-01' - 85 AND sold_date <= DATE '2001-06-01' AND price_cents >= 1000000")
def a_offer_backlog(spark, sf, as_of="2001-06-01", floor_cents=1_000_000):
    d = F.lit(as_of).cast("date")
    rows = flat(spark, sf).where((F.col("best_offer") == 1) & (F.col("sold_date") > F.date_sub(d, 85)) & (F.col("sold_date") <= d) & (F.col("price_cents") >= floor_cents))
    return rows.agg(F.count_if(F.coalesce("offer_status", F.lit("")) != "found").alias("pending"), F.count_if(F.col("offer_status") == "found").alias("found"))


@query("a_offer_discount", f"{W} SELECT floor((1 - sum(price_cents) FILTER (WHERE offer_status = 'found')::DOUBLE / sum(ask_cents) FILTER (WHERE offer_status = 'found')) * 10000 + 0.5) / 10000.0 AS discount, count(*) FILTER (WHERE offer_status = 'found') AS found, count(*) FILTER (WHERE offer_status = 'error') AS error, count(*) FILTER (WHERE offer_status IS NULL) AS unseen FROM flat WHERE best_offer = 1")
def a_offer_discount(spark, sf):
    found = F.col("offer_status") == "found"
    cut = 1 - F.sum(F.when(found, F.col("price_cents"))).cast("double") / F.sum(F.when(found, F.col("ask_cents")))
    return flat(spark, sf).where("best_offer = 1").agg(stats.rounded(cut, 4).alias("discount"), F.count_if(found).alias("found"), F.count_if(F.col("offer_status") == "error").alias("error"), F.count_if(F.col("offer_status").isNull()).alias("unseen"))


THIN = """SELECT d AS day, n, floor(n / p90::DOUBLE * 100 + 0.5) / 100.0 AS fraction FROM (SELECT sold_date AS d, count(*) AS n FROM flat GROUP BY 1),
  (SELECT list_sort(list(n))[least(count(*) - 1, round_even((count(*) - 1) * 0.9, 0)::INT) + 1] AS p90, count(*) AS days FROM (SELECT count(*) AS n FROM flat GROUP BY sold_date)) WHERE n < 0.5 * p90 AND days >= 3"""


@query("a_thin_days", f"{W} {THIN}", dates="day")
def a_thin_days(spark, sf, ratio=0.5):
    days = flat(spark, sf).groupBy(F.col("sold_date").alias("day")).agg(F.count("*").alias("n"))
    ref = days.agg(stats.nearest_rank(F.array_sort(F.collect_list("n")), 0.9).alias("p90"), F.count("*").alias("days"))  # one number a day
    return days.crossJoin(ref).where((F.col("n") < ratio * F.col("p90")) & (F.col("days") >= 3)).select("day", "n", stats.rounded(F.col("n") / F.col("p90").cast("double"), 2).alias("fraction"))


@query("a_coverage_report", f"""{WR}, w AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-30' - 19, DATE '2024-01-30', INTERVAL 1 DAY) t(d)), ok AS (SELECT target_date FROM runs WHERE status = 'ok')
  SELECT count(*) FILTER (WHERE day IN (SELECT target_date FROM ok)) AS collected, count(*) FILTER (WHERE day NOT IN (SELECT target_date FROM ok)) AS missing, max(day) FILTER (WHERE day NOT IN (SELECT target_date FROM ok)) AS next_up,
  (SELECT count(*) FROM ok WHERE target_date < DATE '2024-01-30' - 19) AS outside FROM w""", dates="next_up")
def a_coverage_report(spark, sf, as_of="2024-01-30", days=20):
    end = F.lit(as_of).cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    done = runs(spark, sf).where("status = 'ok'").select(F.col("target_date").alias("day"), F.lit(True).alias("ok"))
    both = spine.withColumn("inside", F.lit(True)).join(done, "day", "full_outer")
    inside, ok = F.coalesce("inside", F.lit(False)), F.coalesce("ok", F.lit(False))
    return both.agg(F.count_if(inside & ok).alias("collected"), F.count_if(inside & ~ok).alias("missing"), F.max(F.when(inside & ~ok, F.col("day"))).alias("next_up"), F.count_if(~inside & (F.col("day") < F.date_sub(end, days - 1))).alias("outside"))


@query("a_completed_days", f"{WR} SELECT target_date FROM runs WHERE status = 'ok' AND items_seen > 0", dates="target_date")
def a_completed_days(spark, sf):
    return runs(spark, sf).where("status = 'ok'").select("target_date").intersect(table(spark, sf, "events").select(F.to_date("ts")))


@query("a_watermark", f"{WR} SELECT strftime(max(m), '%Y-%m-%d %H:%M') AS watermark FROM (SELECT max(started_at) AS m FROM runs UNION ALL SELECT max(finished_at) FROM runs)")
def a_watermark(spark, sf):
    r = runs(spark, sf)
    return r.agg(F.max("started_at").alias("m")).unionAll(r.agg(F.max("finished_at"))).agg(F.date_format(F.max("m"), "yyyy-MM-dd HH:mm").alias("watermark"))


@query("a_run_report", f"""{WR}, q AS (SELECT DISTINCT event_type AS query_id FROM events) SELECT r.run_id, r.status, q.query_id, coalesce(sum(s.items), 0)::BIGINT AS items, coalesce(sum(s.items), 0) = 0 AS empty
  FROM runs r CROSS JOIN q LEFT JOIN segments s ON s.run_id = r.run_id AND s.query_id = q.query_id GROUP BY 1, 2, 3""")
def a_run_report(spark, sf):
    known = table(spark, sf, "events").select(F.col("event_type").alias("query_id")).distinct().agg(F.collect_set("query_id").alias("q"))  # configured queries
    r = runs(spark, sf).select("run_id", "status").crossJoin(known).select("run_id", "status", F.explode("q").alias("query_id"))
    s = segments(spark, sf).groupBy("run_id", "query_id").agg(F.sum("items").alias("items"))
    return r.join(s, ["run_id", "query_id"], "left").select("run_id", "status", "query_id", F.coalesce("items", F.lit(0)).alias("items"), (F.coalesce("items", F.lit(0)) == 0).alias("empty"))


@query("a_recent_runs", f"{WR} SELECT run_id, status, items_seen, items_new FROM runs ORDER BY started_at DESC LIMIT 5")
def a_recent_runs(spark, sf):
    return runs(spark, sf).orderBy(F.desc("started_at")).limit(5).select("run_id", "status", "items_seen", "items_new")


@query("a_usage_quota", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) > 5 AS over FROM events GROUP BY 1, 2")
def a_usage_quota(spark, sf, quota=5):
    return table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests")).withColumn("over", F.col("requests") > quota)


@query("a_image_coverage", f"{W} SELECT count(*) AS n, count(image_url) AS with_photo, floor(count(image_url) / count(*)::DOUBLE * 1000 + 0.5) / 1000.0 AS coverage FROM flat")
def a_image_coverage(spark, sf):
    return flat(spark, sf).agg(F.count("*").alias("n"), F.count("image_url").alias("with_photo"), stats.rounded(F.count("image_url") / F.count("*"), 3).alias("coverage"))


@query("a_import_report", f"{W} SELECT count(*) AS seen, count(DISTINCT card_key) AS cards, count(*) FILTER (WHERE card_key IS NULL) AS skipped, min(sold_date) AS first_day, max(sold_date) AS last_day FROM flat", dates="first_day last_day")
def a_import_report(spark, sf):
    return flat(spark, sf).agg(F.count("*").alias("seen"), F.count_distinct("card_key").alias("cards"), F.count_if(F.col("card_key").isNull()).alias("skipped"), F.min("sold_date").alias("first_day"), F.max("sold_date").alias("last_day"))
