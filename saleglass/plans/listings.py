"""Filters, searches, shapes and scans over sales and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.operators import catalogue as cat
from saleglass.operators.titles import sells_several
from saleglass.registry import query
from saleglass.sources import saved
from saleglass.sources.bindings import CHECKLIST_SQL, FLAT_SQL, cards, checklist, flat, sales, table

W = f"WITH {FLAT_SQL}"
WC = f"WITH {FLAT_SQL}, {cat.CATALOGUE_SQL}"


@query("f_priced", f"{W} SELECT item_id, price_cents FROM flat WHERE price_cents IS NOT NULL AND currency = 'USD'")
def f_priced(spark, sf):
    return flat(spark, sf).where(stats.priced()).select("item_id", "price_cents")


@query("f_ask_only", f"{W} SELECT item_id FROM flat WHERE best_offer = 1 AND coalesce(offer_status, '') <> 'found'")
def f_ask_only(spark, sf):
    return flat(spark, sf).where(stats.ask_only()).select("item_id")


@query("f_confirmed", f"{W} SELECT item_id FROM flat WHERE NOT (best_offer = 1 AND coalesce(offer_status, '') <> 'found')")
def f_confirmed(spark, sf):
    return flat(spark, sf).where(~stats.ask_only()).select("item_id")


def sales_search(rows, *, player=None, set_name=None, team=None, grader=None, card_number=None, year=None, grade=None, since=None, until=None, rookie=None, auto=None, least_confidence=None, no_offers=False, limit=100):
    """Sales that meet every filter given, newest first, then dearest."""
    c = F.col
    tests = [
        (player, lambda v: c("player").ilike(f"%{v}%")), (set_name, lambda v: c("set_name").ilike(f"%{v}%")), (team, lambda v: c("team") == v), (grader, lambda v: c("grader") == v),
        (card_number, lambda v: c("card_number") == v), (year, lambda v: c("year") == v), (grade, lambda v: c("grade") == v), (since, lambda v: c("sold_date") >= F.lit(v).cast("date")),
        (until, lambda v: c("sold_date") <= F.lit(v).cast("date")), (rookie, lambda v: c("is_rookie") == int(v)), (auto, lambda v: c("is_auto") == int(v)), (least_confidence, lambda v: c("confidence") >= v),
    ]
    for value, test in tests:
        if value is not None:
            rows = rows.where(test(value))
    if no_offers:
        rows = rows.where(c("best_offer") == 0)
    return rows.orderBy(F.desc("sold_date"), F.desc("price_cents"), "item_id").limit(limit)


@query("f_sales_search", f"""{W} SELECT item_id, sold_date, price_cents FROM flat WHERE player ILIKE '%rod%' AND grader = 'PSA' AND sold_date >= DATE '1997-01-01' AND is_auto = 1 AND confidence >= 0.3 AND best_offer = 0
  ORDER BY sold_date DESC, price_cents DESC, item_id LIMIT 100""", dates="sold_date")
def f_sales_search(spark, sf):
    return sales_search(flat(spark, sf), player="rod", grader="PSA", since="1997-01-01", auto=True, least_confidence=0.3, no_offers=True).select("item_id", "sold_date", "price_cents")


def catalogue_search(rows, *, q=None, sport=None, qualities=None, least_sales=None, least_trend_sales=None, low=None, high=None, flags=None):
    c = F.col
    if q is not None:
        rows = rows.where(c("name").ilike(f"%{q}%"))
    if sport is not None:
        rows = rows.where((c("sport") == sport) | c("sport").isNull()) if sport == "football" else rows.where(c("sport") == sport)
    if qualities:
        rows = rows.where(c("quality").isin(*qualities))
    for column, least in (("sales", least_sales), ("trend_sales", least_trend_sales), ("median_cents", low)):
        if least is not None:
            rows = rows.where(c(column) >= least)
    if high is not None:
        rows = rows.where(c("median_cents") <= high)
    for flag, value in (flags or {}).items():
        rows = rows.where(c(flag) == int(value))
    return rows


@query("f_catalogue_search", f"""{WC} SELECT card_key, name, sales, median_cents, count(*) OVER () AS total FROM cat WHERE name ILIKE '%gear%' AND (sport = 'football' OR sport IS NULL) AND quality IN ('clean', 'suspect') AND sales >= 5
  AND median_cents BETWEEN 1000000 AND 9000000 AND is_rookie = 0 ORDER BY sales DESC, median_cents DESC, card_key LIMIT 50""")
def f_catalogue_search(spark, sf):
    found = catalogue_search(cat.catalogue(flat(spark, sf)), q="gear", sport="football", qualities=["clean", "suspect"], least_sales=5, low=1_000_000, high=9_000_000, flags={"is_rookie": False}).select("card_key", "name", "sales", "median_cents")
    page = found.orderBy(F.desc("sales"), F.desc("median_cents"), "card_key").limit(50)
    return page.crossJoin(found.agg(F.count("*").alias("total")))  # one row


@query("f_catalogue_cli", f"{WC} SELECT card_key, sales FROM cat WHERE quality = 'clean' AND (sport = 'football' OR sport IS NULL) AND player ILIKE '%bolt%' AND sales >= 3 AND trend_sales >= 4")
def f_catalogue_cli(spark, sf):
    rows = cat.catalogue(flat(spark, sf)).where(F.col("player").ilike("%bolt%"))
    return catalogue_search(rows, sport="football", qualities=["clean"], least_sales=3, least_trend_sales=4).select("card_key", "sales")


#: Listings of several cards, by turns, and one that only sounds like one.
SAID_LOTS = ("Lot of 5 ", "Lot of (25) ", "7 Card Rookie Lot ", "Set of 12 ", "(4) Cards Football Lot ", "Complete Team Set ", "pick your card ", "Sunset of fire ")


@query("f_multi_lot", f"""{W}, t AS (SELECT item_id, CAST(split_part(item_id, '-', 3) AS INT) AS p FROM flat)
  SELECT item_id, p % 17 = 0 AS sounds FROM t WHERE p % 17 <> 0 OR p // 17 % {len(SAID_LOTS)} = {len(SAID_LOTS) - 1}""")
def f_multi_lot(spark, sf):
    part = F.split("item_id", "-")[2].cast("int")
    turn = F.floor(part / 17) % len(SAID_LOTS) + 1
    title = F.when(part % 17 == 0, F.concat(F.element_at(F.array(*map(F.lit, SAID_LOTS)), turn.cast("int")), "title")).otherwise(F.col("title"))
    return flat(spark, sf).where(~sells_several(title)).select("item_id", (part % 17 == 0).alias("sounds"))


@query("f_table_search", f"{W} SELECT item_id FROM flat WHERE contains(lower(title), 'nation_7') OR contains(lower(player), 'nation_7') OR contains(lower(set_name), 'nation_7') OR contains(lower(team), 'nation_7')")
def f_table_search(spark, sf, q="nation_7"):
    hit = F.lit(False)
    for c in ("title", "player", "set_name", "team"):
        hit = hit | (F.instr(F.lower(F.coalesce(c, F.lit(""))), q) > 0)
    return flat(spark, sf).where(hit).select("item_id")


@query("f_all_words", f"{WC} SELECT card_key FROM cat WHERE contains(lower(name || ' ' || player || ' ' || set_name), 'brand1') AND contains(lower(name || ' ' || player || ' ' || set_name), 'red')")
def f_all_words(spark, sf, words="brand1 red"):
    rows = cat.catalogue(flat(spark, sf)).withColumn("hay", F.lower(F.concat_ws(" ", "name", "player", "set_name")))
    return rows.where(F.forall(F.split(F.lit(words.lower()), " +"), lambda w: F.contains(F.col("hay"), w))).select("card_key")


def fulltext(rows, id_col, text_col, all_of=(), none_of=()):
    """Ids of the texts that hold every word of ``all_of`` and none of ``none_of``; each row is decided where it is."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    held = rows.select(id_col, words.alias("_words"))
    for w in all_of:
        held = held.where(F.array_contains("_words", w))
    for w in none_of:
        held = held.where(~F.array_contains("_words", w))
    return held.select(id_col)


@query("f_fulltext", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND NOT list_contains(w, 'idiot')""")
def f_fulltext(spark, sf):
    return fulltext(table(spark, sf, "documents"), "doc_id", F.col("text"), ("the", "of"), ("idiot",))


@query("f_placeholder_url", f"{W} SELECT item_id, image_url LIKE '%-3' OR image_url LIKE '%-5' AS placeholder FROM flat WHERE image_url IS NOT NULL")
def f_placeholder_url(spark, sf):
    number = F.regexp_extract("image_url", r"-(\d+)$", 1)
    url = F.when(number == "3", F.lit("data:image/gif;base64,R0lGOD")).when(number == "5", F.lit("https://img/s_1x2.gif")).otherwise(F.col("image_url"))
    return flat(spark, sf).where("image_url is not null").select("item_id", url.rlike(r"(?i)^data:|/s_1x2\.gif|/blank\.gif|spacer").alias("placeholder"))


@query("f_thin_checklist", f"WITH {CHECKLIST_SQL} SELECT card_key FROM checklist WHERE year IS NOT NULL AND set_name IS NOT NULL AND (card_number IS NOT NULL OR player IS NOT NULL)")
def f_thin_checklist(spark, sf):
    c = F.col
    return checklist(spark, sf).where(c("year").isNotNull() & c("set_name").isNotNull() & (c("card_number").isNotNull() | c("player").isNotNull())).select("card_key")


@query("f_on_target_date", f"""{W} SELECT listing_format AS page, count(*) FILTER (WHERE sold_date = DATE '1999-03-03') AS on_day, bool_and(sold_date < DATE '1999-03-03') AS all_past FROM flat GROUP BY 1""")
def f_on_target_date(spark, sf, day="1999-03-03"):
    d = F.lit(day).cast("date")
    return flat(spark, sf).groupBy(F.col("listing_format").alias("page")).agg(F.count_if(F.col("sold_date") == d).alias("on_day"), F.bool_and(F.col("sold_date") < d).alias("all_past"))


CONTROL = ["_nkw", "_sacat", "_pgn", "_ipg", "lh_sold", "lh_complete", "rt", "_from"]


@query("f_aspect_clean", "SELECT event_id, event_type AS aspect, CASE event_id % 5 WHEN 0 THEN 'Base' WHEN 4 THEN 'Prizm' END AS value FROM events WHERE event_id % 5 IN (0, 4) AND event_type <> 'view'")
def f_aspect_clean(spark, sf):
    value = F.element_at(F.array(*map(F.lit, ["Base", "See all", "[gone]", "enc:xy", "Prizm"])), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "_sacat").otherwise(F.col("event_type")).alias("aspect"), value.alias("value"))
    a, v = F.lower("aspect"), F.lower("value")
    bad = a.isin(*CONTROL) | a.startswith("_") | (F.trim("value") == "") | v.isin("see all", "not specified") | v.rlike(r"^\[.*\]$") | (F.length("value") > 60) | v.startswith("enc:")
    return rows.where(~bad)


@query("p_sale_shape", f"""{W} SELECT item_id, price_cents / 100.0 AS price, best_offer = 1 AS best_offer, best_offer = 1 AND coalesce(offer_status, '') <> 'found' AS price_is_ask, is_rookie = 1 AS rookie, is_auto = 1 AS auto, 'https://items/' || item_id AS url FROM flat""")
def p_sale_shape(spark, sf):
    return flat(spark, sf).select(
        "item_id", (F.col("price_cents") / 100.0).alias("price"), (F.col("best_offer") == 1).alias("best_offer"), stats.ask_only().alias("price_is_ask"), (F.col("is_rookie") == 1).alias("rookie"), (F.col("is_auto") == 1).alias("auto"),
        F.concat(F.lit("https://items/"), "item_id").alias("url"),
    )


@query("p_card_shape", f"{WC} SELECT card_key, coalesce(sport, 'football') AS sport, median_cents / 100.0 AS median, low_cents / 100.0 AS low, high_cents / 100.0 AS high, is_auto = 1 AS auto, quality FROM cat")
def p_card_shape(spark, sf):
    c = F.col
    return cat.catalogue(flat(spark, sf)).select("card_key", F.coalesce("sport", F.lit("football")).alias("sport"), (c("median_cents") / 100.0).alias("median"), (c("low_cents") / 100.0).alias("low"), (c("high_cents") / 100.0).alias("high"), (c("is_auto") == 1).alias("auto"), "quality")


def export_rows(s, c):
    """Flattened sale with attributes; asks stand on best offers only."""
    rows = s.join(c.drop("sport"), "item_id", "left")
    offer = F.col("best_offer") == 1
    return rows.withColumns({"ask_cents": F.when(offer, F.coalesce("ask_cents", "price_cents")), "offer_known": (offer & (F.coalesce("offer_status", F.lit("")) == "found")).cast("int"), "confidence": F.coalesce("confidence", F.lit(0.0))})


@query("p_export_row", f"""{W} SELECT f.item_id, CASE WHEN f.best_offer = 1 THEN coalesce(f.ask_cents, f.price_cents) END AS ask_cents, CAST(f.best_offer = 1 AND coalesce(f.offer_status, '') = 'found' AS INT) AS offer_known,
  coalesce(c.confidence, 0) AS confidence, c.card_key FROM flat f LEFT JOIN cards c USING (item_id)""")
def p_export_row(spark, sf):
    return export_rows(sales(spark, sf), cards(spark, sf)).select("item_id", "ask_cents", "offer_known", "confidence", "card_key")


@query("p_total_cents", f"{W} SELECT item_id, coalesce(price_cents, 0) + coalesce(shipping_cents, 0) AS total_cents FROM flat")
def p_total_cents(spark, sf):
    return sales(spark, sf).select("item_id", (F.coalesce("price_cents", F.lit(0)) + F.coalesce("shipping_cents", F.lit(0))).alias("total_cents"))


@query("src_sales_view", f"{W} SELECT f.item_id, f.price_cents / 100.0 AS price, f.shipping_cents / 100.0 AS shipping, c.card_key, c.player FROM flat f LEFT JOIN cards c USING (item_id)")
def src_sales_view(spark, sf):
    rows = sales(spark, sf).join(cards(spark, sf).drop("sport"), "item_id", "left")
    return rows.select("item_id", (F.col("price_cents") / 100.0).alias("price"), (F.col("shipping_cents") / 100.0).alias("shipping"), "card_key", "player")


@query("src_aspect_json", """WITH p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0)
  SELECT p_partkey AS k, 'Brand' AS aspect, p_brand AS value, p_size::BIGINT AS n FROM p UNION ALL SELECT p_partkey, 'Brand', p_type, CASE WHEN p_partkey % 2 = 0 THEN 12 END FROM p UNION ALL SELECT p_partkey, 'Empty', NULL, NULL FROM p
  UNION ALL SELECT p_partkey, 'Set/Insert', p_name, NULL FROM p""")
def src_aspect_json(spark, sf):
    """Nested payloads with counts as numbers and text, malformed ones, an aspect without values, one without a name, and
    texts that are no payload."""
    k = F.col("p_partkey")
    entry = '{"localizedAspectValue": "%s", "matchCount": %s}'
    values = [F.format_string(entry, "p_brand", F.col("p_size").cast("string")), F.format_string(entry, "p_type", F.when(k % 2 == 0, '"12"').otherwise('"12x"')), F.lit('{"localizedAspectValue": "", "matchCount": 4}')]
    payload = F.concat(
        F.lit('{"refinement": {"aspectDistributions": [{"localizedAspectName": "Brand", "aspectValueDistributions": ['), F.concat_ws(", ", *values), F.lit(']}, {"localizedAspectName": "Empty", "aspectValueDistributions": []}, '),
        F.format_string('{"localizedAspectName": "Set/Insert", "aspectValueDistributions": [{"localizedAspectValue": "%s", "matchCount": 3.5}]}, {"aspectValueDistributions": [{"localizedAspectValue": "x"}]}]}}', "p_name"),
    )
    rows = table(spark, sf, "part").select(k.alias("k"), F.when(k % 7 == 0, "{oops").otherwise(payload).alias("payload"))
    return saved.aspects(rows, "payload")


@query("src_roster", "SELECT DISTINCT lower(p_name) AS name FROM part")
def src_roster(spark, sf):
    lines = table(spark, sf, "part").select(F.concat("p_name", F.lit(", from the list  ")).alias("value"))
    return lines.where(~F.trim("value").startswith("#")).select(F.lower(F.trim(F.split("value", ",")[0])).alias("name")).where("name <> ''").distinct()


@query("src_wordlist", "SELECT p_partkey AS row, p_name AS term FROM part WHERE p_partkey % 3 <> 0")
def src_wordlist(spark, sf):
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat("p_name", F.lit("  # why"))).alias("value"))
    return lines.select("row", F.trim(F.split("value", "#")[0]).alias("term")).where("term <> ''")
