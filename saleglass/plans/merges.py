"""Keyed merges, incremental export and sinks, each read back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleglass.operators import catalogue as cat
from saleglass.operators import exports, partitions
from saleglass.operators import merges as m
from saleglass.plans import audits, rollups
from saleglass.plans.text import meant
from saleglass.registry import SQL, query
from saleglass.sources import saved
from saleglass.sources.bindings import CHECKLIST_SQL, FLAT_SQL, RUNS_SQL, cards, checklist, flat, runs, sales, segments, table
from saleglass.sources.files import new_path

W = f"WITH {FLAT_SQL}"
WC = f"WITH {FLAT_SQL}, {cat.CATALOGUE_SQL}"
STATE = ["item_id", "price_cents", "best_offer", "offer_status", "ask_cents", "query_id", "sport"]


def _batch(spark, sf):
    """A batch that repeats some sales, changes prices, and brings new ones; sent twice, the later row counts."""
    s = sales(spark, sf).select(*STATE).where("price_cents % 3 = 0")
    first = s.withColumns({"price_cents": F.lit(1).cast("long"), "seq": F.lit(1)})
    second = s.withColumns({"price_cents": F.col("price_cents") + 500, "query_id": F.lit("late"), "seq": F.lit(2)})
    new = s.withColumns({"item_id": F.concat(F.lit("new-"), "item_id"), "seq": F.lit(1)})
    return first.unionByName(second).unionByName(new)


@query("m_upsert_sales", f"""{W} SELECT item_id, CASE WHEN price_cents % 3 = 0 AND coalesce(offer_status, '') <> 'found' THEN price_cents + 500 ELSE price_cents END AS price_cents,
  CASE WHEN price_cents % 3 = 0 THEN coalesce(query_id, 'late') ELSE query_id END AS query_id FROM flat UNION ALL SELECT 'new-' || item_id, price_cents, query_id FROM flat WHERE price_cents % 3 = 0""")
def m_upsert_sales(spark, sf):
    return m.upsert_sales(sales(spark, sf).select(*STATE), _batch(spark, sf)).select("item_id", "price_cents", "query_id")


@query("m_upsert_cards", f"{W} SELECT item_id, CASE WHEN confidence > 0.5 THEN 'v2' ELSE 'v1' END AS version FROM cards")
def m_upsert_cards(spark, sf):
    old = cards(spark, sf).select("item_id", "confidence", F.lit("v1").alias("version"))
    return m.merge(old, old.where("confidence > 0.5").withColumn("version", F.lit("v2")), "item_id", {}).select("item_id", "version")


@query("m_record_offer", f"""{W} SELECT item_id, CASE WHEN best_offer = 1 AND offer_status IS NULL THEN price_cents - 100 ELSE price_cents END AS price_cents, CASE WHEN best_offer = 1 AND offer_status IS NULL THEN price_cents ELSE ask_cents END AS ask_cents,
  CASE WHEN best_offer = 1 AND offer_status IS NULL THEN 'found' WHEN best_offer = 1 AND offer_status = 'error' THEN 'gone' ELSE offer_status END AS offer_status FROM flat""")
def m_record_offer(spark, sf):
    s = sales(spark, sf)
    offers = s.where("best_offer = 1").select("item_id", F.when(F.col("offer_status") == "error", "gone").otherwise("found").alias("status"), (F.col("price_cents") - 100).alias("accepted_cents"))
    return m.record_offers(s.select("item_id", "price_cents", "ask_cents", "offer_status"), offers).select("item_id", "price_cents", "ask_cents", "offer_status")


@query("m_segment_additive", f"WITH {RUNS_SQL} SELECT run_id || '/' || segment_id AS id, CASE WHEN status = 'retrying' THEN items + 5 ELSE 5 END AS items FROM segments")
def m_segment_additive(spark, sf):
    s = segments(spark, sf).select(F.concat_ws("/", "run_id", "segment_id").alias("id"), "status", "pages", "items")
    again = s.withColumns({"status": F.lit("done"), "pages": F.lit(1).cast("long"), "items": F.lit(5).cast("long")})
    return m.record_segments(s, again).select("id", "items")


@query("m_sync_state", f"{W} SELECT 'api' AS target, strftime(max(sold_date), '%Y-%m-%d') AS watermark, count(*) + 10 AS rows_sent FROM flat")
def m_sync_state(spark, sf):
    old = spark.createDataFrame([("api", "1990-01-01", 10)], "target string, watermark string, rows_sent long")
    sent = sales(spark, sf).agg(F.lit("api").alias("target"), F.date_format(F.max("sold_date"), "yyyy-MM-dd").alias("watermark"), F.count("*").alias("rows_sent"))
    return m.merge(old, sent, "target", {"watermark": F.greatest("t.watermark", "s.watermark"), "rows_sent": F.col("t.rows_sent") + F.col("s.rows_sent")})


@query("m_mark_recollect", f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN status = 'ok' AND day(target_date) % 2 = 0 THEN 'partial' ELSE status END AS status FROM runs")
def m_mark_recollect(spark, sf):
    r = runs(spark, sf)
    days = r.where(F.dayofmonth("target_date") % 2 == 0).select("target_date", F.lit(True).alias("again"))
    return r.join(days, "target_date", "left").select("run_id", F.when((F.col("status") == "ok") & F.col("again"), "partial").otherwise(F.col("status")).alias("status"))


@query("m_resize_images", f"{W} SELECT item_id, image_url || '/s-l500.jpg' AS image_url FROM flat WHERE image_url IS NOT NULL")
def m_resize_images(spark, sf):
    from saleglass.functions.text import image_url

    return sales(spark, sf).where("image_url is not null").select("item_id", image_url(F.concat("image_url", F.lit("/s-l225.jpg")), 500, "img").alias("image_url"))


@query("m_checklist_upsert", f"WITH {CHECKLIST_SQL} SELECT year, set_name, count(*) AS cards FROM checklist GROUP BY 1, 2")
def m_checklist_upsert(spark, sf):
    c = checklist(spark, sf)
    return m.merge(c, c.where("year > 2000").withColumn("print_run", F.lit(1)), "card_key", {}).groupBy("year", "set_name").agg(F.count("*").alias("cards"))


def _dated(spark, sf):
    """Sales with the times they were written and parsed: noon of their day, and an hour later."""
    rows = flat(spark, sf, dealt=True)
    return rows.withColumns({"updated_at": F.col("sold_date").cast("timestamp") + F.expr("interval 12 hours"), "parsed_at": F.when(~F.col("item_id").startswith("7"), F.col("sold_date").cast("timestamp") + F.expr("interval 13 hours"))})


def _moved(rows):
    """Some sales are written again at another price, others are parsed to another card while the sale stays as it was."""
    late, again = F.col("price_cents") % 7 == 0, (F.col("price_cents") % 11 == 0) & F.col("card_key").isNotNull()
    return rows.withColumns({
        "price_cents": F.when(late, F.col("price_cents") + 100).otherwise(F.col("price_cents")), "updated_at": F.when(late, F.lit("2030-01-01").cast("timestamp")).otherwise(F.col("updated_at")),
        "card_key": F.when(again, F.concat("card_key", F.lit("x"))).otherwise(F.col("card_key")), "parsed_at": F.when(again, F.lit("2030-01-02").cast("timestamp")).otherwise(F.col("parsed_at")),
    })


#: Sales before and after, as views that the sums of the catalogue stand on.
MOVED_SQL = f"""{FLAT_SQL.strip().split("cards AS (SELECT")[0].rstrip().rstrip(",").replace("flat AS (", "f0 AS (", 1)},
flat AS (SELECT * REPLACE (CASE WHEN price_cents % 7 = 0 THEN price_cents + 100 ELSE price_cents END AS price_cents, CASE WHEN price_cents % 11 = 0 THEN card_key || 'x' ELSE card_key END AS card_key) FROM f0),
labelled AS (SELECT *, coalesce(grader || ' ' || regexp_replace(CAST(grade AS VARCHAR), '\\.0$', ''), grader, 'Raw') AS grade_label FROM flat)"""
_USED = "price_cents IS NOT NULL AND currency = 'USD' AND card_key IS NOT NULL"
_CHANGED = "price_cents % 7 = 0 OR price_cents % 11 = 0 AND card_key IS NOT NULL"
_DAYS = "SELECT sold_date, count(*) AS n, count(*) FILTER (WHERE currency = 'USD') AS p, median(price_cents) FILTER (WHERE currency = 'USD') AS m, sum(price_cents) FILTER (WHERE currency = 'USD') AS t"


@query("m_incremental_export", f"""WITH {MOVED_SQL}, keys AS (SELECT card_key FROM f0 WHERE {_CHANGED} UNION SELECT card_key || 'x' FROM f0 WHERE price_cents % 11 = 0 UNION SELECT card_key FROM flat WHERE item_id IN (SELECT item_id FROM f0 WHERE {_CHANGED})),
  l0 AS (SELECT *, coalesce(grader || ' ' || CAST(grade AS VARCHAR), grader, 'Raw') AS grade_label FROM f0), d AS (SELECT DISTINCT sold_date FROM f0 WHERE price_cents % 7 = 0)
  SELECT 1 AS run, (SELECT count(*) FROM f0) AS sales, (SELECT count(DISTINCT sold_date) FROM f0) AS daily, (SELECT count(DISTINCT card_key) FROM f0 WHERE {_USED}) AS cards, (SELECT count(DISTINCT (card_key, grade_label)) FROM l0 WHERE {_USED}) AS card_grades
  UNION ALL SELECT 2, (SELECT count(*) FROM f0 WHERE {_CHANGED}), (SELECT count(*) FROM ({_DAYS} FROM flat GROUP BY 1 EXCEPT {_DAYS} FROM f0 GROUP BY 1)), (SELECT count(DISTINCT card_key) FROM flat WHERE {_USED} AND card_key IN (SELECT card_key FROM keys)),
    (SELECT count(DISTINCT (card_key, grade_label)) FROM labelled WHERE {_USED} AND card_key IN (SELECT card_key FROM keys)) UNION ALL SELECT 3, 0, 0, 0, 0""")
def m_incremental_export(spark, sf):
    """Rows written by three exports: of everything, of what was written or parsed since, and without a change."""
    path, rows = new_path(spark, "export"), partitions.settled(_dated(spark, sf), "sales")
    moved = _moved(rows)
    runs = [exports.export(r, path) for r in (rows, moved, moved)]
    return spark.createDataFrame([(i, *(r[c] for c in ("sales", "daily", "cards", "card_grades"))) for i, r in enumerate(runs, 1)], "run int, sales long, daily long, cards long, card_grades long")


def _through(spark, df, name, kind="parquet", **options):
    path = new_path(spark, name)
    df.write.format(kind).options(**options).save(path)
    return path


@query("sink_sales_csv", f"{W} SELECT item_id, price_cents / 100.0 AS price, set_name FROM flat WHERE sold_date >= DATE '2001-01-01'")
def sink_sales_csv(spark, sf, since="2001-01-01"):
    rows = flat(spark, sf).where(F.col("sold_date") >= F.lit(since).cast("date")).orderBy(F.desc("sold_date"), F.desc("price_cents"), "item_id").select("item_id", (F.col("price_cents") / 100.0).alias("price"), "set_name")
    return spark.read.schema(rows.schema).csv(_through(spark, rows, "sales", "csv", header=True), header=True)


@query("sink_catalogue_csv", f"{WC} SELECT card_key, sales, median_cents / 100.0 AS median_usd FROM cat WHERE quality = 'clean'")
def sink_catalogue_csv(spark, sf):
    clean = cat.catalogue(flat(spark, sf)).where("quality = 'clean'").orderBy(F.desc("sales"), "card_key")
    rows = clean.select("card_key", "sales", (F.col("median_cents") / 100.0).alias("median_usd"))
    return spark.read.schema(rows.schema).csv(_through(spark, rows, "catalogue", "csv", header=True), header=True)


#: Datasets of the dashboard: what makes them of sales, the key, the count and the amount that are read back.
DASHBOARD = {
    "daily": (rollups.daily, "sold_date", "n", "median"), "players": (rollups.players, "player", "n", "median"), "sets": (rollups.sets, "set_name", "n", "median"), "grades": (rollups.grades, "grade_label", "n", "median"),
    "recent": (rollups.recent, "item_id", "price_cents", "price_cents"), "top": (rollups.top, "item_id", "price_cents", "price_cents"), "cards": (rollups.cards, "card_key", "size(points)", "points[0].price"), "meta": (rollups.meta, "last_day", "total", "median"),
}
_FIRST_SALES = "(SELECT card_key, arg_min(price_cents, (sold_date, item_id)) / 100.0 AS first FROM flat WHERE price_cents IS NOT NULL AND currency = 'USD' GROUP BY 1)"


def _dashboard_sql():
    parts = []
    for name, (_, key, n, amount) in DASHBOARD.items():
        source = f"({SQL['a_card_histories']}) h JOIN {_FIRST_SALES} f USING (card_key)" if name == "cards" else f"({SQL[{'recent': 'w_recent', 'top': 'w_top_sales'}.get(name, 'a_' + name)]})"
        n, amount = ("n", "first") if name == "cards" else (n, amount)
        parts.append(f"SELECT '{name}' AS dataset, {key}::VARCHAR AS key, {n}::BIGINT AS n, {amount}::DOUBLE AS amount FROM {source}")
    return f"{W} " + " UNION ALL ".join(parts)


@query("sink_dashboard_json", _dashboard_sql())
def sink_dashboard_json(spark, sf):
    """Eight datasets as JSON, cards with their sales nested, all made of sales that are materialised once; what they hold is
    read back."""
    rows, out = partitions.settled(flat(spark, sf, dealt=True), "dashboard"), []
    for name, (make, key, n, amount) in DASHBOARD.items():
        made = make(rows)
        back = spark.read.schema(made.schema).json(_through(spark, made, name, "json"))
        out.append(back.select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("key"), F.expr(n).cast("long").alias("n"), F.expr(amount).cast("double").alias("amount")))
    return functools.reduce(DataFrame.unionByName, out)


@query("sink_upsert_export", f"""WITH {MOVED_SQL}, {cat.CATALOGUE_SQL} SELECT 'sales' AS kind, item_id AS key, 1 AS n, price_cents AS cents FROM flat
  UNION ALL SELECT 'daily', strftime(sold_date, '%Y-%m-%d'), count(*), (sum(price_cents) FILTER (WHERE currency = 'USD'))::BIGINT FROM flat GROUP BY sold_date
  UNION ALL SELECT 'cards', card_key, sales, median_cents FROM cat UNION ALL SELECT 'card_grades', card_key || '|' || grade_label, count(*), trunc(median(price_cents))::BIGINT FROM labelled WHERE {_USED} GROUP BY card_key, grade_label""")
def sink_upsert_export(spark, sf):
    """The four tables after an export, a change and another export: as if all had been exported at the end."""
    path, rows = new_path(spark, "export"), partitions.settled(_dated(spark, sf), "sales")
    for r in (rows, _moved(rows)):
        exports.export(r, path)
    one = F.lit(1).cast("long")
    kinds = (("sales", F.col("item_id"), one, "price_cents"), ("daily", F.date_format("sold_date", "yyyy-MM-dd"), F.col("sales"), "total_cents"),
             ("cards", F.col("card_key"), F.col("sales"), "median_cents"), ("card_grades", F.concat_ws("|", "card_key", "grade_label"), F.col("sales"), "median_cents"))
    tables = [spark.read.parquet(f"{path}/{kind}").select(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"), F.col(cents).alias("cents")) for kind, key, n, cents in kinds]
    return functools.reduce(DataFrame.unionByName, tables)


@query("sink_review_sample", f"{W} SELECT item_id, '' AS correct, '' AS notes FROM flat WHERE card_key IS NOT NULL AND confidence >= 0.4 ORDER BY md5(item_id || ':1'), item_id LIMIT 100")
def sink_review_sample(spark, sf):
    rows = rollups.w_sample(spark, sf).select("item_id", F.lit("").alias("correct"), F.lit("").alias("notes"))
    return spark.read.schema(rows.schema).csv(_through(spark, rows, "sample", "csv", header=True, emptyValue='""'), header=True, emptyValue="").select("item_id", F.coalesce("correct", F.lit("")).alias("correct"), F.coalesce("notes", F.lit("")).alias("notes"))


def _text(spark, rows, name):
    return spark.read.text(_through(spark, rows.select(F.col(rows.columns[0]).cast("string").alias("value")), name, "text"))


@query("sink_roster", f"SELECT DISTINCT name AS value FROM ({SQL['a_learn_names']})")
def sink_roster(spark, sf):
    return _text(spark, audits.a_learn_names(spark, sf).select("name").distinct(), "roster")


@query("sink_inserts_proposal", f"SELECT phrase || '  # seen ' || sightings || ' in ' || contexts || ', beside ' || players || ' names' AS value FROM ({SQL['a_learn_inserts']})")
def sink_inserts_proposal(spark, sf):
    line = F.format_string("%s  # seen %d in %d, beside %d names", "phrase", "sightings", "contexts", "players")
    return _text(spark, audits.a_learn_inserts(spark, sf).select(line), "inserts")


def _new_terms(spark, sf, column, least_words=1):
    known = table(spark, sf, "part").where("p_partkey % 10 = 0").select(F.lower(column).alias("term")).distinct()
    terms = table(spark, sf, "part").select(F.lower(column).alias("term")).distinct()
    return terms.where(F.size(F.split("term", " ")) >= least_words).join(known, "term", "left_anti")


for _name, _column, _words in (("sink_vocab_roster", "p_name", 1), ("sink_vocab_sets", "p_name", 2), ("sink_vocab_designations", "p_type", 1)):
    query(_name, f"SELECT DISTINCT lower({_column}) AS value FROM part WHERE lower({_column}) NOT IN (SELECT lower({_column}) FROM part WHERE p_partkey % 10 = 0) AND len(string_split({_column}, ' ')) >= {_words}")(
        lambda spark, sf, n=_name, c=_column, w=_words: _text(spark, _new_terms(spark, sf, c, w), n)
    )


#: Sections and categories of a checklist, by turns, and brands as it writes them.
SECTIONS = (("Base Set", "Base"), ("Rookies", "Insert"), ("Downtown", "Insert"), ("Rookie Ink", "Autograph"), ("Patches", "Memorabilia"), ("base – rookies", ""), ("", "Insert"))
CHECKED_BRANDS = (("Panini Prizm", "Prizm"), ("Topps Chrome", "Topps Chrome"), ("Flagship", "Topps"), ("Panini New Kind", "Panini New Kind"))


def _by_turn(values, index="p_partkey"):
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.col(index) % len(values) + 1).cast("int"))


@query("src_checklist_csv", f"""WITH s AS (SELECT *, {meant(SECTIONS, 'p_partkey')} AS category, {meant([(x,) for x, _ in SECTIONS], 'p_partkey')} AS section, {meant(CHECKED_BRANDS, 'p_partkey')} AS brand FROM part WHERE p_partkey % 11 <> 0)
  SELECT 2000 + p_size AS year, brand AS set_name, CASE WHEN p_partkey % 7 IN (2, 3, 4) THEN section END AS subset, CASE WHEN p_partkey % 5 > 0 THEN p_partkey::VARCHAR END AS card_number, p_name AS player,
    CASE WHEN p_partkey % 3 = 1 THEN p_type END AS parallel, CASE WHEN p_partkey % 2 = 0 THEN 99 END AS print_run, category = 'Autograph' AS is_auto, category = 'Memorabilia' AS is_relic FROM s WHERE p_partkey % 13 <> 0""")
def src_checklist_csv(spark, sf):
    """A compressed checklist with another sport, rows without a year, base sections and parallels, and brands before sets."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        F.when(k % 11 == 0, "Baseball").otherwise(" FOOTBALL").alias("sport"), F.when(k % 13 != 0, (2000 + F.col("p_size")).cast("string")).otherwise("n/a").alias("year"), _by_turn([b for b, _ in CHECKED_BRANDS]).alias("brand"),
        F.when(k % 5 > 0, F.concat(F.lit("#"), k)).alias("card_number"), F.col("p_name").alias("player"), _by_turn([c for _, c in SECTIONS]).alias("category"), _by_turn([x for x, _ in SECTIONS]).alias("set"),
        F.when(k % 3 == 1, F.col("p_type")).when(k % 3 == 2, "Base").alias("parallel"), F.when(k % 2 == 0, "99").otherwise("none").alias("print_run"),
    )
    path = _through(spark, rows, "checklist", "csv", header=True, compression="gzip")
    return saved.checklist_rows(spark.read.schema(rows.schema).csv(path, header=True))


@query("src_capture_json", "SELECT (900000000000 + p_partkey)::VARCHAR AS item_id, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents FROM part WHERE p_partkey % 7 > 0")
def src_capture_json(spark, sf):
    from saleglass.functions.text import money_cents

    k = F.col("p_partkey")
    sale = F.struct(F.when(k % 7 == 0, "x1").otherwise((F.lit(900000000000) + k).cast("string")).alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"))
    rows = table(spark, sf, "part").groupBy((k % 50).alias("page")).agg(F.collect_list(sale).alias("sales"))  # a page of sales
    back = spark.read.schema(rows.schema).json(_through(spark, rows, "capture", "json")).select(F.explode("sales").alias("s"))
    return back.where(F.col("s.id").rlike(r"^\d+$") & (F.trim("s.title") != "")).select(F.col("s.id").alias("item_id"), money_cents("s.price").alias("price_cents"))


@query("src_checklist_json", "SELECT p_partkey AS k, p_name AS player, p_partkey::VARCHAR AS number, CASE WHEN p_partkey % 2 = 0 THEN 99 END AS print_run, 2000 + p_size AS year FROM part")
def src_checklist_json(spark, sf):
    k = F.col("p_partkey")
    card = F.when(k % 2 == 0, F.to_json(F.create_map(F.lit("Card_Number"), F.concat(k.cast("string"), F.lit("/99")), F.lit("Athlete"), F.col("p_name")))).otherwise(F.to_json(F.create_map(F.lit("number"), k.cast("string"), F.lit("playerName"), F.col("p_name"))))
    rows = table(spark, sf, "part").select(k.alias("k"), F.concat((F.lit(2000) + F.col("p_size")).cast("string"), F.lit(" Select")).alias("set"), card.alias("card"))
    fields = F.transform_keys(F.from_json("card", "map<string,string>"), lambda key, _: F.regexp_replace(F.lower(key), "_", ""))
    f = lambda *names: F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names))
    number = f("cardnumber", "number", "no")
    run = F.regexp_extract(number, r"/(\d+)$", 1)
    return rows.select("k", f("athlete", "player", "playername").alias("player"), F.regexp_replace(number, r"/\d+$", "").alias("number"), F.nullif(run, F.lit("")).cast("int").alias("print_run"), F.regexp_extract("set", r"\b(\d{4})\b", 1).cast("int").alias("year"))


@query("src_index_entries", "SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 4")
def src_index_entries(spark, sf):
    """Products as a list, wrapped under two names, by id, and as something else."""
    k = F.col("p_partkey")
    one = F.array(F.struct(k.cast("string").alias("id"), F.col("p_name").alias("name")))
    by_id = F.create_map(k.cast("string"), F.struct(F.col("p_name").alias("name")))
    shapes = F.when(k % 5 == 0, F.to_json(one)).when(k % 5 == 1, F.to_json(F.struct(one.alias("items")))).when(k % 5 == 2, F.to_json(by_id))
    payload = shapes.when(k % 5 == 3, F.to_json(F.struct(F.array().cast("array<int>").alias("products"), one.alias("data")))).otherwise('{"pages": 3}')
    return saved.index_entries(table(spark, sf, "part").select(payload.alias("p")), "p")


@query("src_saved_files", """WITH p AS (SELECT page_id % 8 AS g, length(to_json({'html': html})::VARCHAR) AS chars, html FROM pages WHERE html IS NOT NULL)
  SELECT kind AS suffix, count(DISTINCT g) AS files, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM p, (VALUES ('txt'), ('json')) k(kind) GROUP BY 1""")
def src_saved_files(spark, sf):
    """Whole files of two kinds below folders and by pattern, some named twice, some copied, one kind unknown: each once."""
    rows = table(spark, sf, "pages").where("html is not null").select((F.col("page_id") % 8).alias("g"), "page_id", "html")
    lines = rows.select("g", "page_id", F.to_json(F.struct("html")).alias("value"))

    def put(df, name, kind):
        path = new_path(spark, name)
        df.repartition(8, "g").sortWithinPartitions("g", "page_id").drop("page_id").write.partitionBy("g").format(kind).save(path)
        return path

    text, copy, other = put(lines, "pages", "text"), put(lines, "copies", "text"), put(lines, "tables", "csv")
    json = put(rows.withColumn("kind", F.lit("json")), "pages", "json")
    files = saved.saved_files(spark, [text, f"{text}/g=1", copy, f"{json}/*/*.json", f"{json}/*", other, f"{text}/none"], ("txt", "json"))
    pages = files.select("suffix", "path", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    html = F.get_json_object("line", "$.html")
    return pages.groupBy("suffix").agg(F.count_distinct("path").alias("files"), F.count("*").alias("pages"), F.sum(F.length(html)).alias("chars"))
