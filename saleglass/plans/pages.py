"""Facts from page text: facet links, listing fields, amounts and offers, page states, photo labels, word windows."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from saleglass.functions import text as x
from saleglass.functions import vocabulary as v
from saleglass.operators.labels import group_rows, label_attrs
from saleglass.plans import titles
from saleglass.plans.text import told
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, flat, table

W = f"WITH {FLAT_SQL}"
CONTROL = ("_nkw", "_sacat", "_pgn", "_from", "rt")


def facet_links(pages, id_col, html):
    """(page, aspect, value, count) of links: query pairs without control names, values split at |, count from the text."""
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(r'<a href="[^"]*\?([^"]*)"[^>]*>[^<]*'), F.lit(1)).alias("q"), F.regexp_extract_all(html, F.lit(r'<a href="[^"]*\?[^"]*"[^>]*>([^<]*)'), F.lit(1)).alias("t"))
    rows = pages.select(F.col(id_col), F.posexplode(links).alias("pos", "l"))
    pairs = rows.select(id_col, "pos", F.regexp_replace(F.regexp_extract("l.t", r"\(([0-9,]+)\)", 1), ",", "").try_cast("long").alias("n"), F.explode(F.split("l.q", "&(?:amp;)?")).alias("pair"))
    kv = pairs.select(id_col, "pos", "n", F.split("pair", "=", 2)[0].alias("aspect"), F.explode(F.split(F.url_decode(F.split("pair", "=", 2)[1]), r"\|")).alias("value"))
    kv = kv.where(~F.col("aspect").isin(*CONTROL) & (F.col("value") != ""))
    return kv.groupBy(id_col, "aspect", "value").agg(F.min_by("n", "pos").alias("n"))


@query("g_links_facets", "SELECT user_id AS page, event_type AS aspect, json_extract_string(props, '$.k') || ' x' AS value, arg_min(1000 + event_id, event_id) AS n FROM events GROUP BY 1, 2, 3")
def g_links_facets(spark, sf):
    value = F.concat(F.get_json_object("props", "$.k"), F.lit("%20x"))
    link = F.concat(F.lit('<a href="/s?_nkw=y&amp;'), "event_type", F.lit("="), value, F.lit('" class=f>v ('), F.format_number(F.col("event_id") + 1000, 0), F.lit(")</a>"))
    pages = table(spark, sf, "events").groupBy(F.col("user_id").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", link.alias("l")))), lambda s: s["l"]), "\n").alias("html"))  # a page of links
    return facet_links(pages, "page", F.col("html"))


@query("g_listing_fields", f"{W} SELECT item_id, price_cents, CASE WHEN bids IS NOT NULL THEN bids END AS bids, best_offer, strftime(sold_date, '%Y-%m-%d') AS day FROM flat")
def g_listing_fields(spark, sf):
    tile = F.concat_ws("\n", "title", F.concat(F.lit("$"), F.format_number(F.col("price_cents") / 100.0, 2)), F.concat(F.lit("Sold  "), F.date_format("sold_date", "MMM d, yyyy")), F.concat(F.col("bids").cast("string"), F.lit(" bids")), F.when(F.col("best_offer") == 1, "Best offer accepted"))
    t = flat(spark, sf).select("item_id", tile.alias("tile"))
    return t.select("item_id", x.money_cents("tile").alias("price_cents"), x.bids("tile").alias("bids"), F.col("tile").rlike(r"(?i)best\s+offer\s+accepted").cast("int").alias("best_offer"), x.sold_date("tile").alias("day"))


AMOUNT = r"(?:[A-Z]{1,2} )?\$[0-9][0-9,]*(?:\.[0-9]{2})?"


def _with_amounts(pages, text):
    """``pages`` with ``_cut``: every dollar amount of a text, with the texts before and after it up to its neighbours."""
    # cut the text at amounts: piece i stands before amount i; each is read once, as a column of its own
    out = pages.withColumns({"_amounts": F.regexp_extract_all(text, F.lit(f"({AMOUNT})"), F.lit(1)), "_pieces": F.split(text, AMOUNT)})
    n = F.size("_amounts")
    cut = F.arrays_zip(F.col("_amounts").alias("amount"), F.slice("_pieces", F.lit(1), n).alias("before"), F.slice("_pieces", F.lit(2), n).alias("after"))
    return out.withColumn("_cut", cut).drop("_amounts", "_pieces")


def _kind(c):
    """Each pattern is looked for only where words stand that it can't do without."""
    before, after = F.right(c["before"], F.lit(70)), F.left(c["after"], F.lit(30))
    near = F.concat(before, F.lit(" "), after)

    def has(text, *words):
        return functools.reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in words))

    shipping = has(near, "shipping", "tax") & near.rlike(r"(?i)shipping|\btax\b")
    struck = has(before, "was", "list price") & before.rlike(r"(?i)\b(was|list price)\b[^$]*$")
    accepted = has(before, "best offer accepted") & before.rlike("(?i)best offer accepted")
    return F.when(~F.startswith(c["amount"], F.lit("$")), "foreign").when(shipping, "shipping").when(struck, "struck").when(accepted, "accepted").otherwise("other")


def money_candidates(pages, id_col, text):
    """Every dollar amount with up to 70 characters before it (not past the amount before) and 30 after, and its kind."""
    # an outer explode: for a plain one Spark adds a filter on the cut array's size and takes it below the joins, so all texts are cut twice
    rows = _with_amounts(pages, text).select(F.col(id_col), F.posexplode_outer("_cut").alias("pos", "c")).where("pos is not null")
    return rows.select(id_col, "pos", x.money_cents("c.amount").alias("cents"), _kind(F.col("c")).alias("kind"))


def _offers(spark, sf):
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c / 100.0, 2))
    c = F.col("price_cents")
    text = F.concat(F.lit("Was "), usd(c), F.lit(". Best offer accepted: "), usd(c - 100), F.lit(" and then a longer line of words that says nothing at all. Next "), usd(c + 7), F.lit(" is it. + "), usd(F.lit(450)), F.lit(" shipping"))
    return flat(spark, sf, dealt=True).select("item_id", text.alias("text"), "price_cents")


@query("g_money_candidates", f"{W} SELECT item_id, p AS pos, CASE p WHEN 0 THEN price_cents WHEN 1 THEN price_cents - 100 WHEN 2 THEN price_cents + 7 ELSE 450 END AS cents, CASE p WHEN 0 THEN 'struck' WHEN 1 THEN 'accepted' WHEN 2 THEN 'other' ELSE 'shipping' END AS kind FROM flat, (VALUES (0), (1), (2), (3)) t(p)")
def g_money_candidates(spark, sf):
    return money_candidates(_offers(spark, sf), "item_id", F.col("text"))


def read_offers(pages, id_col):
    """Exactly one accepted amount from a fifth of the ask up to it: found. More: ambiguous. None: not shown.

    ``pages``: id, text, ask_cents, gone. The amounts of a page are read within its row, and only those behind the words."""
    said = F.filter("_cut", lambda c: F.contains(F.lower(c["before"]), F.lit("best offer accepted")) & (_kind(c) == "accepted"))
    read = _with_amounts(pages, F.col("text")).select(id_col, "gone", "ask_cents", F.when(F.col("gone"), None).otherwise(F.transform(said, lambda c: x.money_cents(c["amount"]))).alias("cents"))
    fit = read.select(id_col, "gone", F.filter("cents", lambda c: (c >= 0.2 * F.col("ask_cents")) & (c < F.col("ask_cents"))).alias("cents"))
    both = fit.select(id_col, "gone", F.array_min("cents").alias("low"), F.array_max("cents").alias("high"))
    state = F.when(F.col("gone"), "gone").when(F.col("low").isNull(), "not_shown").when(F.col("low") == F.col("high"), "found").otherwise("ambiguous")
    return both.select(id_col, state.alias("state"), F.when(state == "found", F.col("low")).alias("cents"))


@query("g_read_offer", f"{W} SELECT item_id, CASE WHEN price_cents % 10 = 0 THEN 'gone' WHEN price_cents % 10 = 1 THEN 'not_shown' ELSE 'found' END AS state, CASE WHEN price_cents % 10 > 1 THEN price_cents - 100 END AS cents FROM flat")
def g_read_offer(spark, sf):
    pages = _offers(spark, sf).select("item_id", "text", F.when(F.col("price_cents") % 10 == 1, F.lit(1)).otherwise(F.col("price_cents")).alias("ask_cents"), (F.col("price_cents") % 10 == 0).alias("gone"))
    return read_offers(pages, "item_id")


@query("g_page_state", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'signed_out' WHEN 1 THEN 'bot_check' WHEN 2 THEN 'no_listing' ELSE 'ok' END AS state FROM pages")
def g_page_state(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, ("Please sign in to continue", "Pardon our interruption", "This listing was removed", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    html = F.concat(F.coalesce("html", F.lit("")), mark)
    state = F.when(html.rlike("(?i)sign in to (continue|see)"), "signed_out").when(html.rlike("(?i)pardon our interruption|are you a robot"), "bot_check").when(html.rlike("(?i)listing (was )?(removed|ended)|no longer available"), "no_listing").otherwise("ok")
    return table(spark, sf, "pages").select("page_id", state.alias("state"))


@query("w_group_rows", "SELECT p_partkey AS item_id, t AS top, x AS text, c AS confidence FROM part, LATERAL (VALUES (0.1::DOUBLE, p_brand || ' ' || p_type, 0.8::DOUBLE), (0.13::DOUBLE, p_name, 0.7::DOUBLE)) v(t, x, c)")
def w_group_rows(spark, sf):
    d = F.explode(F.array(*(F.struct(F.lit(t).alias("top"), F.col(c).alias("text"), F.lit(k).alias("confidence")) for t, c, k in ((0.1, "p_brand", 0.9), (0.115, "p_type", 0.8), (0.13, "p_name", 0.7)))))
    return group_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), d.alias("d")).select("item_id", "d.*"))


#: Label lines by turns: grader and grade as printed, what they mean.
SAID_GRADES = (("GEM MT 10", "PSA", 10.0), ("SGC 9.5", "SGC", 9.5), ("NM-MT", "PSA", 8.0), ("BGS", "BGS", None), ("", None, None), ("CGC MINT", "CGC", 9.0))
_LABEL = {name: f"list_extract([{', '.join('NULL' if g[i] is None else repr(g[i]) for g in SAID_GRADES)}], CAST(p_partkey % {len(SAID_GRADES)} + 1 AS BIGINT))" for i, name in ((1, "grader"), (2, "grade"))}


@query("x_label_attrs", f"""WITH p AS (SELECT *, {titles.WHO_SQL.replace('player', 'p_name')} AS who, {_LABEL['grader']} AS grader, {_LABEL['grade']}::DOUBLE AS grade FROM part)
  SELECT p_partkey AS item_id, 1990 + p_size AS year, 'Donruss Optic' AS set_name, CASE WHEN NOT starts_with(p_name, 'old ') THEN who END AS player, (p_partkey % 1000)::VARCHAR AS card_number, grader, grade,
    CASE WHEN NOT starts_with(p_name, 'old ') THEN CASE WHEN grader IS NULL THEN 0.8 ELSE 0.95 END WHEN grader IS NULL THEN 0.6 ELSE 0.75 END::DOUBLE AS confidence FROM p""")
def x_label_attrs(spark, sf):
    """Labels with letters read as digits and words run together, lines below the label, and uncertain ones."""
    k = F.col("p_partkey")
    first = F.concat((F.lit(1990) + F.col("p_size")).cast("string"), F.lit("PANINI D0NRUSS 0PTIC #"), k % 1000, F.lit("R00KIE"))
    lines = [(0.1, first, 0.9), (0.15, F.upper(titles.who("p_name")), 0.8), (0.2, told([(g[0],) for g in SAID_GRADES], k), 0.7), (0.5, F.lit("SGC 1999 #5 MOSAIC"), 0.9), (0.12, F.lit("BGS 2"), 0.3)]
    d = F.explode(F.array(*(F.struct(F.lit(t).alias("top"), text.alias("text"), F.lit(c).alias("confidence")) for t, text, c in lines))).alias("d")
    return label_attrs(table(spark, sf, "part").select(k.alias("item_id"), d).select("item_id", "d.*"), "item_id", v.SETS, titles.roster(spark, sf))


@query("a_title_words", "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 50")
def a_title_words(spark, sf, least=50):
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    per = w.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).where(F.col("n") >= least)


@query("w_last_turn", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def w_last_turn(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))
