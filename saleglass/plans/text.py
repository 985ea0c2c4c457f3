"""Scalar text functions over titles and texts built from the tables, so that the right answer is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.functions import text as x
from saleglass.functions import vocabulary as v
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, flat, table

W = f"WITH {FLAT_SQL}"


def _part(spark, sf):
    return table(spark, sf, "part").withColumnRenamed("p_partkey", "k")


@query("x_normalize_player", "SELECT p_partkey AS k, replace(p_name, ' ', '') || 'eo' AS fold FROM part")
def x_normalize_player(spark, sf):
    return _part(spark, sf).select("k", x.folded_person(F.concat(F.initcap("p_name"), F.lit("-É'ø Jr."), F.lit(" o"))).alias("fold"))


@query("x_slug", "SELECT p_partkey AS k, replace(p_name, ' ', '-') || '-uber-' || p_partkey AS slug FROM part")
def x_slug(spark, sf):
    return _part(spark, sf).select("k", x.slug(F.concat(F.lit("  "), "p_name", F.lit(" / Über! #"), F.col("k").cast("string"), F.lit("--"))).alias("slug"))


_KEYS = "CASE WHEN confidence >= 0.4 THEN concat_ws('-', CASE WHEN sport <> 'football' THEN sport END, year, lower(set_name), coalesce('n' || card_number, replace(player, ' ', '') || '-r' || (year % 100)), lower(parallel), CASE WHEN is_auto = 1 THEN 'auto' END, CASE WHEN is_relic = 1 THEN 'patch' END) END"


def _attrs(spark, sf):
    return flat(spark, sf).withColumns({"print_run": (F.col("year") % 100).cast("string"), "subset": F.lit(None).cast("string"), "variety": F.lit(None).cast("string"), "unparsed": F.lit(None).cast("string")})


@query("x_card_key", f"{W} SELECT item_id, {_KEYS} AS card_key FROM flat")
def x_card_key(spark, sf):
    return _attrs(spark, sf).select("item_id", x.card_key().alias("card_key"))


@query("x_card_name", f"{W} SELECT item_id, concat_ws(' ', year, set_name, player, '#' || card_number, parallel, '/' || (year % 100), CASE WHEN is_auto = 1 THEN 'Auto' END, CASE WHEN is_relic = 1 THEN 'Patch' END) AS name FROM flat")
def x_card_name(spark, sf):
    return _attrs(spark, sf).select("item_id", x.card_name().alias("name"))


@query("x_fold_number", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 > 0 THEN 'AB' || p_partkey END AS number FROM part")
def x_fold_number(spark, sf):
    return _part(spark, sf).select("k", x.folded_number(F.when(F.col("k") % 5 > 0, F.concat(F.lit("ab-"), "k", F.lit("."))).otherwise("--")).alias("number"))


_SIGN = "CASE k % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'CAD' END"


def _priced_text(spark, sf):
    sign = F.element_at(F.array(*map(F.lit, ("$", "€", "£ ", "C $"))), (F.col("k") % 4 + 1).cast("int"))
    return _part(spark, sf).withColumn("text", F.concat(F.lit("Was "), sign, F.format_number(F.col("p_retailprice") * 3, 2), F.lit(" + $4.50 shipping")))


@query("x_money_cents", f"SELECT p_partkey AS k, CAST(round(p_retailprice * 3 * 100) AS BIGINT) AS cents, {_SIGN.replace('k %', 'p_partkey %')} AS currency FROM part")
def x_money_cents(spark, sf):
    return _priced_text(spark, sf).select("k", x.money_cents("text").alias("cents"), x.currency("text").alias("currency"))


@query("x_shipping_cents", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 0::BIGINT WHEN p_partkey % 3 = 1 THEN 450::BIGINT END AS cents FROM part")
def x_shipping_cents(spark, sf):
    text = F.when(F.col("k") % 3 == 0, "$3.00 Free shipping").when(F.col("k") % 3 == 1, F.col("text")).otherwise("$5.00")
    return _priced_text(spark, sf).select("k", x.shipping_cents(text).alias("cents"))


@query("x_sold_date", "SELECT l_orderkey AS k, l_linenumber AS n, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3")
def x_sold_date(spark, sf):
    d = F.col("l_shipdate")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Sold  "), F.date_format(d, "MMM d, yyyy"))).otherwise(F.concat(F.lit("sold "), F.date_format(d, "d MMM yyyy")))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.sold_date(text).alias("day"))
    return rows.groupBy("k", "n", "day").agg(F.count("*").alias("rows"))


@query("x_bids_format", f"{W} SELECT item_id, bids, listing_format FROM flat")
def x_bids_format(spark, sf):
    b = x.bids(F.concat_ws(" · ", F.concat(F.col("bids").cast("string"), F.lit(" bids")), F.lit("3d left")))
    return flat(spark, sf).select("item_id", b.alias("bids"), F.when(b.isNotNull(), "auction").otherwise("fixed").alias("listing_format"))


@query("x_best_offer", f"{W} SELECT item_id, best_offer FROM flat")
def x_best_offer(spark, sf):
    text = F.when(F.col("best_offer") == 1, "Best  offer accepted").otherwise("Buy It Now")
    return flat(spark, sf).select("item_id", text.rlike(r"(?i)best\s+offer\s+accepted").cast("int").alias("best_offer"))


@query(
    "x_condition",
    """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Brand New' WHEN 1 THEN 'Ungraded' WHEN 2 THEN 'Graded' WHEN 4 THEN 'Pre-Owned'
       WHEN 5 THEN 'New (Other)' WHEN 6 THEN 'Open Box' WHEN 7 THEN 'Used' WHEN 8 THEN 'Like New' END AS condition FROM part""",
)
def x_condition(spark, sf):
    said = ("Brand new - sealed", "UNGRADED card", "Professionally graded", "as is", "Pre-owned", "New (other), see", "open BOX", "Used once", "Like new")
    return _part(spark, sf).select("k", x.condition(F.element_at(F.array(*map(F.lit, said)), (F.col("k") % 9 + 1).cast("int"))).alias("condition"))


@query("x_seller", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS seller FROM part")
def x_seller(spark, sf):
    return _part(spark, sf).select("k", x.seller(F.when(F.col("k") % 2 == 0, F.concat("p_name", F.lit(" (1,234) 99.8%"))).otherwise(F.concat(F.lit(" "), "p_type"))).alias("seller"))


@query("x_result_count", "SELECT p_partkey AS k, p_partkey * 1000 AS n, p_partkey % 3 = 0 AS capped FROM part")
def x_result_count(spark, sf):
    n, capped = x.result_count(F.concat(F.format_number(F.col("k") * 1000, 0), F.when(F.col("k") % 3 == 0, "+").otherwise(""), F.lit(" results for x")))
    return _part(spark, sf).select("k", n.alias("n"), capped.alias("capped"))


@query("x_item_id", "SELECT p_partkey AS k, 900000000000 + p_partkey AS item_id FROM part")
def x_item_id(spark, sf):
    url = F.concat(F.lit("https://www.shop.example/itm/some-title/"), (F.lit(900000000000) + F.col("k")).cast("string"), F.lit("?hash=item1"))
    return _part(spark, sf).select("k", F.regexp_extract(url, r"/itm/(?:[^/?]+/)?(\d{9,})", 1).cast("long").alias("item_id"))


@query(
    "x_image_url",
    """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'https://img.example/g/' || p_partkey || '/s-l500.jpg' WHEN 1 THEN 'https://other.example/s-l64.jpg'
       WHEN 3 THEN 'https://img.example/a/s-l800.jpg' WHEN 4 THEN 'https://img.example/a/s-l64.webp' WHEN 5 THEN 'https://img.example/a/s-l96.png' END AS url FROM part""",
)
def x_image_url(spark, sf):
    k = F.col("k")
    first = F.concat(F.lit("//img.example/thumbs/g/"), k, F.lit("/s-l225.jpg?set_id=8#x"))
    url = F.when(k % 6 == 0, x.image_url(first, 480)).when(k % 6 == 1, x.image_url(F.lit("https://other.example/s-l64.jpg"), 480)).when(k % 6 == 2, x.image_url(F.lit("data:image/gif;base64,R0"), 480))
    for rest, name, size in ((3, "s-l225.jpg", 790), (4, "s-l140.webp", 60), (5, "s-l140.png", 100)):
        url = url.when(k % 6 == rest, x.image_url(F.lit(f"https://img.example/a/{name}"), size))
    return _part(spark, sf).select("k", url.alias("url"))


@query("x_srcset_best", "SELECT p_partkey AS k, 'b' || p_partkey AS url FROM part")
def x_srcset_best(spark, sf):
    return _part(spark, sf).select("k", x.srcset_best(F.concat(F.lit("a 100w, b"), "k", F.lit(" 900w, c 900w, d"))).alias("url"))


@query("x_deconfuse", "SELECT p_partkey AS k, replace(replace(replace(p_name, ' ', ''), 'l', 'i'), 'z', 'z') || 'osb' AS fold FROM part")
def x_deconfuse(spark, sf):
    return _part(spark, sf).select("k", x.deconfused(F.concat(F.upper("p_name"), F.lit(" -058"))).alias("fold"))


@query("x_card_number_tail", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'RC' || p_partkey || '-7' WHEN p_partkey <= 25 THEN NULL ELSE p_partkey || '-' || (p_partkey + 5) END AS number FROM part")
def x_card_number_tail(spark, sf):
    k = F.col("k")
    number = F.when(k % 3 == 0, F.concat(F.lit("RC"), k)).otherwise(k.cast("string"))
    return _part(spark, sf).select("k", x.number_tail(number, F.when(k % 3 == 0, "7").otherwise((k + 5).cast("string"))).alias("number"))


@query("x_one_typo", "SELECT p_partkey AS k, CASE WHEN length(p_name) >= 9 THEN p_partkey % 4 < 3 WHEN p_partkey % 4 = 0 THEN length(p_name) = 8 OR p_name[2] = p_name[3] ELSE p_partkey % 4 = 2 AND (length(p_name) = 8 OR p_name[1] = 'q') END AS typo FROM part")
def x_one_typo(spark, sf):
    a, k = F.col("p_name"), F.col("k")
    swapped = F.concat(a.substr(F.lit(1), F.lit(1)), a.substr(F.lit(3), F.lit(1)), a.substr(F.lit(2), F.lit(1)), a.substr(F.lit(4), F.length(a)))
    b = F.when(k % 4 == 0, swapped).when(k % 4 == 1, a.substr(F.lit(2), F.length(a))).when(k % 4 == 2, F.concat(F.lit("q"), a.substr(F.lit(2), F.length(a)))).otherwise(F.concat(F.lit("qqq"), a.substr(F.lit(4), F.length(a))))
    return _part(spark, sf).select("k", x.one_typo(a, b).alias("typo"))


@query("x_same_person", "SELECT p_partkey AS k, p_partkey % 2 = 0 AS same FROM part")
def x_same_person(spark, sf):
    other = F.when(F.col("k") % 2 == 0, F.concat("p_name", F.lit(" senior"))).otherwise("someone quite other")
    return _part(spark, sf).select("k", x.same_person(x.folded_person("p_name"), x.folded_person(other)).alias("same"))


def meant(pairs, index):
    """SQL of what the text in a row means: the last field of the pair whose turn it is."""
    means = ", ".join("NULL" if p[-1] is None else "'" + p[-1].replace("'", "''") + "'" for p in pairs)
    return f"list_extract([{means}], CAST({index} % {len(pairs)} + 1 AS BIGINT))"


def told(pairs, index):
    """The text that stands in a row, by turns; ``meant`` is its twin in SQL."""
    return F.element_at(F.array(*(F.lit(p[0]) for p in pairs)), (index % len(pairs) + 1).cast("int"))


SPORTS_SAID = (
    ("NFL Chiefs hoops", "football"), ("Lakers rookie", "basketball"), ("no sport", None), ("Bears Bulls", None),
    ("2024 Prizm Football Lakers NBA", "basketball"), ("Stadium Club Yankees", "baseball"), ("Giants", None),
    ("San Francisco Giants", "baseball"), ("New York Giants", "football"), ("St. Louis Cardinals", "baseball"),
    ("court kings", "basketball"), ("Rookie Ticket", "football"), ("football hoops Miami", "basketball"),
    ("World  Series", "baseball"), ("Red Sox", "baseball"), ("Portland Trail Blazers", "basketball"), ("Redskins", "football"),
    ("MLB NFL", None), ("slam dunk", "basketball"), ("Niners", "football"), ("Seattle SuperSonics", "basketball"),
    ("Miami Heat", "basketball"), ("heat check", None), ("Expos NBA", "baseball"), ("Sky Box", "basketball"),
)


@query("x_sport_title", f"SELECT p_partkey AS k, {meant(SPORTS_SAID, 'p_partkey')} AS sport FROM part")
def x_sport_title(spark, sf):
    return _part(spark, sf).select("k", v.sport_of(F.concat_ws(" ", "p_name", told(SPORTS_SAID, F.col("k")))).alias("sport"))


@query("x_sport", f"SELECT p_partkey AS k, coalesce({meant(SPORTS_SAID, 'p_partkey')}, CASE WHEN p_partkey % 2 = 0 THEN 'tennis' END, 'football') AS sport FROM part")
def x_sport(spark, sf):
    title = F.concat_ws(" ", "p_name", told(SPORTS_SAID, F.col("k")))
    collected_as = F.when(F.col("k") % 2 == 0, "tennis")
    return _part(spark, sf).select("k", F.coalesce(v.sport_of(title), collected_as, F.lit("football")).alias("sport"))


TEAMS_SAID = (
    ("Niners", "San Francisco 49ers"), ("CHIEFS", "Kansas City Chiefs"), ("nobody", None), ("green  bay", "Green Bay Packers"),
    ("Green Bay Packers", "Green Bay Packers"), ("bucs", "Tampa Bay Buccaneers"), ("Commanders", "Washington Commanders"),
    ("Redskins", "Washington Redskins"), ("St. Louis Rams", "St. Louis Rams"), ("Jets Bills", "New York Jets"),
    ("new york giants", "New York Giants"), ("Chief", None), ("49ers", "San Francisco 49ers"), ("Seattle SEAHAWKS", "Seattle Seahawks"),
)


@query("x_team", f"SELECT p_partkey AS k, {meant(TEAMS_SAID, 'p_partkey')} AS team FROM part")
def x_team(spark, sf):
    return _part(spark, sf).select("k", v.team_of(F.concat_ws(" ", "p_name", told(TEAMS_SAID, F.col("k")))).alias("team"))


SETS_SAID = (
    ("PRIZM", "Prizm"), ("Panini Donruss", "Donruss"), ("donruss  optic", "Donruss Optic"), ("Topps Chrome", "Topps Chrome"),
    ("Flagship", "Topps"), ("topps flagship chrome", "Topps Chrome"), ("Topps Heritage", "Heritage"), ("Panini One", "Panini One"),
    ("Panini New  Product", "Panini New Product"), ("bowman's best", "Bowman's Best"), ("Prizm Draft Picks", "Prizm Draft Picks"),
)


@query("x_set_canonical", f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '') ELSE {meant(SETS_SAID, 'p_partkey')} END AS set_name FROM part""")
def x_set_canonical(spark, sf):
    """Known names, aliases and brands before known names; names of the table's own sets in any case and spacing."""
    fold = F.regexp_replace(F.lower("name"), r"\s+", "")
    sets = table(spark, sf, "part").select(F.regexp_replace("p_brand", "#", "").alias("name")).distinct().select(fold.alias("fold"), F.col("name").alias("own"))
    spaced = F.regexp_replace(F.upper(F.regexp_replace("p_brand", "#", " ")), r"\s+", "  ")
    said = _part(spark, sf).select("k", F.when(F.col("k") % 2 == 0, spaced).otherwise(told(SETS_SAID, F.col("k"))).alias("name"))
    return said.withColumn("fold", fold).join(sets, "fold", "left").select("k", F.coalesce("own", v.canonical_set(F.col("name"))).alias("set_name"))


BRANDS_SAID = (
    ("Prizm", "Panini"), ("TOPPS  CHROME", "Topps"), ("SPx", "Upper Deck"), ("Pinnacle", None), ("allen & ginter", "Topps"),
    ("National Treasures", "Panini"), ("Unknown Set", None), ("XR", "Panini"), ("Exquisite", "Upper Deck"),
)


@query("x_brand", f"SELECT p_partkey AS k, {meant(BRANDS_SAID, 'p_partkey')} AS brand FROM part")
def x_brand(spark, sf):
    return _part(spark, sf).select("k", v.brand_of(F.col("p_name"), told(BRANDS_SAID, F.col("k"))).alias("brand"))


NAMESAKES_SAID = (
    ("Josh Allen", "Jaguars", "Josh Hines-Allen"), ("Josh Allen", "Bills Jaguars", "Josh Allen"), ("JOSH ALLEN", "kentucky", "Josh Hines-Allen"),
    ("Josh Allen", "", "Josh Allen"), ("Joe Doe", "Jaguars", "Joe Doe"), ("Josh Allen", "Jags Wyoming", "Josh Allen"), ("Josh Allen", "Jaguarsx", "Josh Allen"),
)


@query("x_namesake", f"SELECT p_partkey AS k, {meant(NAMESAKES_SAID, 'p_partkey')} AS player FROM part")
def x_namesake(spark, sf):
    said, team = told(NAMESAKES_SAID, F.col("k")), told([p[1:] for p in NAMESAKES_SAID], F.col("k"))
    return _part(spark, sf).select("k", v.namesake(said, v.others_meant(F.concat_ws(" ", "p_name", said, team))).alias("player"))


PRINTINGS_SAID = (
    ("Pink Prizm", "y"), ("Chrome", "n"), ("Retail", "n"), ("Gold Label", "n"), ("Tie-Dye", "y"), ("Rated Rookie", "n"), ("", "n"),
    ("Sapphire", "y"), ("Cracked Ice", "y"), ("flagship", "n"), ("Gold Standard", "n"), ("Goldish", "n"), ("Press-Proof /99", "y"),
)


@query("x_names_printing", f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) IN ('red', 'blue')
  ELSE {meant(PRINTINGS_SAID, 'p_partkey')} = 'y' END AS printing FROM part""")
def x_names_printing(spark, sf):
    name = F.when(F.col("k") % 2 == 0, F.col("p_name")).otherwise(told(PRINTINGS_SAID, F.col("k")))
    return _part(spark, sf).select("k", v.names_printing(name).alias("printing"))


@query("x_normalise_set", "SELECT p_partkey AS k, replace(p_brand, '#', '') AS set_name FROM part")
def x_normalise_set(spark, sf):
    said = F.concat(F.lit("2023-24 "), F.regexp_replace("p_brand", "#", ""), F.lit(" Football"))
    return _part(spark, sf).select("k", F.trim(F.regexp_replace(F.regexp_replace(said, r"^\d{4}(-\d{2,4})?\s+", ""), r"(?i)\s+(football|basketball|baseball|hockey|soccer)$", "")).alias("set_name"))


@query("x_run_seconds", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 500 = 0 THEN NULL ELSE (event_id % 500)::DOUBLE END AS seconds FROM events")
def x_run_seconds(spark, sf):
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    end = start + F.make_interval(secs=(F.col("event_id") % 500).cast("decimal(18,6)"))
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.concat(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    seconds = (F.unix_millis(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))) - F.unix_millis(start)) / 1000.0
    return table(spark, sf, "events").select("event_id", F.when(seconds > 0, seconds).alias("seconds"))


@query("x_lookup_cutoff", f"{W} SELECT count(*) AS n FROM flat WHERE sold_date >= DATE '2001-06-01' - 85")
def x_lookup_cutoff(spark, sf, as_of="2001-06-01"):
    return flat(spark, sf).where(F.col("sold_date") >= F.date_sub(F.lit(as_of).cast("date"), 85)).agg(F.count("*").alias("n"))
