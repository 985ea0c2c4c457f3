"""Data-quality audits, triage, review samples and learned vocabularies."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from saleglass.functions import stats
from saleglass.functions import vocabulary as v
from saleglass.functions.text import folded_person, same_person
from saleglass.operators import catalogue as cat
from saleglass.operators.grids import by_leader, contradictory, delta, parse_grid, scored
from saleglass.operators.partitions import settled
from saleglass.operators.readings import learned_inserts, vocabulary_gaps
from saleglass.operators.titles import STANDARD, parse_titles, with_words
from saleglass.plans import titles as t
from saleglass.plans.text import meant, told
from saleglass.registry import SQL, query
from saleglass.sources.bindings import CHECKLIST_SQL, FLAT_SQL, cards, checklist, flat, table

W = f"WITH {FLAT_SQL}"
BUCKETS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01))


def audit_coverage(rows):
    """Cards, keyed ones, groups and confidence buckets in one pass by key."""
    by_key = rows.groupBy("card_key").agg(F.count("*").alias("n"), *(F.count_if((F.col("confidence") >= lo) & (F.col("confidence") < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(BUCKETS)))
    keyed = F.col("card_key").isNotNull()
    return by_key.agg(
        F.sum("n").alias("cards"), F.sum(F.when(keyed, F.col("n")).otherwise(0)).alias("keyed"), F.count_if(keyed).alias("groups"), F.count_if(keyed & (F.col("n") == 1)).alias("singletons"),
        F.sum(F.when(keyed & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("grouped_sales"), *(F.sum(f"b{i}").alias(f"b{i}") for i in range(5)),
    ).withColumn("key_rate", stats.rounded(F.col("keyed") / F.col("cards"), 3))


@query("a_audit_coverage", f"""{W}, g AS (SELECT card_key, count(*) AS n FROM flat WHERE card_key IS NOT NULL GROUP BY 1)
  SELECT count(*) AS cards, count(card_key) AS keyed, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM g WHERE n = 1) AS singletons, (SELECT sum(n) FROM g WHERE n > 1)::BIGINT AS grouped_sales,
  """ + ", ".join(f"count(*) FILTER (WHERE confidence >= {lo} AND confidence < {hi}) AS b{i}" for i, (lo, hi) in enumerate(BUCKETS)) + ", floor(count(card_key) / count(*)::DOUBLE * 1000 + 0.5) / 1000.0 AS key_rate FROM flat")
def a_audit_coverage(spark, sf):
    return audit_coverage(flat(spark, sf))


def _named(spark, sf):
    """Names as sellers vary them: one line in nine swaps two letters, one in ten names somebody else."""
    n = F.split("item_id", "-")
    typo = n[0].cast("int") % 9 == 0
    other = n[0].cast("int") % 10 == 1
    name = F.when(other, "somebody else").when(typo, F.concat("player", F.lit("s"))).otherwise(F.col("player"))
    return flat(spark, sf).where("card_key is not null").select("card_key", "item_id", "title", name.alias("name"))


NAMED_SQL = "named AS (SELECT card_key, item_id, title, CASE WHEN split_part(item_id, '-', 1)::INT % 10 = 1 THEN 'somebody else' WHEN split_part(item_id, '-', 1)::INT % 9 = 0 THEN player || 's' ELSE player END AS name, player FROM flat WHERE card_key IS NOT NULL)"
#: Names of a key here are its player, that name with an s, or somebody else; the leader is the most frequent.
LED_SQL = f"""{NAMED_SQL}, k AS (SELECT card_key, name, any_value(player) AS player, count(*) AS n FROM named GROUP BY 1, 2), l AS (SELECT card_key, arg_max(name, (n, -length(name))) AS leader, any_value(player) AS player FROM k GROUP BY 1)"""


@query("a_contradictory", f"""{W}, {LED_SQL}, d AS (SELECT card_key, sum(n) AS sales, sum(n) FILTER (WHERE (name = 'somebody else') <> (leader = 'somebody else')) AS dissent FROM k JOIN l USING (card_key) GROUP BY 1)
  SELECT card_key, sales::BIGINT AS sales, dissent::BIGINT AS dissent, floor(dissent / sales::DOUBLE * 100 + 0.5) / 100.0 AS share FROM d WHERE dissent > 0 AND dissent / sales::DOUBLE >= 0.1""")
def a_contradictory(spark, sf):
    return contradictory(by_leader(_named(spark, sf))).withColumn("share", stats.rounded(F.col("dissent") / F.col("sales"), 2))


@query("a_messy_names", f"{W}, {NAMED_SQL} SELECT card_key, count(*) AS sales, count(DISTINCT name) AS variants FROM named GROUP BY 1 HAVING count(DISTINCT name) >= 2 AND bool_and(name <> 'somebody else')")
def a_messy_names(spark, sf):
    return messy(by_leader(_named(spark, sf))).select("card_key", "sales", "variants")


def messy(led):
    """Keys of several spellings that are all one person's."""
    k = led.groupBy("card_key").agg(F.sum("n").alias("sales"), F.count("*").alias("variants"), F.bool_and(same_person(F.col("fold"), F.col("leader"))).alias("one"))
    return k.where("one and variants >= 2")


@query("a_wide_spread", f"{W} SELECT card_key, grade_label, count(*) AS sales, max(price_cents) / 100.0 AS high, floor(max(price_cents) / median(price_cents) * 10 + 0.5) / 10.0 AS ratio FROM labelled WHERE card_key IS NOT NULL AND best_offer = 0 AND currency = 'USD' GROUP BY 1, 2 HAVING count(*) >= 5 AND max(price_cents) / median(price_cents) >= 2.5")
def a_wide_spread(spark, sf, least=2.5):
    rows = flat(spark, sf).where(stats.priced() & (F.col("best_offer") == 0) & F.col("card_key").isNotNull()).withColumn("grade_label", stats.grade_label())
    g = rows.groupBy("card_key", "grade_label").agg(F.count("*").alias("sales"), (F.max("price_cents") / 100.0).alias("high"), (F.max("price_cents") / F.median("price_cents")).alias("ratio"))
    return g.where((F.col("sales") >= 5) & (F.col("ratio") >= least)).withColumn("ratio", stats.rounded(F.col("ratio"), 1))


@query("a_number_split", f"""{W}, g AS (SELECT year, lower(set_name) AS s, lower(replace(player, ' ', '')) AS p, lower(parallel) AS pa, count(*) FILTER (WHERE card_number IS NULL) AS missing, count(DISTINCT upper(card_number)) AS numbers FROM flat GROUP BY 1, 2, 3, 4)
  SELECT sum(missing) FILTER (WHERE numbers = 1)::BIGINT AS recoverable, sum(missing) FILTER (WHERE numbers > 1)::BIGINT AS ambiguous, count(*) FILTER (WHERE missing > 0 AND numbers > 0) AS groups FROM g""")
def a_number_split(spark, sf):
    g = flat(spark, sf).groupBy("year", F.lower("set_name").alias("s"), folded_person("player").alias("p"), F.lower("parallel").alias("pa")).agg(F.count_if(F.col("card_number").isNull()).alias("missing"), F.count_distinct(F.upper("card_number")).alias("numbers"))
    return g.agg(F.sum(F.when(F.col("numbers") == 1, F.col("missing"))).alias("recoverable"), F.sum(F.when(F.col("numbers") > 1, F.col("missing"))).alias("ambiguous"), F.count_if((F.col("missing") > 0) & (F.col("numbers") > 0)).alias("groups"))


@query("a_vocab_gaps", f"""WITH {FLAT_SQL}, {t.K_SQL}, said AS ({t.TITLE_SQL}),
  s AS (SELECT item_id, o, n, concat_ws(' ', said, list_extract(['glossy', 'glossy variant', 'see photos'], o % 3 + 1)) AS title FROM said),
  w AS (SELECT item_id, title, unnest(string_split(list_extract(['glossy', 'glossy variant', 'see photos'], o % 3 + 1), ' ')) AS word FROM s
    UNION ALL SELECT item_id, title, CASE WHEN n = 4 THEN 'zesty' WHEN n = 6 THEN 'Wyvernhide' WHEN n = 5 AND o % 4 = 3 THEN 'Set' END FROM s WHERE n IN (4, 6) OR n = 5 AND o % 4 = 3)
  SELECT word, count(*) AS n, min(item_id) AS example_id, arg_min(title, item_id) AS example FROM w GROUP BY 1""")
def a_vocab_gaps(spark, sf):
    order = F.split("item_id", "-")[0].cast("int")
    left = F.element_at(F.array(*map(F.lit, ("glossy", "glossy variant", "see photos"))), (order % 3 + 1).cast("int"))
    titled = t.titles(spark, sf).withColumn("title", F.concat_ws(" ", "title", left))
    return vocabulary_gaps(parse_titles(titled, t.vocabulary(spark, sf), roster=t.roster(spark, sf)))


_BAD = f"{W}, {LED_SQL}, d AS (SELECT card_key, sum(n) AS sales, sum(n) FILTER (WHERE (name = 'somebody else') <> (leader = 'somebody else')) AS dissent FROM k JOIN l USING (card_key) GROUP BY 1) SELECT sales FROM d WHERE dissent > 0 AND dissent / sales::DOUBLE >= 0.1"


@query("a_audit_report", f"""SELECT c.*, s.recoverable, s.ambiguous, s.groups AS split_groups, (SELECT count(*) FROM ({SQL['a_messy_names']})) AS messy_groups, (SELECT count(*) FROM ({SQL['a_wide_spread']})) AS wide_spread_groups,
  b.n AS contradictory_groups, floor(b.sales / c.keyed::DOUBLE * 10000 + 0.5) / 10000.0 AS known_bad_rate FROM ({SQL['a_audit_coverage']}) c, ({SQL['a_number_split']}) s, (SELECT count(*) AS n, sum(sales) AS sales FROM ({_BAD})) b""")
def a_audit_report(spark, sf):
    """Every measure that needs no marked rows in one row; the names of cards are folded once for both that compare them."""
    led = settled(by_leader(_named(spark, sf)), "led")
    bad = contradictory(led).agg(F.count("*").alias("contradictory_groups"), F.coalesce(F.sum("sales"), F.lit(0)).alias("bad"))
    parts = [audit_coverage(flat(spark, sf)), a_number_split(spark, sf).withColumnRenamed("groups", "split_groups"), messy(led).agg(F.count("*").alias("messy_groups")), a_wide_spread(spark, sf).agg(F.count("*").alias("wide_spread_groups")), bad]
    row = functools.reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return row.withColumn("known_bad_rate", stats.rounded(F.col("bad") / F.nullif("keyed", F.lit(0)), 4)).drop("bad")


TRIAGE = "SELECT card_key, count(card_number) = 0 AS numberless, count(*) AS sales, count(*) FILTER (WHERE grader IS NOT NULL AND image_url IS NOT NULL) AS readable, count(image_url) AS photos FROM flat WHERE card_key IS NOT NULL GROUP BY 1"


@query("a_triage", f"""{W}, t AS ({TRIAGE}) SELECT count(*) AS groups, sum(sales)::BIGINT AS sales, count(*) FILTER (WHERE sales >= 3) AS three_or_more, count(*) FILTER (WHERE readable > 0) AS readable_groups, count(*) FILTER (WHERE readable = 0) AS person_only, count(*) FILTER (WHERE photos > 0) AS with_photo FROM t WHERE numberless""")
def a_triage(spark, sf):
    photo = F.col("image_url").isNotNull()
    t = flat(spark, sf).where("card_key is not null").groupBy("card_key").agg((F.count("card_number") == 0).alias("numberless"), F.count("*").alias("sales"), F.count_if(photo & F.col("grader").isNotNull()).alias("readable"), F.count_if(photo).alias("photos"))
    return t.where("numberless").agg(F.count("*").alias("groups"), F.sum("sales").alias("sales"), F.count_if(F.col("sales") >= 3).alias("three_or_more"), F.count_if(F.col("readable") > 0).alias("readable_groups"), F.count_if(F.col("readable") == 0).alias("person_only"), F.count_if(F.col("photos") > 0).alias("with_photo"))


@query("a_triage_coverage", f"{W} SELECT count(*) AS sales, count(image_url) AS with_photo, count(grader) AS graded, count(*) FILTER (WHERE image_url IS NOT NULL AND grader IS NOT NULL) AS both FROM flat")
def a_triage_coverage(spark, sf):
    return flat(spark, sf).agg(F.count("*").alias("sales"), F.count("image_url").alias("with_photo"), F.count("grader").alias("graded"), F.count_if(F.col("image_url").isNotNull() & F.col("grader").isNotNull()).alias("both"))


@query("a_review_queue", f"{W} SELECT card_key, count(*) AS sales, min(sold_date) AS first_sold, max(sold_date) AS last_sold, count(image_url) AS photos, array_to_string(list_sort(list(DISTINCT title))[1:4], '|') AS titles FROM flat WHERE card_key IS NOT NULL GROUP BY 1 HAVING count(card_number) = 0 AND count(*) >= 3", dates="first_sold last_sold")
def a_review_queue(spark, sf, least=3):
    q = flat(spark, sf).where("card_key is not null").groupBy("card_key").agg(F.count("*").alias("sales"), F.min("sold_date").alias("first_sold"), F.max("sold_date").alias("last_sold"), F.count("image_url").alias("photos"), F.count("card_number").alias("numbers"), F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, 4), "|").alias("titles"))
    return q.where((F.col("numbers") == 0) & (F.col("sales") >= least)).drop("numbers")


@query("a_bucket_titles", f"{W} SELECT card_key, title FROM (SELECT card_key, title, row_number() OVER (PARTITION BY card_key ORDER BY length(title), title) AS r FROM (SELECT DISTINCT card_key, title FROM flat WHERE card_key IN (SELECT card_key FROM flat GROUP BY 1 HAVING count(card_number) = 0))) WHERE r <= 5")
def a_bucket_titles(spark, sf):
    rows = flat(spark, sf).where("card_key is not null")
    flagged = rows.groupBy("card_key").agg(F.count("card_number").alias("n")).where("n = 0").select("card_key")
    titles = rows.join(flagged, "card_key", "left_semi").select("card_key", "title").distinct()
    r = F.row_number().over(Window.partitionBy("card_key").orderBy(F.length("title"), "title"))
    return titles.withColumn("r", r).where("r <= 5").select("card_key", "title")


@query("a_review_score", f"""{W}, m AS (SELECT CASE price_cents % 10 WHEN 0 THEN 'n' WHEN 1 THEN 'skip' WHEN 2 THEN '' ELSE 'Y' END AS mark FROM flat), s AS (SELECT count(*) FILTER (WHERE mark = 'Y') AS yes, count(*) FILTER (WHERE mark = 'n') AS no, count(*) FILTER (WHERE mark = 'skip') AS skipped, count(*) FILTER (WHERE mark = '') AS blank FROM m)
  SELECT yes, no, skipped, blank, floor(yes / (yes + no)::DOUBLE * 10000 + 0.5) / 10000.0 AS accuracy, floor(1.96 * sqrt(yes / (yes + no)::DOUBLE * (1 - yes / (yes + no)::DOUBLE) / (yes + no)) * 10000 + 0.5) / 10000.0 AS margin FROM s""")
def a_review_score(spark, sf):
    mark = F.lower(F.trim(F.when(F.col("price_cents") % 10 == 0, "n").when(F.col("price_cents") % 10 == 1, "skip").when(F.col("price_cents") % 10 == 2, "").otherwise("Y")))
    s = flat(spark, sf).select(mark.alias("m")).agg(F.count_if(F.col("m").isin("y", "yes", "1")).alias("yes"), F.count_if(F.col("m").isin("n", "no", "0")).alias("no"), F.count_if(F.col("m").isin("skip", "?")).alias("skipped"), F.count_if(F.col("m") == "").alias("blank"))
    n = F.col("yes") + F.col("no")
    p = F.col("yes") / n
    return s.select("*", stats.rounded(p, 4).alias("accuracy"), stats.rounded(1.96 * F.sqrt(p * (1 - p) / n), 4).alias("margin"))


@query("margin_of_error", f"{W} SELECT set_name, floor(1.96 * sqrt(avg(best_offer) * (1 - avg(best_offer)) / count(*)) * 10000 + 0.5) / 10000.0 AS margin FROM flat GROUP BY 1")
def margin_of_error(spark, sf):
    p = F.avg("best_offer")
    return flat(spark, sf).groupBy("set_name").agg(stats.rounded(1.96 * F.sqrt(p * (1 - p) / F.count("*")), 4).alias("margin"))


#: Titles of the grid: two of three have a word behind the name, one that a list calls an insert, one that nobody knows; four
#: of five a number, shared by several.
GRID_SQL = f"""p AS (SELECT p_partkey AS k, p_size + 1990 AS year, replace(p_brand, '#', '') AS brand, {t.WHO_SQL.replace('player', 'p_name')} AS who, NOT starts_with(p_name, 'old ') AS listed, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 3)::VARCHAR END AS num FROM part),
  c(config, listed_all, keyed_words, all_sets) AS (SELECT CASE WHEN a THEN 'all' ELSE 'few' END || CASE WHEN w THEN ' keyed' ELSE ' claimed' END || CASE WHEN s THEN ' + sets' ELSE '' END, a, w, s FROM (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(w), (VALUES (true), (false)) z(s)),
  g AS (SELECT config, k, CASE WHEN k % 3 = 2 AND NOT (listed_all AND listed) THEN who || ' Dragonbone' ELSE who END AS player, year, brand, num, CASE WHEN k % 3 = 0 AND keyed_words THEN 'wyvernhide' END AS subset FROM p, c WHERE all_sets OR replace(brand, 'Brand', '')::INT <= 12),
  keys AS (SELECT config, lower(replace(player, ' ', '')) AS fold, concat_ws('-', year, lower(brand), subset, coalesce('n' || num, lower(replace(player, ' ', '')))) AS key FROM g),
  n AS (SELECT config, key, count(*) AS n FROM keys GROUP BY 1, 2), f AS (SELECT config, key, fold, count(*) AS n FROM keys GROUP BY 1, 2, 3),
  l AS (SELECT config, key, arg_min(fold, (-n, length(fold), fold)) AS leader FROM f GROUP BY 1, 2),
  d AS (SELECT config, key, sum(n) AS sales, sum(n) FILTER (WHERE NOT (contains(fold, leader) OR contains(leader, fold) OR length(fold) >= 8 AND length(leader) >= 8 AND damerau_levenshtein(fold, leader) <= 1)) AS dissent FROM f JOIN l USING (config, key) GROUP BY 1, 2),
  s AS (SELECT config, sum(n)::BIGINT AS keyed, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS grouped, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS grouped_sales, floor(count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE * 10000 + 0.5) / 10000.0 AS rate FROM n GROUP BY 1),
  grid AS (SELECT s.*, coalesce(w.wrong, 0)::BIGINT AS wrong FROM s LEFT JOIN (SELECT config, sum(sales) AS wrong FROM d WHERE dissent > 0 AND dissent / sales::DOUBLE >= 0.1 GROUP BY 1) w USING (config))"""


def _grid(spark, sf, only=None):
    """Each roster, way with the listed words and list of sets, as one parse."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    behind = F.when(k % 3 == 0, "Wyvernhide").when(k % 3 == 2, "Dragonbone")
    title = F.concat_ws(" ", F.col("p_size") + 1990, F.regexp_replace("p_brand", "#", ""), t.who("p_name"), behind, F.when(k % 5 > 0, F.concat(F.lit("#"), k % 3)))
    titles = part.select(k.cast("string").alias("item_id"), title.alias("title"))
    rosters = {"all": t.roster(spark, sf), "few": t.roster(spark, sf).limit(0)}
    modes, sets = {"claimed": "designations", "keyed": "inserts"}, {"": 12, " + sets": 25}
    configs = [(f"{r} {m}{s}", with_words(STANDARD, sets=tuple(f"Brand{i}" for i in range(1, n + 1)), **{kind: ("Wyvernhide",)}), names) for r, names in rosters.items() for m, kind in modes.items() for s, n in sets.items()]
    return scored(parse_grid(titles, [c for c in configs if only is None or c[0] in only]))


@query("a_parser_delta", f"""WITH {GRID_SQL}, m AS (UNPIVOT (SELECT config, keyed::DOUBLE AS keyed, grouped::DOUBLE AS grouped, grouped_sales::DOUBLE AS grouped_sales, rate::DOUBLE AS rate FROM grid) ON keyed, grouped, grouped_sales, rate INTO NAME metric VALUE v),
  b AS (SELECT metric, max(v) FILTER (WHERE config = 'few claimed') AS before, max(v) FILTER (WHERE config = 'all keyed + sets') AS after FROM m GROUP BY 1)
  SELECT *, CASE WHEN abs(after - before) < CASE metric WHEN 'rate' THEN 0.0005 ELSE 0.5 END THEN 'no change' WHEN (after > before) <> (metric = 'rate') THEN 'better' ELSE 'worse' END AS verdict FROM b""")
def a_parser_delta(spark, sf):
    """One table parsed before and after a larger vocabulary, in a single job."""
    before, after = "few claimed", "all keyed + sets"
    return delta(_grid(spark, sf, (before, after)), before, after)


@query("a_learn_names", f"""{W}, w AS (SELECT year, set_name, unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS name FROM (SELECT year, set_name, string_split(player, ' ') AS x FROM flat))
  SELECT name, count(*) AS sightings, count(DISTINCT (year, set_name)) AS contexts FROM w GROUP BY 1 HAVING count(DISTINCT (year, set_name)) >= 3 AND count(*) >= 8""")
def a_learn_names(spark, sf, contexts=3, sightings=8):
    x = F.split("player", " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(x) - 1), lambda i: F.array_join(F.slice(x, i, 2), " "))
    w = flat(spark, sf).where(F.size(x) >= 2).select("year", "set_name", F.explode(windows).alias("name")).where(~F.col("name").rlike(r"(?i)\b(jr|sr|ii|iii|iv|v)$"))
    return w.groupBy("name").agg(F.count("*").alias("sightings"), F.count_distinct(F.struct("year", "set_name")).alias("contexts")).where((F.col("contexts") >= contexts) & (F.col("sightings") >= sightings))


@query("a_learn_inserts", f"""{W} SELECT 'genies' AS phrase, count(*) AS sightings, 2 AS contexts, count(DISTINCT player) AS players FROM flat WHERE set_name = 'Brand1' AND split_part(item_id, '-', 2)::INT < 4
  UNION ALL SELECT phrase, count(*), 1, count(DISTINCT player) FROM flat, (VALUES ('downtown'), ('kings'), ('downtown kings')) v(phrase) WHERE set_name = 'Brand2' AND split_part(item_id, '-', 1)::INT % 2 = 0 GROUP BY phrase""")
def a_learn_inserts(spark, sf):
    """Titles of two seasons: one insert in both of a product, one in a season, one that many products share, one beside a
    single player."""
    f = flat(spark, sf)
    order, line = F.split("item_id", "-")[0].cast("int"), F.split("item_id", "-")[1].cast("int")
    insert = (
        F.when((F.col("set_name") == "Brand1") & (line < 4), "Genies").when((F.col("set_name") == "Brand2") & (order % 2 == 0), "Downtown Kings")
        .when(F.col("set_name").isin("Brand3", "Brand4"), "Everywhere").when((F.col("set_name") == "Brand5") & (F.col("player") == "small ring"), "Kaboom")
    )
    title = F.concat_ws(" card ", "set_name", insert, "player")
    titles = f.select("item_id", "set_name", (2020 + order % 2).alias("year"), title.alias("title"))
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    return learned_inserts(titles, names, ["brand"], ["card", "cards", "free", "mint"]).select("phrase", "sightings", "contexts", "players")


@query("a_facet_harvest", "SELECT event_type AS aspect, json_extract_string(props, '$.k') AS value, max(user_id) AS n FROM events GROUP BY 1, 2")
def a_facet_harvest(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("aspect"), F.get_json_object("props", "$.k").alias("value")).agg(F.max("user_id").alias("n"))


#: Aspects as listings name them, by turns, and what they feed.
SAID_FACETS = (
    ("Player/Athlete", "players"), ("Set", "sets"), ("PARALLEL / VARIETY", "parallels"), ("Insert Set", "parallels"), ("Season", "seasons"), ("Year Manufactured", "seasons"), ("Colour", None),
    ("Card Number", "card_numbers"), ("Manufacturer", "brands"), ("team", "teams"), ("Country of Origin", "countries"),
)


def vocabulary_facets(rows, least):
    """bucket, value and the highest n of values of ``rows`` (aspect, value, n) whose aspect feeds a vocabulary."""
    bucket = v.spelled(F.regexp_replace(F.lower("aspect"), "[^a-z0-9]", ""), v.FACETS)
    return rows.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket", "value").agg(F.max("n").alias("n")).where(F.col("n") >= least)


@query("a_facet_vocab", f"""SELECT bucket, value, max(user_id) AS n FROM (SELECT {meant(SAID_FACETS, 'user_id')} AS bucket, json_extract_string(props, '$.k') AS value, user_id FROM events)
  WHERE bucket IS NOT NULL GROUP BY 1, 2 HAVING max(user_id) >= 5""")
def a_facet_vocab(spark, sf, least=5):
    rows = table(spark, sf, "events").select(told(SAID_FACETS, F.col("user_id")).alias("aspect"), F.get_json_object("props", "$.k").alias("value"), F.col("user_id").alias("n"))
    return vocabulary_facets(rows, least)


@query("w_facet_topk", "SELECT aspect, value, n FROM (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY n DESC, value) AS r FROM (SELECT event_type AS aspect, json_extract_string(props, '$.k') AS value, max(user_id) AS n FROM events GROUP BY 1, 2)) WHERE r <= 5")
def w_facet_topk(spark, sf, k=5):
    r = F.row_number().over(Window.partitionBy("aspect").orderBy(F.desc("n"), "value"))
    return a_facet_harvest(spark, sf).withColumn("r", r).where(F.col("r") <= k).drop("r")


WK = f"WITH {CHECKLIST_SQL}"


@query("a_checklist_vocab", f"{WK} SELECT 'parallel' AS kind, parallel AS term FROM checklist UNION SELECT 'subset', subset FROM checklist WHERE subset IS NOT NULL UNION SELECT 'set', set_name FROM checklist")
def a_checklist_vocab(spark, sf):
    c = checklist(spark, sf)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(col).alias("term")) for k, col in (("parallel", "parallel"), ("subset", "subset"), ("set", "set_name")))))
    return c.select(kinds.alias("x")).select("x.*").where("term is not null").distinct()


@query("a_checklist_stats", f"{WK} SELECT count(*) AS cards, count(DISTINCT set_name) AS sets, min(year) AS first_year, max(year) AS last_year, count(DISTINCT subset) AS inserts, count(DISTINCT parallel) AS parallels, count(DISTINCT (year, set_name)) AS products FROM checklist")
def a_checklist_stats(spark, sf):
    c = checklist(spark, sf)
    return c.agg(F.count("*").alias("cards"), F.count_distinct("set_name").alias("sets"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("subset").alias("inserts"), F.count_distinct("parallel").alias("parallels"), F.count_distinct(F.struct("year", "set_name")).alias("products"))


@query("a_checklist_sets", f"{WK} SELECT year, set_name, count(*) AS cards FROM checklist GROUP BY 1, 2")
def a_checklist_sets(spark, sf):
    return checklist(spark, sf).groupBy("year", "set_name").agg(F.count("*").alias("cards"))


@query("a_vocab_grid", f"WITH {GRID_SQL} SELECT *, row_number() OVER (ORDER BY grouped DESC, config) = 1 AS best FROM grid")
def a_vocab_grid(spark, sf):
    scores = _grid(spark, sf)
    first = F.row_number().over(Window.orderBy(F.desc("grouped"), "config"))  # one row a configuration
    return scores.withColumn("best", first == 1)
