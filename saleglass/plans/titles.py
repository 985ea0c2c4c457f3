"""The title parser, stage by stage, on titles written from known attributes in three orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from saleglass.functions import text as x
from saleglass.functions import vocabulary as v
from saleglass.operators import learned
from saleglass.operators.partitions import settled
from saleglass.operators.titles import STANDARD, numbered, numbers_of, parse_titles, shaped, with_read, with_words, worded, works_of
from saleglass.plans.text import SPORTS_SAID, TEAMS_SAID, meant, told
from saleglass.registry import query
from saleglass.sources.bindings import FLAT_SQL, flat, table
from saleglass.sources.files import new_path

#: How titles say a flag, a lot and a number, by turns of the order.
AUTOS, ROOKIES, RELICS = ("Auto", "On-Card", "signed", "Autographed"), ("RC", "RY", "1st Year", "Rookie"), ("Patch", "RPA", "Game-Worn", "Threads")
LOTS = ("lot of 4", "Lot of (25)", "2 card lot", "Set of 12")
NUMBERS = (("#", ""), ("#", "GH-LB"), ("TRC-", ""), ("#NFS-", ""))


def _turn(texts, index="o"):
    return f"list_extract([{', '.join(repr(t) for t in texts)}], CAST({index} % {len(texts)} + 1 AS BIGINT))"


WHO_SQL = "upper(player[1]) || split_part(player, ' ', 1)[2:] || 'son ' || upper(split_part(player, ' ', 2)[1]) || split_part(player, ' ', 2)[2:]"
#: o and n: order and line. Line 7 names nobody, line 6 has a word nobody knows behind the name; old players aren't known.
K_SQL = f"""k0 AS (SELECT *, split_part(item_id, '-', 1)::INT AS o, split_part(item_id, '-', 2)::INT AS n, (card_number::INT % 10000)::VARCHAR AS num FROM flat),
k1 AS (SELECT *, CASE WHEN n <> 7 THEN {WHO_SQL} END AS who, NOT starts_with(player, 'old ') AS known,
  {_turn([p.removeprefix('#') for p, _ in NUMBERS])} || num || {_turn([t for _, t in NUMBERS])} AS number,
  {_turn([p for p, _ in NUMBERS])} || num || {_turn([t for _, t in NUMBERS])} AS hash FROM k0),
k AS (SELECT *, CASE WHEN n = 6 AND NOT known THEN who || ' Wyvernhide' ELSE who END AS guess FROM k1)"""
TITLE_SQL = f"""SELECT *, CASE o % 3 WHEN 0 THEN concat_ws(' ', year, what, whos, hash, run, extra, graded) WHEN 1 THEN concat_ws(' ', graded, whos, year, what, hash, run, extra)
  ELSE concat_ws(' ', hash, year, what, extra, whos, run, graded) END AS said FROM (
  SELECT *, who || CASE WHEN n = 6 THEN ' Wyvernhide' ELSE '' END AS whos, concat_ws(' ', set_name, upper(parallel[1]) || lower(parallel[2:]), 'Prizm') AS what,
    CASE n WHEN 2 THEN '/' || (year % 90 + 10) WHEN 3 THEN '7/' || (year % 90 + 10) END AS run, nullif(concat_ws(' ', grader, regexp_replace(CAST(grade AS VARCHAR), '\\.0$', '')), '') AS graded,
    nullif(concat_ws(' ', CASE WHEN is_auto = 1 THEN {_turn(AUTOS)} END, CASE WHEN is_rookie = 1 THEN {_turn(ROOKIES)} END, CASE WHEN is_relic = 1 THEN {_turn(RELICS)} END,
      CASE n WHEN 5 THEN {_turn(LOTS)} WHEN 4 THEN 'zesty' END), '') AS extra FROM k)"""
W = f"WITH {FLAT_SQL}, {K_SQL}"


def who(player="player"):
    """A name that no vocabulary knows a word of: the player's, its first word longer."""
    words = F.split(player, " ")
    return F.concat(F.initcap(words[0]), F.lit("son "), F.initcap(words[1]))


def titles(spark, sf):
    """item_id and title, with a run on some, a serial on others, numbers in four shapes, flags in four wordings, lots in
    four, one line without a name and one with a word behind it."""
    o, n = F.col("o"), F.col("n")

    def turn(texts):
        return F.element_at(F.array(*map(F.lit, texts)), (o % len(texts) + 1).cast("int"))

    # a title costs far more to parse than a line to move, so lines are dealt; what several orders of words use is made once a row
    f = flat(spark, sf, dealt=True).withColumns({"o": F.substring_index("item_id", "-", 1).cast("int"), "n": F.split_part("item_id", F.lit("-"), F.lit(2)).cast("int"), "_who": who()})
    flags = (F.when(F.col(c) == 1, turn(texts)) for c, texts in (("is_auto", AUTOS), ("is_rookie", ROOKIES), ("is_relic", RELICS)))
    rows = f.select(
        "item_id", "year", "o",
        F.concat(turn([p for p, _ in NUMBERS]), F.col("card_number").cast("int") % 10000, turn([t for _, t in NUMBERS])).alias("number"),
        F.when(n == 2, F.concat(F.lit("/"), F.col("year") % 90 + 10)).when(n == 3, F.concat(F.lit("7/"), F.col("year") % 90 + 10)).alias("run"),
        F.nullif(F.concat_ws(" ", "grader", F.regexp_replace(F.col("grade").cast("string"), r"\.0$", "")), F.lit("")).alias("graded"),
        F.when(n == 6, F.concat("_who", F.lit(" Wyvernhide"))).when(n < 6, F.col("_who")).alias("named"),
        F.concat_ws(" ", "set_name", F.initcap("parallel"), F.lit("Prizm")).alias("what"),
        F.nullif(F.concat_ws(" ", *flags, F.when(n == 5, turn(LOTS)).when(n == 4, "zesty")), F.lit("")).alias("extra"),
    )
    ordered = F.when(o % 3 == 0, F.concat_ws(" ", "year", "what", "named", "number", "run", "extra", "graded")).when(o % 3 == 1, F.concat_ws(" ", "graded", "named", "year", "what", "number", "run", "extra"))
    return rows.select("item_id", ordered.otherwise(F.concat_ws(" ", "number", "year", "what", "extra", "named", "run", "graded")).alias("title"))


def vocabulary(spark, sf):
    """All known words, and the set and parallel names of the data: a few dozen, whatever the number of sales."""
    part = table(spark, sf, "part")
    sets = [r[0] for r in part.select(F.regexp_replace("p_brand", "#", "")).distinct().collect()]
    return with_words(STANDARD, sets=tuple(sorted(sets)), parallels=tuple(sorted(r[0] for r in part.select(F.concat(F.initcap("p_type"), F.lit(" Prizm"))).distinct().collect())))


def roster(spark, sf):
    """The players known by name: all but the old ones."""
    return table(spark, sf, "part").where(~F.col("p_name").startswith("old ")).select(who("p_name").alias("name"))


def parsed(spark, sf, each=None):
    return parse_titles(titles(spark, sf), vocabulary(spark, sf), roster=roster(spark, sf), keep=("item_id",), each=each)


def _stage(name, sql, *columns, run=parsed):
    query(name, f"{W} SELECT item_id, {sql} FROM k")(lambda spark, sf: run(spark, sf).select("item_id", *columns))


def _capital(column):
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def _numbers(spark, sf):
    return numbered(titles(spark, sf))


_stage("t01_grade", "grader, grade", "grader", "grade", run=_numbers)
_stage("t02_card_number", "CASE WHEN n <> 5 THEN number END AS card_number", "card_number")
_stage("t03_serial", "CASE WHEN n = 3 THEN 7 END AS serial, CASE WHEN n IN (2, 3) THEN year % 90 + 10 END AS print_run", "serial", "print_run", run=_numbers)
_stage("t04_year", "year", "year", run=_numbers)
_stage("t09_parallel", f"{_capital('parallel')} || ' Prizm' AS parallel", "parallel")
_stage("t10_flags", "is_rookie, is_auto, is_relic", "is_rookie", "is_auto", "is_relic")
_stage("t11_player", "CASE WHEN n <> 5 THEN guess END AS player", "player")
SURE_SQL = "(CASE WHEN n = 5 THEN 30 ELSE 40 + CASE WHEN n = 7 THEN 0 WHEN known THEN 45 ELSE 35 END + CASE WHEN card_number IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN grader IS NOT NULL THEN 5 ELSE 0 END END) / 100.0::DOUBLE"
_stage("t13_confidence", f"{SURE_SQL} AS confidence", "confidence")
_stage("t15_unparsed", "CASE WHEN n = 4 THEN 'zesty' WHEN n = 6 THEN 'Wyvernhide' WHEN n = 5 AND o % 4 = 3 THEN 'Set' END AS unparsed", "unparsed")
_stage("t16_multi_card", "CAST(n = 5 AS INT) AS is_lot, CASE WHEN n <> 5 THEN guess END AS player, CASE WHEN n <> 5 THEN number END AS card_number", "is_lot", "player", "card_number")


def said(spark, sf, pairs):
    """item_id and a title of every sale: its year, a phrase by turns, and its player."""
    f = flat(spark, sf, dealt=True)
    phrase = told(pairs, F.substring_index("item_id", "-", 1).cast("int"))
    return f.select("item_id", F.concat_ws(" ", "year", phrase, F.initcap("player")).alias("title"))


@query("t05_team", f"{W} SELECT item_id, {meant(TEAMS_SAID, 'o')} AS team FROM k")
def t05_team(spark, sf):
    return parse_titles(said(spark, sf, TEAMS_SAID), STANDARD, keep=("item_id",)).select("item_id", "team")


#: Sets as titles write them: the first known name is taken, the longest that starts there; aliases become the set meant.
SET_TITLES = (
    ("Panini PRIZM", "Prizm", "Panini"), ("donruss  optic", "Donruss Optic", "Panini"), ("Topps Flagship Chrome", "Topps Chrome", "Topps"),
    ("Flagship", "Topps", None), ("Prizm Draft Picks", "Prizm Draft Picks", "Panini"), ("PANINI Rookies & Stars", "Rookies & Stars", "Panini"),
    ("Contenders Optic", "Contenders Optic", None), ("Nothing Known", None, None), ("Upper Deck SP Authentic", "Upper Deck", None),
    ("Leaf Metal", None, "Leaf"), ("SPx", "SPx", "Upper Deck"), ("Playoff Absolute", "Absolute", "Playoff"), ("Philadelphia", "Philadelphia", None),
)


@query("t06_set", f"{W} SELECT item_id, {meant([p[:2] for p in SET_TITLES], 'o')} AS set_name FROM k")
def t06_set(spark, sf):
    return parse_titles(said(spark, sf, SET_TITLES), STANDARD, keep=("item_id",)).select("item_id", "set_name")


@query("t08_brand", f"{W} SELECT item_id, {meant(SET_TITLES, 'o')} AS brand FROM k")
def t08_brand(spark, sf):
    """The brand still unclaimed after the set, else the maker of the set."""
    return parse_titles(said(spark, sf, SET_TITLES), STANDARD, keep=("item_id",)).select("item_id", "brand")


#: Phrases of the three classes: text, insert, variety, parallel, and the flags spoken of by the first phrase.
SUBSET_TITLES = (
    ("Genies", "Genies", None, None, 0, 0, 0), ("GENIES", "Genies", None, None, 0, 0, 0), ("Rated Rookie", None, "Rated Rookie", None, 1, 0, 0),
    ("Rookie Patch Autograph", "Rookie Patch Autograph", None, None, 1, 1, 1), ("Rookie  Patch Silver", "Rookie Patch", None, "Silver", 1, 1, 0),
    ("Decade Dominance Silver", "Decade Dominance", None, "Silver", 0, 0, 0), ("Genies Rated Rookie", "Genies", "Rated Rookie", None, 0, 0, 0),
    ("Future Stars All-Pro", None, "All-Pro Future Stars", None, 0, 0, 0), ("pink velocity", None, None, "Pink Velocity", 0, 0, 0),
    ("Gold Disco Sapphire", None, None, "Disco Sapphire Gold", 0, 0, 0), ("Retail Exclusive Genies", "Genies", "Retail Exclusive", None, 0, 0, 0),
    ("Dragon Scale", "Dragon Scale", None, None, 0, 0, 0), ("Dragonscale Hall of Fame Signatures", "Hall of Fame Signatures", None, None, 0, 0, 0), ("RC", None, None, None, 1, 0, 0),
)
_T07 = {name: meant([p[: i + 2] for p in SUBSET_TITLES], "o") for i, name in enumerate(("subset", "variety", "parallel"))}


def _flag_of(i):
    return f"list_extract([{', '.join(str(p[i]) for p in SUBSET_TITLES)}], CAST(o % {len(SUBSET_TITLES)} + 1 AS BIGINT))"


@query("t07_subset", f"""{W}, s AS (SELECT *, {', '.join(f'{x} AS s_{name}' for name, x in _T07.items())}, {_flag_of(4)} AS rookie, {_flag_of(5)} AS relic, {_flag_of(6)} AS auto FROM k)
  SELECT item_id, s_subset AS subset, s_variety AS variety, s_parallel AS parallel, rookie AS is_rookie, relic AS is_relic, auto AS is_auto,
    concat_ws('-', year, 'donruss', lower(replace(s_subset, ' ', '-')), 'n' || n, lower(replace(s_parallel, ' ', '-')), CASE WHEN auto = 1 THEN 'auto' END, CASE WHEN relic = 1 THEN 'patch' END) AS card_key FROM s""")
def t07_subset(spark, sf):
    """Inserts go to the key, learned printings to the parallels, designations to the variety; up to two phrases a title."""
    rows = flat(spark, sf).select("item_id", F.concat_ws(" ", "year", F.lit("Donruss"), who(), told(SUBSET_TITLES, F.split("item_id", "-")[0].cast("int")), F.concat(F.lit("#"), F.split("item_id", "-")[1])).alias("title"))
    p = parse_titles(rows, with_words(STANDARD, printings=("Pink Velocity", "Disco Sapphire"), designations=("Retail Exclusive",)))
    return identified(p).select("item_id", "subset", "variety", "parallel", "is_rookie", "is_relic", "is_auto", "card_key")


#: Known names behind the first player, by turns: joined in several ways, shouted, unknown, several, none.
BESIDE = (
    ("& Smallson Ring", ["Smallson Ring"]), ("and LARGESON WIDGET", ["Largeson Widget"]), ("/ oldson rod", []), ("& Nobody Here", []),
    ("rookie", []), ("with newson plate & Coldson Anvil", ["Newson Plate", "Coldson Anvil"]), ("x Hot-son Gizmo", ["Hotson Gizmo"]),
)
_BESIDE = f"list_extract([{', '.join(str(names) + '::VARCHAR[]' for _, names in BESIDE)}], CAST(p_partkey % {len(BESIDE)} + 1 AS BIGINT))"


@query("t12_second_player", f"""WITH said AS (SELECT p_partkey AS k, {WHO_SQL.replace('player', 'p_name')} AS who, {_BESIDE} AS beside FROM part WHERE NOT starts_with(p_name, 'old ')),
  known AS (SELECT DISTINCT who FROM said), b AS (SELECT k, who, unnest(beside) AS name FROM said), y AS (SELECT DISTINCT k, who, name FROM b WHERE name <> who AND name IN (SELECT who FROM known))
  SELECT k, string_agg(name, ' / ' ORDER BY name) AS players FROM (SELECT k, name FROM y UNION SELECT k, who FROM y) GROUP BY k""")
def t12_second_player(spark, sf):
    """Titles with several known players name all of them, the parser's own first one among them."""
    part = table(spark, sf, "part").where(~F.col("p_name").startswith("old "))
    title = F.concat_ws(" ", F.lit("2020 Prizm"), who("p_name"), F.lit("#12"), told(BESIDE, F.col("p_partkey")))
    p = parse_titles(part.select(F.col("p_partkey").alias("k"), title.alias("title")), STANDARD, roster=roster(spark, sf))
    return p.where(F.contains("player", F.lit(" / "))).select("k", F.col("player").alias("players"))


@query("t14_sport", f"{W} SELECT item_id, {meant(SPORTS_SAID, 'o')} AS sport FROM k")
def t14_sport(spark, sf):
    return said(spark, sf, SPORTS_SAID).select("item_id", v.sport_of(F.col("title")).alias("sport"))


_FOLD = "lower(replace(guess, ' ', ''))"
_ID = f"""CASE WHEN n <> 5 AND (number IS NOT NULL OR n <> 7) THEN concat_ws('-', year, lower(set_name), coalesce('n' || lower(number), {_FOLD} || CASE WHEN n IN (2, 3) THEN '-r' || (year % 90 + 10) ELSE '' END),
  lower(parallel) || '-prizm', CASE WHEN is_auto = 1 THEN 'auto' END, CASE WHEN is_relic = 1 THEN 'patch' END) END"""


def _football(p):
    return p.withColumns({"sport": F.lit("football"), "print_run": F.col("print_run").cast("string")})


def identified(p):
    return _football(p).withColumns({"card_key": x.card_key(), "card_name": x.card_name()})


def keyed(spark, sf):
    """item_id and card_key of every title. All of a key but the number is made once a shape of titles."""
    ends = parsed(spark, sf, each=lambda read: _football(read).withColumn("_ends", x.key_ends()))
    return ends.select("item_id", x.keyed("_ends", "card_number").alias("card_key"))


@query("t17_identity", f"{W} SELECT item_id, {_ID} AS card_key FROM k")
def t17_identity(spark, sf):
    return keyed(spark, sf)


@query("t18_reparse", f"{W} SELECT count(*) AS titles, count({_ID}) AS keyed, count(DISTINCT {_ID}) AS groups FROM k")
def t18_reparse(spark, sf):
    return keyed(spark, sf).agg(F.count("*").alias("titles"), F.count("card_key").alias("keyed"), F.count_distinct("card_key").alias("groups"))


#: Words as they were learned, by version: set, insert and designation. The second one leaves out, adds, and asks for words
#: that are known already.
LEARNED = {
    1: (("set", "Brand1"), ("set", "Panini Brand2"), ("insert", "Widget Kings"), ("designation", "Retail Only"), ("designation", "Pink Scales")),
    2: (("set", "Brand3"), ("insert", "Rated Rookie"), ("insert", "Retail Only"), ("designation", "Silver"), ("designation", "Pink Scales"), ("designation", "Genies"), ("set", "Panini Prizm")),
}
SAID_LEARNED = ("Widget Kings", "Retail Only", "Pink Scales", "Rated Rookie", "Genies Silver", "Panini Prizm")
#: What each of ``SAID_LEARNED`` means, by version: subset, variety, parallel.
MEANT_LEARNED = {
    1: (("Widget Kings", None, None), (None, "Retail Only", None), (None, None, "Pink Scales"), (None, "Rated Rookie", None), ("Genies", None, "Silver"), (None, None, None)),
    2: ((None, None, None), ("Retail Only", None, None), (None, None, "Pink Scales"), (None, "Rated Rookie", None), ("Genies", None, "Silver"), (None, None, None)),
}


def _learned_sql(version):
    fields = ", ".join(f"{meant([(m[i],) for m in MEANT_LEARNED[version]], 'o')} AS {name}" for i, name in enumerate(("subset", "variety", "parallel")))
    sets = "WHEN set_name = 'Brand1' THEN set_name" if version == 1 else "WHEN set_name = 'Brand3' THEN set_name"
    return f"SELECT item_id, {version} AS version, CASE {sets} WHEN o % {len(SAID_LEARNED)} = 5 THEN 'Prizm' END AS set_name, {fields} FROM k"


@query("t19_learned_vocab", f"{W} {_learned_sql(1)} UNION ALL {_learned_sql(2)}")
def t19_learned_vocab(spark, sf):
    """Titles under two versions of a learned vocabulary, each replacing the one before; known words keep their meaning."""
    path = new_path(spark, "vocabulary")
    for version, words in LEARNED.items():
        learned.publish(spark.createDataFrame(words, "kind string, name string"), path, version)
    words = learned.table_of(spark, path)
    said = F.element_at(F.array(*map(F.lit, SAID_LEARNED)), (F.split("item_id", "-")[0].cast("int") % len(SAID_LEARNED) + 1).cast("int"))
    rows = settled(shaped(flat(spark, sf).select("item_id", F.concat_ws(" ", "year", "set_name", who(), said).alias("title"))), "shaped")
    early = numbers_of(rows)
    works = works_of(early)
    both = [with_read(rows, worded(early, learned.read(words, version), works=works)).select("item_id", F.lit(version).alias("version"), "set_name", "subset", "variety", "parallel") for version in LEARNED]
    return both[0].unionByName(both[1])
