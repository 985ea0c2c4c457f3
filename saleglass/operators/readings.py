"""Two readings of one item, and names that titles teach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleglass.functions.text import folded_person
from saleglass.operators.roster import IN_ROW, few, looked_up

FIELDS = ("year", "set_name", "player", "card_number", "grader", "grade")


def equivalent(field: str, a: Column, b: Column) -> Column:
    """Names (folded) agree if one holds the other; sets, numbers and graders by letters and digits alone; the rest if equal."""
    if field == "player":
        x, y = a, b
        return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    if field in ("set_name", "card_number", "grader"):
        x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
        return (a == b) | (x == y)
    return a == b


def reconcile(titles: DataFrame, readings: DataFrame) -> DataFrame:
    """The title's fields with blanks filled from the reading of the photo, which wins only on the player.

    Both: item_id, the six fields, confidence. ``filled``, ``agreed`` and ``conflicts`` list field names. An agreement
    adds 0.05 to the confidence, up to 1 and never down; any conflict takes 0.15, down to 0.1. A reading that is not
    there or has no confidence changes nothing; ``outcome`` says failed, no label or read.
    """
    r = readings.select("item_id", F.struct(*FIELDS, "confidence").alias("r"))
    both = titles.join(r, "item_id", "left").withColumns({"_ours": folded_person("player"), "_theirs": folded_person("r.player")})
    heard = F.coalesce(F.col("r.confidence"), F.lit(0.0)) > 0
    state, kinds = {}, dict(titles.dtypes)
    for f in FIELDS:
        ours, theirs = F.col(f), F.when(heard, F.col(f"r.{f}"))
        blank = lambda c: c.isNull() | (c == "") if kinds[f] == "string" else c.isNull()  # noqa: E731, B023
        state[f] = F.when(blank(theirs), None).when(blank(ours), "filled").when(equivalent(f, *((F.col("_ours"), F.col("_theirs")) if f == "player" else (ours, theirs))), "agreed").otherwise("conflicts")
    both = both.withColumns({f"_{f}": s for f, s in state.items()})
    listed = {k: F.array_compact(F.array(*(F.when(F.col(f"_{f}") == k, f) for f in FIELDS))) for k in ("filled", "agreed", "conflicts")}
    both = both.withColumns(listed)
    c = F.col("confidence")
    up = F.when(F.size("agreed") > 0, F.greatest(c, F.round(F.least(F.lit(1.0), c + 0.05 * F.size("agreed")), 2))).otherwise(c)
    merged = {f: F.when(F.col(f"_{f}") == "filled", F.col(f"r.{f}")).otherwise(F.col(f)) for f in FIELDS}
    merged["player"] = F.when(F.col("_player").isin("filled", "conflicts"), F.col("r.player")).otherwise(F.col("player"))
    merged["confidence"] = F.when(F.size("conflicts") > 0, F.round(F.greatest(F.lit(0.1), up - 0.15), 2)).otherwise(up)
    merged["outcome"] = F.when(F.col("r").isNull(), "failed").when(heard, "read").otherwise("no label")
    return both.withColumns(merged).drop("r", "_ours", "_theirs", *(f"_{f}" for f in FIELDS))


def behind(words: Column, k: int) -> Column:
    """The array from its ``k``-th word on. Zipped with the array itself, the ends of runs meet their beginnings."""
    return F.slice(words, k, F.lit(1 << 30))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_runs(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words of an array, as texts."""
    runs = words
    for k in range(2, n + 1):
        runs = F.zip_with(runs, behind(words, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(runs)


def word_windows(text: Column, sizes: tuple[int, ...]) -> Column:
    """All runs of ``sizes`` words of a lower-cased text, once each."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return once(words, lambda w: F.array_distinct(F.concat(*(word_runs(w, n) for n in sizes))))


def second_players(titles: DataFrame, names: DataFrame, key: str, least: int = 8, in_row: int = IN_ROW) -> DataFrame:
    """key, players: the player of a title and the known names beside, in alphabetical order, joined by " / ".

    ``titles``: key, player, title; ``names`` (name, lower case) gives the longest spelling of each folded name of
    ``least`` letters or more. A name that the first player's holds is no second one; titles without one have no row.
    Up to ``in_row`` names are looked up within the row of a title, more meet its word windows by a join.
    """
    own, said = folded_person("player"), word_windows(F.col("title"), (2, 3))
    roster = names.select("name", folded_person("name").alias("fold")).where(F.length("fold") >= least)
    best = roster.groupBy("fold").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("best"))
    if few(roster, in_row):
        fold_of = looked_up(roster.select(F.col("name").alias("key"), F.col("fold").alias("value")).distinct())
        best_of = looked_up(best.select(F.col("fold").alias("key"), F.col("best").alias("value")))
        heard = titles.select(key, "player", own.alias("_own"), F.transform(said, fold_of).alias("_folds"))
        heard = heard.select(key, "player", F.filter(F.array_distinct("_folds"), lambda f: ~F.contains(F.col("_own"), f)).alias("_folds")).where(F.size("_folds") > 0)
        heard = heard.select(key, "player", F.transform("_folds", best_of).alias("_best"))
        both = heard.groupBy(key, "player").agg(F.array_distinct(F.flatten(F.collect_list("_best"))).alias("n"))  # titles of one item
    else:
        roster = roster.join(best, "fold").select("name", "fold", "best")
        heard = titles.select(key, "player", F.explode(said).alias("name")).join(roster, "name").where(~F.contains(own, F.col("fold")))
        both = heard.groupBy(key, "player").agg(F.collect_set("best").alias("n"))  # names of one title
    return both.select(key, F.array_join(F.array_sort(F.array_append("n", F.lower("player"))), " / ").alias("players"))


def vocabulary_gaps(parsed: DataFrame) -> DataFrame:
    """word, n, example (title) and example_id: words left over in titles, with the title of the first item."""
    words = parsed.select("item_id", "title", F.explode(F.split("unparsed", " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min_by("title", "item_id").alias("example"), F.min("item_id").alias("example_id"))


def learned_inserts(titles: DataFrame, names: DataFrame, known: list[str], noise: list[str], sightings=6, contexts=2, players=4) -> DataFrame:
    """Phrases of one or two words that may name an insert: seen often, in few products, beside many players.

    ``titles``: item_id, title, year, set_name; ``names`` (name, lower case): the players known. A single word has five
    letters or more and is no word of a known term; of a pair no word is noise and not both are known. ``known`` and
    ``noise`` are short lists in lower case.
    """
    parts = sorted({w for term in known for w in term.split()})
    t = titles.where(F.col("year").isNotNull() & F.col("set_name").isNotNull())
    words = F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z][a-z'’]*"), F.lit(0)), lambda w: F.length(w) > 2)
    t = t.select("item_id", "year", "set_name", words.alias("w"))
    single = F.filter("w", lambda w: (F.length(w) >= 5) & ~w.isin(*noise) & ~w.isin(*parts))
    couples = F.zip_with(F.col("w"), behind(F.col("w"), 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    couples = F.filter(couples, lambda p: p["b"].isNotNull() & ~p["a"].isin(*noise) & ~p["b"].isin(*noise) & ~(p["a"].isin(*known) & p["b"].isin(*known)))
    pairs = F.transform(couples, lambda p: F.concat_ws(" ", p["a"], p["b"]))
    runs = F.concat(word_runs(F.col("w"), 2), word_runs(F.col("w"), 3))
    beside = t.select("item_id", F.explode(F.array_distinct(runs)).alias("name")).join(names.distinct(), "name")
    phrases = t.select("item_id", "year", "set_name", F.explode(F.array_distinct(F.concat(single, pairs))).alias("phrase"))
    phrases = phrases.where(~F.col("phrase").isin(*known)).join(names.select(F.col("name").alias("phrase")).distinct(), "phrase", "left_anti")
    seen = phrases.groupBy("phrase").agg(F.count("*").alias("sightings"), F.count_distinct("year", "set_name").alias("contexts"))
    seen = seen.where((F.col("sightings") >= sightings) & (F.col("contexts") <= contexts))
    company = phrases.join(beside, "item_id").groupBy("phrase").agg(F.count_distinct("name").alias("players")).where(F.col("players") >= players)
    return seen.join(company, "phrase")
