"""Listing titles to attributes: a chain of claims over a work column, all in one projection.

Each stage takes its match out of the work column (blanks of the same length stay), so later stages can't read it again.
Vocabularies are lists of words; they become patterns in which words share their beginnings. Known players come as a table
(see ``roster``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleglass.functions import vocabulary as v
from saleglass.functions.text import folded_person, folded_words, number_tail
from saleglass.operators.partitions import settled
from saleglass.operators.roster import LEAST, with_known

# Graders, words of flags and lots, words behind a "#" that make it no card number.
GRADERS = "PSA BGS BVG SGC CGC CSG HGA TAG ISA BECKETT".split()
ROOKIE = r"(?i)\b(RC|RY|ROOKIE|ROOKIE\s+CARD|1ST\s+YEAR)\b"
AUTO = r"(?i)\b(AUTO(?:GRAPH(?:ED)?)?|SIGNED|ON[-\s]CARD)\b"
RELIC = r"(?i)\b(PATCH|RELIC|JERSEY|RPA|MEM(?:ORABILIA)?|SWATCH|GLOVE|THREADS|GAME[-\s]?WORN|GAME[-\s]?USED|WORN)\b"
LOT = (
    r"(?i)\b(?:pick\s+your|you\s+pick|complete\s+your|choose\s+your|your\s+choice|build\s+your|lot\s+of\s+\(?\s*(?:\d+|cards?)"
    r"|\(?\s*\d+\s*\)?\s*-?\s*cards?(?:\s+[a-z&']+){0,3}\s+lot|cards?\s+lot|rookie\s+lot|player\s+lot|mixed\s+lot|investor\s+lot"
    r"|complete\s+(?:factory\s+|team\s+)?set|factory\s+set|team\s+set|set\s+of\s+\(?\s*\d+|\(?\s*\d+\s*\)?\s*-?\s*cards?\s+set)\b"
)
PLACE = r"(?:overall|draft\s+pick(?!s)|pick(?!s)|ranked|rank|seed|prospect)"
NOT_A_NUMBER = "psa bgs sgc cgc csg hga tag isa rc ssp mint gem hot rare auto lot nfl psa10 new".split()

_NO = "|".join(NOT_A_NUMBER)
NUMBER = rf"(?i)#\s?([A-Z]{{0,4}}-?\d{{1,4}}(?:-?[A-Z]{{1,3}})*)(?:-(\d{{1,4}}))?\b(?!/)(?!\s+{PLACE}\b)"
WEAKER_NUMBERS = (
    r"\b([A-Z]{2,4}-\d{1,4})\b",
    rf"(?i)#\s?(?!(?:{_NO})-|[A-Z]{{1,5}}-(?:{_NO})\b)([A-Z]{{1,5}}-[A-Z]{{1,5}})\b(?!-?\d)",
    rf"(?i)#\s?(?!(?:{_NO})\b)([A-Z]{{3,6}})\b(?!-?\d)",
)
YEAR = r"\b(19[5-9]\d|20[0-4]\d)(?:\s*[-/]\s*\d{2})?\b"
#: Tokens that are the card number for certain, whatever their digits: the only "#" of a title, or without one its only "-" before a digit.
#: No grader stands in them, and no word of digits and letters ("#49ers") that a vocabulary may know.
_OTHER_WORDS = rf"(?!\S*(?:{'|'.join(GRADERS)}|ERS))"
CERTAIN = rf"(?i)(?<!\S)(?=#){_OTHER_WORDS}(#[A-Z]{{0,4}}-?\d{{1,4}}(?:-?[A-Z])*+)(?!\S)(?!\s+{PLACE}\b)"
CERTAIN_DASH = rf"(?<!\S)(?=[A-Z]{{2,4}}-){_OTHER_WORDS}([A-Z]{{2,4}}-\d{{1,4}})(?!\S)"
#: Words that a title without the fragment of a name leaves behind.
LEFT = r"[A-Za-z][A-Za-z'\-]{2,}"


def sells_several(title: Column) -> Column:
    """Whether a listing sells many cards at one price. Every such phrase holds one of three words, which are looked for first."""
    low = F.lower(title)
    return (F.contains(low, F.lit("lot")) | F.contains(low, F.lit("set")) | F.contains(low, F.lit("you"))) & title.rlike(LOT)


@dataclass(frozen=True)
class Vocabulary:
    """Words of each class. ``inserts`` are part of a card, ``printings`` (learned) are parallels, ``designations`` are noted
    as its variety. ``set_names`` and ``team_names`` say what a spelling in lower case means, itself where they don't."""

    sets: tuple[str, ...] = ()
    parallels: tuple[str, ...] = ()
    teams: tuple[str, ...] = ()
    inserts: tuple[str, ...] = ()
    designations: tuple[str, ...] = ()
    printings: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    set_names: dict[str, str] = field(default_factory=dict, hash=False)
    team_names: dict[str, str] = field(default_factory=lambda: v.TEAM_NAMES, hash=False)

    def pattern(self, *kinds: str) -> str | None:
        words = [w for k in kinds for w in getattr(self, k)]
        return v.any_of(words) if words else None

    def spelling(self, *kinds: str) -> dict[str, str]:
        return {w.lower(): w for k in kinds for w in getattr(self, k)}


#: Everything that the library knows by itself.
STANDARD = Vocabulary(
    sets=(*v.SETS, *v.SET_ALIASES), parallels=v.PARALLELS, teams=tuple(v.TEAM_NAMES), inserts=v.INSERTS, designations=v.DESIGNATIONS, brands=v.BRANDS, set_names=dict(v.SET_ALIASES)
)


def with_words(vocabulary: Vocabulary, **more: tuple[str, ...]) -> Vocabulary:
    """``vocabulary`` with more words of some classes."""
    return replace(vocabulary, **{k: (*getattr(vocabulary, k), *words) for k, words in more.items()})


def claim(df: DataFrame, pattern: str | None, where: Column | None = None, **outputs: int) -> DataFrame:
    """Groups of the first match as columns (null without one), and the match blanked in ``work``; in rows ``where`` only.

    One scan of the title marks its matches; place and text of the first are read off the marks, groups from that text.
    The marked text stays behind as ``_k`` for the next claim to replace."""
    if pattern is None:
        return df.withColumns({name: F.lit(None).cast("string") for name in outputs})
    marked = F.regexp_replace("work", pattern, "\x01$0\x02")
    df = df.withColumn("_k", marked if where is None else F.when(where, marked).otherwise(F.col("work")))
    at = F.instr("_k", "\x01")
    m = F.substring_index(F.substring_index("_k", "\x02", 1), "\x01", -1)
    work = F.when(at > 0, F.overlay("work", F.repeat(F.lit(" "), F.length(m)), at)).otherwise(F.col("work"))
    found = {name: F.when(at > 0, m if g == 0 else F.nullif(F.regexp_extract(m, pattern, g), F.lit(""))) for name, g in outputs.items()}
    return df.withColumns({**found, "work": work})


def flag(df: DataFrame, name: str, pattern: str) -> DataFrame:
    return claim(df, pattern, _f=0).withColumn(name, F.col("_f").isNotNull().cast("int")).drop("_f")


def subsets(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Up to two phrases, each by its class: ``subset`` (an insert), ``_printings``, ``variety`` (designations in alphabetical
    order); and the flags that the first phrase speaks of, since the flags' own words are gone with it."""
    kinds = ("inserts", "designations", "printings")
    pattern = vocabulary.pattern(*kinds)
    out = claim(claim(df, pattern, _s1=0), pattern, _s2=0)
    said = F.array(F.col("_s1"), F.col("_s2"))

    def of(kind: str) -> Column:
        spelling = vocabulary.spelling(kind)
        return F.array_compact(F.transform(said, lambda s: v.spelled(s, spelling))) if spelling else F.array().cast("array<string>")

    variety = F.array_join(F.array_sort(F.array_distinct(of("designations"))), " ")
    out = out.withColumns({"subset": F.try_element_at(of("inserts"), F.lit(-1)), "variety": F.nullif(variety, F.lit("")), "_printings": of("printings")})
    spoken = {"_says_rookie": "(?i)rookie", "_says_relic": RELIC, "_says_auto": AUTO}
    return out.withColumns({name: F.coalesce(F.col("_s1").rlike(p), F.lit(False)) for name, p in spoken.items()}).drop("_s1", "_s2")


def parallels(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The printings claimed and up to three parallels in the vocabulary's spelling, each once, in alphabetical order."""
    found, out = ["_p1", "_p2", "_p3"], df
    if vocabulary.parallels:
        for i, name in enumerate(found):
            out = claim(out, vocabulary.pattern("parallels"), F.col(found[i - 1]).isNotNull() if i else None, **{name: 0})
        spelling = vocabulary.spelling("parallels")
        each = F.concat("_printings", F.array_compact(F.array(*(v.spelled(F.col(name), spelling) for name in found))))
    else:
        each = F.col("_printings")
    return out.withColumn("parallel", F.nullif(F.array_join(F.array_sort(F.array_distinct(each)), " "), F.lit(""))).drop("_printings", *found)


def name_runs(work: Column) -> Column:
    """Runs of name-shaped words, as an array of texts. Noise, numbers and other words end a run; claimed text doesn't."""
    words = F.filter(F.split(F.regexp_replace(work, r"(?U)[^\w\s'’.\-]", " "), r"(?U)\s+"), lambda w: w != "")

    def good(w: Column) -> Column:
        bare = F.lower(F.regexp_replace(w, r"^[.,\-'’]+|[.,\-'’]+$", ""))
        named = w.rlike(r"^[A-Z][A-Za-z'’.\-]*$") | bare.rlike(v.SUFFIX_PATTERN)
        return named & (bare != "") & ~v.is_noise(bare) & ~bare.rlike(r"^\d+$")

    marked = F.array_join(F.transform(words, lambda w: F.when(good(w), w).otherwise("|")), " ")
    return F.filter(F.transform(F.split(marked, r"\|"), lambda r: F.trim(r)), lambda r: r != "")


def windows(words: Column, size: int, between: str = " ") -> Column:
    """All runs of ``size`` neighbouring words, as texts."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(size)), between))


def titled(name: Column) -> Column:
    """Each letter that follows none is a capital, all others are small."""
    return F.replace(F.initcap(F.regexp_replace(name, "([^A-Za-z])(?=[A-Za-z])", "$1\x01 ")), F.lit("\x01 "), F.lit(""))


def shouted(name: Column) -> Column:
    return name.rlike("[A-Z]") & ~name.rlike("[a-z]")


def best_run(runs: Column) -> Column:
    """Two or three words before four, three before two, then a single word; the first of equals."""
    def kind(n: Column) -> Column:
        return F.when(n == 3, 4).when(n == 2, 3).when(n == 4, 2).when(n == 1, 1).otherwise(0)

    scored = F.transform(runs, lambda r, i: F.struct(kind(F.size(F.split(r, " "))).alias("kind"), (-i).alias("i"), r.alias("r")))
    best = F.array_max(F.filter(scored, lambda s: s["kind"] > 0))["r"]
    return F.nullif(F.regexp_replace(best, r"^[ .,\-]+|[ .,\-]+$", ""), F.lit(""))


def players(df: DataFrame, roster: DataFrame | None) -> DataFrame:
    """``player`` and ``_known``: a known name of three, then two words in the first run that holds one, else the best run;
    known names elsewhere in the words left stand beside it, in alphabetical order."""
    out = df.withColumn("_runs", name_runs(F.col("work")))
    guess = best_run(F.col("_runs"))
    if roster is None:
        return out.withColumns({"player": F.when(shouted(guess), titled(guess)).otherwise(guess), "_known": F.lit(False)}).drop("_runs")
    each = F.transform("_runs", lambda r: F.concat(windows(F.split(r, " "), 3), windows(F.split(r, " "), 2)))
    out = out.withColumn("_left", F.filter(F.split(folded_words("work"), " "), lambda w: w != ""))
    folds = F.concat(*(windows(F.col("_left"), n, "") for n in (2, 3, 4, 5)))
    out = out.withColumns({"_windows": F.flatten(each), "_folds": F.filter(folds, lambda f: F.length(f) >= LEAST)})
    out = with_known(out, roster, "_windows", "_folds", "_hit", "_also")
    first = F.coalesce("_hit", guess)
    out = out.withColumn("_first", F.when(shouted(first), titled(first)).otherwise(first))
    others = F.filter("_also", lambda n: ~F.contains(folded_person("_first"), folded_person(n)))
    out = out.withColumn("_others", F.when(F.col("_first").isNotNull(), F.transform(others, titled)))
    both = F.array_join(F.array_sort(F.concat(F.array(F.when(F.col("_first") == F.lower("_first"), titled(F.col("_first"))).otherwise(F.col("_first"))), "_others")), " / ")
    more = F.coalesce(F.size("_others") > 0, F.lit(False))
    return out.withColumns({"player": F.when(more, both).otherwise(F.col("_first")), "_known": F.col("_hit").isNotNull() | more}).drop("_runs", "_left", "_windows", "_folds", "_hit", "_also", "_first", "_others")


def tidied(work: Column) -> Column:
    """Runs of blanks as two blanks, none at the ends. No pattern tells two blanks from more, so what is read stays the same."""
    return F.trim(F.regexp_replace(work, r"\s{2,}", "  "))


def numbered(df: DataFrame, title: str = "title") -> DataFrame:
    """``df`` with ``work`` and all that no vocabulary decides: grader, grade, card_number, serial, print_run, year, is_lot and
    ``_others_meant``. Patterns that need a certain character are looked for only where it stands."""
    graders = rf"(?=[{''.join(sorted({g[0] for g in GRADERS}))}])({'|'.join(GRADERS)})"

    def has(character: str) -> Column:
        return F.contains(F.col("work"), F.lit(character))

    out = df.withColumn("work", F.coalesce(title, F.lit("")))
    out = claim(out, rf"(?i)\b{graders}\s*(?:GEM\s*-?\s*MT|GEM\s*MINT|MINT|AUTH(?:ENTIC)?)?\s*(10(?:\.0)?|[1-9](?:\.5|\.0)?)\b", _g=1, _v=2)
    out = claim(out, rf"(?i)\b{graders}\b", F.col("_g").isNull(), _alone=1)
    grader = F.upper(F.coalesce("_g", "_alone"))
    out = out.withColumns({"grader": F.when(grader == "BECKETT", "BGS").otherwise(grader), "grade": F.col("_v").cast("double")}).drop("_g", "_v", "_alone")
    out = claim(out, NUMBER, has("#"), _n=1, _t=2)
    out = out.withColumn("card_number", F.upper(number_tail("_n", "_t"))).drop("_n", "_t")
    for weaker, character in zip(WEAKER_NUMBERS, "-##", strict=True):
        out = claim(out, weaker, F.col("card_number").isNull() & has(character), _n=1).withColumn("card_number", F.coalesce("card_number", F.upper("_n"))).drop("_n")
    out = claim(out, r"\b(\d{1,4})\s*/\s*(\d{1,5})\b", has("/"), _a=1, _b=2)
    out = claim(out, r"(?<![\d/])/\s*(\d{1,5})\b", F.col("_b").isNull() & has("/"), _c=1)
    a, b = F.col("_a").cast("int"), F.col("_b").cast("int")
    out = out.withColumns(
        {"serial": F.when(a <= b, a), "print_run": F.coalesce(b, F.col("_c").cast("int")), "card_number": F.coalesce("card_number", F.when(a > b, F.col("_a")))}
    ).drop("_a", "_b", "_c")
    out = claim(out, YEAR, _y=1).withColumn("year", F.col("_y").cast("int")).drop("_y", "_k")
    lot = F.coalesce(sells_several(F.col(title)), F.lit(False)).cast("int")
    return out.withColumns({"work": tidied(F.col("work")), "is_lot": lot, "_others_meant": v.others_meant(F.col(title))})


def shaped(df: DataFrame, title: str = "title") -> DataFrame:
    """``df`` with ``_shape`` and ``_number``: the title with one 0 for the digits of its card number, and that number, where it is certain
    that they are read as the number and as nothing else; else the title as it is, and null.

    A certain number is claimed whole by the first pattern that can meet it, so titles of one shape differ in ``card_number`` alone."""
    text = F.coalesce(title, F.lit(""))
    hash_, dash = F.contains(text, F.lit("#")), F.contains(text, F.lit("-"))
    only = F.when(hash_, F.when(F.substring_index(text, "#", 2) == text, F.regexp_extract(text, CERTAIN, 1))).when(dash, F.when(F.regexp_count(text, F.lit(r"-\d")) == 1, F.regexp_extract(text, CERTAIN_DASH, 1)))
    out = df.withColumn("_token", F.nullif(only, F.lit("")))
    return out.withColumns({"_shape": F.coalesce(F.replace(text, F.col("_token"), F.regexp_replace("_token", r"\d+", "0")), text), "_number": F.upper(F.ltrim(F.col("_token"), F.lit("#")))}).drop("_token")


def numbers_of(rows: DataFrame) -> DataFrame:
    """``numbered`` for the shapes of ``shaped``, each once."""
    return settled(numbered(rows.select("_shape").distinct(), "_shape"), "numbered")


def with_read(rows: DataFrame, read: DataFrame) -> DataFrame:
    """``rows`` of ``shaped`` with what their shapes say (``worded``), each with its own card number."""
    columns = [c for c in read.columns if c != "_shape"]
    out = rows.drop(*columns).join(read.withColumnRenamed("_shape", "_read"), F.col("_shape") == F.col("_read"))
    number = F.when(F.col("card_number").isNotNull(), F.coalesce("_number", "card_number"))
    return out.withColumn("card_number", number).drop("_shape", "_number", "_read")


def parse_titles(
    df: DataFrame, vocabulary: Vocabulary, title: str = "title", roster: DataFrame | None = None, keep: tuple[str, ...] | None = None, each: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``df`` with grader, grade, card_number, serial, print_run, year, team, set_name, subset, variety, brand, parallel, flags,
    player, is_lot, confidence and unparsed.

    Teams, sets and brands leave as they are printed. ``roster`` (name) holds known players. A null title gives nulls; a lot
    of cards has no number and no player. Columns of ``df`` with these names are replaced. The rows are written once, with
    the shapes of their titles; all else is read once a shape. Of ``df`` the columns ``keep`` stay (all, if null): the title need not
    be written beside its shape. ``each`` adds columns to what shapes say, of anything but a number's digits.
    """
    rows = shaped(df, title)
    rows = settled(rows if keep is None else rows.select(*keep, "_shape", "_number"), "shaped")
    read = worded(numbers_of(rows), vocabulary, roster)
    return with_read(rows, read if each is None else each(read))


#: What the words of a title decide, and with them ``_words_score`` and ``_known``.
WORDED = ("team", "set_name", "subset", "variety", "brand", "parallel", "is_rookie", "is_auto", "is_relic", "player", "unparsed")


def works_of(df: DataFrame) -> DataFrame:
    """What is left of the titles of ``numbered``, each once."""
    return settled(df.select("work").distinct(), "works")


def worded(df: DataFrame, vocabulary: Vocabulary, roster: DataFrame | None = None, works: DataFrame | None = None) -> DataFrame:
    """The rest of ``parse_titles`` for the rows of ``numbered``, so that several vocabularies can share those (and their
    ``works_of``). Titles that are equal but for their numbers are read as one, and each gets its words back by a join. What
    is read is written, since the long chain of claims must not be planned again with each stage of the join."""
    read = settled(words_read(works_of(df) if works is None else works, vocabulary, roster), "words")
    out = df.drop(*WORDED, "confidence").join(read.withColumnRenamed("work", "_work"), F.col("work") == F.col("_work"))
    lot = F.col("is_lot") == 1
    score = F.col("_words_score") + sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0) for c, w in (("year", 20), ("card_number", 10), ("grader", 5))), F.lit(0))
    one = v.namesake(F.col("player"), F.col("_others_meant"))
    out = out.withColumns({"confidence": F.when(lot, F.least(score, F.lit(30))).otherwise(score) / 100.0, "card_number": F.when(~lot, F.col("card_number")), "player": F.when(~lot, one)})
    return out.drop("work", "_work", "_words_score", "_others_meant")


def words_read(works: DataFrame, vocabulary: Vocabulary, roster: DataFrame | None = None) -> DataFrame:
    """``works`` (work) with ``WORDED`` and ``_words_score``, the part of the confidence that they give."""
    out = works.withColumn("_work", F.col("work"))
    out = claim(out, vocabulary.pattern("teams"), team=0)
    out = claim(out, vocabulary.pattern("sets"), set_name=0)
    out = out.withColumns({"team": F.coalesce(v.spelled(F.col("team"), vocabulary.spelling("teams") | vocabulary.team_names), v.collapsed(F.col("team"))), "set_name": meant_set(vocabulary)})
    out = subsets(out, vocabulary)
    out = claim(out, vocabulary.pattern("brands"), brand=0)
    makers = {s.lower(): brand for brand, held in v.SETS_BY_BRAND.items() if brand for s in held}
    out = out.withColumn("brand", F.coalesce(v.spelled(F.col("brand"), vocabulary.spelling("brands") or {"": ""}), v.spelled(F.col("set_name"), makers)))
    out = parallels(out, vocabulary)
    for name, pattern in (("rookie", ROOKIE), ("auto", AUTO), ("relic", RELIC)):
        out = flag(out, f"is_{name}", pattern).withColumn(f"is_{name}", F.greatest(f"is_{name}", F.col(f"_says_{name}").cast("int"))).drop(f"_says_{name}")
    out = players(out, roster)
    score = sum((F.when(test, F.lit(w)).otherwise(0) for test, w in ((F.col("player").isNotNull(), 35), (F.col("_known"), 10), (F.col("set_name").isNotNull(), 20))), F.lit(0))
    own = F.split(F.lower(F.coalesce("player", F.lit(""))), r"\s+")
    own = F.when(F.col("_known"), own).otherwise(F.slice(own, 1, 2))
    left = F.filter(F.regexp_extract_all("work", F.lit(LEFT), F.lit(0)), lambda w: ~v.is_noise(F.lower(w)) & ~F.lower(w).rlike(v.SUFFIX_PATTERN) & ~F.array_contains(own, F.lower(w)))
    out = out.withColumns({"_words_score": score, "unparsed": F.nullif(F.array_join(F.array_distinct(left), " "), F.lit(""))})
    out = out.select(F.col("_work").alias("work"), *WORDED, "_words_score")
    return out.select(F.inline(F.array(F.struct("*"))))  # a filter on a parsed column isn't taken apart into all claims before it


def meant_set(vocabulary: Vocabulary) -> Column:
    """The set that the claimed spelling means: by ``set_names``, else as the vocabulary writes it."""
    said = F.col("set_name")
    return F.coalesce(v.spelled(said, vocabulary.spelling("sets") | vocabulary.set_names or {"": ""}), v.collapsed(said))
