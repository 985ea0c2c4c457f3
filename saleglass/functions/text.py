"""Text functions as column expressions: names, numbers, money, dates, URLs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Latin letters with marks, by rule: those whose canonical form begins with an ASCII letter.
_MARKED = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFKD", chr(i))[0] < "\x80"]


def ascii_fold(c: str | Column) -> Column:
    """Marks go, other characters beyond ASCII too."""
    x = _col(c)
    folded = F.regexp_replace(F.translate(x, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(folded)  # most texts hold nothing else


def folded_words(c: str | Column) -> Column:
    """Words of a name without marks and suffixes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "), r"\b(jr|sr|ii|iii|iv|v)\b", " ")


def folded_person(c: str | Column) -> Column:
    """One token for all spellings of a name."""
    return F.replace(folded_words(c), F.lit(" "), F.lit(""))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def folded_number(c: str | Column) -> Column:
    x = F.regexp_replace(F.upper(_col(c)), "[^A-Z0-9]", "")
    return F.when(x != "", x)


def one_typo(a: Column, b: Column) -> Column:
    """Equal, or of eight letters or more and one substitution, deletion or swap of neighbours apart."""
    a, b = F.replace(a, F.lit("cks"), F.lit("xs")), F.replace(b, F.lit("cks"), F.lit("xs"))
    far = F.abs(F.length(a) - F.length(b)) > 1
    short = (F.length(a) < 8) | (F.length(b) < 8)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))
    i, j = F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(2))
    swap = (F.length(a) == F.length(b)) & (F.size(at) == 2) & (j == i + 1) & (a.substr(i, F.lit(1)) == b.substr(j, F.lit(1))) & (a.substr(j, F.lit(1)) == b.substr(i, F.lit(1)))
    return (a == b) | (~far & ~short & ((F.levenshtein(a, b) == 1) | F.coalesce(swap, F.lit(False))))


def same_person(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a) | one_typo(a, b)


def money_cents(c: str | Column) -> Column:
    """First amount of money in a text, in cents."""
    return F.round(F.replace(F.regexp_extract(_col(c), r"(?:\$|€|£|USD|EUR|GBP|CAD|C \$)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)") * 100).cast("long")


CURRENCIES = (("C $", "CAD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"))


def currency(c: str | Column) -> Column:
    sign = F.regexp_extract(_col(c), r"(C \$|\$|€|£|USD|EUR|GBP|CAD)\s*[0-9]", 1)
    out = F.when(sign.isin("USD", "EUR", "GBP", "CAD"), sign)
    for s, code in CURRENCIES:
        out = out.when(sign == s, code)
    return out


def sold_date(c: str | Column) -> Column:
    """The day in "Sold Jul 30, 2025" or "Sold 30 Jul 2025"."""
    us = r"(?i)sold\s+([A-Za-z]{3})[a-z]*\s+(\d{1,2}),\s*(\d{4})"
    eu = r"(?i)sold\s+(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    x = _col(c)

    def day(pattern, m, d):
        return F.try_to_timestamp(F.concat_ws(" ", F.initcap(F.regexp_extract(x, pattern, m)), F.regexp_extract(x, pattern, d), F.regexp_extract(x, pattern, 3)), F.lit("MMM d yyyy")).cast("date")

    return F.coalesce(day(us, 1, 2), day(eu, 2, 1))


def shipping_cents(c: str | Column) -> Column:
    x = _col(c)
    return F.when(x.rlike(r"(?i)free\s+(shipping|delivery|postage)"), F.lit(0).cast("long")).when(x.rlike(r"(?i)\+\s*\S*\s?[0-9.,]+\s*(shipping|delivery|postage)"), money_cents(F.regexp_extract(x, r"\+\s*([^+]*)$", 1)))


def bids(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), r"(?i)(\d+)\s+bids?\b", 1).try_cast("int")


# Words for a listing's condition, in the order they are looked for, and as they are shown.
HINTS = (
    ("brand new", "Brand New"), ("pre-owned", "Pre-Owned"), ("new (other)", "New (Other)"), ("open box", "Open Box"),
    ("used", "Used"), ("ungraded", "Ungraded"), ("graded", "Graded"), ("like new", "Like New"),
)


def condition(c: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for hint, shown in reversed(HINTS):
        out = F.when(F.contains(F.lower(_col(c)), F.lit(hint)), shown).otherwise(out)
    return out


def seller(c: str | Column) -> Column:
    name = F.trim(F.regexp_extract(_col(c), r"^([^(]+)\(", 1))
    return F.when(name != "", name).otherwise(F.left(F.trim(_col(c)), F.lit(64)))


def result_count(c: str | Column) -> tuple[Column, Column]:
    n = F.regexp_replace(F.regexp_extract(_col(c), r"([0-9][0-9,]*)\+?\s+results", 1), ",", "").try_cast("long")
    return n, _col(c).rlike(r"[0-9]\+\s+results")


SIZES = (64, 96, 140, 225, 300, 400, 500, 640, 800, 960, 1200, 1600)


def image_url(c: str | Column, size: int = 500, host: str = "img.example") -> Column:
    """Placeholder to null, no query or fragment, https; on the known host no thumbs folder and the nearest size."""
    snapped = min(SIZES, key=lambda s: (abs(s - size), s))
    x = F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"[?#].*$", ""), "^//", "https://")
    own = F.regexp_replace(F.regexp_replace(x, "/thumbs/", "/"), r"/s-l\d+(\.\w+)$", f"/s-l{snapped}$1")
    return F.when(_col(c).isNull() | _col(c).rlike(r"(?i)^data:|s_1x2\.gif|/blank\.gif|spacer|^\s*$"), None).when(F.contains(x, F.lit(f"//{host}/")), own).otherwise(x)


def srcset_best(c: str | Column) -> Column:
    """Candidate with the highest descriptor, the first of equals."""
    parts = F.transform(F.split(_col(c), r",\s+"), lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\s([0-9.]+)[wx]\s*$", 1).try_cast("double"), F.lit(1.0)).alias("score"), (-i).alias("pos"), F.regexp_extract(F.trim(p), r"^(\S+)", 1).alias("url")))
    return F.array_max(F.filter(parts, lambda s: s["url"] != ""))["url"]


def deconfused(c: str | Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", ""), "01l5826", "oiisbzg")


def number_tail(number: str | Column, tail: str | Column) -> Column:
    """A number with its "-N" tail: kept if it has letters; an ascending range from 25 or less is no number; else kept."""
    n, t = _col(number), _col(tail)
    ascending = (n.try_cast("int") <= 25) & (t.try_cast("int") > n.try_cast("int"))
    return F.when(t.isNull(), n).when(n.rlike("[A-Za-z]"), F.concat(n, F.lit("-"), t)).when(ascending, None).otherwise(F.concat(n, F.lit("-"), t))


def key_ends(default_sport: str = "football", least: float = 0.4) -> Column:
    """What stands before and behind the number in a product's identity, and what stands there without one; null if too little is known."""
    c = F.col
    who = F.when(c("player").isNotNull() & (c("player") != ""), F.concat(folded_person("player"), F.when(c("print_run").isNotNull(), F.concat(F.lit("-r"), c("print_run"))).otherwise(F.lit(""))))
    before = F.concat_ws("-", F.when(c("sport") != default_sport, slug("sport")), c("year").cast("string"), slug("set_name"), F.when(c("subset") != "", slug("subset")))
    ends = (F.when(c("parallel") != "", F.concat(F.lit("-"), slug("parallel"))), F.when(c("is_auto") == 1, "-auto"), F.when(c("is_relic") == 1, "-patch"))
    known = (F.coalesce("confidence", F.lit(0.0)) >= least) & c("year").isNotNull() & (c("set_name") != "")
    return F.when(known, F.struct(before.alias("before"), who.alias("who"), F.concat_ws("", *ends).alias("after")))


def keyed(ends: str | Column, number: str | Column) -> Column:
    """Identity of a product from ``key_ends`` and its number."""
    ends, number = _col(ends), _col(number)
    core = F.coalesce(F.when(number.isNotNull() & (number != ""), F.concat(F.lit("n"), slug(number))), ends["who"])
    return F.concat(ends["before"], F.lit("-"), core, ends["after"])


def card_key(default_sport: str = "football", least: float = 0.4) -> Column:
    """Identity of a product from its columns, null if too little is known; see the survey's rules."""
    return keyed(key_ends(default_sport, least), "card_number")


def card_name() -> Column:
    c = F.col
    lead = F.array_compact(F.array(c("year").cast("string"), c("set_name"), c("subset"), c("variety"), c("player"), F.concat(F.lit("#"), c("card_number"))))
    plain = F.when(c("subset").isNull() & c("variety").isNull() & c("unparsed").isNull(), "Base")
    tail = F.array_compact(F.array(F.coalesce("parallel", plain), F.concat(F.lit("/"), c("print_run")), F.when(c("is_auto") == 1, "Auto"), F.when(c("is_relic") == 1, "Patch")))
    return F.when(F.size(lead) >= 2, F.array_join(F.concat(lead, tail), " "))
