"""Texts read off photos: detections to visual rows, and the rows of a label to attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleglass.functions.text import deconfused, folded_person
from saleglass.functions.vocabulary import GRADE_WORDS
from saleglass.operators.roster import LEAST, with_known
from saleglass.operators.titles import GRADERS, titled, windows

#: Part of a photo's height that the label takes, and the least confidence of a detection.
BAND, SURE = 0.22, 0.5


def group_rows(lines, item="item_id", gap=0.02):
    """Text detections (text, top, confidence) on one visual row, within ``gap`` of the row's first. One item's
    detections are few; the fold keeps the row's anchor, which a gap between neighbours wouldn't."""
    kind = "array<struct<top:double,text:string,confidence:double>>"
    held = lines.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("top", "text", "confidence"))).cast(kind).alias("d"))

    def step(acc, d):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["top"].alias("top"), F.concat_ws(" ", last["text"], d["text"]).alias("text"), F.least(last["confidence"], d["confidence"]).alias("confidence"))
        return F.when((F.size(acc) > 0) & (d["top"] - last["top"] <= gap + 1e-9), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(d))).cast(kind)

    return held.select(item, F.explode(F.aggregate("d", F.array().cast(kind), step)).alias("r")).select(item, "r.top", "r.text", "r.confidence")


def _first_held(folded: Column, said: list[tuple[str, str]]) -> Column:
    """Of (text, value) pairs the value of the longest text that ``folded`` holds, letters and digits alike read as one."""
    ordered = sorted(said, key=lambda p: -len(p[0]))
    return F.coalesce(*(F.when(F.contains(folded, deconfused(F.lit(text))), F.lit(value)) for text, value in ordered))


def label_attrs(detections: DataFrame, item: str, sets, roster: DataFrame) -> DataFrame:
    """``item``, year, set_name, player, card_number, grader, grade and confidence of the label of each photo.

    ``detections``: item, text, top, confidence; uncertain ones and those below the label count for nothing. Grades in
    words speak of the first grader unless another one is named. Each of the first four fields adds 0.2, a grader 0.15, up
    to 0.95. An item without a label row has no row.
    """
    rows = group_rows(detections.where(F.col("confidence") >= SURE), item).where(F.col("top") <= BAND)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda s: s["text"]), " ")
    out = rows.groupBy(item).agg(said.alias("_text")).withColumn("_folded", deconfused("_text"))
    words = F.filter(F.transform(F.split("_text", r"\s+"), deconfused), lambda w: w != "")
    out = out.withColumn("_words", words)
    near = F.filter(F.concat(*(windows(F.col("_words"), n, "") for n in (4, 3, 2))), lambda w: F.length(w) >= LEAST)
    longest = F.array_sort(F.transform(near, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    out = out.withColumns({"_windows": F.transform(longest, lambda s: s["w"]), "_none": F.array().cast("array<string>")})
    keyed = roster.select(deconfused(folded_person("name")).alias("name"), F.lower("name").alias("_said")).groupBy("name").agg(F.min("_said").alias("_said"))
    out = with_known(out, keyed.select("name"), "_windows", "_none", "_key", "_also").join(keyed.withColumnRenamed("name", "_key"), "_key", "left")
    grader = F.coalesce(*(F.when(F.contains(F.upper("_text"), F.lit(g)), F.lit("BGS" if g == "BECKETT" else g)) for g in GRADERS))
    worded = _first_held(F.col("_folded"), list(GRADE_WORDS.items()))
    number = F.nullif(F.regexp_extract("_text", r"\b(10|[1-9](?:\.5)?)\b", 1), F.lit("")).cast("double")
    out = out.withColumns({
        "year": F.nullif(F.regexp_extract("_text", r"(?<!\d)(19[5-9]\d|20[0-4]\d)(?!\d)", 1), F.lit("")).cast("int"), "set_name": _first_held(F.col("_folded"), [(s, s) for s in sets]), "player": titled(F.col("_said")),
        "card_number": F.upper(F.nullif(F.regexp_extract("_text", r"(?i)#\s?([A-Z]{0,4}-?\d{1,4}(?:[A-Z](?![A-Za-z0-9]))?)", 1), F.lit(""))),
        "grader": F.when(worded.isNotNull(), F.coalesce(grader, F.lit("PSA"))).otherwise(grader), "grade": F.coalesce(worded, F.when(grader.isNotNull(), number)),
    })
    found = sum((F.col(c).isNotNull().cast("int") for c in ("year", "set_name", "player", "card_number")), F.lit(0))
    sure = F.least(F.lit(0.95), F.round(0.2 * found + 0.15 * F.col("grader").isNotNull().cast("int"), 2))
    return out.select(item, "year", "set_name", "player", "card_number", "grader", "grade", sure.alias("confidence"))
