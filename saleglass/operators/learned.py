"""Learned vocabularies: a versioned table of words, each version replaced as a whole, read into a ``Vocabulary``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.functions import vocabulary as v
from saleglass.operators.titles import STANDARD, Vocabulary, with_words

#: Words of one version; they become patterns, so a longer list is refused.
MOST = 20_000
KINDS = ("insert", "designation", "set")


def publish(words: DataFrame, path: str, version: int) -> None:
    """Write ``words`` (kind, name) as ``version`` of the table at ``path``; that version's earlier rows go, others stay."""
    rows = words.select("kind", F.trim("name").alias("name"), F.lit(version).alias("version")).where(F.col("kind").isin(*KINDS) & (F.col("name") != "")).distinct()
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def table_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, name string, version int").parquet(path)


def read(words: DataFrame, version: int | None = None, base: Vocabulary = STANDARD) -> Vocabulary:
    """``base`` with the words of a version (the newest, if none is named) and of no other one.

    Known words keep their meaning: an insert or designation of ``base`` is neither learned again nor moved to another
    class; a learned designation that is a known parallel, set, alias or brand is left out. Designations that name a colour
    or finish are printings. A learned set that is a known one behind a brand's name is another spelling of it.
    """
    newest = words.agg(F.max("version")).first()[0] if version is None else version
    rows = [] if newest is None else words.where(F.col("version") == newest).select("kind", "name", v.names_printing(F.col("name")).alias("prints")).distinct().orderBy("kind", "name").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a vocabulary of more than {MOST} words")
    known = {kind: base.spelling(kind) for kind in ("inserts", "designations", "parallels", "sets", "brands")}
    kept = known["inserts"].keys() | known["designations"].keys()
    reserved = kept | known["parallels"].keys() | known["sets"].keys() | known["brands"].keys() | base.set_names.keys()
    inserts = [r["name"] for r in rows if r["kind"] == "insert" and r["name"].lower() not in kept]
    said = [r for r in rows if r["kind"] == "designation" and r["name"].lower() not in reserved]
    meant: dict[str, str] = {}
    for r in rows:
        low = r["name"].lower()
        if r["kind"] == "set" and low not in known["sets"]:
            makers = [b for b in known["brands"] if low.startswith(b + " ")]
            behind = low[len(max(makers, key=len)) + 1 :].strip() if makers else low
            meant[low] = base.set_names.get(behind) or known["sets"].get(behind, r["name"])
    more = with_words(
        base, inserts=tuple(inserts), designations=tuple(r["name"] for r in said if not r["prints"]), printings=tuple(r["name"] for r in said if r["prints"]), sets=tuple(meant)
    )
    return Vocabulary(**{**more.__dict__, "set_names": {**meant, **base.set_names}})
