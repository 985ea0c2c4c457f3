"""Saved files, checklists and payloads of other programs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.functions import vocabulary as v

#: Ends of the names of files that are read from folders.
SUFFIXES = ("html", "htm", "mhtml", "mht", "txt", "json")


def saved_files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, suffix and text of the files that ``paths`` name: files, patterns, and folders with all below them.

    From folders only files of known ``suffixes`` come. A file that several paths name comes once; of files of the same
    content the first by path. Whole files are rows, so a single file must fit in a task. A path that names nothing adds
    nothing.
    """
    conf, folders, others = spark._jsc.hadoopConfiguration(), [], []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        for f in at.getFileSystem(conf).globStatus(at) or []:
            (folders if f.isDirectory() else others).append(f.getPath().toString())
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    read = [files.load(folders).where(known.isin(*suffixes))] if folders else []
    read += [files.load(others)] if others else []
    if not read:
        return spark.createDataFrame([], "path string, suffix string, text string")
    rows = read[0] if len(read) == 1 else read[0].unionByName(read[1])
    rows = rows.dropDuplicates(["path"])
    first = rows.groupBy(F.md5("content")).agg(F.min("path").alias("path")).select("path")
    return rows.join(first, "path", "left_semi").select("path", known.alias("suffix"), F.decode("content", "UTF-8").alias("text"))


ASPECTS = "struct<refinement:struct<aspectDistributions:array<struct<localizedAspectName:string,aspectValueDistributions:array<struct<localizedAspectValue:string,matchCount:string>>>>>>"


def aspects(payloads: DataFrame, column: str) -> DataFrame:
    """The rows of ``payloads`` with aspect, value and n for each value of each named aspect in a nested payload.

    A count that isn't a whole number is null; an aspect without values stays, with a null value; values and aspects
    without a name go. A payload that can't be read has no rows.
    """
    read = payloads.withColumn("_p", F.from_json(column, ASPECTS)["refinement"]["aspectDistributions"])
    each = read.select("*", F.explode_outer("_p").alias("_a")).where(F.col("_a.localizedAspectName") != "")
    one = each.select("*", F.explode_outer("_a.aspectValueDistributions").alias("_v")).where(F.col("_v").isNull() | (F.col("_v.localizedAspectValue") != ""))
    n = F.when(F.col("_v.matchCount").rlike(r"^\d+$"), F.col("_v.matchCount").try_cast("long"))
    return one.select(*(c for c in payloads.columns if c != column), F.col("_a.localizedAspectName").alias("aspect"), F.col("_v.localizedAspectValue").alias("value"), n.alias("n"))


# Sections that are parts of a base set, and words for no parallel.
BASE_SECTIONS = (
    "base set", "base", "rookies", "veterans", "base – rookies", "base - rookies", "base – veterans", "base - veterans",
    "legends", "base set rookies", "base set veterans", "rookie cards",
)
BASE_PARALLELS = ("", "base")


def checklist_rows(raw: DataFrame, sport: str = "football") -> DataFrame:
    """year, set_name, subset, card_number, player, parallel, print_run, is_auto and is_relic of a checklist of text columns.

    Only rows of ``sport`` (all, where it is empty) with a year, a brand, and a number or a player. Sections of a base set
    name no insert, and a base parallel is none. Sets are those that titles mean.
    """
    def said(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    number = F.regexp_replace(said("card_number"), "^#+", "")
    category, section, year = F.lower(said("category")), said("set"), said("year").try_cast("int")
    insert = (category != "base") & ~F.lower(section).isin(*BASE_SECTIONS) & (section != "")
    rows = raw if not sport else raw.where(F.lower(said("sport")) == sport)
    return rows.where((year > 0) & (said("brand") != "") & ((number != "") | (said("player") != ""))).select(
        year.alias("year"), v.canonical_set(said("brand")).alias("set_name"), F.when(insert, section).alias("subset"), F.nullif(number, F.lit("")).alias("card_number"),
        F.nullif(said("player"), F.lit("")).alias("player"), F.when(~F.lower(said("parallel")).isin(*BASE_PARALLELS), said("parallel")).alias("parallel"), said("print_run").try_cast("int").alias("print_run"),
        (category == "autograph").alias("is_auto"), (category == "memorabilia").alias("is_relic"),
    )


#: Names under which a list of products is wrapped, in the order they are looked for.
WRAPPERS = ("products", "checklists", "items", "data", "sets")


def index_entries(payloads: DataFrame, column: str, fields: str = "name:string") -> DataFrame:
    """id and ``fields`` of the products of an index: a list, a list under a known name, or products by id. A payload of
    another shape has no rows."""
    names = [f.split(":")[0] for f in fields.split(",")]
    kind = f"array<struct<id:string,{fields}>>"
    wrapped = F.from_json(column, f"struct<{','.join(f'{w}:string' for w in WRAPPERS)}>")
    lists = F.coalesce(*(F.when(F.size(F.from_json(wrapped[w], kind)) > 0, F.from_json(wrapped[w], kind)) for w in WRAPPERS))
    by_id = F.transform(F.map_entries(F.from_json(column, f"map<string,struct<{fields}>>")), lambda e: F.struct(e["key"].alias("id"), *(e["value"][n].alias(n) for n in names)))
    at = F.ltrim(column)
    found = F.when(F.startswith(at, F.lit("[")), F.from_json(column, kind)).when(lists.isNotNull(), lists).otherwise(by_id)
    return payloads.select(F.inline(F.filter(found, lambda e: e.isNotNull() & F.coalesce(*(e[n].isNotNull() for n in names))))).select("id", *names)
