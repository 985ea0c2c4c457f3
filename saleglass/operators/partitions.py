"""Keyed rows in partitioned Parquet tables, of which only the partitions that a change touches are written anew."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saleglass.sources.files import new_path

#: How tables are compressed that are read a few times at most: some 0.6 of what Spark's usual way takes.
COMPRESSION = "zstd"
#: Marks that are sent to all tasks: a bit a row of some 800 million rows.
MARKS_BYTES = 100_000_000
#: Whether Spark deletes the shuffle files of a query at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within go as soon as it is done, not when the driver's memory is next collected."""
    before = spark.conf.get(SWEEP, "false")
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back, so that it is computed once and may replace what it was read from."""
    path = new_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, without rows where there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def found(path: str, schema: StructType, keys: DataFrame, part: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Where the rows of the table's ``keys`` stand: their keys, ``part``, the columns ``also``, file and place in it. Whole rows aren't moved."""
    spark, names = keys.sparkSession, keys.columns
    held = spark.read.schema(schema).parquet(path).select(*dict.fromkeys([*names, part, *also]), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return settled(held.join(keys, names, "left_semi"), "found")


def without(held: DataFrame, spots: DataFrame, most: int = MARKS_BYTES) -> DataFrame:
    """Rows of a table as read but those of ``spots`` (``found``): a bit for each row of a file up to the last one found tells which. Marks of up
    to ``most`` bytes are sent to all tasks."""
    at, name = F.col("_at") + 1, F.col("_file")
    place = F.bitmap_bit_position(at)
    spots = spots.select(name.alias("_marked"), F.bitmap_bucket_number(at).alias("_block"), place.alias("_place")).repartition("_marked", "_block")
    bits = F.substring(F.bitmap_construct_agg("_place"), F.lit(1), (F.floor(F.max("_place") / 8) + 1).cast("int"))
    marks = settled(spots.groupBy("_marked", "_block").agg(bits.alias("_bits")), "marks")
    size = marks.agg(F.sum(F.octet_length("_bits") + F.octet_length("_marked"))).first()[0] or 0
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = held.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    rows = rows.join(F.broadcast(marks) if size <= most else marks, (name == F.col("_marked")) & (F.bitmap_bucket_number(at) == F.col("_block")), "left")
    return rows.where(F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 0, F.lit(True))).select(*held.columns)


def upsert(path: str, rows: DataFrame, keys: list[str], part: str, gone: DataFrame | None = None, moves: bool = False, staged: bool = False, spots: DataFrame | None = None) -> int:
    """Put ``rows`` into the table at ``path`` in place of those of equal ``keys``, and take out those of ``gone`` (keys).
    Gives the number of rows put in.

    ``part`` names the column of the partitions. Only partitions of ``rows`` and ``gone`` (which has ``part`` too) are read
    and replaced; with ``moves`` a key may stand in another partition than before, and the table's keys are read to find it
    (``spots``, if the caller has found them already). ``staged`` rows stand in a table that isn't this one, so they aren't written
    to another. Partitions with no row left go. The number of partitions must be bounded: their names pass the driver.
    """
    spark = rows.sparkSession
    with swept(spark):
        if not exists(spark, path):
            rows.write.option("compression", COMPRESSION).partitionBy(part).parquet(path)
            return spark.read.schema(rows.schema).parquet(path).count()
        rows = rows if staged else settled(rows, "upsert")
        put = rows.count()
        out = rows.select(*keys, part) if gone is None else rows.select(*keys, part).unionByName(gone.select(*keys, part))
        held = spark.read.schema(rows.schema).parquet(path)
        mine = {r[0] for r in rows.select(part).distinct().collect()}
        touched = mine if gone is None else mine | {r[0] for r in gone.select(part).distinct().collect()}
        if moves and spots is None:
            spots = found(path, rows.schema, out.select(*keys), part)
        if spots is not None:
            touched = touched | {r[0] for r in spots.select(part).distinct().collect()}
        if not touched:
            return put
        kept = held.where(F.col(part).isin(list(touched)))
        kept = kept.join(out.select(*keys).distinct(), keys, "left_anti") if spots is None else without(kept, spots)
        emptied = touched - mine
        if emptied:
            emptied -= {r[0] for r in kept.where(F.col(part).isin(list(emptied))).select(part).distinct().collect()}
        # partitions are staged and exchanged once all tasks are done, so they may be read meanwhile
        kept.unionByName(rows).write.mode("overwrite").option("compression", COMPRESSION).option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        for value in emptied:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={value}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return put
