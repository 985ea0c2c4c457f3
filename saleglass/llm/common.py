"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves a
    local master; elsewhere executors would write to disks of their own, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.saleglass.shared", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="saleglass-")
            spark.conf.set("spark.saleglass.shared", base)
    own = f"{base.rstrip('/')}/saleglass-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return own


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that tasks don't need it installed."""
    if spark.conf.get("spark.saleglass.shipped", None) == spark.sparkContext.applicationId:
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="saleglass-")) / "saleglass.zip"
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))
    spark.conf.set("spark.saleglass.shipped", spark.sparkContext.applicationId)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: list, limit: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into ranges of about ``limit`` characters, so that word lists stay small."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))
