"""Importance resampling towards a target distribution, over hashed runs of words.

A feature is a run of 1 to ``n`` words; its bucket is the CRC-32 of its UTF-8 bytes modulo the number of buckets. The
share of each bucket in the target against that in the corpus is its gain; a document's weight is the sum over its
features, and documents are drawn by weight plus Gumbel noise from a hash of their id.

Hashing every occurrence anew is the cost, so a bounded head of frequent words travels to all tasks with their CRC
states (a run goes on from the state of its first word), and one of frequent pairs with their buckets. Words and pairs
of the tail take their CRC directly. Which features are in the head changes no result: both ways lead to the same
bucket, and bucket totals are exact counts over all texts. Head, totals and gains are of fixed size on the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm.common import documents, keep

#: Entries of each head, and bytes of the longest word in one.
HEAD, HEAD_BYTES = 20_000, 64
#: Features a task counts at a time while it looks for the frequent ones.
COUNTED = 200_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and all beyond ASCII; A-Z become small."""
    return text.translate(_LETTERS).split()


class States(dict):
    """CRC state by word; those of the tail are computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class PairBuckets(dict):
    """Bucket by pair of words; those of the tail go on from the state of the first word."""

    def __init__(self, known: dict, states: States, buckets: int):
        super().__init__(known)
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets


class Hashing:
    """Buckets of a text's features, with the heads of frequent words and pairs."""

    def __init__(self, n: int, buckets: int, words: list[bytes] = (), pairs: list[tuple[bytes, bytes]] = ()):
        self.n, self.buckets = n, buckets
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = PairBuckets({}, self.states, buckets)
        self.pairs.update({p: self.pairs[p] for p in pairs})

    def of(self, words: list[bytes]) -> np.ndarray:
        out = [np.fromiter(map(self.states.__getitem__, words), np.int64, len(words)) % self.buckets]
        if self.n > 1 and len(words) > 1:
            out.append(np.fromiter(map(self.pairs.__getitem__, pairwise(words)), np.int64, len(words) - 1))
        for length in range(3, min(self.n, len(words)) + 1):
            runs = (zlib.crc32(b" ".join(words[i : i + length])) % self.buckets for i in range(len(words) - length + 1))
            out.append(np.fromiter(runs, np.int64, len(words) - length + 1))
        return np.concatenate(out)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.binary()):
        yield t.as_py() or b""


def _frequent(n: int):
    def thinned(counts: Counter) -> Counter:
        return Counter(dict(counts.most_common(HEAD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(min(n, 2))]
        for b in batches:
            for text in _texts(b.column(0)):
                words = words_of(text)
                for counts, features in zip(found, (words, pairwise(words)), strict=False):
                    counts.update(features)
            found = [thinned(c) if len(c) > COUNTED else c for c in found]
        for length, counts in enumerate(found, 1):
            top = [(w if length == 1 else b" ".join(w), c) for w, c in counts.most_common(HEAD)]
            top = [(w, c) for w, c in top if len(w) <= HEAD_BYTES * length]
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * len(top), pa.int32()), pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["length", "feature", "n"]
            )

    return run


def frequent(texts: DataFrame, n: int) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """At most ``HEAD`` frequent words and, for ``n`` over 1, pairs of a table of one text column."""
    counted = texts.mapInArrow(_frequent(n), "length int, feature binary, n long").groupBy("length", "feature").agg(F.sum("n").alias("n"))
    heads = [[bytes(r["feature"]) for r in counted.where(F.col("length") == k).orderBy(F.desc("n"), "feature").limit(HEAD).collect()] for k in range(1, min(n, 2) + 1)]
    return heads[0], [tuple(p.split(b" ")) for p in heads[1]] if n > 1 else []


def _totals(hashing: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hashing.buckets, np.int64)
        for b in batches:
            for text in _texts(b.column(0)):
                total += np.bincount(hashing.of(words), minlength=hashing.buckets) if (words := words_of(text)) else 0
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, hashing: Hashing) -> np.ndarray:
    """How many features of a table of one text column fall in each bucket."""
    rows = texts.mapInArrow(_totals(hashing), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(hashing.buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of each bucket's share in the target against its share in the corpus), both smoothed by one."""
    s_all, t_all, size = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = [(t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: str, key: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(hashing: Hashing, gain: np.ndarray, seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight, score = [], [], [], []
            for key, text in zip(b.column("key").to_pylist(), _texts(b.column("text")), strict=True):
                words = words_of(text)
                features = hashing.of(words)
                n_words.append(len(words))
                n_features.append(len(features))
                weight.append(int(gain[features].sum()))
                score.append(weight[-1] + noise(seed, key or ""))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, score))], ["id", "n_words", "n_features", "weight", "score"])

    return run


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Places 1, 2, ... of the highest scores, up to ``percent`` of all rows, ties to smaller ids.

    Equal rows are counted first, so that copies meet nowhere; the rows are dealt by ranges of (score, id), and a
    range's places begin behind the counts of those before it.
    """
    columns = ["id", "n_words", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features", "n_words"]
    counted = scored.groupBy(*columns).agg(F.count("*").alias("copies"))
    dealt = keep(counted.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "drawn-ranges")
    sums = dealt.groupBy("range").agg(F.sum("copies").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    drawn = (sums.agg(F.sum("n")).first()[0] or 0) * percent // 100
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("offset") + F.sum("copies").over(within)
    placed = dealt.join(F.broadcast(offsets), "range").withColumn("first", last - F.col("copies"))
    each = placed.select(*columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("rank"))
    return each.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with its id, n_words, n_features, weight, score and rank (null where it isn't drawn).

    Of the rows with at least ``least_words`` words the ``percent`` in a hundred with the highest scores are drawn, rounded
    down; ties go to smaller ids, rows without an id last. A null or empty text, in either table, has no features and weight
    0. Repeated rows count each on its own and take one place each. An empty target leaves every bucket its smoothed share,
    an empty ``docs`` gives no rows. Texts of any length are read whole; other columns are ignored.
    """
    texts, goal = docs.select(F.col(text_col).alias("text")), target.select(F.col(target_col).alias("text"))
    hashing = Hashing(n, buckets, *frequent(texts, n))
    gain = gains(bucket_totals(texts, hashing), bucket_totals(goal, hashing))
    thin = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    shape = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    scored = keep(thin.mapInArrow(_scored(hashing, gain, seed), shape), "importance")
    enough = F.col("n_words") >= least_words
    out = _ranked(scored.where(enough), percent).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resample`` of all ``documents`` towards ``benchmark`` by single words, 10 in 100; its docstring defines all cases."""
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, n=1)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _sql_words(table: str, key: str) -> str:
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""SELECT {key} AS id, unnest(regexp_extract_all(translate(text, '{capitals}', '{small}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {table}"""


OP12_SQL = f"""
WITH RECURSIVE step AS (
  SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
d AS MATERIALIZED (SELECT id, word, count(*) AS n FROM ({_sql_words('documents', 'doc_id')}) GROUP BY ALL),
b AS MATERIALIZED (SELECT word, count(*) AS n FROM ({_sql_words('benchmark', 'item_id')}) GROUP BY ALL),
w AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b)),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM w, crc
), s AS (SELECT bucket, sum(n) AS n FROM d JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM d) + 10000)::DOUBLE
    / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM b) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)
), weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM d JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON doc_id = id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
