"""Exact top-k search by inner product with bounds from segment statistics, coarse to fine.

A vector cut into segments of L components is described by each segment's mean m and deviation s. For two vectors the
squared distance is at least the sum of L * ((m - m')^2 + (s - s')^2); finer segments give sharper bounds. With the
lengths of both vectors a bound on the distance is one on the inner product, and since a vector's squared length is the
sum of its L * (m^2 + s^2), that bound is the inner product of the descriptions (sqrt(L) * m, sqrt(L) * s). Candidates
whose bound stays below a query's score number k so far are out; the others go to the next resolution, and those left
after the last one get their exact score in whole numbers.

Queries and rows are packed into blocks of bounded size. Each block of rows meets each block of queries by an equi-join
on (chunk, query block), so every task holds one pair of blocks. Nothing but counts passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm.common import keep
from saleglass.llm.vectors import finite, matrix, whole

#: Scaled components are held between these bounds, so that scores of up to 2,048 components are exact in 64 bits.
LIMIT = 2**26
#: Rows and queries described and scored at a time.
STEP, ASKED = 2048, 1024
NO_ID, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def resolutions(width: int) -> list[int]:
    """Numbers of segments, coarse to fine, the last of two components each."""
    out = [1]
    while out[-1] * 4 <= width:
        out.append(out[-1] * 2)
    return out


def described(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length."""
    parts = v.reshape(len(v), segments, v.shape[1] // segments).astype(np.float64)
    return (np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(parts.shape[2])).astype(np.float32)


def padded(v: np.ndarray, width: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, width - v.shape[1])))


def exact_type(q: np.ndarray, x: np.ndarray) -> type:
    """The smallest type in which all sums of products are exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def best(score: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def search(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``k`` best rows (all, if fewer): places of queries, ids and scores, best first."""
    if len(queries) > ASKED:
        parts = [(at, search(queries[at : at + ASKED], rows, ids, k)) for at in range(0, len(queries), ASKED)]
        return np.concatenate([q + at for at, (q, _, _) in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])
    width = 1 << (max(queries.shape[1], rows.shape[1], 2) - 1).bit_length()
    queries, rows = padded(queries, width), padded(rows, width)
    levels, kind = resolutions(width), exact_type(queries, rows)
    seen, exact = [described(queries, s) for s in levels], queries.astype(kind)
    lengths = [np.sqrt((v.astype(np.float64) ** 2).sum(1)) for v in (queries, rows)]
    slack = 1e-4 * lengths[0] * lengths[1].max(initial=0) + 1e-3  # bounds come in single precision
    least = np.full(len(queries), LOWEST)  # each query's score number k so far
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(rows), STEP):
        x, names = rows[at : at + STEP], ids[at : at + STEP]
        alive = np.ones((len(queries), len(x)), bool)
        if (least > LOWEST).any():
            cut = (least - slack).astype(np.float32)[:, None]
            for s, description in zip(levels, seen, strict=True):
                alive &= description @ described(x, s).T >= cut
                some = alive.any(0)
                if not some.all():
                    x, names, alive = x[some], names[some], alive[:, some]
        if not len(x):
            continue
        score = exact @ x.astype(kind).T
        alive &= score >= least[:, None].astype(kind)
        if len(x) > k and (least == LOWEST).any():  # rows of this block alone set a first bar
            alive &= score >= np.partition(score, len(x) - k, 1)[:, len(x) - k][:, None]
        q, i = np.nonzero(alive)
        pool = tuple(np.r_[a, b] for a, b in zip(held, (q, names[i], score[q, i].astype(np.int64)), strict=True))
        top = best(pool[2], pool[1], pool[0], k)
        held = tuple(p[top] for p in pool)
        ends = np.searchsorted(held[0], np.arange(len(queries)), "right")
        full = np.bincount(held[0], minlength=len(queries)) >= k
        least[full] = held[2][ends[full] - 1]
    return held


_BLOCK = "block long, n long, n_queries long, width int, ids binary, numbers binary"


def _packed(size: int, every: int):
    """Blocks of at most ``size`` rows of a partition, numbered by partition and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, vectors, held = [], [], 0

        def block() -> pa.RecordBatch:
            width = max(v.shape[1] for v in vectors)
            names, numbers = np.concatenate(ids), np.concatenate([padded(v, width) for v in vectors])
            small = numbers.astype(np.int8 if np.abs(numbers).max(initial=0) < 128 else np.int32)
            asked = int(((names != NO_ID) & (names % every == 0)).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([len(names)]), pa.array([asked]), pa.array([width], pa.int32()), pa.array([names.tobytes()]), pa.array([small.tobytes()])],
                ["block", "n", "n_queries", "width", "ids", "numbers"],
            )

        for b in batches:
            all_ids, all_v = np.asarray(b.column(0).fill_null(NO_ID)), matrix(b.column(1))
            at = 0
            while at < len(all_ids):
                take = min(size - held, len(all_ids) - at)
                ids.append(all_ids[at : at + take])
                vectors.append(all_v[at : at + take])
                held, at = held + take, at + take
                if held == size:
                    yield block()
                    made, held = made + 1, 0
                    ids.clear()
                    vectors.clear()
        if held:
            yield block()

    return run


def _unpacked(n: int, width: int, ids: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int8 if len(numbers) == n * width else np.int32
    return np.frombuffer(ids, np.int64), np.frombuffer(numbers, kind).reshape(n, width).astype(np.int64)


def _scored(k: int):
    names = ["block", "place", "query_id", "own", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                ids, rows = _unpacked(row["n"], row["width"], row["ids"], row["numbers"])
                asked, queries = _unpacked(row["q_n"], row["q_width"], row["q_ids"], row["q_numbers"])
                own = (queries * queries).sum(1)
                q, found, score = search(queries, rows, ids, k)
                for at in range(0, len(q), 100_000):
                    p = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(q[p]), row["block"])), pa.array(q[p]), pa.array(asked[q[p]]), pa.array(own[q[p]]), pa.array(found[p], mask=found[p] == NO_ID), pa.array(score[p])], names
                    )

    return run


def top_matches(
    vectors: DataFrame, k: int, factor: int, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int = 8192, queries_a_block: int = 8192
) -> DataFrame:
    """The ``k`` rows of highest inner product for every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components count as floor(``factor`` * x), held between -2^26 and 2^26; shorter vectors are filled up with zeros.
    Vectors that are null or hold null or infinite components or NaN take no part; an empty vector scores 0. Rows without
    an id are candidates, behind all others of their score, and no queries. A query's own row is no candidate of it, one
    row of several that are equal in id and vector; the others stay candidates, and each of them asks on its own.
    An empty table gives no rows. Other columns are ignored.
    """
    usable = finite(vectors, vector_col).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), factor, LIMIT).alias("v"))
    rows = keep(usable.mapInArrow(_packed(rows_a_block, every), _BLOCK), "search-rows")
    total = rows.agg(F.sum("n").alias("n"), F.sum("n_queries").alias("q")).first()
    chunks, blocks = -(-(total["n"] or 0) // rows_a_block) or 1, -(-(total["q"] or 0) // queries_a_block) or 1
    asked = usable.where(F.col("id") % every == 0).repartition(blocks)
    queries = keep(asked.mapInArrow(_packed(queries_a_block, every), _BLOCK), "search-queries")
    tasks = min(chunks * blocks, 10_000)
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    left = rows.select(chunk.alias("chunk"), "n", "width", "ids", "numbers").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select(
        "block", F.pmod(F.shiftright("block", 32), F.lit(blocks)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        *(F.col(c).alias(f"q_{c}") for c in ("n", "width", "ids", "numbers")),
    )
    keys = ["chunk", "group"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys).hint("merge"), keys)
    found = met.mapInArrow(_scored(k + 1), "block long, place long, query_id long, own long, vec_id long, score long")
    order = Window.partitionBy("block", "place", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    self_ = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    before = F.sum(F.coalesce(self_.cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranked.withColumn("own_rows", before).where(~(F.coalesce(self_, F.lit(False)) & (F.col("own_rows") == 1)))
    rank = F.col("at") - F.least("own_rows", F.lit(1))
    return placed.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def op13_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_matches`` of all ``embeddings``: 20 rows a query, components times 64; its docstring defines all cases."""
    return top_matches(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, 64)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
