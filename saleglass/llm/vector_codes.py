"""Vector codes: codebooks for parts of vectors by Lloyd rounds over cover trees.

Every task builds cover trees over the distinct parts of its rows, once, and writes them to the shared folder. A node
holds a centre, the radius of its points, their number and their sum; its children's centres lie more than half that
radius apart and cover its points within it. In a round an entry is out for a whole subtree when it is farther from the
centre than the nearest entry by more than two radii (triangle inequality). A node with one entry left adds its sum as
one; only ambiguous nodes descend, and single points compare exactly, in whole numbers. Sums of a round are added up by
part and entry, so the driver sees codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import keep
from saleglass.llm.vectors import finite, matrix, whole

#: Components are held between these bounds, so that squared distances of up to 64 components are exact in 64 bits.
LIMIT = 2**27
#: Rows of a tree, and points of a node that becomes single points at once.
TREE_ROWS, BUCKET = 8192, 16


@dataclass
class CoverTree:
    """Nodes level by level; the children of a node stand together. Leaves are single points, in ``point`` by place."""

    points: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    first: np.ndarray
    children: np.ndarray
    point: np.ndarray


def cover_tree(points: np.ndarray, counts: np.ndarray) -> CoverTree:
    """The tree over different ``points`` that occur ``counts`` times."""
    level, nodes, radius, children = [np.arange(len(points))], [], [], []
    while level:
        below = []
        for held in level:
            nodes.append(held)
            parts, reach = [], 0.0
            if len(held) > 1:
                square = ((points[held] - points[held[0]]) ** 2).sum(1)
                reach = float(square.max()) ** 0.5
                if len(held) <= BUCKET:
                    parts = list(held[:, None])
                else:
                    near = square <= reach * reach / 4
                    while len(held):
                        parts.append(held[near])
                        held = held[~near]
                        if len(held):
                            near = ((points[held] - points[held[0]]) ** 2).sum(1) <= reach * reach / 4
            radius.append(reach)
            children.append(len(parts))
            below += parts
        level = below
    centre, below = np.array([n[0] for n in nodes]), np.array(children)
    number, sums = counts[centre], points[centre] * counts[centre][:, None]
    for i in np.flatnonzero(below):
        number[i], sums[i] = counts[nodes[i]].sum(), counts[nodes[i]] @ points[nodes[i]]
    return CoverTree(points[centre], np.array(radius), number, sums, 1 + np.cumsum(below) - below, below, np.where(below > 0, -1, centre))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - entries[None]) ** 2).sum(2)


def descend(tree: CoverTree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes that are settled, and the entry nearest to all their points, ties to the lower index."""
    at, possible = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(at):
        square = np.where(possible, squares(tree.points[at], entries), np.iinfo(np.int64).max)
        best = square.argmin(1)
        apart = np.sqrt(square.astype(np.float64))
        reach = apart.min(1) + 2 * tree.radius[at]
        possible &= apart <= (reach * (1 + 1e-9) + 1e-6)[:, None]
        settled = (possible.sum(1) == 1) | (tree.children[at] == 0)
        yield at[settled], best[settled]
        at, possible = at[~settled], possible[~settled]
        n = tree.children[at]
        at, possible = _spread(tree.first[at], n), np.repeat(possible, n, 0)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... up to ``n`` of each."""
    starts = np.cumsum(n) - n
    return np.repeat(first - starts, n) + np.arange(n.sum())


def nearest(tree: CoverTree, entries: np.ndarray) -> np.ndarray:
    """The entry of every point of the tree."""
    out = np.zeros(int((tree.point >= 0).sum()), np.int64)
    for at, best in descend(tree, entries):
        while len(at):
            leaf = tree.point[at] >= 0
            out[tree.point[at[leaf]]] = best[leaf]
            at, best = at[~leaf], best[~leaf]
            n = tree.children[at]
            at, best = _spread(tree.first[at], n), np.repeat(best, n)
    return out


_TREE = "part int, width int, wide boolean, points binary, counts binary, inner binary, radius binary, sums binary, children binary"


def _stored(part: int, tree: CoverTree) -> dict:
    """Sums of single points are left out, and numbers that fit in 16 bits take no more."""
    wide, inner = bool(np.abs(tree.points).max(initial=0) >= 2**15), np.flatnonzero(tree.children)
    return {
        "part": part, "width": tree.points.shape[1], "wide": wide, "points": tree.points.astype(np.int32 if wide else np.int16).tobytes(), "counts": tree.counts.astype(np.int32).tobytes(),
        "inner": inner.astype(np.int32).tobytes(), "radius": tree.radius[inner].tobytes(), "sums": tree.sums[inner].tobytes(), "children": tree.children[inner].astype(np.int32).tobytes(),
    }


def _loaded(row: dict) -> CoverTree:
    points = np.frombuffer(row["points"], np.int32 if row["wide"] else np.int16).astype(np.int64).reshape(-1, row["width"])
    counts, inner = np.frombuffer(row["counts"], np.int32).astype(np.int64), np.frombuffer(row["inner"], np.int32)
    radius, children, sums = np.zeros(len(points)), np.zeros(len(points), np.int64), points * counts[:, None]
    radius[inner], children[inner] = np.frombuffer(row["radius"]), np.frombuffer(row["children"], np.int32)
    sums[inner] = np.frombuffer(row["sums"], np.int64).reshape(-1, row["width"])
    return CoverTree(points, radius, counts, sums, 1 + np.cumsum(children) - children, children, np.full(len(points), -1))


def _parts(v: np.ndarray, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of the vectors: itself, its different values, where each row's value stands, and how often it occurs."""
    width = v.shape[1] // parts
    for p in range(parts):
        own = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
        keys = own.view([("", own.dtype)] * width).ravel()
        _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        yield own, own[first], inverse.ravel(), counts


def _planted(parts: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TREE_ROWS):
                v = matrix(b.column(0).slice(at, TREE_ROWS), dimensions)
                for p, (_, points, _, counts) in enumerate(_parts(v, parts)):
                    row = _stored(p, cover_tree(points, counts))
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


_ARROW = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("points", "counts", "inner", "radius", "sums", "children"))])


def _summed(codebooks: np.ndarray):
    """Sums and numbers of the parts nearest to each entry, of all trees of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = codebooks.shape
        total = np.zeros((parts, entries, width + 1), np.int64)  # the number stands last
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                tree, own = _loaded(row), total[row["part"]]
                for at, best in descend(tree, codebooks[row["part"]]):
                    np.add.at(own, best, np.c_[tree.sums[at], tree.counts[at]])
        part, entry, place = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(total.ravel())], ["part", "entry", "place", "total"])

    return run


def _coded(codebooks: np.ndarray, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TREE_ROWS):
                rows = b.slice(at, TREE_ROWS)
                v = matrix(rows.column(rows.schema.get_field_index("v")), dimensions)
                codes, error = np.zeros((len(v), len(codebooks)), np.uint8), np.zeros(len(v), np.int64)
                for p, (own, points, inverse, counts) in enumerate(_parts(v, len(codebooks))):
                    codes[:, p] = nearest(cover_tree(points, counts), codebooks[p])[inverse]
                    error += ((own - codebooks[p][codes[:, p]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])

    return run


def fit(usable: DataFrame, dimensions: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) of a table with ``id`` and ``v``, after all rounds."""
    seeds = usable.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    width = dimensions // parts
    books = np.zeros((parts, len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        books[:, i] = np.pad(np.array(r["v"], np.int64), (0, dimensions - len(r["v"]))).reshape(parts, width)
    if not len(seeds) or not width:
        return books
    trees = keep(usable.select("v").mapInArrow(_planted(parts, dimensions), _TREE), "cover-trees")
    for _ in range(rounds):
        found = trees.mapInArrow(_summed(books), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        total = np.zeros((parts, len(seeds), width + 1), np.int64)
        for r in found:
            total[r["part"], r["entry"], r["place"]] = r["total"]
        used = total[:, :, -1] > 0
        books[used] = total[used][:, :-1] // total[used][:, -1:]
    return books


def with_group_total(rows: DataFrame, group: str, value: str, name: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal ``group`` (nulls together; null if it passes 64 bits).

    Groups of over one ``hot``-th of all rows are fewer than ``hot``, so their sums are broadcast; others meet by a join.
    """
    sums = keep(rows.groupBy(F.col(group).alias("_group")).agg(F.try_sum(value).alias(name), F.count("*").alias("_n")), "group-totals")
    bar = (sums.agg(F.sum("_n")).first()[0] or 0) / hot
    large, small = sums.where(F.col("_n") > bar), sums.where(F.col("_n") <= bar).drop("_n")
    same = F.col(group).eqNullSafe(F.col("_group"))
    met = rows.join(F.broadcast(large), same, "left")
    rest = met.where(F.col("_n").isNull()).drop("_group", "_n", name)
    return met.where(F.col("_n").isNotNull()).drop("_group", "_n").unionByName(rest.join(small, same).drop("_group"))


def encode(
    vectors: DataFrame, factor: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """id, label, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Rows whose vector is null or holds null or infinite components or NaN go. Components count as floor(``factor`` * x), held
    between -2^27 and 2^27. Vectors are filled up with zeros to the longest one's length, rounded up to a multiple of
    ``parts``; an empty vector counts as zeros. Codebooks start as the rows of the smallest ids (null ids last; rows of
    equal ids by their vectors); with fewer rows than ``entries`` there are fewer entries, at most 256. Ties go to the lower
    entry. Repeated rows count each and stay. An empty table gives no rows. Other columns are ignored.
    """
    usable = finite(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(F.col(vector_col), factor, LIMIT).alias("v"))
    longest = usable.agg(F.max(F.size("v"))).first()[0] or 0
    dimensions = -(-longest // parts) * parts
    books = fit(usable, dimensions, parts, entries, rounds)
    types = {c: vectors.schema[n].dataType.simpleString() for c, n in (("id", id_col), ("label", label_col))}
    shape = f"id {types['id']}, label {types['label']}, code string, error long"
    if dimensions:
        coded = usable.mapInArrow(_coded(books, dimensions), shape)
    else:
        coded = usable.select("id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = with_group_total(keep(coded, "vector-codes"), "label", "error", "label_error")
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode`` of all ``embeddings`` in 8 parts, 16 entries and 6 rounds; its docstring defines all cases."""
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    assign = """a{i} AS MATERIALIZED (SELECT vec_id, part, s, min({{'d': list_inner_product(s, s) - 2 * list_inner_product(s, c) + list_inner_product(c, c), 'e': entry}}) AS m
  FROM p JOIN c{i} USING (part) GROUP BY vec_id, part, s)"""
    move = """c{j} AS MATERIALIZED (SELECT part, entry, coalesce(n.c, o.c) AS c FROM c{i} AS o LEFT JOIN (
  SELECT part, m.e AS entry, list((t - (((t % n) + n) % n)) // n ORDER BY pos)::DOUBLE[] AS c FROM (
    SELECT part, m, pos, sum(s[pos])::BIGINT AS t, count(*) AS n FROM (SELECT part, {{'e': m.e}} AS m, s FROM a{i}), range(1, 9) AS r(pos) GROUP BY part, m, pos
  ) GROUP BY part, m.e) AS n USING (part, entry))"""
    steps = ",\n".join(f"{assign.format(i=i)},\n{move.format(i=i, j=i + 1)}" for i in range(6))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, part, v[part * 8 + 1 : part * 8 + 8] AS s FROM v, range(8) AS r(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
{steps},
{assign.format(i=6)},
books AS (SELECT sha256(string_agg(c[pos]::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS said FROM c6, range(1, 9) AS r(pos)),
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, said AS codebooks_sha256 FROM coded JOIN v USING (vec_id), books
"""


OP11_SQL = _sql()
