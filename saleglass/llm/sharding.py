"""Minimax contiguous sharding: the smallest feasible shard capacity over ordered atomic groups, then the cuts.

Documents with equal texts form one atomic group and are never parted. Groups stand in the order of the
text's MD5. Only sums over ranges of that order reach the driver: first 4,096 ranges, then, round by round,
256 sub-ranges of each range in which a cut can still fall. Each round brackets the smallest feasible capacity
between a search that may cut inside an unresolved range and one that may not; when the two agree, the capacity
is exact. What the driver holds depends on the number of shards, not on the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm.common import documents, keep, text_or_empty


@dataclass(frozen=True)
class Range:
    """All groups whose MD5 begins with ``prefix``."""

    prefix: str
    size: int
    single: bool


def _cumulated(ranges: list[Range]) -> list[int]:
    at = [0]
    for r in ranges:
        at.append(at[-1] + r.size)
    return at


def greedy(ranges: list[Range], at: list[int], capacity: int, shards: int, inside: bool) -> tuple[bool, list[int]]:
    """Fill shard after shard up to ``capacity``. Gives whether all fits, and where each shard ends.

    ``inside``: a cut may fall inside a range of several groups (too hopeful); else only between ranges (too strict).
    """
    total, pos, ends, fits = at[-1], 0, [], True
    for _ in range(shards):
        reach = pos + capacity
        if reach >= total:
            return fits, [*ends, total]
        i = bisect_right(at, reach) - 1
        nxt = reach if inside and not ranges[i].single else at[i]
        if nxt <= pos:  # the next range alone is larger than the capacity
            fits, nxt = False, at[i + 1]
        pos = nxt
        ends.append(pos)
    return False, ends


def smallest_capacity(ranges: list[Range], shards: int, inside: bool) -> int:
    """Binary search for the smallest capacity that ``greedy`` can pack into ``shards`` shards."""
    at = _cumulated(ranges)
    low = max([-(-at[-1] // shards), *(r.size for r in ranges if r.single or not inside)])
    high = max(low, at[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ranges, at, mid, shards, inside)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def unresolved(ranges: list[Range], shards: int, low: int, high: int) -> list[Range]:
    """Ranges of several groups in which a cut can fall for a capacity from ``low`` to ``high``."""
    at = _cumulated(ranges)
    large = [r for r in ranges if not r.single and r.size > low]
    if large:
        return large
    hopeful = greedy(ranges, at, high, shards, True)[1]
    strict = greedy(ranges, at, low, shards, False)[1]
    found: dict[str, Range] = {}
    for ends in (zip(strict, hopeful, strict=False), ((e, e) for e in greedy(ranges, at, low, shards, True)[1])):
        for a, b in ends:
            for i in range(max(0, bisect_right(at, min(a, b)) - 1), min(len(ranges), bisect_left(at, max(a, b)) + 1)):
                if not ranges[i].single:
                    found[ranges[i].prefix] = ranges[i]
    return list(found.values())


def cut(ranges: list[Range], shards: int, capacity: int) -> list[str]:
    """First prefix of each shard after the first. No shard exceeds ``capacity``; cuts stand as near an even split
    as that allows. A shard left empty begins where the next one does; ``g`` is past every prefix."""
    at = _cumulated(ranges)
    total = at[-1]
    least = [total]  # from the right: where a shard may begin at the earliest if the rest is to fit
    for _ in range(shards - 1):
        least.append(at[bisect_left(at, max(0, least[-1] - capacity))])
    least.reverse()
    pos, starts = 0, []
    for j in range(1, shards):
        goal = pos + (total - pos) / (shards - j + 1)
        i = bisect_right(at, goal) - 1
        if i + 1 < len(at) and at[i + 1] - goal < goal - at[i]:
            i += 1
        i = min(i, bisect_right(at, pos + capacity) - 1)
        i = max(i, bisect_left(at, max(pos, least[j - 1])))
        pos = at[i]
        starts.append(ranges[i].prefix if i < len(ranges) else "g")
    return starts


def _sums(thin: DataFrame, digits: int, within: list[Range] | None = None) -> list[Range]:
    if within is not None:
        width = len(within[0].prefix)
        thin = thin.where(F.substring("atom", 1, width).isin([r.prefix for r in within]))
    rows = (
        thin.groupBy(F.substring("atom", 1, digits).alias("prefix"))
        .agg(F.sum("size").alias("size"), (F.min("atom") == F.max("atom")).alias("single"))
        .collect()
    )
    return [Range(r["prefix"], r["size"], r["single"]) for r in rows]


def plan_cuts(thin: DataFrame, shards: int, first_digits: int = 3, more_digits: int = 2) -> tuple[int, list[str]]:
    """The exact smallest capacity and the cuts, for a table with ``atom`` (hex of the group) and ``size``."""
    ranges = sorted(_sums(thin, first_digits), key=lambda r: r.prefix)
    if not ranges:
        return 0, []
    while True:
        low, high = smallest_capacity(ranges, shards, True), smallest_capacity(ranges, shards, False)
        if low == high:
            return high, cut(ranges, shards, high)
        split = unresolved(ranges, shards, low, high)
        by_width: dict[int, list[Range]] = {}
        for r in split:
            by_width.setdefault(len(r.prefix), []).append(r)
        finer = [x for width, group in by_width.items() for x in _sums(thin, width + more_digits, group)]
        gone = {r.prefix for r in split}
        ranges = sorted([r for r in ranges if r.prefix not in gone] + finer, key=lambda r: r.prefix)


def shard_documents(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, slot_cells: int = 1024
) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot in that shard.

    Returns id, size (UTF-8 bytes plus ``overhead``), text_crc32, atom, shard (0 to ``shards`` - 1) and slot
    (0, 1, ... without gaps in each shard). A null text counts as the empty text and shares its group. Repeated rows
    each get a slot. An empty table gives no rows. Other columns are ignored. If one group is larger than an even
    share, it sets the capacity and the other shards stay as even as they can.

    Slots are numbered in ``slot_cells`` hashed cells a shard, so that no task orders a whole shard.
    """
    text = text_or_empty(text_col)
    thin = keep(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("atom"),
        ),
        "shard-sizes",
    )
    _, starts = plan_cuts(thin, shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("atom") >= F.lit(s)).cast("int")
    placed = thin.withColumns({"shard": shard, "cell": F.pmod(F.xxhash64("id"), F.lit(slot_cells)).cast("int")})
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    order = Window.partitionBy("shard", "cell").orderBy("id", "atom")
    return placed.join(F.broadcast(offsets), ["shard", "cell"]).select(  # at most shards x slot_cells rows
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "atom",
        "shard",
        (F.col("offset") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
