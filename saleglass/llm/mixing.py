"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Only pattern totals reach the
driver. There, a min-cost flow routes each pattern's words to the quotas of its sources; reading a pattern's words
the first time is free, each further lap costs more, so repeats come last. The flow says how much of each pattern
goes to each source; documents then fill these amounts in a seeded order.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm.common import WORD, documents, keep, text_or_empty

Pattern = tuple[str, ...]


def capped_targets(totals: dict[str, int], weights: dict[str, float], share: float, ceiling: float) -> dict[str, float]:
    """Share ``share`` of all words by weight; no target passes ``ceiling`` times its source, the excess is reshared."""
    targets: dict[str, float] = {}
    left, free = share * sum(totals.values()), list(totals)
    while free:
        unit = left / sum(weights[s] for s in free)
        full = [s for s in free if unit * weights[s] > ceiling * totals[s]]
        if not full:
            return targets | {s: unit * weights[s] for s in free}
        for s in full:
            targets[s] = ceiling * totals[s]
            left -= targets[s]
        left, free = max(left, 0.0), [s for s in free if s not in targets]
    return targets


class _Flow:
    """Successive shortest paths with potentials over one small graph."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        potential: dict[int, int] = defaultdict(int)
        while True:
            dist, via, heap = {source: 0}, {}, [(0, source)]
            while heap:
                d, v = heapq.heappop(heap)
                if d > dist[v]:
                    continue
                for e in self.out[v]:
                    if self.cap[e] > 0:
                        w = self.to[e]
                        nd = d + self.cost[e] + potential[v] - potential[w]
                        if nd < dist.get(w, math.inf):
                            dist[w], via[w] = nd, e
                            heapq.heappush(heap, (nd, w))
            if sink not in dist:
                return
            for v, d in dist.items():
                potential[v] += d
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            most = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= most
                self.cap[e ^ 1] += most


def route(patterns: dict[Pattern, int], quotas: dict[str, int], laps: int = 2) -> dict[Pattern, dict[str, int]]:
    """Words of each pattern that go to each of its sources. Lap k of a pattern costs k squared (convex)."""
    owner = {s: s for s in quotas}

    def find(s: str) -> str:
        while owner[s] != s:
            owner[s] = owner[owner[s]]
            s = owner[s]
        return s

    for p in patterns:
        for s in p[1:]:
            owner[find(s)] = find(p[0])
    parts: dict[str, list[Pattern]] = defaultdict(list)
    for p in sorted(patterns):
        parts[find(p[0])].append(p)
    routed: dict[Pattern, dict[str, int]] = {}
    for group in parts.values():  # patterns that share no source don't meet
        flow, names = _Flow(), sorted({s for p in group for s in p})
        node = {s: 2 + i for i, s in enumerate(names)}
        arcs = {}
        for i, p in enumerate(group):
            v = 2 + len(names) + i
            for lap in range(laps):
                flow.arc(0, v, patterns[p], lap * lap)
            for s in p:
                arcs[p, s] = flow.arc(v, node[s], laps * patterns[p], 0)
        for s in names:
            flow.arc(node[s], 1, quotas[s], 0)
        flow.run(0, 1)
        for (p, s), e in arcs.items():
            routed.setdefault(p, {})[s] = flow.cap[e ^ 1]
    return routed


def mix(sized: DataFrame, quotas: dict[str, int], laps: int = 2, seed: str = "mix", cells: int = 4096) -> DataFrame:
    """Select documents of ``sized`` (id, row, members array of source keys, size) to the quotas.

    Returns id, row (as given), members, size, taken (words, repeats counted) and parts (source, words). In each pattern the documents
    stand in the order of MD5(seed:id); the routed amounts are laid along that line, lap after lap. A document is read
    whole but for those at the ends of an amount, which are read in part, so quotas are met to the word where supply
    allows. Ties of the order (repeated ids) are broken by size. Documents without members or words take nothing. An
    empty table gives no rows. The line is summed in ``cells`` cells a pattern, so no task orders a whole pattern.

    The driver holds one number per pattern and source; the number of patterns must be a matter of metadata.
    """
    spark = sized.sparkSession
    known = sized.select("id", "row", F.array_sort(F.array_distinct("members")).alias("members"), F.col("size").cast("long").alias("size"))
    known = known.withColumn("u", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    known = known.withColumn("cell", F.pmod(F.conv(F.substring("u", 1, 6), 16, 10).cast("long"), F.lit(cells)).cast("int"))
    sums = keep(known.groupBy("members", "cell").agg(F.sum("size").alias("size")), "mix-cells")
    totals = {tuple(r["members"]): r["size"] for r in sums.groupBy("members").agg(F.sum("size").alias("size")).collect() if r["members"]}
    rows = []
    for p, by_source in route(totals, {s: quotas.get(s, 0) for p in totals for s in p}, laps).items():
        start, segments = 0, []
        for s in p:
            if by_source[s]:
                segments.append((s, start, start + by_source[s]))
                start += by_source[s]
        rows.append((list(p), totals[p], segments))
    plan = spark.createDataFrame(rows, "members array<string>, pattern_size long, segments array<struct<source:string,a:long,b:long>>")
    before = Window.partitionBy("members").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("members", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    run = Window.partitionBy("members", "cell").orderBy("u", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = known.join(offsets, ["members", "cell"], "left").join(plan, "members", "left")
    lined = lined.withColumn("at", F.col("offset") + F.sum("size").over(run) - F.col("size"))

    def overlap(segment, lap: int):
        a = F.col("at") + lap * F.col("pattern_size")
        return F.greatest(F.lit(0), F.least(a + F.col("size"), segment["b"]) - F.greatest(a, segment["a"]))

    parts = F.transform(
        F.coalesce(F.col("segments"), F.array().cast("array<struct<source:string,a:long,b:long>>")),
        lambda s: F.struct(s["source"].alias("source"), sum((overlap(s, lap) for lap in range(laps)), F.lit(0)).cast("long").alias("words")),
    )
    lined = lined.withColumn("parts", F.filter(parts, lambda x: x["words"] > 0))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return lined.select("id", "row", "members", "size", taken.alias("taken"), "parts")


def source_key(col: str):
    """Sources as non-null keys that sort as code points do, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(col)), F.lit("b"))


def row_key():
    return F.xxhash64("doc_id", F.md5(text_or_empty("text")))


def mix_sources(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """Mix ``docs`` (doc_id, source, text): sources by code point, null last, weigh ``weights`` in turn.

    Returns doc_id, row (a hash of id and text), size (words; null text 0), source_size, target and taken. Every row of
    ``docs`` is returned.
    """
    sized = keep(
        docs.select(F.col("doc_id").alias("id"), row_key().alias("row"), F.array(source_key("source")).alias("members"), F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size")),
        "mix-sizes",
    )
    totals = {r["s"]: r["size"] for r in sized.groupBy(F.col("members")[0].alias("s")).agg(F.sum("size").alias("size")).collect()}
    weighed = {s: float(weights[i % len(weights)]) for i, s in enumerate(sorted(totals))}
    targets = capped_targets(totals, weighed, share, ceiling)
    mixed = mix(sized, {s: int(t) for s, t in targets.items()}, laps=math.ceil(ceiling), seed=seed)
    table = docs.sparkSession.createDataFrame([(s, totals[s], float(targets[s])) for s in totals], "s string, source_size long, target double")
    return mixed.join(table, mixed["members"][0] == table["s"], "left").select(F.col("id").alias("doc_id"), "row", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: a row for each time a document is read, with its columns. A document read in part keeps its
    first words, joined by spaces, and its n_chars follow if there are any."""
    taken = mix_sources(docs, **options).where("taken > 0").select("row", "size", "taken").groupBy("row").agg(F.max("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    names = docs.columns
    # repeated rows share what they take
    both = docs.select(F.struct("*").alias("doc"), row_key().alias("row")).join(taken.select("row", "size", F.ceil(F.col("taken") / F.col("n")).alias("taken")), "row")
    laps = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")) - 1), lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size"))))
    read = both.select("doc", "size", laps.alias("words"))
    head = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    whole = F.col("words") == F.col("size")
    text = F.when(whole, F.col("doc.text")).otherwise(head)
    columns = [text.alias("text") if c == "text" else F.when(whole, F.col("doc.n_chars")).otherwise(F.length(head)).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in names]
    return read.select(*columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("row")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), t AS (
  SELECT s, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM d GROUP BY s
), k AS (  -- by ratio of ceiling to weight: those before the last unit that fits are capped
  SELECT *, 1.5 * (SELECT sum(size) FROM d) - coalesce(sum(2.0 * source_size) OVER o, 0) AS left_words,
         sum(w) OVER (ORDER BY 2.0 * source_size / w DESC, s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free_w,
         2.0 * source_size / w AS ratio
  FROM t WINDOW o AS (ORDER BY 2.0 * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (SELECT arg_min(left_words / free_w, ratio) FILTER (WHERE left_words / free_w <= ratio) AS unit FROM k
), g AS (SELECT s, source_size, least(w * unit, 2.0 * source_size)::DOUBLE AS target FROM t, u
), c AS (
  SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY s ORDER BY ('0x' || substr(md5('mix:' || doc_id), 1, 6))::BIGINT % 4096, md5('mix:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM d JOIN g USING (s)
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(a + size, floor(target)) - a) + greatest(0, least(a + source_size + size, floor(target)) - a - source_size))::BIGINT AS taken
FROM c
"""
