"""Benchmark decontamination by CGK embedding and bit sampling, verified by edit distance.

Benchmark items and texts are sequences of lower-cased words; a leak is a part of a text within ``1 - LEAST`` of an
item's words in edits. A CGK walk reads a window from its start: at each step it writes the word under its pointer,
and a random function of step and word decides whether the pointer moves on. Edit distance thus becomes Hamming
distance between walks, and sampled coordinates of them, hashed, meet in a table. ``WALKS`` walks of ``SAMPLES``
tables each reach the target recall; the longer the item, the more walks and the fewer samples a table (``effort``),
because walks that slipped out of step agree in fewer places. Windows have the sizes of the items. Candidates are
verified exactly.

A window is walked only where it can be a leak at all: by the q-gram lemma, a part within the allowed edits of an item
of m words keeps at least m - q + 1 - q * edits of its q-grams, so windows with fewer q-grams of any item are left
out without loss. Items are sent to the tasks in blocks of about ``BLOCK_WORDS`` words; each block is a pass, and with
more than one, a block is let go of once its pass is written.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from saleglass.llm.alignment import find
from saleglass.llm.common import documents, keep, slices
from saleglass.llm.near_dedup import mixed, words_of

LEAST = 0.8
WALKS, SAMPLES, REACH = 6, 5, 2
SHORT, LONG = 40, 120  # item words: above SHORT two samples a table, above LONG more walks
GRAM, BLOCK_WORDS = 3, 2_000_000
WALK_CELLS = 3_000_000

_rng = np.random.default_rng(2)
_FACTORS = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(words: list[bytes]) -> np.ndarray:
    """Within one process only. 0 stands for no word."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) | np.uint64(1)


def edits(n_words: int, least: float) -> int:
    return int(n_words * (1 - least) + 1e-9)


def effort(n_words: int) -> tuple[int, int]:
    """Walks and samples a table for items of a size, from measured recall at the limit of edits."""
    if n_words <= SHORT:
        return WALKS, 3
    return WALKS * max(1, -(-n_words // LONG)), 2


@dataclass(frozen=True)
class Size:
    """What items of one size ask of a window: q-grams of length ``gram``, ``needed`` of them in ``reach`` words."""

    words: int
    edits: int
    gram: int
    needed: int

    @classmethod
    def of(cls, n: int, least: float) -> Size:
        k = edits(n, least)
        for gram in range(min(GRAM, n), 0, -1):
            if (needed := n - gram + 1 - gram * k) > 0:
                return cls(n, k, gram, needed)
        return cls(n, k, 1, max(1, n - k))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` words at each place; runs go on past the end with 0."""
    pad = np.concatenate([h, np.zeros(size, np.uint64)])
    return mixed(sum(pad[k : k + len(h)] * _FACTORS[k] for k in range(size)))


def walk(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walks from ``starts``: the words written and the pointer, a row a step. Past its end a walk writes 0."""
    seeds = np.random.default_rng([2, seed]).integers(1, 2**63, steps, dtype=np.uint64)
    pad = np.concatenate([h, np.zeros(1, np.uint64)])
    at, written, pointer = starts.copy(), np.empty((steps, len(starts)), np.uint64), np.empty((steps, len(starts)), np.int64)
    for j in range(steps):
        w = np.where(at < ends, pad[np.minimum(at, len(h))], np.uint64(0))
        written[j], pointer[j] = w, at
        at = at + ((mixed(w ^ seeds[j]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return written, pointer


class Index:
    """The items of one block: gate, walks and tables. Built in each task from the items themselves."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: float = LEAST) -> None:
        self.items = [(i, w) for i, w in items if w]
        self.sizes = {n: Size.of(n, least) for n in sorted({len(w) for _, w in self.items})}
        by_gram = defaultdict(list)
        for _, w in self.items:
            g = self.sizes[len(w)].gram
            by_gram[g].append(grams(hashes(w), g)[: len(w) - g + 1])
        self.gate = {g: np.unique(np.concatenate(x)) for g, x in by_gram.items()}
        members = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            members[len(w)].append(k)
        self.tables: list[dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        for seed in range(max((effort(n)[0] for n in members), default=0)):
            by_size = {}
            for n, ks in members.items():
                walks, picked = effort(n)
                if seed >= walks:
                    continue
                h = hashes([x for k in ks for x in self.items[k][1]])
                starts = np.arange(len(ks)) * n
                written, _ = walk(h, starts, starts + n, REACH * n, seed)
                picks = np.random.default_rng([3, seed, n]).integers(0, REACH * n, (SAMPLES, picked))
                tables = []
                for p in picks:
                    keys = self._key(written[p])
                    order = np.argsort(keys, kind="stable")
                    tables.append((p, keys[order], np.array(ks)[order]))
                by_size[n] = tables
            self.tables.append(by_size)

    @staticmethod
    def _key(words: np.ndarray) -> np.ndarray:
        return sum(row * f for row, f in zip(words, _FACTORS, strict=False))

    def windows(self, h: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size, the places where a window keeps enough q-grams."""
        found, place = {}, np.arange(len(h))
        for g, known in self.gate.items():
            keys = grams(h, g)
            at = np.searchsorted(known, keys)
            hit = (known[np.minimum(at, len(known) - 1)] == keys) & (place + g <= ends)
            if not hit.any():
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            for n, s in self.sizes.items():
                if s.gram == g:
                    reach = np.minimum(place + n + s.edits - g + 1, ends)
                    found[n] = np.flatnonzero(total[np.maximum(reach, place)] - total[:-1] >= s.needed)
        return {n: x for n, x in found.items() if len(x)}

    def candidates(self, h: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(start, item) of windows that meet an item in a table, by start."""
        windows, found = self.windows(h, ends), []
        if not windows:
            return []
        efforts = sorted({0, *(effort(n)[0] for n in windows)})
        for before, last in pairwise(efforts):  # walks that the same sizes ask for
            own = {n: x for n, x in windows.items() if effort(n)[0] >= last}
            starts, steps = np.unique(np.concatenate(list(own.values()))), REACH * max(own)
            for part in np.array_split(starts, -(-len(starts) * steps // WALK_CELLS)):
                columns = {n: col for n, x in own.items() if len(col := np.flatnonzero(np.isin(part, x, assume_unique=True)))}
                for seed in range(before, last):
                    written, pointer = walk(h, part, ends[part], steps, seed)
                    for n, col in columns.items():
                        stop = part[col] + n
                        for picks, keys, items in self.tables[seed][n]:
                            at = picks[:, None], col
                            k = self._key(np.where(pointer[at] < stop, written[at], np.uint64(0)))
                            lo = np.searchsorted(keys, k)
                            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k)
                            count = np.searchsorted(keys, k[hit], "right") - lo[hit]
                            place = np.arange(count.sum()) + np.repeat(lo[hit] - np.cumsum(count) + count, count)
                            found.append(np.repeat(part[col[hit]], count) * len(self.items) + items[place])
        return [divmod(x, len(self.items)) for x in np.unique(np.concatenate(found)).tolist()]

    def leaks(self, texts: list) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, distance, first word, end word) for the best part of each text for each item that leaks."""
        for a, b in slices(texts, 4_000_000):
            words = [words_of(t) for t in texts[a:b]]
            sizes = np.array([len(w) for w in words], np.int64)
            flat = [x for w in words for x in w]
            if not flat or not self.items:
                continue
            first = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(words)), sizes)
            at = defaultdict(list)
            for start, item in self.candidates(hashes(flat), (first + sizes)[text]):
                at[int(text[start]), item].append(start)
            for (t, item), starts in sorted(at.items()):
                item_id, pattern = self.items[item]
                k, best, done = self.sizes[len(pattern)].edits, None, -1
                for s in starts:
                    lo, hi = max(first[t], s - k), min(first[t] + sizes[t], s + len(pattern) + 2 * k)
                    if hi <= done:
                        continue
                    done = min(first[t] + sizes[t], hi + len(pattern))  # this part covers the next starts too
                    hit = find(pattern, flat[lo:done], k)
                    if hit and (best is None or hit[0] < best[0]):
                        best = hit[0], int(lo - first[t]) + hit[1], int(lo - first[t]) + hit[2]
                if best:
                    yield a + t, item_id, *best


_HELD: dict[tuple[str, float], Index] = {}


def held_index(shared: Broadcast, least: float) -> Index:
    """The index of a block, built once in each Python worker; the last one stays for the worker's next task.
    Its items are numbered by place, as ids may repeat."""
    name, items = shared.value
    if (name, least) not in _HELD:
        _HELD.clear()
        _HELD[name, least] = Index([(i, w) for i, (_, w) in enumerate(items)], least)
    return _HELD[name, least]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leaks of benchmark items (item_id, text) into ``docs``.

    Returns id, item_id, n_edits, n_item_words, first_word, end_word: one row for each row of ``docs`` and item that
    leaks, for the nearest part. Ids are of any type; rows that repeat an item's id with another text are items of their
    own. Items without words (null, empty) leak nowhere, null and empty texts hold no leak.
    Repeated rows are reported again, an empty table gives no rows. Other columns are ignored.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, n_edits int, n_item_words int, first_word int, end_word int"
    out, item_kind = None, to_arrow_type(benchmark.schema["item_id"].dataType)
    for shared, alone in item_blocks(benchmark):
        part = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_runner(shared, least, item_kind), schema)
        if not alone:
            part = keep(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """(name of the block, its items as (id, words)) in broadcasts of about ``BLOCK_WORDS`` words, and whether there is but
    one. The driver holds one block at a time, if the taker destroys each of many once its pass is written."""
    items = benchmark.select("item_id", "text").dropDuplicates().where("text is not null")
    n_blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (5 * BLOCK_WORDS)))
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        held = uuid.uuid4().hex, [(r["item_id"], words_of(r["text"])) for r in rows]
        yield benchmark.sparkSession.sparkContext.broadcast(held), n_blocks == 1


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with all their columns.

    Null and empty texts hold none and stay; repeated rows stay or go alike; an empty benchmark or one of items without
    words takes nothing; an empty table gives no rows. Other columns may have any name, also those of ``find_leaks``.
    """
    at = docs.columns.index(text_col)

    def filtered(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held_index(shared, least)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in index.leaks(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return run

    for shared, alone in item_blocks(benchmark):
        docs = docs.mapInArrow(filtered(shared), docs.schema)
        if not alone:
            docs = keep(docs, "clean")
            shared.destroy()
    return docs


def _runner(shared, least: float, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = shared.value[1], held_index(shared, least)
        ids, patterns = zip(*items, strict=True) if items else ((), ())
        for batch in batches:
            found = [(t, ids[i], d, len(patterns[i]), lo, hi) for t, i, d, lo, hi in index.leaks(batch.column(1).to_pylist())]
            text, item, *numbers = zip(*found, strict=True) if found else ((),) * 6
            columns = [batch.column(0).take(pa.array(text, pa.int64())), pa.array(item, item_kind), *(pa.array(x, pa.int32()) for x in numbers)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "item_id", "n_edits", "n_item_words", "first_word", "end_word"])

    return run


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
