"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier. Suffixes are dealt by content, so that
equal strings meet and no task holds more than its share:

1. Of the ``SPAN`` grams in every string of ``LENGTH`` bytes the one of smallest hash is its anchor; equal strings have
   equal anchors at equal places. Anchors go, with a hash of all bytes that strings around them can have, to the task of
   their hash. Where only one anchor has a hash nothing repeats; where all bytes around are equal, all but the first
   repeat wholly. Equal means here that two 64-bit hashes agree, the gram's and that of all bytes around.
2. Anchors of one hash that differ in their surroundings bring these bytes along. Each shard of them has its
   Burrows-Wheeler transform, by place as all stand at the same anchor, and the transforms are merged by refining
   their interleave, a byte a step. Common prefixes follow from those of the step before: one more than the least between
   two neighbours that got the same byte. Intervals of common prefix ``LENGTH`` are repeated strings; all but the first
   of each are marked.
3. Marked starts meet their document, which loses the bytes they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import documents, keep, text_or_empty

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams in a string; an anchor has up to SPAN - 1 bytes of its string before it
BEFORE = SPAN - 1
SLICE_BYTES, SHARD_ROWS, MERGE_ROWS, PLACE_BITS = 2_000_000, 30_000, 4_096, 24

_P = np.uint64(0xD6E8FEB86659FD93)
_M = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(2**64 - 2**PLACE_BITS)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place, by doubling; the last ones wrap and must not be used."""
    with np.errstate(over="ignore"):
        h, width, power = b.astype(np.uint64) + np.uint64(1), 1, _P
        out, done, shift = None, 0, np.uint64(1)
        size = GRAM
        while size:
            if size & 1:
                part = np.roll(h, -done) if done else h
                out = part.copy() if out is None else out + part * shift
                done += width
                shift = shift * power
            size >>= 1
            if size:
                h = h + np.roll(h, -width) * power
                power = power * power
                width *= 2
        out ^= out >> np.uint64(31)
        out *= _M
        out ^= out >> np.uint64(29)
        return out


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of byte strings (the first of the smallest grams of each string of ``LENGTH`` bytes): number of the
    piece, place in it, and hash. All pieces together have at most ``2 ** PLACE_BITS`` bytes."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum())
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    # the hash's high bits, then the place: the least is the first of the smallest
    low, width = (h & _HIGH) | np.arange(n, dtype=np.uint64), 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n_starts = n - SPAN + 1
    low = np.minimum(low[:n_starts], low[SPAN - width : SPAN - width + n_starts])
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:n_starts]
    place = (low & ~_HIGH).astype(np.int64)[np.arange(n_starts) + LENGTH <= ends[piece]]
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    piece = np.searchsorted(ends, place, "right")
    return piece, place - (ends - sizes)[piece], h[place]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, and parts of long ones, in lots of about ``SLICE_BYTES``: numbers of the texts, offsets, bytes. Each
    string of ``LENGTH`` bytes starts in one part."""
    at, offsets, parts, size = [], [], [], 0
    for k, raw in enumerate(texts):
        for o in range(0, max(1, len(raw) - LENGTH + 1), SLICE_BYTES):
            part = raw[o : o + SLICE_BYTES + LENGTH - 1]
            at.append(k)
            offsets.append(o)
            parts.append(part)
            size += len(part)
            if size >= SLICE_BYTES:
                yield at, offsets, parts
                at, offsets, parts, size = [], [], [], 0
    if parts:
        yield at, offsets, parts


def _local(doc_ids: list, texts: list) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, around, doc, place, repeats) for anchors of a run of documents. Of anchors that agree in all bytes around
    within a lot, all but the first are known to repeat already."""
    import xxhash

    of, ids = xxhash.xxh3_64_intdigest, np.array(doc_ids, np.int64)
    for at, offsets, parts in _pieces(texts):
        piece, place, h = anchors(parts)
        text, place = np.array(at, np.int64)[piece], place + np.array(offsets, np.int64)[piece]
        around = np.fromiter(
            (of(texts[k][p - BEFORE if p > BEFORE else 0 : p + LENGTH], p if p < BEFORE else BEFORE) for k, p in zip(text.tolist(), place.tolist(), strict=True)), np.uint64, len(place)
        )
        doc = ids[text]
        order = np.lexsort((place, doc, around, h))
        h, around, doc, place = h[order], around[order], doc[order], place[order]
        new = np.append(True, (h[1:] != h[:-1]) | (around[1:] != around[:-1]))[: len(h)]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        repeats = (doc != doc[lead]) | (place != place[lead])
        # what is known already needn't meet its like: deal it evenly
        h = np.where(repeats, (doc.view(np.uint64) * _P + place.view(np.uint64)) * _M, h)
        yield h, around, doc, place, repeats


def _split(group: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Stable order by group, then byte. Both fit in 16 bits for all but very many groups."""
    by_byte = np.argsort(byte, kind="stable")
    return by_byte[np.argsort(group[by_byte], kind="stable")]


def transform(group: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of one shard's families, by place since all stand at the same anchor: row k holds the
    bytes that stand before the suffixes of length k, in the order of these suffixes, and the families in that order."""
    n, width = around.shape
    byte, family = np.empty((width, n), np.uint16), np.empty((width, n), np.int32)
    order = np.arange(n, dtype=np.int32)
    for k in range(width):
        family[k], byte[k] = order, around[order, width - 1 - k]
        order = order[_split(group[order], byte[k])]
    return byte, family


def merge_transforms(group: np.ndarray, first: np.ndarray, around: np.ndarray, rows: int = MERGE_ROWS) -> np.ndarray:
    """Which strings of ``LENGTH`` bytes repeat an earlier one.

    ``around``: a row a suffix family, the bytes from ``BEFORE`` before an anchor to ``LENGTH`` after its start, 256
    where the document has none. ``group``: equal for anchors of one hash, in runs. ``first``: a number that orders the
    families by document and place. Returns a row a family; column o: the string that starts o bytes before the anchor.

    Shards of ``rows`` families have a transform each. Only their interleave, the shard of each suffix in the merged order,
    is refined: each step reads the next byte of every shard's transform in the order of the interleave so far and splits the
    interleave by it. No suffix is sorted again, and no shard's order is looked at but through its transform.
    """
    n, width = around.shape
    out = np.zeros((n, SPAN), bool)
    if n < 2:
        return out
    group = group.astype(np.uint16 if group[-1] < 1 << 16 else np.int64)
    starts = np.arange(0, n, rows)
    parts = [transform(group[a : a + rows], around[a : a + rows]) for a in starts]
    shard = np.repeat(np.arange(len(starts), dtype=np.uint16), np.diff(np.append(starts, n)))
    common = np.zeros(n, np.int64)  # common[i]: common prefix of neighbours i - 1 and i
    at = np.arange(n)  # each suffix's row in the shards' transforms, one shard after another
    byte, family = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] + a for p, a in zip(parts, starts, strict=True)], 1)
    for step in range(width):
        if len(parts) > 1:
            at[np.argsort(shard, kind="stable")] = np.arange(n)
        own, own_family = byte[step][at], family[step][at]
        own_group = group[own_family]
        split = _split(own_group, own)
        own, own_group, order = own[split], own_group[split], own_family[split]
        same = np.zeros(n, bool)
        same[1:] = (own[1:] == own[:-1]) & (own_group[1:] == own_group[:-1]) & (own[1:] != 256)
        again = np.flatnonzero(same)
        longer = np.zeros(n, np.int64)
        if len(again):
            bounds = np.empty(2 * len(again), np.int64)
            bounds[0::2], bounds[1::2] = split[again - 1] + 1, split[again] + 1
            longer[again] = np.minimum(np.minimum.reduceat(np.append(common, 0), bounds)[0::2] + 1, LENGTH)
        shard, common = shard[split], longer
        o = step + 1 - LENGTH
        if o >= 0:
            heads = np.flatnonzero(common < LENGTH)
            if len(heads) < n:
                low = np.minimum.reduceat(first[order], heads)
                repeated = first[order] != np.repeat(low, np.diff(np.append(heads, n)))
                out[order[repeated], o] = True
    return out


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of marks."""
    edge = np.zeros((marked.shape[0], marked.shape[1] + 2), np.int8)
    edge[:, 1:-1] = marked
    step = np.diff(edge, axis=1)
    row, lo = np.nonzero(step == 1)
    return row, lo, np.nonzero(step == -1)[1] - 1


def _by_group(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Whole groups of a sorted partition, some at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= SHARD_ROWS:
            last = held[-1].column(column)[-1]
            new = np.flatnonzero(batch.column(column).to_numpy() != last.as_py())
            cut = int(new[0]) if len(new) else batch.num_rows
            if len(new):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id long, text binary): (doc_id, a, b), strings that start at a to b repeat an earlier one."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, around, doc, place, repeats in _local(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(repeats)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "around", "doc_id", "place", "repeats"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc_id", "place", "again"]
        for t in _by_group(batches, 0):
            h, around, doc, place, repeats = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(h[repeats]), pa.array(doc[repeats]), pa.array(place[repeats]), pa.array(np.ones(int(repeats.sum()), bool))], names=names)
            h, around, doc, place = h[~repeats], around[~repeats], doc[~repeats], place[~repeats]
            if not len(h):
                continue
            order = np.lexsort((place, doc, around, h))
            h, around, doc, place = h[order], around[order], doc[order], place[order]
            new_h = np.append(True, h[1:] != h[:-1])
            new = new_h | np.append(True, around[1:] != around[:-1])
            number = np.cumsum(new_h) - 1
            kinds = np.bincount(number, new)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (doc != doc[lead]) | (place != place[lead])
            take = again | (kinds[number] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(doc[take]), pa.array(place[take]), pa.array(again[take])], names=names)

    found = docs.mapInArrow(local, "h long, around long, doc_id long, place int, repeats boolean")
    met = keep(found.repartition("h").sortWithinPartitions("h").mapInArrow(meet, "h long, doc_id long, place int, again boolean"), "anchors")

    opened = met.where("not again").groupBy("doc_id").agg(F.collect_list(F.struct("h", "place")).alias("at"))  # anchors of one document

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at:
                    places = [x["place"] for x in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["h"] for x in at], pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array(places, pa.int32()), pa.array([raw[max(0, p - BEFORE) : p + LENGTH] for p in places], pa.binary())],
                        names=["h", "doc_id", "place", "bytes"],
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, 0):
            h, doc, place = (t.column(i).combine_chunks().to_numpy() for i in range(3))
            around = np.full((len(h), BEFORE + LENGTH), 256, np.uint16)
            for i, (p, raw) in enumerate(zip(place.tolist(), t.column(3).to_pylist(), strict=True)):
                lead = BEFORE - min(p, BEFORE)
                around[i, lead : lead + len(raw)] = np.frombuffer(raw, np.uint8)
            first = np.empty(len(h), np.int64)
            order = np.lexsort((place, doc))
            first[order] = np.arange(len(h))
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            row, lo, hi = _runs(merge_transforms(group, first, around))
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((place[row] - hi).astype(np.int64)), pa.array((place[row] - lo).astype(np.int64))], names=["doc_id", "a", "b"])

    span = "doc_id long, a long, b long"
    bytes_of = docs.join(opened, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "at").mapInArrow(surroundings, "h long, doc_id long, place int, bytes binary")
    partly = bytes_of.repartition("h").sortWithinPartitions("h").mapInArrow(merge, span)
    place = F.col("place").cast("long")
    wholly = met.where("again").select("doc_id", (place - BEFORE).alias("a"), place.alias("b"))
    return wholly.unionByName(partly)


def covered(n_bytes: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the strings that start at a to b."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        lo, hi = max(a, 0), min(b, n_bytes - LENGTH) + LENGTH
        if hi - lo < LENGTH:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for each row of ``docs``.

    ``id_col`` is a whole number that names one text; rows that repeat an id and text are one document and are reported
    alike. Null ids stand before all others; null texts are empty. Texts of fewer than ``LENGTH`` bytes stay. An empty
    table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    starts = repeated_starts(source.select("doc_id", "text"))
    spans = starts.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cut = covered(len(raw), [(x["a"], x["b"]) for x in own or ()])
                at, parts = 0, []
                for a, b in cut:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = source.join(spans, "doc_id", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
