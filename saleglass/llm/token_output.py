"""Token ids in a compressed block file, and back.

Documents are dealt in ranges of ascending id; each task tokenizes its range, cuts the ids into blocks of ``BLOCK``
and codes them (see ``id_coder``). The file is a Parquet table with a row a block: range, block number, first id in
the range, number of ids, CRC-32 of the ids, payload, and the pieces of documents in it. A block is decoded without any other.
Parquet's committer takes care of lost and repeated tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm import id_coder
from saleglass.llm.common import documents, keep, slices, text_or_empty

END_ID = 1
BLOCKS = "part int, block long, first long, n_ids int, crc long, payload binary, doc_id array<long>, nth array<long>, seq array<int>, n array<int>, ends array<boolean>"


class Words:
    """Ids of texts by way of their words.

    The tokenizer never joins characters across ASCII white space: its pre-tokenizer drops white space, and neither
    its lower-casing nor its normalization composes across it. So a text's ids are those of its words, one after
    another, and a word is tokenized once for as long as it is held; at most ``limit`` words are held.

    Fewer different words are held if a full stop or comma after a letter or digit stands apart, as the tokenizer cuts there
    too, and if words are in lower case (ASCII only). Neither is done for texts with special tokens or combining marks.
    """

    limit = 500_000
    _mark = re.compile(r"[.,](?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff][.,])(?=[\x20\x09-\x0D]|\Z)")
    _combining = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.between = zero[0] if len(zero) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = _Places()
        self.ids, self.sizes = [np.array([END_ID], np.uint32)], [np.array([1])]
        self.flat, self.first, self.size = self.ids[0], np.array([0]), np.array([1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and how many each text has."""
        if len(self.places) > self.limit:
            self.forget()
        words = [self._words(t) for t in texts]
        places = self.places
        counts = np.array([len(w) + 1 for w in words], np.int64)
        at = np.fromiter((p for w in words for p in (*map(places.__getitem__, w), 0)), np.int64, int(counts.sum()))
        if places.fresh:
            ids, sizes = self._tokenized([w.decode() for w in places.fresh])
            places.fresh.clear()
            self.sizes.append(sizes)
            self.ids.append(ids)
            self.flat, self.size = np.concatenate(self.ids), np.concatenate(self.sizes)
            self.ids, self.sizes = [self.flat], [self.size]
            self.first = np.cumsum(self.size) - self.size
        size = self.size[at]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        per_text = np.diff(np.concatenate([[0], upto[np.cumsum(counts) - 1]])) if len(texts) else np.zeros(0, np.int64)
        return ids, per_text


    def _words(self, text: str) -> list[bytes]:
        if "<|" in text or not text.isascii() and self._combining.search(text):
            return text.encode().split()
        return self._mark.sub(r" \g<0>", text).encode().lower().split()

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has. Words of letters alone are one piece to the tokenizer;
        many go at once, with the digit 0 between them."""
        plain = [w for w in words if w.isalpha()]
        lots = [plain[a : a + 1000] for a in range(0, len(plain), 1000)]
        of = {}
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([" 0 ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = found.ids
            stops = np.flatnonzero(np.array(ids) == self.between).tolist()
            if len(stops) == len(lot) - 1:
                of |= {w: ids[a:b] for w, a, b in zip(lot, [0, *(x + 1 for x in stops)], [*stops, len(ids)], strict=True)}
        rest = [w for w in words if w not in of]
        of |= {w: e.ids for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        found = [of[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


_held: dict[str, Words] = {}


def words_by(path: str) -> Words:
    """This process's words of a tokenizer: what one task has tokenized, the next one needn't."""
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]


class _Places(dict):
    """Word to its row; rows are given in order of first sight, row 0 is the end id."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self) + 1
        self.fresh.append(word)
        return row


class _Blocks:
    """Cuts a range's stream of ids into coded blocks."""

    def __init__(self, part: int) -> None:
        self.part, self.block, self.first, self.nth = part, 0, 0, 0
        self.held, self.n_held = [], 0
        self.pieces: list[tuple[int, int, int, int, bool]] = []  # document, its number, piece, ids, whether it ends

    def add(self, ids: np.ndarray, doc_ids: list, per_text: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        for d, n in zip(doc_ids, per_text.tolist(), strict=True):
            self.pieces.append((d, self.nth, 0, n, True))
            self.nth += 1

    def rows(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        n_full = len(ids) // id_coder.BLOCK
        stops = [id_coder.BLOCK * (i + 1) for i in range(n_full)]
        if last and len(ids) > n_full * id_coder.BLOCK:
            stops.append(len(ids))
        blocks, rows, start, k = [], [], 0, 0
        pieces = self.pieces
        for stop in stops:
            blocks.append(ids[start:stop])
            room, own = stop - start, []
            while room:
                d, nth, seq, n, ends = pieces[k]
                if n <= room:
                    own.append(pieces[k])
                    k += 1
                    room -= n
                else:
                    own.append((d, nth, seq, room, False))
                    pieces[k] = (d, nth, seq + 1, n - room, ends)
                    room = 0
            rows.append((self.block, self.first + start, stop - start, id_coder.checksum(blocks[-1]), own))
            self.block += 1
            start = stop
        payloads = [p for i in range(0, len(blocks), id_coder.BATCH) for p in id_coder.encode(blocks[i : i + id_coder.BATCH])]
        self.first += start
        self.held, self.n_held, self.pieces = [ids[start:]], len(ids) - start, pieces[k:]

        def lists(i: int, kind: pa.DataType) -> pa.Array:
            return pa.array([[x[i] for x in r[4]] for r in rows], pa.list_(kind))

        columns = [
            pa.array([self.part] * len(rows), pa.int32()),
            *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))),
            pa.array(payloads, pa.binary()),
            lists(0, pa.int64()), lists(1, pa.int64()), lists(2, pa.int32()), lists(3, pa.int32()), lists(4, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "block", "first", "n_ids", "crc", "payload", "doc_id", "nth", "seq", "n", "ends"])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the block file of ``docs`` in ascending id order (null ids first; repeated ids by text). A null text has
    the end id only. An empty table gives no blocks. ``tokenizer_path`` must be there on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = words_by(tokenizer_path), _Blocks(TaskContext.get().partitionId())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                out.add(*_swap(words.encode(texts[a:b]), ids[a:b]))
                if out.n_held >= id_coder.BLOCK * id_coder.BATCH:
                    yield out.rows(False)
        yield out.rows(True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS)


def _swap(found: tuple[np.ndarray, np.ndarray], doc_ids: list) -> tuple[np.ndarray, list, np.ndarray]:
    return found[0], doc_ids, found[1]


class DamagedBlock(ValueError):
    """A block's ids don't have the checksum that stands in its row."""


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Pieces of documents from a block file: part, doc_id, nth, seq, start (in the range), n, whole, and either crc (of
    the ids as little-endian unsigned 32-bit integers) if the piece is a whole document or those bytes if not."""
    schema = "part int, doc_id long, nth long, seq int, start long, n long, whole boolean, crc long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, id_coder.BATCH):
                rows = batch.slice(a, id_coder.BATCH).to_pylist()
                out = []
                for r, ids in zip(rows, id_coder.decode([r["payload"] for r in rows], [r["n_ids"] for r in rows]), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if crc32(raw) != r["crc"]:
                        raise DamagedBlock(f"range {r['part']}, block {r['block']}")
                    at = 0
                    for d, nth, seq, n, ends in zip(r["doc_id"], r["nth"], r["seq"], r["n"], r["ends"], strict=True):
                        whole, own = ends and seq == 0, raw[4 * at : 4 * (at + n)]
                        out.append((r["part"], d, nth, seq, r["first"] + at, n, whole, crc32(own) if whole else None, None if whole else own))
                        at += n
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [()] * 9, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "nth", "seq", "start", "n", "whole", "crc", "bytes"])

    return blocks.select("part", "block", "first", "n_ids", "crc", "payload", "doc_id", "nth", "seq", "n", "ends").mapInArrow(run, schema)


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in a block file."""
    pieces = keep(decode_blocks(blocks), "token-pieces")
    columns = ["part", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")]
    whole = pieces.where("whole").select(*columns)
    # documents longer than what was left of their block: bounded by the length of one document
    split = pieces.where("not whole").groupBy("part", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n"),
        F.crc32(F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "bytes"))), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["bytes"]))).alias("crc"),
    )
    sizes = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = whole.unionByName(split.select(*columns)).join(F.broadcast(offsets), "part")
    return rows.select("doc_id", (F.col("offset") + F.col("start")).cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(keep(encode_documents(documents(spark, sf_dir), default_tokenizer()), "token-blocks"))
