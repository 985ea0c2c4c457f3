"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one bit a rule (1: failed).
Policies are versioned masks over these bits; applying one, or asking what each rule of it costs, reads only the
ledger and works by bitwise operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import documents, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts")

SYMBOLS, SPACE = b"[#*$%&|<>]"[1:-1], b" \t\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8

Measures = dict[str, np.ndarray]

#: Name and test of each rule, in the order of their bits. A bit keeps its rule for good; new rules go to the end.
RULES: tuple[tuple[str, Callable[[Measures], np.ndarray]], ...] = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    ("duplicate_lines", lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),
    ("short_or_long_words", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    ("capitals", lambda m: m["n_upper"] > m["n_lower"]),
    ("exclamations", lambda m: 100 * m["n_shouts"] > 30 * m["n_words"]),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


BASE = mask("few_words", "repeated_words")
#: Versions stay as they are; a changed policy gets a new version.
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("symbols", "duplicate_lines", "short_or_long_words", "capitals", "exclamations"),
}

_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(1, 2**62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PER_TEXT = np.uint64(_rng.integers(1, 2**62)) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words that lie in a window of eight words found twice or more in that text."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(words), np.int64)
    if total < WINDOW:
        return out
    h = np.fromiter((hash(w) for text in words for w in text), np.int64, total).view(np.uint64)
    text_of = np.repeat(np.arange(len(words)), sizes)
    n = total - WINDOW + 1
    key = text_of[:n].astype(np.uint64) * _PER_TEXT
    for k in range(WINDOW):
        key += h[k : k + n] * _FACTORS[k]
    starts = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
    if not len(starts):
        return out
    key = key[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(starts), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    change = np.zeros(total + 1, np.int32)
    change[starts[hit]] += 1  # starts are distinct
    change[starts[hit] + WINDOW] -= 1
    covered = np.cumsum(change[:total]) > 0
    return np.bincount(text_of, weights=covered, minlength=len(words)).astype(np.int64)


def measure(texts: list) -> Measures:
    """All measurements of whole texts; a null text is an empty one."""
    out = {k: np.zeros(len(texts), np.int64) for k in MEASURES}
    for a, b in slices(texts):
        words = []
        for i in range(a, b):
            text = texts[i] or ""
            raw = text.encode()
            w = raw.split()
            words.append(w)
            out["n_words"][i] = len(w)
            out["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
            for name, chars in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_lower", LOWER), ("n_shouts", b"!")):
                out[name][i] = len(raw) - len(raw.translate(None, chars))
            lines = [x for x in raw.split(b"\n") if x.strip()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_repeat_words"][a:b] = repeated_words(words)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, the measurements, and failed (bits of ``RULES``).

    Null and empty texts have no words and fail few_words only. Repeated rows give repeated rows, an empty table none;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1).to_pylist())
            failed = np.zeros(batch.num_rows, np.int64)
            for i, (_, rule) in enumerate(RULES):
                failed |= rule(m).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in MEASURES), pa.array(failed)], names=[id_col, *MEASURES, "failed"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in MEASURES) + ", failed long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def kept(policy: str):
    """Whether a row of the ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that stay if it is dropped."""
    bits = POLICIES[policy]
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(bits)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit"), F.lit(bits & ~b).alias("rest")) for n, b in BITS.items() if b & bits))
    both = counts.withColumn("r", F.explode(rules)).select("failed", "n", "r.*")

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return both.groupBy("rule", "bit").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("failed") == F.col("bit")).alias("n_alone"),
        total(F.col("failed").bitwiseAND(F.col("rest")) == 0).alias("n_kept_without"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(documents(spark, sf_dir)).select(
        "doc_id", *MEASURES[:5], (~kept("base")).alias("base_failed"), kept("v1").alias("kept"), F.col("failed").alias("failed_bits")
    )
