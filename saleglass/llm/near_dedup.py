"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its lower-cased words; k-mers are three words in a row, labelled with how often they have occurred so far.
For each of ``BANDS`` hash functions the ``PICKS`` labelled k-mers of smallest hash are taken and kept in text order;
equal picks in equal order make a candidate. Lengths may differ by the similarity asked for at most, so the band key
also holds the class of the length (and of the next one). Texts of a band are compared with the smallest of them.

A band is settled once its texts lie in one component. Every other band goes on with two leaders more: the text that has
most links so far (the original of many variants, which aren't alike among themselves, has links from the leaders of
its bands, the middle of a chain from both its ends) and the first in one order of all texts; only texts of other components
meet them. Bands whose leaders found a link go on for as long as a round finds many (``FEW``). What leaders leave is compared
exactly: in every band whose texts still lie in several components, the texts outside of the largest one meet all texts of other
components, in blocks of at most some ``LARGE`` texts dealt over all tasks. Bands with the same largest component meet as one group
where that makes fewer pairs. Pairs that share a band are verified where they meet, so only links become rows. So no pair that
shares a band is left out, whatever the size of the band; this part grows with a band's texts times those outside of its
largest component.

Pairs are first held against each other by bags of words, which rule out most unlike texts before any text is read. A
link is a word edit similarity of ``LEAST`` or more. Classes are the connected components of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saleglass.llm.alignment import similarity
from saleglass.llm.common import documents, keep, slices, text_or_empty
from saleglass.llm.components import components

KMER, PICKS, BANDS, LEAST = 3, 2, 40, 0.8
BAG, SALTS = 512, 64
#: Texts in a block of all texts of a band. Where more than that stand outside, blocks are larger, of ``LARGE`` texts at most (those outside, all).
BLOCK, LEAST_BLOCKS, LARGE = 64, 4, (512, 256)
#: A round of leaders that finds less than one link for so many rows of unsettled bands is the last one.
FEW = 100

_rng = np.random.default_rng(5)
_WORD = _rng.integers(1, 2**62, KMER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def stable_hash(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words that are the same in every process."""
    import xxhash

    of = xxhash.xxh3_64_intdigest
    return np.fromiter(map(of, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def labels_of(keys: np.ndarray) -> np.ndarray:
    """How often each key has occurred before, in order."""
    label = np.zeros(len(keys), np.uint64)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        at = np.flatnonzero(twice[slot] == keys)
        order = at[np.argsort(slot[at], kind="stable")]
        nth = np.arange(len(order))
        new = np.append(True, slot[order][1:] != slot[order][:-1])
        label[order] = (nth - np.maximum.accumulate(np.where(new, nth, 0))).astype(np.uint64)
    return label


def labelled_kmers(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every labelled k-mer of each text, one text after another, and how many each has. A text of fewer words
    than a k-mer has one k-mer, of all its words."""
    sizes = np.array([len(w) for w in words], np.int64)
    return kmers_of(stable_hash([w for text in words for w in text]), sizes)


def kmers_of(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``labelled_kmers`` from the hashes of all words and the number of words of each text."""
    pad = np.concatenate([flat, np.zeros(KMER, np.uint64)])
    first = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, np.maximum(1, sizes - KMER + 1), 0)
    total = int(counts.sum())
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + first[text]
    h = np.zeros(total, np.uint64)
    left = sizes[text] - (begin - first[text])
    for k in range(KMER):
        h += np.where(k < left, pad[begin + k], np.uint64(k)) * _WORD[k]
    h = mixed(h)
    return mixed(h + labels_of(mixed(h + text.astype(np.uint64) * _MIX)) * _MIX), counts


def bags(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row a text: how many of its words fall into each of ``BAG`` cells, 255 at most. One word put in, taken out or
    exchanged changes a row by two at most, so rows that lie further apart belong to texts that aren't similar."""
    cells = np.repeat(np.arange(len(sizes)) * BAG, sizes) + (flat % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=len(sizes) * BAG), 255).astype(np.uint8).reshape(-1, BAG)


def sketch(texts: list, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, the band keys (row per text) and the bags of words of whole texts."""
    n_words = np.zeros(len(texts), np.int64)
    keys = np.zeros((len(texts), bands), np.uint64)
    bag = np.zeros((len(texts), BAG), np.uint8)
    for a, b in slices(texts, 400_000):
        words = [words_of(t) for t in texts[a:b]]
        n_words[a:b] = sizes = np.array([len(w) for w in words], np.int64)
        flat = stable_hash([w for text in words for w in text])
        bag[a:b] = bags(flat, sizes)
        h, counts = kmers_of(flat, sizes)
        filled = np.flatnonzero(counts)
        if not len(filled):
            continue
        counts = counts[filled]
        starts = np.cumsum(counts) - counts
        place_bits = np.uint64(len(h).bit_length())
        low_bits = (np.uint64(1) << place_bits) - np.uint64(1)
        nth = np.arange(len(h), dtype=np.uint64)
        for band in range(bands):
            v = h * _SEEDS[band]
            v |= low_bits  # the last bits hold the place instead
            v ^= low_bits ^ nth
            places, values = [], []
            for _ in range(PICKS):
                low = np.minimum.reduceat(v, starts)
                spent = low == _LAST
                place = (low & low_bits).astype(np.int64)
                place[spent] = 0
                places.append(np.where(spent, np.int64(2**62), place))
                values.append(np.where(spent, np.uint64(0), h[place]))
                v[place[~spent]] = _LAST
            order = np.argsort(np.stack(places), 0, kind="stable")
            picked = np.take_along_axis(np.stack(values), order, 0)
            key = np.full(len(filled), band, np.uint64)
            for row in picked:
                key = mixed(key * _MIX + row)
            keys[a + filled, band] = key
    return n_words, keys, bag


def _sketched(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bag = sketch(batch.column(1).to_pylist())
            flat = pa.array(keys.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
            rows = pa.array([r.tobytes() for r in bag], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(offsets, flat), rows], names=["atom", "n_words", "keys", "bag"])

    return docs.select("atom", "text").mapInArrow(run, "atom string, n_words long, keys array<long>, bag binary")


def _with_leader(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs`` with the columns of their leader's row in ``side``. A leader of many pairs is read in ``SALTS`` parts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    return salted.join(side.join(salted.select("leader", "salt").distinct(), "leader"), ["leader", "salt"]).drop("salt")


def _plausible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose bags of words don't rule out that they are similar."""
    bag = texts.select("node", "n_words", "bag")
    rows = _with_leader(pairs.join(bag, "node"), bag.toDF("leader", "leader_words", "leader_bag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for i in (4, 5))
            edits = (np.maximum(n, m) * (1 - least) + 1e-9).astype(np.int64)
            ok = (np.abs(one - two).sum(1, dtype=np.int64) <= 2 * edits) & (np.abs(n - m) <= edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["leader", "node"]).filter(pa.array(ok))

    return rows.select("leader", "node", "n_words", "leader_words", "bag", "leader_bag").mapInArrow(run, "leader long, node long")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (leader, node) whose texts (node, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            ok = []
            for leader, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if leader != last:
                    last, words = leader, words_of(a.as_py())
                ok.append(similarity(words, words_of(b.as_py()), least) is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["leader", "node"]).filter(pa.array(ok, pa.bool_()))

    rows = _with_leader(pairs.join(texts.select("node", "text"), "node"), texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")))
    return rows.select("leader", "node", "leader_text", "text").mapInArrow(run, "leader long, node long")


def _led(rows: DataFrame) -> DataFrame:
    """Rows (node, key, own) of keys with two nodes or more against the key's smallest node: node, key, leader. Keys without a
    row of their ``own`` length hold texts that all meet under the key of theirs, and are left out."""
    led = rows.withColumns({"leader": F.min("node").over(Window.partitionBy("key")), "any_own": F.max("own").over(Window.partitionBy("key"))})
    return led.where("any_own and node <> leader").select("node", "key", "leader")


def _mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, node) of keys whose nodes lie in several components, with the component as class. Only these are written."""
    of_key = Window.partitionBy("key")
    classed = rows.join(classes, "node").withColumns({"a": F.min("class").over(of_key), "b": F.max("class").over(of_key)})
    return keep(classed.where("a < b").select("key", "node", "class"), "near-rest")


def _degree(links: DataFrame) -> DataFrame:
    ends = (links.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n")) for end in ("leader", "node"))
    return next(ends).unionByName(next(ends)).groupBy("node").agg(F.sum("n").alias("n_links"))


def _unlike(of: pa.Table, least: float) -> pa.Table:
    """Pairs of a block pair (rows as in ``_rest``) that lie in different components and may be similar, or if texts are
    given, are. Only pairs that share one of ``keys`` count; where both are ``outside``, once."""
    node, side, outside, group, n = (of.column(c).to_numpy() for c in ("node", "first", "outside", "class", "n_words"))
    bag = np.frombuffer(b"".join(of.column("bag").to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16)
    keys, words = [frozenset(k) for k in of.column("keys").to_pylist()], {}

    def alike(x: int, y: int) -> bool:
        for at in (x, y):
            if at not in words:
                words[at] = words_of(of.column("text")[at].as_py())
        return similarity(words[x], words[y], least) is not None

    pairs = []
    for x in np.flatnonzero(side):
        edits = (np.maximum(n, n[x]) * (1 - least) + 1e-9).astype(np.int64)
        other = np.flatnonzero(~side & (group != group[x]) & (np.abs(n - n[x]) <= edits) & (~outside | (node > node[x])))
        other = other[np.abs(bag[other] - bag[x]).sum(1, dtype=np.int64) <= 2 * edits[other]]
        pairs += [(min(node[x], node[y]), max(node[x], node[y])) for y in other if not keys[x].isdisjoint(keys[y]) and ("text" not in of.column_names or alike(x, y))]
    return pa.table({"leader": pa.array([p[0] for p in pairs], pa.int64()), "node": pa.array([p[1] for p in pairs], pa.int64())})


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, class) in pairs of blocks (key, i, j): those that are ``first`` are to meet the others of their pair.

    Of two nodes in different components one at least stands outside the key's largest component. So those outside, which
    leaders leave few of, meet all nodes, in blocks: the largest component is never held against itself."""
    of_key, all_of_key = Window.partitionBy("key"), F.count("*").over(Window.partitionBy("key"))
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "class")))
    sized = sized.withColumn("outside", F.col("class") != F.max_by("class", F.struct("n", "class")).over(of_key))
    n_outside, large = F.count_if("outside").over(of_key), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(all_of_key / F.lit(LARGE[1])))
    small = F.ceil(all_of_key / F.lit(BLOCK))
    sized = sized.withColumns({"is": F.ceil(n_outside / F.lit(LARGE[0])), "js": F.when(n_outside > BLOCK, F.least(small, large)).otherwise(small)})
    at = F.xxhash64("node")

    def blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    rest = ["outside", *(c for c in rows.columns if c != "key")]
    one = sized.where("outside").select("key", F.pmod(at, F.col("is")).alias("i"), blocks("js").alias("j"), F.lit(True).alias("first"), *rest)
    two = sized.select("key", blocks("is").alias("i"), F.pmod(at, F.col("js")).alias("j"), F.lit(False).alias("first"), *rest)
    return one.unionByName(two)


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, class) with ``keys``, in groups: near copies share most of their keys, so keys with the same largest
    component become one, with each node once, where all its pairs are fewer than those of its keys one by one."""
    of_key = Window.partitionBy("key")
    topped = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "class"))).withColumn("top", F.max_by("class", F.struct("n", "class")).over(of_key))
    met = F.when(F.col("class") != F.col("top"), F.count("*").over(of_key))
    nodes = topped.withColumn("met", met).groupBy("top", "node").agg(F.first("class").alias("class"), F.collect_list("key").alias("keys"), F.sum("met").alias("met"))
    tops = nodes.groupBy("top").agg((F.count("*") * F.count_if(F.col("class") != F.col("top"))).alias("at_once"), F.sum("met").alias("by_key"))
    one = F.array(F.struct(F.xxhash64("top").alias("key"), "keys"))
    each = F.transform("keys", lambda k: F.struct(k.alias("key"), F.array(k).alias("keys")))
    groups = nodes.join(tops, "top").select("node", "class", F.explode(F.when(F.col("at_once") <= F.col("by_key"), one).otherwise(each)).alias("group"))
    return groups.select("group.key", "node", "class", "group.keys")


def _rest(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs (leader, node) of different components within the keys of ``rows`` (key, node, class) that may be similar, or
    that are, if ``texts`` have a text."""
    met = _dealt(_grouped(rows)).join(texts.select("node", "n_words", "bag", *(c for c in texts.columns if c == "text")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            of = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                yield from _unlike(held.slice(begin, end - begin), least).to_batches()
            held = held.slice(cuts[-1])
        if held is not None:
            yield from _unlike(held, least).to_batches()

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "leader long, node long").distinct()


def _next_led(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (key, node, class) with the next two leaders of their key as leds (node, class): the text with most links so far, as the original
    of many variants has, and the first in one order of all texts."""
    of_key, of_all = F.xxhash64("key", "node"), F.xxhash64("node")
    ranked = rows.join(_degree(links), "node", "left").select("key", "node", "class", F.struct(F.coalesce("n_links", F.lit(0)), of_key).alias("rank"), of_all.alias("chance"))
    one, group = F.struct("node", "class"), Window.partitionBy("key")
    return ranked.select("key", "node", "class", F.array_distinct(F.array(F.max_by(one, "rank").over(group), F.min_by(one, "chance").over(group))).alias("leds"))


def _against(led: DataFrame) -> DataFrame:
    """Rows of ``_next_led`` against those of their leaders that lie in other components: key, node, leader. Of two leaders, the second meets the first."""
    first = F.col("leds")[0]["node"]
    other = F.filter("leds", lambda x: (x["class"] != F.col("class")) & (~F.col("was_led") | (x["node"] == first)))
    return led.withColumn("was_led", _was_led()).select("key", "node", F.explode(F.transform(other, lambda x: x["node"])).alias("leader"))


def _was_led() -> Column:
    return F.array_contains(F.transform("leds", lambda x: x["node"]), F.col("node"))


def _links(led: DataFrame, texts: DataFrame, least: float, tested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Compare rows with their leaders, but for pairs ``tested`` before. Gives the links and the pairs compared."""
    pairs = led.select("leader", "node").distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["leader", "node"], "left_anti")
    pairs = keep(pairs, "near-pairs")
    likely = keep(_plausible(pairs, texts, least), "near-likely")
    return keep(_verified(likely, texts, least), "near-links"), pairs


def _joined(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` (node, class) after the links ``found`` between their nodes."""
    ends = found.join(classes, "node").withColumnRenamed("class", "a").join(classes.toDF("leader", "b"), "leader")
    moved = components(ends.select("a", "b").where("a <> b").distinct()).toDF("class", "component")
    return keep(classes.join(moved, "class", "left").select("node", F.coalesce("component", "class").alias("class")), "near-classes")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Every row of ``docs`` as id, class_id, keeper (the first row of its class), n_links, and atom (MD5 of the text).

    class_id is the smallest id in the class. n_links counts the different texts that the text was verified against.
    Equal texts share a class without being compared; null counts as the empty text. Texts without a word meet equal
    texts only. Of rows that repeat an id and text, one is the keeper. An empty table gives no rows. Texts are compared
    whole; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("atom", F.md5("text"))
    unique = (
        _sketched(source).groupBy("atom").agg(F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("bag").alias("bag"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = keep(unique, "near-nodes")  # node numbers are fixed by this write
    step = math.log(1 / least)
    length = F.floor(F.log(F.col("n_words")) / F.lit(step)).cast("int")
    banded = nodes.where("n_words > 0").select(
        "node", F.explode(F.transform("keys", lambda k, i: F.struct(i.alias("band"), k.alias("key")))).alias("k"), length.alias("size_class")
    )
    sizes = F.array(F.struct("size_class", F.lit(True).alias("own")), F.struct((F.col("size_class") + 1).alias("size_class"), F.lit(False).alias("own")))
    banded = banded.select("node", F.explode(sizes).alias("size"), "k.key")
    banded = banded.select("node", F.xxhash64("key", "size.size_class").alias("key"), "size.own")
    led = keep(_led(banded), "near-bands")
    bands = led.select("key", "node")  # their first leader has met them all

    wanted = led.select(F.explode(F.array("node", "leader")).alias("node")).distinct().join(nodes.select("node", "atom", "n_words", "bag"), "node")
    chosen = source.select("id", "atom").groupBy("atom").agg(F.min("id").alias("one")).join(wanted, "atom")
    chosen = chosen.withColumnRenamed("atom", "own")
    of_one = source.join(chosen, (F.col("atom") == F.col("own")) & F.col("id").eqNullSafe(F.col("one")))
    texts = keep(of_one.dropDuplicates(["node"]).select("node", "text", "n_words", "bag"), "near-texts")

    links, tested = _links(led, texts, least)
    found = components(links.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    classes = keep(texts.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("class")), "near-classes")
    rows = bands
    while True:
        led = keep(_next_led(_mixed(rows, classes), links), "near-led")
        found, pairs = _links(_against(led), texts, least, tested)
        n_found = found.count()
        if n_found:
            links, tested, classes = links.unionByName(found), tested.unionByName(pairs), _joined(classes, found)
        if n_found * FEW <= led.count():
            break
        of_use = _against(led).join(found, ["leader", "node"], "left_semi").select("key").distinct()
        rows = led.where(~_was_led()).select("key", "node").join(of_use, "key", "left_semi")

    found = keep(_rest(_mixed(bands, classes), texts, least), "near-links")
    if not found.isEmpty():
        links, classes = links.unionByName(found), _joined(classes, found)

    links = keep(links.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct(), "near-links")
    classed = nodes.select("node", "atom").join(classes, "node", "left").join(_degree(links), "node", "left")
    classed = classed.select("atom", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    members = keep(source.select("id", "atom").withColumn("nth", F.monotonically_increasing_id()).join(classed, "atom"), "near-members")
    # nulls first, as everywhere in Spark's order
    heads = members.groupBy("class").agg(F.min(F.struct("id", "nth")).alias("head"))
    return members.join(heads, "class").select(F.col("id").alias(id_col), F.col("head.id").alias("class_id"), (F.col("nth") == F.col("head.nth")).alias("keeper"), "n_links", "atom")


def one_of_each(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near duplicates, with all columns of ``docs``; nulls, empty texts, ties and repeated rows as in
    ``near_classes``. An empty table stays empty; columns of any name are kept."""
    keepers = near_classes(docs, id_col, text_col, least).where("keeper").select(F.col(id_col).alias("kept_id"), F.col("atom").alias("kept_atom"))
    with_row = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.md5(text_or_empty(text_col)).alias("atom"))
    kept = with_row.join(keepers, (F.col("atom") == F.col("kept_atom")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "atom").orderBy("atom"))  # repeated rows
    return kept.withColumn("nth", nth).where("nth = 1").select("doc.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).drop("atom")
