"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from saleglass.llm import common, decontamination, html_main, licenses, mixing, near_dedup, quality, sharding, suffix_dedup, token_output, toxicity
from saleglass.llm.alignment import similarity
from tests.llm.test_plain import levenshtein

R = random.Random(4)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(R.choices(WORDS, k=n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


BASE = prose(120)
LONG = prose(6000)
TEXTS = [BASE, BASE, edited(BASE, 4), edited(BASE, 5), prose(60), None, "", "", "x", "   ", LONG, edited(LONG, 60), "De " * 60 + prose(4), "De " * 60 + prose(4), prose(30) + " " + BASE[:200], "é " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns with names that the operators use inside."""
    common.ship(spark)
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 1, "k", 2, 3, 4) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, prose(25), None, "s1", None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, atom string, size int, row int, node int")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def empty(docs):
    return docs.limit(0)


def test_shards(docs, rows):
    out = sharding.shard_documents(docs, 5).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows)
    slots, shard_of, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in out:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["atom"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    groups = Counter()
    for r in out:
        groups[r["atom"]] += r["size"]
    assert max(sizes.values()) >= max(groups.values())
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[5]["size"] == 16 and by_id[5]["text_crc32"] == 0 and by_id[5]["shard"] == by_id[6]["shard"]
    assert by_id[0]["text_crc32"] == zlib.crc32(BASE.encode())
    assert sharding.shard_documents(empty(docs), 5).count() == 0


def test_cuts_are_minimal_with_coarse_ranges(spark):
    sizes = [R.randrange(1, 50) for _ in range(300)]
    atoms = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(300))
    thin = spark.createDataFrame(list(zip(atoms, sizes, strict=True)), "atom string, size long")
    capacity, starts = sharding.plan_cuts(thin, 7, first_digits=1, more_digits=1)
    exact = sharding.smallest_capacity([sharding.Range(a, s, True) for a, s in zip(atoms, sizes, strict=True)], 7, False)
    filled = Counter()
    for a, s in zip(atoms, sizes, strict=True):
        filled[sum(a >= x for x in starts)] += s
    assert capacity == exact and max(filled.values()) <= exact


def test_mix(docs, rows):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    taken, total, target = Counter(), Counter(), {}
    n_words = {(r["doc_id"]): len((r["text"] or "").split()) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == n_words[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        total[s] += r["size"]
        target[s] = r["target"]
    assert set(target) == {None, "s0", "s1", "s2"}
    for s, t in target.items():
        assert t <= 2 * total[s] and abs(taken[s] - t) <= 1
    assert abs(sum(target.values()) - min(1.5 * sum(total.values()), 2 * sum(total.values()))) < 1e-6
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(empty(docs)).count() == 0


def test_overlapping_sources_share_documents(spark):
    sized = spark.createDataFrame([(i, i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(20)], "id long, row long, members array<string>, size long")
    out = mixing.mix(sized, {"a": 120, "b": 90}).collect()
    by = Counter()
    for r in out:
        for p in r["parts"]:
            by[p["source"]] += p["words"]
    assert by == {"a": 120, "b": 90}


def test_mixed_documents_repeat_rows(docs):
    plan = mixing.mix_sources(docs).collect()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    for d in want:
        assert abs(got[d] - want[d]) <= 1, d


def test_ledger_and_ablation(docs, rows):
    out = quality.ledger(docs)
    assert out.count() == len(rows) and quality.ledger(empty(docs)).count() == 0
    failed = [r["failed"] for r in out.collect()]
    bits = quality.POLICIES["v1"]
    for r in quality.ablation(out, "v1").collect():
        assert r["n_failed"] == sum(f & r["bit"] != 0 for f in failed)
        assert r["n_alone"] == sum(f & bits == r["bit"] for f in failed)
        assert r["n_kept_without"] == sum(f & (bits & ~r["bit"]) == 0 for f in failed)
    assert {r["doc_id"]: r["failed"] for r in out.collect()}[5] == quality.mask("few_words")


def test_near_classes_against_brute_force(docs, rows):
    out = near_dedup.near_classes(docs).collect()
    assert len(out) == len(rows)
    n = len(rows)
    words = [(r["text"] or "").lower().split() for r in rows]
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            alike = (rows[i]["text"] or "") == (rows[j]["text"] or "")
            close = longer and min(len(words[i]), len(words[j])) >= 0.8 * longer
            if close and not alike:  # long texts by the aligner, which is held against ``levenshtein`` elsewhere
                close = levenshtein(words[i], words[j]) <= 0.2 * longer if longer < 400 else similarity(words[i], words[j], 0.8) is not None
            if alike or close:
                group = [group[j] if g == group[i] else g for g in group]
    want = defaultdict(list)
    for i in range(n):
        want[group[i]].append(rows[i]["doc_id"])
    got = defaultdict(list)
    for r in out:
        got[r["class_id"]].append(r["doc_id"])

    def plain(x):
        return sorted(sorted(map(str, v)) for v in x.values())

    assert plain(got) == plain(want)
    assert sum(r["keeper"] for r in out) == len(want)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert near_dedup.near_classes(empty(docs)).count() == 0


def test_polluted_bands_lose_no_link(spark):
    """Many texts that share a passage but aren't alike, among them pairs that are."""
    shared = prose(40)
    texts = []
    for _ in range(25):
        own = prose(22)
        texts += [shared + " " + own, shared + " " + edited(own, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
    assert all(classes[2 * i] == classes[2 * i + 1] for i in range(25))


def changed(text, places):
    """Words at the places replaced by ones found nowhere else."""
    w = text.split()
    for p in places:
        w[p] = f"z{R.randrange(10**9)}"
    return " ".join(w)


def test_stars_and_chains_lose_no_link(spark):
    """Variants of one original aren't alike among themselves; of A, B and C only A and C aren't."""
    texts = []
    for _ in range(3):
        star = prose(200)
        texts += [star, *(changed(star, R.sample(range(200), 24)) for _ in range(40))]
    for _ in range(30):
        a = prose(150)
        b = changed(a, range(100, 120))
        texts += [a, b, changed(b, range(130, 148))]
    R.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
    words, (_, keys, _) = [near_dedup.words_of(t) for t in texts], near_dedup.sketch(texts)
    met = 0
    for i in range(len(texts)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and similarity(words[i], words[j], 0.8) is not None:
                met += 1
                assert classes[i] == classes[j]
    assert met > 100 and len(set(classes.values())) >= 33


def test_bands_find_pairs_at_the_verified_similarity():
    """Scattered substitutions, at 0.80, 0.85 and 0.90."""
    for n in (50, 200, 600):
        for share, least in ((0.2, 0.95), (0.15, 0.99), (0.1, 0.99)):
            texts = []
            for _ in range(150):
                text = prose(n)
                texts += [text, changed(text, R.sample(range(n), int(n * share)))]
            keys = near_dedup.sketch(texts)[1]
            assert (keys[::2] == keys[1::2]).any(1).mean() >= least, (n, share)


def test_leaks(docs, spark):
    benchmark = spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, None), (3, ""), (4, prose(30))], "item_id long, text string")
    out = decontamination.find_leaks(docs, benchmark).collect()
    assert {r["doc_id"] for r in out} >= {0, 1} and {r["item_id"] for r in out} == {1}
    first = next(r for r in out if r["doc_id"] == 0)
    assert (first["n_edits"], first["first_word"], first["end_word"]) == (0, 20, 60)
    kept = decontamination.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out}
    assert decontamination.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.find_leaks(empty(docs), benchmark).count() == 0


def test_leaks_in_several_blocks(docs, spark, monkeypatch):
    words = BASE.split()
    benchmark = spark.createDataFrame([(i, " ".join(words[i : i + 30])) for i in range(0, 90, 10)] + [(99, prose(30))], "item_id long, text string")
    clash = docs.withColumn("item_id", F.lit(7)).withColumn("n_edits", F.lit(None).cast("int"))
    whole = decontamination.find_leaks(clash, benchmark).collect()
    clean = decontamination.without_leaks(clash, benchmark).collect()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert sum(1 for shared, alone in decontamination.item_blocks(benchmark) if not alone) > 2
    assert sorted(map(str, decontamination.find_leaks(clash, benchmark).collect())) == sorted(map(str, whole)) and whole
    assert sorted(map(str, decontamination.without_leaks(clash, benchmark).collect())) == sorted(map(str, clean)) and clean


def test_leaks_of_items_with_text_ids_that_repeat(docs, spark):
    words = BASE.split()
    rows = [("x", " ".join(words[20:60])), ("x", " ".join(words[60:90])), (None, " ".join(words[90:120])), ("y", prose(30))]
    out = decontamination.find_leaks(docs.where("doc_id = 0"), spark.createDataFrame(rows, "item_id string, text string")).collect()
    found = {(r["item_id"], r["n_item_words"], r["first_word"], r["end_word"]) for r in out}
    assert found == {("x", 40, 20, 60), ("x", 30, 60, 90), (None, 30, 90, 120)}


def test_licenses(docs, spark):
    one = spark.createDataFrame([(1, prose(50) + " Licensed under the Apache License, Version 2.0. " + prose(9), 5)], "doc_id long, text string, license int")
    assert [(r["license"], r["coverage"], r["first_word"]) for r in licenses.scan_licenses(one).collect()] == [("Apache-2.0-notice", 1.0, 50)]
    assert licenses.scan_licenses(docs).count() == 0 and licenses.scan_licenses(empty(docs)).count() == 0


def test_toxicity(docs, spark, rows):
    texts = [prose(30) + (" vile " if i % 4 == 0 else " ") + prose(10) for i in range(400)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, None, None), (399, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(df, labels)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, net).collect()}
    right = np.mean([(out[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400)])
    assert right > 0.95
    kept = toxicity.without_toxic(df, net)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in out.items() if s < 0.7}
    scores = toxicity.score(docs, net)
    assert scores.count() == len(rows) and {r["doc_id"]: r["score"] for r in scores.collect()}[5] == 0.0
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(empty(docs), net).count() == 0


def test_token_output(docs, rows):
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    blocks = common.keep(token_output.encode_documents(docs, path), "test-blocks")
    out = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_documents(blocks).collect()), key=str)
    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"] is not None, r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert out == sorted(want, key=str)
    assert at > 4096  # a document is split over blocks
    assert token_output.read_documents(common.keep(token_output.encode_documents(empty(docs), path), "test-blocks")).count() == 0
    bad = blocks.withColumn("crc", blocks["crc"] + 1)
    with pytest.raises(Exception, match="DamagedBlock"):
        token_output.decode_blocks(bad).count()


def test_words_are_tokenized_as_whole_texts_are():
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    texts = ["", "Don't STOP now\x1c x y", "á ́b", "<|endoftext|> it's 123\t\n\x0b½", "日本語 text ❤️"]
    ids, sizes = token_output.Words(path).encode(texts)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_html(spark):
    common.ship(spark)
    body = [prose(30) for _ in range(8)]
    pages = [(i, f"http://h{i % 2}.org/{i}", f"<nav>menu</nav><div id=c><h1>t{i}</h1><p>{body[i]}</p></div><footer>f</footer>", 1) for i in range(8)]
    pages += [(8, None, None, 1), (9, "x", "", 1), (10, "http://h0.org/", "<p>a &amp;\n b", 1), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int")
    out = html_main.extract(df).collect()
    assert len(out) == len(pages)
    text = {r["page_id"]: r["text"] for r in out}
    assert all(text[i] == f"t{i}\n{body[i]}" for i in range(8))
    assert text[8] == "" and text[9] == "" and text[10] == "a & b"
    assert html_main.extract(df.limit(0)).count() == 0
    clash = df.select(df.page_id.alias("host"), df.url.alias("path"), df.html.alias("wrapper"))
    again = {r["host"]: r["text"] for r in html_main.extract(clash, "host", "path", "wrapper").collect()}
    assert again == text


def test_repeated_bytes_against_brute_force(docs, rows):
    out = suffix_dedup.remove_repeats(docs).collect()
    assert len(out) == len(rows)
    seen, want = {}, {}
    for r in sorted({(r["doc_id"], r["text"]) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw, hit = (r[1] or "").encode(), []
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                hit.append((k, k))
            seen.setdefault(raw[k : k + 100], 1)
        cut = suffix_dedup.covered(len(raw), hit)
        gone = {j for a, b in cut for j in range(a, b)}
        kept = bytes(x for j, x in enumerate(raw) if j not in gone)
        want[r[0]] = (len(raw), len(gone), len(cut), hashlib.sha256(kept).hexdigest(), kept)
    for r in out:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = common.documents(spark, sf_dir)
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        out = common.keep(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        if name != "source_mixing":
            assert 0.5 * n < out.count() < n
            n = out.count()
        docs = out
    tokens = p.STAGES[-1][1](spark, docs, sf_dir)
    assert tokens.count() == docs.count() and tokens.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert p.ORACLE_SQL is None


@pytest.mark.parametrize("block", [64, 7])
def test_all_pairs_of_a_band_are_compared(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = [" ".join(f"w{i // 3}x{k}" for k in range(40)) + f" end{i}" for i in range(60)]
    n_words, _, bag = near_dedup.sketch(texts)
    held = spark.createDataFrame([(i, int(n_words[i]), bytearray(bag[i].tobytes())) for i in range(60)], "node long, n_words long, bag binary")
    rows = spark.createDataFrame([(i % 2, i, 0 if i < 6 else i) for i in range(60)], "key long, node long, class long")
    got = near_dedup._rest(rows, held, 0.8).collect()
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a // 3 == b // 3 and a % 2 == b % 2 and b >= 6}
    assert len(got) == len(want) and {(r["leader"], r["node"]) for r in got} == want


def test_the_largest_component_of_a_band_is_not_held_against_itself(spark):
    rows = spark.createDataFrame([(1, i, 0 if i < 640 else i) for i in range(644)], "key long, node long, class long")
    dealt = near_dedup._dealt(rows).collect()
    assert len(dealt) == 644 + 4 * 11 and {r["node"] for r in dealt if r["first"]} == {640, 641, 642, 643} and {r["node"] for r in dealt if not r["first"]} == set(range(644))


def test_what_leaders_of_a_band_leave_is_compared_too(spark, monkeypatch):
    """All texts share one band: three pairs of similar texts among many unlike ones, which leaders don't meet."""
    sketched = near_dedup._sketched
    monkeypatch.setattr(near_dedup, "_sketched", lambda docs: sketched(docs).withColumn("keys", F.array(F.lit(1).cast("long"))))
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(40)) + f" end{j}") for i in range(90) for j in range(2 if i % 30 == 0 else 1)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_next_leaders_are_met_by_texts_of_other_components_only(spark):
    rows = spark.createDataFrame([(1, i, 0 if i < 200 else i) for i in range(202)], "key long, node long, class long")
    links = spark.createDataFrame([(0, i) for i in range(1, 200)], "leader long, node long")
    led = near_dedup._against(near_dedup._next_led(rows, links)).collect()
    assert {r["node"] for r in led} == {200, 201} and 2 <= len(led) <= 4 and all((r["leader"] == 0) or (r["leader"] != r["node"]) for r in led)


def test_bands_of_one_component_meet_as_one_group(spark):
    """Twenty bands of the same near copies and two strays: each text once, and links only, each once."""
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(100)] + [" ".join([*base[:36], *(f"s{j}x{k}" for k in range(4 + 8 * j))]) for j in range(2)]
    n_words, _, bag = near_dedup.sketch(texts)
    held = spark.createDataFrame([(i, int(n_words[i]), bytearray(bag[i].tobytes()), t) for i, t in enumerate(texts)], "node long, n_words long, bag binary, text string")
    rows = spark.createDataFrame([(k, i, 0 if i < 100 else i) for k in range(20) for i in range(102)], "key long, node long, class long")
    assert near_dedup._grouped(rows).count() == 102
    got = near_dedup._rest(rows, held, 0.8).collect()
    want = {(i, j) for i in range(102) for j in (100, 101) if i < j and similarity(texts[i].split(), texts[j].split(), 0.8) is not None}
    assert 100 <= len(want) < 201 and len(got) == len(want) and {(r["leader"], r["node"]) for r in got} == want


def test_texts_of_one_length_share_one_key_of_a_band(spark):
    rows = spark.createDataFrame([(1, 1, True), (2, 1, True), (1, 2, False), (2, 2, False), (3, 3, True), (4, 3, False)], "node long, key long, own boolean")
    assert [tuple(r) for r in near_dedup._led(rows).orderBy("key").collect()] == [(2, 1, 1), (4, 3, 3)]
