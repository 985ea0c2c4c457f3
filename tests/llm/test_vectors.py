"""Operators on embeddings and on drawn documents: brute force, nulls, ties, repeated rows, clashing names, no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from saleglass.llm import common, importance, top_search, vector_codes

ROWS = 230


def drawn(rng, n, width):
    return [list(map(float, np.float32(rng.normal(0, 0.3, width)))) for _ in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    """Ids with ties, copies, nulls, short and empty vectors, and column names that the operators use inside."""
    common.ship(spark)
    rng = np.random.default_rng(5)
    rows = [(i, v, i % 4 if i % 9 else None) for i, v in enumerate(drawn(rng, ROWS, 16))]
    rows += [(ROWS + i, rows[7][1], 1) for i in range(60)]  # copies under ids of their own
    rows += [rows[40], rows[40], (60, rows[3][1], 2)]  # repeated rows, and an id with two vectors
    rows += [(1000, None, 1), (1020, [0.1, None], 1), (1040, [float("nan")] * 16, 1), (1060, [float("inf")] * 16, None)]
    rows += [(1080, [], 3), (1100, [0.5, -0.25, 9.0], 3), (None, rows[2][1], None), (1120, [3e38, -3e38] * 8, 0)]
    shape = "vec_id long, embedding array<float>, label int, block int, v int, score int, place int, part int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], shape).repartition(5)


def whole(rows, factor, limit):
    out = []
    for r in rows:
        v = r["embedding"]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((r["vec_id"], [math.floor(min(max(factor * x, -limit), limit)) for x in v], r["label"]))
    return out


def test_search_equals_brute_force():
    rng = np.random.default_rng(0)
    for case in range(40):
        width, n, m, k = (int(rng.integers(0, top)) for top in (20, 5000, 40, 30))
        most = [3, 100, 2**20, 2**26][case % 4]
        x, q = (rng.integers(-most, most + 1, (size, width)) for size in (n, m))
        if n and case % 3 == 0:
            x[rng.random(n) < 0.5] = x[0]
        ids = rng.permutation(2 * n)[:n]
        place, found, score = top_search.search(q, x, ids, k + 1)
        exact = q @ x.T
        for j in range(m):
            order = np.lexsort((ids, -exact[j]))[: k + 1]
            assert list(zip(ids[order], exact[j][order], strict=True)) == list(zip(found[place == j], score[place == j], strict=True))


def test_bounds_never_lie_below_the_product():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-99, 99, (50, 32)), rng.integers(-99, 99, (70, 32))
    bounds = [top_search.described(q, s) @ top_search.described(x, s).T for s in top_search.resolutions(32)]
    assert all((finer <= coarser * (1 + 1e-5) + 1).all() for coarser, finer in zip(bounds, bounds[1:], strict=False))
    assert (bounds[-1] * (1 + 1e-5) + 1 >= q @ x.T).all()


def test_top_matches_of_odd_rows(vectors):
    rows = whole(vectors.collect(), 64, top_search.LIMIT)
    want = Counter()
    for i, (query, q, _) in enumerate(rows):
        if query is None or query % 20:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=False)), math.inf if r is None else r) for j, (r, x, _) in enumerate(rows) if j != i]
        for rank, (score, r) in enumerate(sorted(scored)[:7], 1):
            want[query, rank, None if r == math.inf else r, -score] += 1
    for out in (top_search.top_matches(vectors, 7, 64), top_search.top_matches(vectors, 7, 64, rows_a_block=40, queries_a_block=3)):
        assert out.columns == ["query_id", "rank", "vec_id", "score"]
        assert Counter(map(tuple, out.collect())) == want
    assert top_search.top_matches(vectors.limit(0), 7, 64).count() == 0
    assert top_search.top_matches(vectors.where("vec_id = 20"), 7, 64).count() == 0


def features_of(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 500 for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, n, percent):
    held, goal = Counter(), Counter()
    for _, t in rows:
        held.update(features_of(t, n)[1])
    for t in target:
        goal.update(features_of(t, n)[1])
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (held.total() + 500) / ((held[b] + 1) * (goal.total() + 500)))) for b in held}
    out = []
    for i, t in rows:
        words, f = features_of(t, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[3], r[2], r[1]))
    drawn = len(able) * percent // 100
    rest = [(*r, None) for r in out if r[1] < 20]
    return Counter([(*r, k if k <= drawn else None) for k, r in enumerate(able, 1)] + rest)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "COUNTED", 50)  # the head is thinned all the time
    monkeypatch.setattr(importance, "HEAD", 9)
    r = random.Random(n)
    words = ["The", "THE", "É", "ça", "x1", "don't", "a-b", "", "\t", "日本", "w" * 100, *map(str, range(40))]
    rows = [(i, " ".join(r.choices(words, k=r.choice([3, 19, 20, 30, 90])))) for i in range(90)]
    rows += [(7, rows[7][1])] * 30 + [(8, "20 words " * 10)] + [(200, None), (201, ""), (202, " .,\n"), (None, "one two " * 15), (203, "long text " * 40_000)]
    target = [" ".join(r.choices(words, k=30)) for _ in range(5)] + [None, "", target_copy := "the ça the"] + [target_copy]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, score int, range int, n int").repartition(6)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    out = importance.resample(docs, goal, 30, n=n, buckets=500)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == resampled(rows, target, n, 30)
    assert importance.resample(docs.limit(0), goal, 30, n=n, buckets=500).count() == 0
    alone = importance.resample(docs, goal.limit(0), 30, n=n, buckets=500).collect()
    assert Counter(map(tuple, alone)) == resampled(rows, [], n, 30)


def lloyd(rows, parts, entries, rounds):
    """Codes, errors and codebooks of (id, vector) rows, by comparing everything with everything in Python's numbers."""
    longest = -(-max(len(v) for _, v in rows) // parts) * parts
    width = longest // parts
    cut = [[(v + [0] * (longest - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assigned()
        for p in range(parts):
            for j in range(len(first)):
                own = [c[p] for c, n in zip(cut, near, strict=True) if n[p][1] == j]
                books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else books[p][j]
    near = assigned()
    flat = ",".join(str(x) for p in books for e in p for x in e)
    return ["".join(f"{j:02x}" for _, j in n) for n in near], [sum(d for d, _ in n) for n in near], hashlib.sha256(flat.encode()).hexdigest()


def test_trees_settle_every_point_as_brute_force_does():
    rng = np.random.default_rng(2)
    for case in range(40):
        width, n, k = (int(rng.integers(1, top)) for top in (9, 1500, 17))
        most = [2, 50, 3000, 2**27][case % 4]
        x = rng.integers(-most, most + 1, (n, width))
        if case % 3 == 0:
            x[rng.random(n) < 0.5] = x[0]
        entries = x[rng.integers(0, n, k)] if case % 2 else rng.integers(-most, most + 1, (k, width))
        want = vector_codes.squares(x, entries).argmin(1)
        (_, points, inverse, counts), = vector_codes._parts(x, 1)
        tree = vector_codes.cover_tree(points, counts)
        assert (vector_codes.nearest(tree, entries)[inverse] == want).all()
        total, right = (np.zeros((k, width + 1), np.int64) for _ in range(2))
        again = vector_codes._loaded(vector_codes._stored(0, tree))
        for at, best in vector_codes.descend(again, entries):
            np.add.at(total, best, np.c_[again.sums[at], again.counts[at]])
        np.add.at(right, want, np.c_[x, np.ones(n, np.int64)])
        assert (total == right).all()


def test_whole_subtrees_are_settled_at_once():
    rng = np.random.default_rng(3)
    middles = rng.integers(-9000, 9000, (16, 8))
    x = np.unique(middles[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8)), axis=0)
    tree = vector_codes.cover_tree(x, np.ones(len(x), np.int64))
    assert sum(len(at) for at, _ in vector_codes.descend(tree, middles)) < len(x) / 20


@pytest.mark.parametrize("hot", [1000, 2])
def test_vector_codes_of_odd_rows(vectors, hot, monkeypatch):
    monkeypatch.setattr(vector_codes.with_group_total, "__defaults__", (hot,))
    monkeypatch.setattr(vector_codes, "TREE_ROWS", 64)
    rows = whole(vectors.where("vec_id is null or vec_id <> 1120").collect(), 4096, vector_codes.LIMIT)
    codes, errors, said = lloyd([(i, v) for i, v, _ in rows], 8, 16, 3)
    of_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        of_label[label] += e
    want = Counter((i, label, c, e, of_label[label], said) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
    out = vector_codes.encode(vectors.where("vec_id is null or vec_id <> 1120"), rounds=3)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, out.collect())) == want


def test_vector_codes_of_few_or_no_rows(vectors):
    assert vector_codes.encode(vectors.limit(0)).count() == 0
    few = vector_codes.encode(vectors.where("vec_id in (3, 5)")).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in few) == [(3, "00" * 8, 0), (5, "01" * 8, 0)]
    assert [(r["code"], r["error"]) for r in vector_codes.encode(vectors.where("vec_id = 1080")).collect()] == [("00" * 8, 0)]
    assert vector_codes.encode(vectors.where("vec_id = 1120")).first()["error"] == 0  # far beyond the bounds
