"""Parts of the corpus operators that need no Spark session, against brute force."""

import random
import re
import time
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from saleglass.llm import alignment, decontamination, html_main, id_coder, licenses, mixing, quality, sharding, suffix_dedup, toxicity

R = random.Random(1)


@pytest.fixture(autouse=True)
def seeded():
    """Each test has its own course of random numbers, whatever ran before it."""
    R.seed(1)


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_is_the_edit_distance_up_to_its_limit():
    for _ in range(3000):
        a = [R.randrange(3) for _ in range(R.randrange(14))]
        b = [R.randrange(3) for _ in range(R.randrange(14))]
        d = levenshtein(a, b)
        for k in range(0, 15, 2):
            assert alignment.edit_distance(a, b, k) == (d if d <= k else None)


def test_find_gives_the_nearest_part():
    for _ in range(1000):
        p, t = [R.randrange(3) for _ in range(R.randrange(1, 6))], [R.randrange(3) for _ in range(R.randrange(10))]
        best = min(levenshtein(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        d, a, b = alignment.find(p, t, len(p))
        assert d == best == levenshtein(p, t[a:b])


@pytest.mark.parametrize("inside", [True, False])
def test_smallest_capacity_against_brute_force(inside):
    for _ in range(300):
        sizes = [R.randrange(1, 30) for _ in range(R.randrange(1, 9))]
        shards = R.randrange(1, 5)
        ranges = [sharding.Range(format(i, "03x"), s, True) for i, s in enumerate(sizes)]

        def cost(rest, k):
            if k == 1 or not rest:
                return sum(rest)
            return min(max(sum(rest[:i]), cost(rest[i:], k - 1)) for i in range(len(rest) + 1))

        c = sharding.smallest_capacity(ranges, shards, inside)
        assert c == cost(sizes, shards)
        starts = sharding.cut(ranges, shards, c)
        filled = Counter()
        for r in ranges:
            filled[sum(r.prefix >= s for s in starts)] += r.size
        assert max(filled.values()) <= c and len(starts) == shards - 1


def test_capped_targets_share_all_words_by_weight():
    totals = {"a": 100, "b": 10, "c": 500, "d": 40}
    t = mixing.capped_targets(totals, {"a": 3, "b": 1, "c": 2, "d": 3}, 1.5, 2.0)
    assert abs(sum(t.values()) - 975) < 1e-6
    assert t["a"] == 200 and t["b"] == 20 and t["d"] == 80 and abs(t["c"] - 675) < 1e-6
    assert mixing.capped_targets({}, {}, 1.5, 2.0) == {}
    assert mixing.capped_targets({"a": 0}, {"a": 1}, 1.5, 2.0) == {"a": 0.0}


def test_route_prefers_first_readings_over_repeats():
    routed = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 12})
    assert routed == {("a",): {"a": 10}, ("a", "b"): {"a": 0, "b": 10}, ("b",): {"b": 2}}
    assert mixing.route({("a",): 5}, {"a": 99}) == {("a",): {"a": 10}}  # two laps at most


def test_quality_measures_against_brute_force():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    texts = ["", " \n\t", "one", "a b " * 30, "é\x0bü\x0cß|<a> x\n\nsame\nsame", "x " * 7, "x " * 9]
    texts += ["".join(R.choice(["a ", "b ", "c\n", "#d ", "é"]) for _ in range(R.randrange(200))) for _ in range(80)]
    m = quality.measure([*texts, None])
    for i, t in enumerate([*texts, ""]):
        assert tuple(int(m[k][i]) for k in quality.MEASURES[:5]) == brute(t)


def test_network_learns_a_word_and_scores_every_window():
    clean = [f"w{R.randrange(50)}" for _ in range(4000)]
    texts, labels = [], []
    for i in range(240):
        words = R.sample(clean, 40)
        if i % 3 == 0:
            words[R.randrange(40)] = "horrid"
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    net = toxicity.train(texts, labels)
    codes = toxicity.Codes(net.vocabulary)
    long_bad = " ".join([*R.choices(clean, k=900), "Horrid!", *R.choices(clean, k=30)])
    s = net.scores([long_bad, " ".join(R.choices(clean, k=900)), "", None, "...", "horrid"], codes)
    assert s[0] > 0.7 > 0.3 > s[1] and list(s[2:5]) == [0, 0, 0] and s[5] > 0.5
    one = toxicity.train(["a"], [1])
    assert list(one.scores(["x", ""], toxicity.Codes([]))) == [1.0, 0.0]
    assert list(toxicity.train([], []).scores(["x"], toxicity.Codes([]))) == [0.0]


def test_windows_overlap_and_cover_all_words():
    place, text = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    for t, n in enumerate([0, 1, 32, 33, 100]):
        own = place[text == t]
        assert len(set(own[own >= 0].tolist())) == n
        assert len(own) == 0 or all(np.intersect1d(a, b).size for a, b in pairwise(own.tolist()))


def test_leaks_with_edits_are_found_and_others_are_not():
    items = [(i, [b"w%d" % R.randrange(400) for _ in range(20 + i)]) for i in range(12)]
    index = decontamination.Index(items)
    texts, want = [], set()
    for i, (_, w) in enumerate(items):
        w = list(w)
        for _ in range(i % 4):
            w[R.randrange(len(w))] = b"other"
        around = [b"v%d" % R.randrange(400) for _ in range(60)]
        texts.append(b" ".join([*around[:30], *w, *around[30:]]).decode().upper())
        want.add((i, i))
    texts += [" ".join(f"v{R.randrange(400)}" for _ in range(80)), "", None]
    assert {(t, item) for t, item, *_ in index.leaks(texts)} == want
    assert list(decontamination.Index([(1, [])]).leaks(["a b c"])) == []


@pytest.mark.parametrize("n", [40, 59, 80, 120, 200, 300])
def test_leaks_at_the_limit_of_edits_are_found_at_every_size(n):
    """Recall of 0.95 or more where a fifth of the words is edited, by all kinds of edits."""
    rng = random.Random(n)
    known = [b"w%d" % i for i in range(3000)]
    weights = [1 / (i + 10) for i in range(3000)]
    items = [(i, rng.choices(known, weights, k=n)) for i in range(60)]
    texts = []
    for _, words in items:
        words = list(words)
        for _ in range(n // 5):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(known)]
        texts.append(b" ".join([*rng.choices(known, weights, k=n), *words, *rng.choices(known, weights, k=n)]).decode())
    found = {(t, i): d for t, i, d, *_ in decontamination.Index(items).leaks(texts)}
    assert sum((i, i) in found for i in range(60)) >= 57
    assert all(d <= n // 5 for d in found.values())


def test_license_notices_are_found_with_their_spans():
    t = licenses.Templates()
    found = list(t.scan(["Some text. Released under the MIT License. More.", "nothing here at all", None, "", "licensed under CC BY-NC 4.0"]))
    assert [(i, m[0], m[2]) for i, m in found] == [(0, "MIT-notice", 5), (4, "CC-BY-NC-4.0", 7)]
    assert found[0][1][3:] == (2, 7)


def test_whole_licenses_against_brute_force():
    """Each template, also with some words changed, is found at its place; unlike texts and cut ones aren't."""
    t = licenses.Templates()
    lead = [f"w{i}" for i in range(2000)]
    for name, words in t.rows:
        words = [w.decode() for w in words]
        changed = [w if i % 17 or len(words) < 40 else "other" for i, w in enumerate(words)]
        for text in (words, changed):
            found = list(t.scan([" ".join(lead + text + lead[:50])]))
            ends = [m[3:] for _, m in found]
            assert ends and min(e[0] for e in ends) <= 2000 + 1 and max(e[1] for e in ends) >= 2000 + len(words) - 1, name
            longest = [len(w) for n, w in t.rows if n == name]
            assert any(m[0] == name or m[1] > min(longest) for _, m in found), name
        if len(words) > 100:
            half = [m for _, m in t.scan([" ".join(lead[:40] + words[: len(words) // 3])])]
            assert all(m[1] < len(words) for m in half)


def test_versions_and_kin_are_told_apart():
    t = licenses.Templates()
    texts = {" ".join(w.decode() for w in words): name for name, words in t.rows}
    lesser = next(x for x, name in texts.items() if name == "LGPL-2.1-notice")
    apache = max((x for x, name in texts.items() if name == "Apache-2.0-notice"), key=len)
    mit = next(w for name, w in t.rows if name == "MIT")
    cases = {
        lesser: "LGPL-2.1-notice",
        lesser.replace("2 1 of", "4 of"): "LGPL-other-version",
        lesser.replace("lesser ", ""): "GPL-other-version",
        "licensed under CC BY 4.0. 12 more": "CC-BY-4.0",
        "licensed under CC BY 3.0": "CC-BY-3.0",
        "licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 2.5 International License": "CC-BY-other-version",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-notice",
        "This work is licensed under the GNU General Public License, version 1": "GPL-other-version",
        apache.replace("version 2 0", "version 1 1"): "Apache-other-version",
        "This work is marked with CC0 1.0 Universal": "CC0-1.0-notice",
        " ".join(w.decode() for w in mit[: len(mit) * 7 // 10]): "MIT-grant",
    }
    for text, name in cases.items():
        found = [m[0] for _, m in t.scan([f"some words before it {text} and some after it"])]
        assert found == [name], (text, found)
    assert t.whole["MIT-grant"] == len(mit)


def test_banded_alignment_against_the_whole_table():
    """Score of the best local alignment, where the band holds every cell; matched words and span as one of the best."""

    def whole(a, b):
        best, rows = 0, [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[-1] - 1))
            rows.append(row)
            best = max(best, *row)
        return best

    for _ in range(150):
        a, b = ([R.choice("abcd") for _ in range(R.randrange(1, 14))] for _ in range(2))
        want, got = whole(a, b), licenses.align(a, b, 0, 20)
        if not want:
            assert got is None
            continue
        matched, start, end = got
        assert whole(a, b[start:end]) == want and 2 * matched >= want and matched <= end - start


def test_class_words_drop_no_paragraph_of_an_article():
    for word in "promotion related-work share-price social notice-board-history banner-headline widget-theory copyright-note".split():
        assert html_main.main_text(f"<article><p>Lead.</p><p class={word}>Body text.</p></article>", None) == "Lead.\nBody text.", word
    for word in "feedback discussion user-reviews thread kommentare".split():
        for page in (f"<article><p>Lead.</p><div class={word}><p>Nice</p></div></article>", f"<body><div><p>Lead.</p></div><div class={word}><div><p>Nice</p></div></div></body>"):
            assert html_main.main_text(page, None) == "Lead.", word
    assert html_main.main_text('<article><p>Lead.</p><p class="ad">Buy</p><section class=discussion><p>Found.</p></section></article>', None) == "Lead.\nFound."


def test_many_stray_end_tags_take_linear_time():
    start = time.perf_counter()
    assert html_main.main_text("<main>" + "<div>" * 20_000 + "word" + "</section>" * 20_000, None) == "word"
    assert time.perf_counter() - start < 3


def test_long_rows_of_elements_are_aligned_exactly():
    for n in (0, 1, 7, 60, 120):
        x, y = ([R.choice("abcd") for _ in range(n)] for _ in range(2))
        pairs = html_main._long_common(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in pairwise(pairs))
        assert len(pairs) == len(html_main.aligned(x, y))
    x = [R.choice("abcd") for _ in range(900)]
    assert html_main.aligned(x, x[:300] + ["z"] + x[350:]) and len(html_main.aligned(x + ["q"], ["r", *x, "s"])) == 900


def test_coder_round_trips_and_blocks_are_independent():
    rng = np.random.default_rng(3)
    blocks = [np.zeros(0, np.uint32), np.full(500, 49407, np.uint32), rng.integers(0, 65535, 333).astype(np.uint32), np.tile(rng.integers(0, 99, 40), 20).astype(np.uint32)]
    coded = id_coder.encode(blocks)
    for a, b in zip(blocks, id_coder.decode(coded, [len(b) for b in blocks]), strict=True):
        assert (a == b).all()
    alone = id_coder.decode(coded[3:], [len(blocks[3])])[0]
    assert (alone == blocks[3]).all() and len(coded[3]) < 400 and len(coded[1]) < 60


def test_main_text_without_boilerplate():
    page = (
        '<html><body class="has-sidebar"><header><nav>menu</nav></header><div id=wrap><div class="sidebar">side</div><div class="post-body"><h2>Title &amp; co</h2>'
        "<p>One &lt;b&gt; two<br>three<p>Four <a href=x>five</a><script>var x='</p>'</script><ul><li>a<li>b</ul><div class=ad-box>buy</div><form><input></form>"
        "</div><div class=comments><p>nice</p></div></div><footer>f</footer>"
    )
    assert html_main.main_text(page, None) == "Title & co\nOne <b> two three\nFour five\na\nb"
    assert html_main.main_text(None, None) == "" and html_main.main_text("", ["#root"]) == ""
    assert html_main.main_text("<article><h1>A</h1><p>b", ["#root", "article"]) == "A\nb"


def host_texts(pages):
    """Main texts of pages of one host."""
    w = html_main.merged(*[html_main.as_wrapper(html_main.parse(p)) for p in pages])
    w = html_main.unflat(html_main.flat(w))
    return [html_main.main_text(p, html_main.content_path(w), frozenset(html_main.constants(w))) for p in pages]


def test_wrappers_fold_repeats_and_mark_optional_parts():
    a = html_main.as_wrapper(html_main.parse("<div><h1>x</h1><p>a</p><p>b</p></div>"))
    b = html_main.as_wrapper(html_main.parse("<div><h1>y</h1><p>a</p><table></table></div>"))
    div = html_main.merged(a, b)[html_main.CHILDREN][0]
    got = [(c[html_main.SIGN], c[html_main.REPEATED], c[html_main.OPTIONAL], c[html_main.TEXT] == html_main.SLOT) for c in div[html_main.CHILDREN]]
    assert got == [("h1", False, False, True), ("p", True, False, True), ("table", False, True, False)]
    many = [html_main.as_wrapper(html_main.parse("<div>" + "".join(R.choice(["<p>x</p>", "<h2>y</h2>", "<table></table>"]) for _ in range(900)) + "</div>")) for _ in range(2)]
    assert html_main.merged(*many)[html_main.CHILDREN][0][html_main.SIGN] == "div"


def test_wrappers_tell_articles_from_what_a_host_repeats():
    same = "The same long words about this house and all that it offers to its readers. " * 20
    stories = [" ".join(R.choice("one two three four five six seven".split()) for _ in range(40)) for _ in range(6)]
    assert host_texts([f"<body><div class=a>{same}</div><div class=b><p>{x}</p></div></body>" for x in stories]) == stories
    inside = [f"<article><h1>About</h1><p>{x}</p><p>More words {x[:5]}</p><div>Write to us</div></article>" for x in stories]
    assert host_texts(inside) == [f"About\n{x}\nMore words {x[:5].strip()}" for x in stories]
    assert host_texts(inside[:1] * 4) == [f"About\n{stories[0]}\nMore words {stories[0][:5].strip()}\nWrite to us"] * 4  # copies of one page


def test_main_text_of_names_that_speak_of_states():
    for open_tag, close in (('<body class="comments-open single"><p>', ""), ('<article class="post comment-enabled"><p>', "</article>"), ('<div class="article-related-post"><p>', "</div>")):
        assert html_main.main_text(f"{open_tag}Words of it.</p>{close}", None) == "Words of it."
    assert html_main.main_text('<article>Words<article class="comment">nice</article></article>', None) == "Words"


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 5000 + "<p>ground" + "</div>" * 5000
    assert host_texts([deep, deep.replace("ground", "floor")]) == ["ground", "floor"]
    assert html_main.main_text("<main>" + "<p>word</p>" * 30000, None).count("word") == 30000


def test_anchors_are_the_first_smallest_grams_of_all_strings():
    s = suffix_dedup
    for k in range(30):
        raw = bytes(R.choice(b"abc ") for _ in range(R.randrange(80, 700))) if k % 3 else b"De " * R.randrange(20, 150)
        want = set()
        if len(raw) >= s.LENGTH:
            h = s.gram_hashes(np.frombuffer(raw, np.uint8)) & s._HIGH
            want = {i + int(np.argmin(h[i : i + s.SPAN])) for i in range(len(raw) - s.LENGTH + 1)}
        assert set(s.anchors([raw])[1].tolist()) == want
    two = [bytes(R.choice(b"abc ") for _ in range(300)) for _ in range(2)]
    piece, place, _ = s.anchors(two)
    for k in range(2):
        assert place[piece == k].tolist() == s.anchors([two[k]])[1].tolist()


def test_merged_transforms_mark_later_strings():
    s = suffix_dedup
    base = [bytes(R.choice(b"ab") for _ in range(s.BEFORE + s.LENGTH)) for _ in range(2)]
    rows = []
    for _ in range(12):
        x = bytearray(R.choice(base))
        if R.random() < 0.7:
            x[R.randrange(len(x))] ^= 1
        rows.append(bytes(x))
    around = np.array([list(r) for r in rows], np.uint16)
    around[3, :10] = 256
    marked = s.merge_transforms(np.zeros(12, int), np.arange(12), around)
    for shard in (1, 5, 7):
        assert (s.merge_transforms(np.zeros(12, int), np.arange(12), around, shard) == marked).all()
    group = np.repeat([0, 1], 6)
    apart = np.concatenate([s.merge_transforms(np.zeros(6, int), np.arange(6), around[k : k + 6]) for k in (0, 6)])
    assert (s.merge_transforms(group, np.arange(12), around, 4) == apart).all()
    for i in range(12):
        for o in range(s.SPAN):
            lo = s.BEFORE - o
            own = around[i, lo : lo + s.LENGTH].tolist()
            want = 256 not in own and any(around[j, lo : lo + s.LENGTH].tolist() == own for j in range(i))
            assert marked[i, o] == want
