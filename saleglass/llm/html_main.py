"""Main text of web pages by inferred wrappers.

A wrapper is a union-free regular expression over a host's pages, held as a tree: elements in sequence, each of them
required, optional or repeated, with text that is constant or a slot. It grows page by page: the wrapper's and the next
page's token streams are aligned level by level; equal neighbours fold into a repeated group, an element without a
partner becomes optional, and differing text becomes a slot.

The element that holds the host's articles is an article or main element with text in slots, else the deepest one with
most of the slot text; constant text doesn't count (but where a host has one page, all text does). What a host of three
pages or more repeats in every page, element and text alike, is not part of an article and goes too, headings apart.

Words of class names tell containers apart only. A paragraph, item, cell or heading of the article stays whatever its
class speaks of, unless the whole name says advert or comment.

Wrappers are inferred within tasks, then merged by salted host and by host; no page leaves its task for that, and what
is merged has the size of a template. Pages then go through their host's wrapper.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import keep

SALTS, HELD_HOSTS, BROADCAST_BYTES = 16, 5000, 8_000_000
ALIGNED, TEMPLATE_PAGES = 250_000, 3

# Names of HTML elements and usual words of class names.
BLOCKS = frozenset(
    "html head body div p section article main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address hr details summary fieldset legend button select option optgroup textarea label dialog center menu search iframe object svg canvas video audio title".split()
)
DROPPED = frozenset("head title nav footer aside form button select textarea label dialog menu search iframe object svg canvas video audio fieldset".split())
RAW = frozenset("script style noscript template".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
KEPT = frozenset("html body main article".split())
HOLDERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "masthead cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup login share sharing social related recommended "
    "recommendations pagination pager toolbar widget copyright disclaimer".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
TALK = frozenset("feedback discussion discussions thread threads reviews responses talkback kommentar kommentare commentaires comentarios commenti".split())  # of lists
LISTS = frozenset("div ul ol dl".split())
FLOW = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption address summary".split())
NO_FLOW = frozenset("ad ads advert adverts advertisement advertising sponsored breadcrumb breadcrumbs pagination comment comments reply".split())
STATES = frozenset("has with no without open opened closed enabled disabled on off allowed".split())  # of a name such as comments-open
ARTICLES = frozenset("article content entry post story text".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


class Element:
    __slots__ = ("dropped", "items", "name", "sign", "spared")

    def __init__(self, name: str, words: tuple[str, ...] = ()) -> None:
        self.name, self.items = name, []
        self.sign = name + "".join(f".{w}" for w in words)
        parts = [[x for x in re.split(r"[^a-z]+", w) if x] for w in words]
        told = {x for own in parts if not STATES.intersection(own) for x in own}  # has-sidebar speaks of a neighbour
        if name in KEPT:
            named = name == "article" and any(w in COMMENTS for w in words)
        elif name in FLOW:
            named = any(w in NO_FLOW for w in words)
        else:
            named = bool(told & (BOILERPLATE | COMMENTS)) or name in LISTS and bool(told & TALK) and not told & ARTICLES
        self.dropped = name in DROPPED or named
        self.spared = name not in DROPPED and bool(told & ARTICLES) and not told & COMMENTS  # kept where nothing else is left

    def elements(self) -> list[Element]:
        return [x for x in self.items if isinstance(x, Element)]

    def text(self) -> str:
        """Its own text, without that of elements in it."""
        return squeezed("".join(x for x in self.items if isinstance(x, str)))


def parse(page: str | None) -> Element:
    """Tree of the block elements of a page. Inline elements leave only their text; scripts, styles and comments nothing."""
    page = page or ""
    root = Element("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()

    def close() -> str:
        name = stack.pop().name
        opened[name] -= 1
        return name

    while m := TOKEN.match(page, at):
        at = m.end()
        if not m[2]:
            if m[0][0] != "<":
                stack[-1].items.append(m[0])
            elif m[0] == "<":
                stack[-1].items.append("<")
            continue
        name = m[2].lower()
        if m[1]:
            while opened[name] and close() != name:
                pass
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            stack[-1].items.append(" ")
            continue
        words = tuple(sorted({w.lower() for x in NAMES.finditer(m[3]) for w in (x[1] or x[2] or x[3] or "").split()})) if m[3] else ()
        if name not in BLOCKS:
            new = Element(name, words)
            if name in VOID or not new.dropped:
                continue
        else:
            new = Element(name, words)
            while len(stack) > 1 and stack[-1].name == "p":
                close()
            if name in CLOSES and stack[-1].name in CLOSES[name]:
                close()
                if name == "tr" and stack[-1].name == "tr":
                    close()
        stack[-1].items.append(new)
        if name not in VOID and not m[3].endswith("/"):
            stack.append(new)
            opened[name] += 1
    return root


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


# Fields of a wrapper node; its children are the last one
SIGN, REPEATED, OPTIONAL, TEXT, CHARS, PAGES, KINDS, CHILDREN = range(8)
SLOT = -1


def as_wrapper(root: Element) -> list:
    """A page's own wrapper: [sign, repeated, optional, hash of constant text or ``SLOT``, characters of own text, pages, in the
    root hashes of up to ``TEMPLATE_PAGES`` different pages, children]. Parts that are dropped by their names have no text."""
    top: list = []
    whole = 0
    stack = [(root, top, False)]
    while stack:
        e, siblings, dropped = stack.pop()
        dropped |= e.dropped
        text = "" if dropped else e.text()
        node = [e.sign, False, False, crc32(text.encode()), len(text), 1, [], []]
        whole = crc32(text.encode(), whole)
        siblings.append(node)
        stack.extend((c, node[CHILDREN], dropped) for c in reversed(e.elements()))
    top[0][KINDS].append(whole)
    return merged(top[0])


def merged(*wrappers: list) -> list:
    """The wrapper of all of them: aligned children stay, the others become optional; equal neighbours become one repeated
    group; texts that differ become a slot."""
    out: list = []
    stack = [(out, list(wrappers), False, False)]
    while stack:
        node, sources, repeated, optional = stack.pop()
        texts = {s[TEXT] for s in sources}
        pages = max(s[PAGES] for s in sources) if repeated else sum(s[PAGES] for s in sources)
        node[:] = [
            sources[0][SIGN], repeated or any(s[REPEATED] for s in sources), optional or any(s[OPTIONAL] for s in sources),
            texts.pop() if len(texts) == 1 else SLOT, sum(s[CHARS] for s in sources), pages,
            sorted({k for s in sources for k in s[KINDS]})[:TEMPLATE_PAGES], [],
        ]
        groups = [([c], False) for c in sources[0][CHILDREN]]
        for s in sources[1:]:
            other = s[CHILDREN]
            pairs, joined, i, j = aligned([g[0][0][SIGN] for g in groups], [c[SIGN] for c in other]), [], 0, 0
            for x, y in [*pairs, (len(groups), len(other))]:
                joined += [(g, True) for g, _ in groups[i:x]] + [([c], True) for c in other[j:y]]
                if x < len(groups):
                    joined.append(([*groups[x][0], other[y]], groups[x][1]))
                i, j = x + 1, y + 1
            groups = joined
        k = 0
        while k < len(groups):
            own, missing = list(groups[k][0]), groups[k][1]
            stop = k + 1
            while stop < len(groups) and groups[stop][0][0][SIGN] == own[0][SIGN]:
                own += groups[stop][0]
                missing = missing and groups[stop][1]
                stop += 1
            child: list = []
            node[CHILDREN].append(child)
            stack.append((child, own, stop > k + 1, missing))
            k = stop
    return out


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence as pairs of places."""
    start, pairs = 0, []
    while start < min(len(a), len(b)) and a[start] == b[start]:
        pairs.append((start, start))
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    tail = [(len(a) - end + k, len(b) - end + k) for k in range(end)]
    if len(x) * len(y) > ALIGNED:
        return pairs + [(start + i, start + j) for i, j in _long_common(x, y)] + tail
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            pairs.append((start + i, start + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs + tail


def _long_common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of long lists. A row of the table is one number with a bit a column: 0 where the length
    grows by one, so a table of n by m cells takes n * m / 8 bytes and n operations on whole rows."""
    at: dict[str, int] = {}
    for j, sign in enumerate(y):
        at[sign] = at.get(sign, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for sign in x:
        row, same = rows[-1], at.get(sign, 0)
        rows.append((row + (row & same) | row & ~same) & full)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # no longer for this column
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:  # nor for this row
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def slot_text(wrapper: list) -> dict[int, int]:
    """Characters in slots of each node and all below it, by the node's identity. All text counts where no slot has any."""
    nodes, stack = [], [wrapper]
    while stack:
        nodes.append(stack.pop())
        stack.extend(nodes[-1][CHILDREN])
    slots = any(n[TEXT] == SLOT and n[CHARS] for n in nodes)
    total: dict[int, int] = {}
    for n in reversed(nodes):
        own = n[CHARS] if n[TEXT] == SLOT or not slots else 0
        total[id(n)] = own + sum(total[id(c)] for c in n[CHILDREN])
    return total


def content_path(wrapper: list) -> list[str]:
    """Signs from the root down to the element that holds the articles: an article element or the main one with text in
    slots, else the deepest that has at least 0.7 of all slot text."""
    total = slot_text(wrapper)
    best: tuple[int, int] = (0, 0)
    chosen: tuple | None = None
    stack: list[tuple[list, tuple | None]] = [(wrapper, None)]
    while stack:
        node, above = stack.pop()
        own, name, n = (node[SIGN], above), node[SIGN].split(".")[0], total[id(node)]
        if n and (name in ("article", "main") or ".main" in node[SIGN]) and (2 if name == "article" else 1, n) > best:
            best, chosen = (2 if name == "article" else 1, n), own
        if name != "article":
            stack.extend((c, own) for c in reversed(node[CHILDREN]))
    path: list[str] = []
    while chosen:
        path.append(chosen[0])
        chosen = chosen[1]
    if path:
        return path[::-1]
    path, node = [wrapper[SIGN]], wrapper
    while heavy := [c for c in node[CHILDREN] if not c[REPEATED] and c[SIGN].split(".")[0] in HOLDERS and total[id(c)] >= 0.7 * max(total[id(wrapper)], 1)]:
        node = heavy[0]
        path.append(node[SIGN])
    return path


def constants(wrapper: list) -> list[int]:
    """Hashes (sign and text) of the elements that every page of a host repeats with the same text, if it has enough
    different pages."""
    if len(wrapper[KINDS]) < TEMPLATE_PAGES:
        return []
    same = [n for n in _all(wrapper) if n[CHARS] and n[TEXT] != SLOT and not n[OPTIONAL] and n[PAGES] >= wrapper[PAGES]]
    return sorted({mark(n[SIGN], n[TEXT]) for n in same if n[SIGN].split(".")[0] not in HEADINGS})


def _all(wrapper: list) -> list[list]:
    nodes, stack = [], [wrapper]
    while stack:
        nodes.append(stack.pop())
        stack.extend(nodes[-1][CHILDREN])
    return nodes


def mark(sign: str, text: int) -> int:
    return crc32(f"{sign} {text}".encode())


def flat(wrapper: list) -> str:
    """A wrapper as JSON, one row a node with its depth, so that very deep ones don't nest."""
    rows, stack = [], [(0, wrapper)]
    while stack:
        depth, n = stack.pop()
        rows.append([depth, *n[:CHILDREN]])
        stack.extend((depth + 1, c) for c in reversed(n[CHILDREN]))
    return json.dumps(rows, separators=(",", ":"))


def unflat(text: str) -> list:
    path: list[list] = []
    for depth, *fields in json.loads(text):
        node = [*fields, []]
        del path[depth:]
        if path:
            path[-1][CHILDREN].append(node)
        path.append(node)
    return path[0]


def located(root: Element, path: list[str]) -> list[Element]:
    """Elements of a page at a wrapper's path; those of the nearest level that is there."""
    level = [root]
    for sign in path[1:]:
        found = [c for e in level for c in e.elements() if c.sign == sign and not c.dropped]
        if not found:
            found = [c for e in level for c in e.elements() if c.name == sign.split(".")[0] and not c.dropped]
        if not found:
            break
        level = found
    return level


def blocks(e: Element, known: frozenset[int] = frozenset(), spare: bool = False) -> Iterator[str]:
    """Blocks of text in page order, without parts that are dropped and those that the host repeats (``known``)."""
    stack: list[tuple[Element, int, bool]] = [(e, 0, False)]
    while stack:
        own, at, in_header = stack.pop()
        items, held = own.items, []
        while at < len(items) and isinstance(items[at], str):
            held.append(items[at])
            at += 1
        if held and not in_header and (text := squeezed("".join(held))):
            yield text
        if at == len(items):
            continue
        x = items[at]
        stack.append((own, at + 1, in_header))
        if x.dropped and not (spare and x.spared) or known and x.name not in HEADINGS and (text := x.text()) and mark(x.sign, crc32(text.encode())) in known:
            continue
        stack.append((x, 0, (in_header or x.name == "header") and x.name not in HEADINGS))


def main_text(page: str | None, path: list[str] | None, known: frozenset[int] = frozenset()) -> str:
    """Text of the element that the host's wrapper names; without a wrapper, the page's own."""
    root = parse(page)
    if path is None:
        path = content_path(as_wrapper(root))
    level = located(root, path)
    if not path[-1].startswith("article"):
        articles = [e for e in level if e.name == "article"]
        level = articles or level
    text = "\n".join(t for e in level for t in blocks(e, known))
    text = text or "\n".join(t for e in located(root, content_path(as_wrapper(root))) for t in blocks(e, known))
    return text or "\n".join(blocks(root, known, True))


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _joined(parts: list[str]) -> str:
    out = None
    for p in sorted(parts):
        out = unflat(p) if out is None else merged(out, unflat(p))
    return flat(out)


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON), n_pages."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, flat(w), n) for h, (w, n) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["host", "wrapper", "n_pages"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = as_wrapper(parse(page))
                had = held.get(host)
                held[host] = [w, 1] if had is None else [merged(had[0], w), had[1] + 1]
            if len(held) > HELD_HOSTS:
                yield flush()
        yield flush()

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": rows["host"].iloc[:1].values, "wrapper": [_joined(list(rows["wrapper"]))], "n_pages": [int(rows["n_pages"].sum())]})

    schema = "host string, wrapper string, n_pages long"
    part = pages.select(host_of(url_col).alias("host"), F.col(html_col)).mapInArrow(within, schema)
    part = part.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")).applyInPandas(together, schema)
    return part.groupBy("host").applyInPandas(together, schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every row of ``pages``. Null and empty pages have an empty text; pages without a host (null or
    broken url) share one wrapper. Repeated rows give repeated rows, an empty table none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules: dict[str | None, tuple] = {None: (None, frozenset())}
            texts = []
            for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rule not in rules:
                    path, known = json.loads(rule)
                    rules[rule] = path, frozenset(known)
                texts.append(main_text(page, *rules[rule]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = map(unflat, batch.column(1).to_pylist())
            paths = [json.dumps([content_path(w), constants(w)]) for w in wrappers]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    paths = keep(infer_wrappers(pages, url_col, html_col).select("host", "wrapper").mapInArrow(decide, "host string, path string"), "wrapper-paths")
    size = paths.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # beyond it, pages and paths meet by a shuffle
        paths = F.broadcast(paths)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host")).join(paths, "host", "left")
    return rows.select("page", "url", "html", "path").mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
