"""Main text of web pages, by wrappers inferred from the pages of each host.

A page is a stream of tokens: opening and closing tags and texts. Streams of one host are aligned one
after another into a union-free regular expression, the host's wrapper: what repeats in place
becomes a repeated group, what only one side has becomes an optional group, and texts that differ become
slots, those that never do stay constants. Each text of the wrapper names the containers it stands in; from the slots and
constants of these places the article's places are chosen once for each host, and a page's text is what stands there.
Element names and class words only rank the places.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# Element names by what they do to text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol",
         "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "html",
             "main", "menu", "nav", "ol", "section", "table", "tbody", "td", "th", "tr", "ul", "button", "span"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
#: Words of class, id or role that mark what is no article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
         "contentinfo", "cookie", "cookies", "disqus", "dropdown", "footer", "gdpr", "header", "login", "menu", "menubar", "modal", "nav", "navbar", "navigation",
         "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "promoted", "related", "reply", "replies", "respond", "search", "share",
         "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)>"""
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def _signature(name: str, rest: str) -> tuple[str, bool]:
    """An opening tag as it stands in wrappers, and whether it opens boilerplate."""
    if not rest.strip("/ \n\t"):
        return name, name in BOILERPLATE
    attrs = {a.lower(): next((x for x in v if x), "") for a, *v in _ATTR.findall(rest)}
    words = re.split(r"[^a-z]+", " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower())
    bad = name in BOILERPLATE or any(w in MARKS for w in words) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
    if attrs.get("role", "").lower() == "main":
        name, bad = "main", False
    classes = ".".join(sorted(attrs.get("class", "").split()))
    return (f"{name}.{classes}" if classes else name).replace("/", "").replace("\t", ""), bad


class Page:
    """Blocks of text with their places, and the token stream.

    A place is the path of the containers around a block; one that opens boilerplate is marked by an exclamation mark.
    A text is a token of "#", a hash and, after a tab, its place.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []  # place, text
        self.stream: list[str] = []
        stack: list[tuple[str, str, bool]] = []
        parts: list[str] = []

        def close() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                place = "/".join(sign + "!" * bad for n, sign, bad in stack if n in CONTAINER and n != "span" or bad)
                self.blocks.append((place, text))
                self.stream.append("#" + hashlib.blake2b(text.encode(), digest_size=6).hexdigest() + "\t" + place)

        for m in _TOKEN.finditer(source):
            kind = m.lastgroup
            if m.group("text") is not None:
                parts.append(m.group("text"))
                continue
            if m.group("raw") is not None or kind is None or m.group("name") is None:
                if m.group("raw") is not None and m.group("raw").lower() in ("select", "textarea", "iframe", "video", "canvas", "object"):
                    parts.append(" ")
                continue
            name = m.group("name").lower()
            if name in BLOCK:
                if name == "br":
                    parts.append(" ")
                    continue
                close()
            if m.group("close"):
                if name in CONTAINER and any(n == name for n, _, _ in stack):
                    while stack.pop()[0] != name:
                        pass
                if name in BLOCK:
                    self.stream.append(f"</{name}>")
            elif name not in VOID:
                sign, bad = _signature(name, m.group("rest"))
                if name in CONTAINER and not m.group("rest").endswith("/"):
                    stack.append((name, sign, bad))
                if name in BLOCK:
                    self.stream.append(f"<{sign}>")
        close()


def _is_text(t) -> bool:
    return isinstance(t, str) and t.startswith("#")


def _slot(t: str) -> str:
    return "#" + t[t.index("\t"):]


def _key(t) -> str:
    """What two tokens must have in common to be aligned: texts their place, groups their tokens; a group of one token is as that token."""
    if isinstance(t, str):
        return _slot(t) if _is_text(t) else t
    return _key(t[1][0]) if len(t[1]) == 1 else "(" + " ".join(map(_key, t[1])) + ")"


def _opened(t) -> tuple[str, tuple]:
    """The kinds and the tokens of a group, of groups that hold nothing but a group as one."""
    kinds, inner = "", (t,)
    while len(inner) == 1 and isinstance(inner[0], tuple):
        kinds, inner = kinds + inner[0][0], inner[0][1]
    return kinds, inner


def _common(a, b) -> list:
    """Two alike sequences as one: texts that differ become slots, what one side repeats or leaves out is a group."""
    out = []
    for x, y in zip(a, b):
        if isinstance(x, str) and isinstance(y, str):
            out.append(x if x == y else _slot(x))
            continue
        (p, u), (q, v) = _opened(x), _opened(y)
        kinds, inner = p + q, tuple(_common(u, v))
        out.append(("*" if "*" in kinds else "?", inner))
    return out


def _balanced(tokens) -> bool:
    depth = 0
    for t in tokens:
        if isinstance(t, str) and t.startswith("</"):
            depth -= 1
        elif isinstance(t, str) and t.startswith("<"):
            depth += 1
        if depth < 0:
            return False
    return any(isinstance(t, str) and t.startswith("<") for t in tokens)


#: Tokens of the longest group that is looked for, and cells of an alignment's table.
MOST_GROUP, MOST_CELLS = 64, 1 << 22


def squeeze(tokens: list) -> list:
    """Fold what repeats in place into ('*', group), shortest first."""
    out: list = []
    keys: list[str] = []
    for t in tokens:
        out.append(t)
        keys.append(_key(t))
        if _is_text(t):
            continue
        for size in range(1, min(MOST_GROUP, len(out)) + 1):
            tail = out[-size:]
            before = out[-size - 1] if len(out) > size else None
            if isinstance(before, tuple) and before[0] == "*" and len(before[1]) == size and keys[-size:] == list(map(_key, before[1])):
                out[-size - 1:] = [("*", tuple(_common(before[1], tail)))]
                keys[-size - 1:] = [_key(out[-1])]
                break
            if len(out) >= 2 * size and keys[-size] == keys[-2 * size] and keys[-size:] == keys[-2 * size:-size] and _balanced(tail):
                out[-2 * size:] = [("*", tuple(_common(out[-2 * size:-size], tail)))]
                keys[-2 * size:] = [_key(out[-1])]
                break
    return out


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; beyond MOST_CELLS one through keys that stand once on both sides, if any do."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [(i, i) for i in range(low)], [(len(a) - i, len(b) - i) for i in range(high, 0, -1)]
    u, v = a[low:len(a) - high], b[low:len(b) - high]
    if len(u) * len(v) <= MOST_CELLS:
        numbers = {k: i for i, k in enumerate({*u, *v})}
        x, y = (np.array([numbers[k] for k in c], np.int32) for c in (u, v))
        return ends[0] + [(low + i, low + j) for i, j in _subsequence(x, y)] + ends[1]
    once = lambda c: {k for k, n in Counter(c).items() if n == 1}
    sure = once(u) & once(v)
    where = {k: j for j, k in enumerate(v) if k in sure}
    # the longest run of such keys that is in order on both sides
    best: list[int] = []
    chain: list[tuple[int, int, int]] = []
    for i, k in enumerate(u):
        if k in sure:
            at = bisect_left([chain[c][1] for c in best], where[k])
            chain.append((i, where[k], best[at - 1] if at else -1))
            best[at:at + 1] = [len(chain) - 1]
    anchors, c = [], best[-1] if best else -1
    while c >= 0:
        anchors.append(chain[c][:2])
        c = chain[c][2]
    middle, i, j = [], 0, 0
    for p, q in [*anchors[::-1], (len(u), len(v))] if anchors else []:
        middle += [(low + i + x, low + j + y) for x, y in _matched(u[i:p], v[j:q])]
        if p < len(u):
            middle.append((low + p, low + q))
        i, j = p + 1, q + 1
    return ends[0] + middle + ends[1]


def _subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (b == a[i])))
    out, i, j = [], n, m
    while i and j and best[i, j]:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: what both have stays, what one has alone is optional."""
    out: list = []

    def alone(tokens: list) -> None:
        group: tuple = ()
        for x in tokens:
            if isinstance(x, tuple) and x[0] == "?":
                if group:
                    out.append(("?", group))
                    group = ()
                out.append(x)
            else:
                group += (x,)
        if group:
            out.append(("?", group))

    i = j = 0
    for p, q in [*_matched(list(map(_key, a)), list(map(_key, b))), (len(a), len(b))]:
        alone(a[i:p])
        alone(b[j:q])
        if p < len(a):
            out += _common([a[p]], [b[q]])
        i, j = p + 1, q + 1
    return out


def _frozen(x):
    return tuple(map(_frozen, x)) if isinstance(x, list) else x


def _names(place: str) -> list[str]:
    return [sign.split(".")[0].rstrip("!") for sign in place.split("/")]


def _is_boilerplate(place: str) -> bool:
    names = _names(place)
    return "!" in {sign[-1:] for sign in place.split("/")} or "header" in names and not {"article", "main"} & {*names}


def article_places(wrapper: list) -> list[str]:
    """The places of a wrapper that hold the article, sorted.

    Of the places that are no boilerplate those in an <article> or <main>, if there are any; else all that have a slot; else, where
    nothing differs between the pages, all. A header in an <article> or <main> is the article's own, any other the page's.
    """
    slots: set[str] = set()
    places: set[str] = set()

    def walk(tokens) -> None:
        for t in tokens:
            if isinstance(t, tuple):
                walk(t[1])
            elif _is_text(t):
                places.add(t[t.index("\t") + 1:])
                if t[1] == "\t":
                    slots.add(t[2:])

    walk(wrapper)
    good = {p for p in places if not _is_boilerplate(p)}
    named = {p for p in good if {"article", "main"} & {*_names(p)}}
    return sorted(named or good & slots or good)


def main_text(page: Page, places: set[str]) -> str:
    """What stands in the article's places of the page's host; on a page that has none of them, all that is no boilerplate."""
    return " ".join([text for place, text in page.blocks if place in places] or [text for place, text in page.blocks if not _is_boilerplate(place)])


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


#: Shapes of pages and hosts that a task holds before it folds or sends them, and parts in which a host's wrappers meet first.
MOST_SHAPES, MOST_HOSTS, PARTS = 2_000, 2_000, 32


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON, the article's places) of each host.

    Each task folds its own pages into one wrapper a host (several beyond MOST_HOSTS hosts); different ones of a
    host meet in PARTS parts, and those meet once more, so that no task gets a row for each page or each task.
    """
    names = ["host", "wrapper"]

    def rows(known: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string())], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        shapes: dict[tuple, list] = {}

        def settle():
            for (host, _), flat in sorted(shapes.items(), key=lambda x: x[0]):
                known[host] = align(known[host], flat) if host in known else flat
            shapes.clear()

        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1)):
                host = host.as_py()
                flat = squeeze(Page(source.as_py() or "").stream)
                # most pages have a shape that was met before: only their texts are compared
                shape = (host, hashlib.blake2b(_shape(flat).encode(), digest_size=16).digest())
                shapes[shape] = _common(shapes[shape], flat) if shape in shapes else flat
                if len(shapes) >= MOST_SHAPES:
                    settle()
                if len(known) >= MOST_HOSTS:
                    yield rows(known)
                    known.clear()
        settle()
        if known:
            yield rows(known)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by host."""
        last, wrapper = None, None
        for batch in batches:
            for host, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [_frozen(x) for x in json.loads(w)]
                if host == last:
                    wrapper = align(wrapper, w)
                    continue
                if last is not None:
                    yield rows({last: wrapper})
                last, wrapper = host, w
        if last is not None:
            yield rows({last: wrapper})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_places([_frozen(x) for x in json.loads(w)]) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*names, "places"])

    kind = "host string, wrapper string"
    parts = pages.select(_host(F.col(url_col)).alias("host"), html_col).mapInArrow(fold, kind).distinct()
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).alias("part")
    parts = parts.select("*", part).repartition("host", "part").sortWithinPartitions("part", "host", "wrapper").select(*names)
    return parts.mapInArrow(meet, kind).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(meet, kind).mapInArrow(places, kind + ", places array<string>")


def _shape(tokens) -> str:
    """The tokens without their texts."""
    return "\n".join((_slot(t) if _is_text(t) else t) if isinstance(t, str) else f"{t[0]}({_shape(t[1])})" for t in tokens)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page id, url, text, n_chars) of each page.

    text is the article's blocks in page order, white space folded, joined by a space. Null or empty
    html gives an empty text; pages without a host share the empty host; repeated rows are each
    returned; other columns are ignored; an empty table gives an empty result. Pages are read twice; hosts' places
    are written first, so that Spark knows their size: it broadcasts them up to its threshold, and else joins by host, where
    a host with many pages is split.
    """
    places = written(wrappers(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("places").alias("_places")), "places")
    rows = pages.select(id_col, url_col, html_col, _host(F.col(url_col)).alias("_host")).join(places, "_host", "left").select(id_col, url_col, html_col, "_places")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(Page(source.as_py() or ""), {*(found.as_py() or ())}) for source, found in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
