"""Main text of web pages as a maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, with weights learned from labelled pages: pages whose
article is marked by its own element tell how much likelier each kind of token is inside an article than outside. A linear scan finds
the contiguous run with the largest sum. The smallest element that holds this run, widened to an enclosing article element if
there is one, is the content; blocks inside it that belong to menus, adverts, forms, notices, comments and the like are left out.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000  # labelled pages, those with the least hash of page_id
LEAST_WORD, LEAST_TAG, MOST = 0.1, -0.1, 8.0
BATCH_ROWS = 256

# fixed values: element and attribute names of the web
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body head html caption dd dt legend li option optgroup td th tr tbody thead tfoot title summary".split())
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
_NEVER = frozenset("script style noscript template iframe noembed noframes object embed applet svg canvas math audio video map head title nav footer aside form button select textarea datalist dialog menu search xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist note".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners sidebar sidebars rail nav navbar"
    " navi navigation menu menus submenu breadcrumb breadcrumbs crumbs footer foot masthead topbar header comment comments commentlist respond reply replies disqus"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing shares related recommended"
    " recommendations widget widgets toolbar pagination pager paginator skip search copyright legal paywall outbrain taboola".split()
)
_ARTICLE = frozenset(["article", "main"])
_ARTICLE_NAMES = re.compile(r"(^|[\s_-])(article|post|entry|story|main|page)?[_-]?(body|content|text|article|post|entry|story)([\s_-]|$)", re.I)
_TAG_KINDS = tuple(sorted(_BLOCK | _VOID | frozenset("a b i em strong span u s sub sup small code q cite abbr time label img picture".split())))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_CAMEL = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


class _Element:
    __slots__ = ("name", "parent", "begin", "end", "out", "article", "heading")

    def __init__(self, name, parent, begin, out, article):
        self.name, self.parent, self.begin, self.end, self.out, self.article = name, parent, begin, begin, out, article


def _boilerplate(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in _NEVER or name == "header" and not inside:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    words = {w.lower() for key in ("class", "id") for w in _CAMEL.split(attributes.get(key, "")) if w}
    return bool(words & _NAMES)


def parse(page: str):
    """(tokens, elements): tokens are (kind, text or name, element) in page order, kind "w" for a text run, "t" for a tag."""
    root = _Element("", None, 0, False, False)
    stack, tokens, elements = [root], [], []
    at, n = 0, len(page)

    def close(to: int) -> None:
        while len(stack) > to:
            stack.pop().end = len(tokens)

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[:2] in ("<!", "<?") and text != "<":
                continue
            tokens.append(("w", text, stack[-1]))
            continue
        name = name.lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            tokens.append(("t", name, stack[-1]))
            if depth:
                close(depth)
            continue
        if name in _CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == "p"), 0)
            walls = {"table", "td", "th", "button", "object", "caption", "div", "section", "article", "li", "blockquote"}
            if depth and not any(e.name in walls for e in stack[depth + 1 :]):
                close(depth)
        if name in _SIBLINGS:
            closes, limits = _SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    close(k)
                    if name not in ("td", "th"):
                        continue
                    break
                if stack[k].name in limits:
                    break
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3] else {}
        parent = stack[-1]
        names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')}"
        article = name in _ARTICLE or (name in ("div", "section", "td") and bool(_ARTICLE_NAMES.search(names)))
        inside = parent.article
        out = parent.out or _boilerplate(name, attributes, inside or article)
        element = _Element(name, parent, len(tokens), out, inside or (article and not out))
        element.heading = article and not out
        tokens.append(("t", name, element))
        elements.append(element)
        if name in _VOID or m[3].rstrip().endswith("/") and name not in _BLOCK:
            element.end = len(tokens)
            continue
        stack.append(element)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.start() if end else n
    close(0)
    return tokens, elements


def _kind(kind: str, value: str) -> str:
    return "word" if kind == "w" else value if value in _TAGS else "other"


_TAGS = frozenset(_TAG_KINDS)


def count_kinds(page: str) -> tuple[dict[str, int], dict[str, int]] | None:
    """Counts of each kind of token inside and outside the article element of a labelled page; None for other pages."""
    tokens, elements = parse(page)
    marked = [e for e in elements if e.name == "article" and not e.out]
    if not marked:
        return None
    counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for i, (kind, value, element) in enumerate(tokens):
        own = any(e.begin <= i < e.end for e in marked) and not element.out
        n = len(value.split()) if kind == "w" else 1
        side = counts[0 if own else 1]
        name = _kind(kind, value)
        side[name] = side.get(name, 0) + n
    return counts


def learn_weights(pages: DataFrame, size: int = SAMPLE) -> dict[str, float]:
    """Log odds of each kind of token from at most ``size`` pages whose article is marked; words stay positive and tags negative."""

    def counted(batches):
        for batch in batches:
            rows = {"kind": [], "inside": [], "outside": []}
            for page in batch.column(0).to_pylist():
                found = count_kinds(page)
                for kind in set().union(*found) if found else ():
                    rows["kind"].append(kind)
                    rows["inside"].append(found[0].get(kind, 0))
                    rows["outside"].append(found[1].get(kind, 0))
            yield pa.RecordBatch.from_arrays([pa.array(rows["kind"], pa.string()), pa.array(rows["inside"], pa.int64()), pa.array(rows["outside"], pa.int64())], ["kind", "inside", "outside"])

    labelled = pages.filter(F.col("html").rlike(r"(?i)<article[\s>]")).select("page_id", "html")
    # ids are ranked first; a page is fetched only when its id is among the chosen, of which there are at most ``size``
    chosen = labelled.select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h", "page_id").limit(size).select("page_id")
    sums = labelled.join(F.broadcast(chosen), "page_id").select("html").mapInArrow(counted, "kind string, inside long, outside long")
    got = {r["kind"]: (r["inside"], r["outside"]) for r in sums.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()}
    inside, outside = (sum(v[k] for v in got.values()) for k in (0, 1))
    weights = {"word": 1.0, "other": -2.0} | dict.fromkeys(_TAG_KINDS, -2.0)
    if inside and outside:
        for kind, (a, b) in got.items():
            odds = math.log((a + 1) / (inside + 1)) - math.log((b + 1) / (outside + 1))
            odds = max(-MOST, min(MOST, odds))
            weights[kind] = max(odds, LEAST_WORD) if kind == "word" else min(odds, LEAST_TAG)
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first contiguous range [i, j) with the largest sum, by one scan; empty when nothing is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the main content, joined by an empty line."""
    if not page:
        return ""
    tokens, _ = parse(page)
    scores = []
    for kind, value, element in tokens:
        weight = weights.get(_kind(kind, value), weights["other"])
        if kind == "w":
            n = len(value.split())
            scores.append(-weight * n if element.out else weight * n)
        else:
            scores.append(weight)
    i, j = best_run(scores)
    if i == j:
        return ""
    holder = tokens[i][2]
    while holder.parent is not None and not (holder.begin <= i and j <= holder.end):
        holder = holder.parent
    # a paragraph or list that holds the run is part of its surrounding container
    outer, top = holder, holder
    while outer.parent is not None and outer.name not in ("body", "html", ""):
        if outer.name in _ARTICLE or getattr(outer, "heading", False):
            top = outer
        outer = outer.parent
    if top is holder and not (holder.name in _ARTICLE or getattr(holder, "heading", False)):
        while holder.parent is not None and holder.name not in ("div", "section", "td", "body", "html", ""):
            holder = holder.parent
        top = holder
    begin, end = (0, len(tokens)) if top.parent is None else (top.begin, top.end)

    blocks, parts = [], []

    def flush():
        text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            blocks.append(text)
        parts.clear()

    for kind, value, element in tokens[begin:end]:
        if kind == "t":
            if value in _BLOCK:
                flush()
            elif value == "br":
                parts.append("\n")
        elif not element.out:
            parts.append(value)
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` (page_id, html, ...) with ``text``; other columns as they are, an old ``text`` is replaced.

    Weights are learned from the pages themselves unless given. A null or empty page, and one without words outside menus and the
    like, has an empty text. Pages without a page_id are extracted like others. An empty table gives an empty table.
    """
    weights = weights or learn_weights(pages)
    rest = pages.drop("text")
    names = rest.columns
    html_at = names.index("html")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [extract_text(page, weights) for page in part.column(html_at).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, text string")
