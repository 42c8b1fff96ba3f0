"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative; one
linear scan finds the contiguous region of the greatest sum, which is the
content. Scores come from labelled pages: pages that mark their content with
<article> or <main> say for each kind of word and each tag how often it stands
inside and outside. Words have kinds: plain, inside a link, inside an element
that is something else by its tag or by what it names itself (menus, headers,
footers, sidebars, notices, adverts, forms, comments), and, on pages that mark
their content, plain words outside the mark. From the region, the words of such
elements are left out.

On pages that mark their content, words outside the mark score so low and tags
inside cost so little that the scan finds the mark. On all others it has the
words and tags only; how well it does is measured on marked pages whose marks it
isn't shown (``marks=False``).

An element that names itself as something else but has a <main> or an <h1> in
it, or nearly all of the page's words, is a wrapper and is read like any other.
Headers inside the content belong to it.

Reading a page takes time in proportion to its length, whatever is unclosed in it.

Training takes at most ``sample_pages`` labelled pages of at most
``sample_chars`` characters, those of the smallest hash of page_id: the driver
holds 50 million characters at most.

Defined results: null or empty html, and pages without words, have empty text.
Unclosed and stray tags are read as they come; a < that starts no tag, or whose
tag never ends, is text; an unclosed comment, script or style runs to the page's
end. Rows are independent, so repeated page_id give repeated rows. Other columns
are ignored. The scores are learned when main_text is called.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 500
SAMPLE_CHARS = 100_000
SCHEMA = "page_id long, url string, text string, n_chars long, n_words long"
FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_words", pa.int64())])

#: Elements whose text is never content.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "title", "annotation", "annotation-xml"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset", "label", "option", "head"}
MARKS = {"article", "main"}
#: Elements that don't part words.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mi", "mn", "mo", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "semantics",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that name something other than content.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "dialog", "disqus", "footer", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion",
    "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of those, readers' words, which are never a wrapper of the page.
READERS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
#: Words that may follow one of them in a name: a cookie bar is a notice, an open menu's page isn't a menu.
PARTS = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "message", "module", "outer", "panel", "right", "row",
    "section", "slot", "text", "title", "top", "unit", "wrap", "wrapper",
}
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: Where a tag ends, or a quoted value starts.
STOP = re.compile(r""">|=[ \t\n\f\r]*(["'])""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
VALUES = re.compile(r"""\b(?:href|src|alt|title|content|value|placeholder|class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: A wrapper that says it has (or lacks) a sidebar isn't one.
LAYOUT = re.compile(r"\b(?:has|with|without|no)[-_][a-z]+", re.I)
BODY = re.compile(r"\b(?:article|entry|post|story)[-_](?:body|content|text)\b", re.I)
BODY_PROPERTY = re.compile(r"""itemprop\s*=\s*["']?articleBody|role\s*=\s*["']?main\b""", re.I)
LETTERS = re.compile(r"[a-z]+")


def _named(attributes: str) -> str | None:
    """What class, id or role name the element, if that is something other than content.

    A name is one if its last word is, or one with only parts of a layout after it.
    """
    for m in NAMED.finditer(attributes):
        for name in LAYOUT.sub(" ", m[1].lower()).strip("\"'").split():
            words = LETTERS.findall(re.sub("[a-z]+__", "", name))
            while words and words[-1] in PARTS:
                words.pop()
            if words and words[-1] in NAMES:
                return words[-1]
    return None


def _marked(attributes: str) -> bool:
    return bool(BODY_PROPERTY.search(attributes)) or any(BODY.search(m[1]) for m in NAMED.finditer(attributes))


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts ("text", text, ""), tags ("open" or "close", name, attributes) and elements whose text is none ("raw", name, "").

    A search that fails once isn't made again further on, so time follows the page's length.
    """
    size, start, at = len(page), 0, 0
    lost: dict[str, int] = {}  # what isn't found from a place on

    def find(what: str, begin: int) -> int:
        if begin >= lost.get(what, size + 1):
            return -1
        found = page.find(what, begin)
        if found < 0:
            lost[what] = begin
        return found

    def tag_end(begin: int) -> int:
        if find(">", begin) < 0:
            return -1
        while m := STOP.search(page, begin):
            if m[0] == ">":
                return m.start()
            close = find(m[1], m.end())
            if close < 0:
                return find(">", m.end())
            begin = close + 1
        return -1

    while (lt := find("<", at)) >= 0:
        first = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = find("-->", lt + 4)
            yield "text", page[start:lt], ""
            start = at = end + 3 if end >= 0 else size
            continue
        name = NAME.match(page, lt + 1 + (first == "/")) if first == "/" or first.isascii() and first.isalpha() else None
        end = tag_end(name.end()) if name and first != "/" else find(">", lt + 2) if first and first in "!?/" else -1
        if end < 0:
            at = lt + 1  # no tag: text
            continue
        yield "text", page[start:lt], ""
        start = at = end + 1
        if not name:
            continue
        low, attributes = name[0].lower(), page[name.end() : end]
        if first == "/":
            yield "close", low, ""
        elif low in RAW and not (low == "svg" and attributes.endswith("/")):
            yield "raw", low, ""
            last = re.compile(f"</{low}(?=[\\s/>])", re.I).search(page, at)
            end = find(">", last.end()) if last else -1
            start = at = end + 1 if end >= 0 else size
        else:
            yield "open", low, attributes
    yield "text", page[start:], ""


def _read(seen: list[tuple[str, str, str]], wrappers: set[int]) -> tuple[list[tuple[str, str, int]], list[list]]:
    """Kinds of words and tags with their level (2 in an article, 1 in another mark), and of each element named as something else: [event, name, words before, words after, whether it has a heading or main part]."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, list | None]] = []  # open elements that matter
    kinds: Counter = Counter()
    open_names: Counter = Counter()
    records: list[list] = []
    named_open: list[list] = []
    words = plain = 0
    for i, (event, name, attributes) in enumerate(seen):
        level = 2 if kinds["article"] else 1 if kinds["main"] else 0
        if event == "text":
            if name:
                kind = "aside" if kinds["aside"] else "link" if kinds["link"] else "plain"
                value = entities.unescape(name)
                n = len(value.split())
                words += n
                plain += n * (kind != "aside")
                out.append((kind, value, level))
            continue
        if event == "raw":
            out.append(("<", "p", 0))  # raw elements part words, and say nothing else
            continue
        out.append(("<", name, level))
        if event == "close":
            if open_names[name]:
                while stack:
                    n, kind, record = stack.pop()
                    kinds[kind] -= 1
                    open_names[n] -= 1
                    if record:
                        record[3] = words
                        named_open.pop()
                    if n == name:
                        break
            continue
        if name in ("h1", "main") and named_open:
            named_open[-1][4] = True
        if name in VOID or attributes.endswith("/"):
            continue
        record = None
        inside = kinds["article"] or kinds["main"]
        tag_aside = name in ASIDE and not (name == "header" and inside)
        other = _named(attributes) if attributes and name not in ("html", "body", "main") else None
        if other in ("header", "masthead") and inside:
            other = None
        if other and not tag_aside:
            record = [i, other, words, words, False]
            records.append(record)
        hidden = bool(attributes) and name not in ("html", "body") and HIDDEN.search(VALUES.sub("", attributes))
        if tag_aside or hidden or (other and i not in wrappers):
            kind = "aside"
        elif name == "article":
            kind = "article"
        elif name == "main" or (attributes and name not in INLINE and _marked(attributes)):
            kind = "main"
        elif name == "a":
            kind = "link"
        elif record or open_names[name] and name not in INLINE and name not in ("p", "li", "td", "tr", "option"):
            kind = "none"  # so that its end doesn't close an outer one of the same name
        else:
            continue
        stack.append((name, kind, record))
        kinds[kind] += 1
        open_names[name] += 1
        if record:
            if named_open:
                record.append(named_open[-1])
            named_open.append(record)
    for record in named_open:
        record[3] = words
    for record in reversed(records):  # what stands in an inner one stands in the outer one
        if record[4] and len(record) > 5:
            record[5][4] = True
    return out, [[*r[:5], words, plain] for r in records]


def tokens(page: str, marks: bool = True) -> list[tuple[str, str, bool]]:
    """(kind, text, inside a mark): kind is a kind of word with its text, or "<" with a tag's name.

    Marks are <article> elements or, in a page without any, <main> and elements
    whose attributes say that they are an article's body.
    """
    seen = list(events(page))
    out, records = _read(seen, set())
    wrappers = {i for i, name, before, after, heading, every, plain in records if name not in READERS and (heading or (after - before > 0.6 * every and plain < 0.1 * (after - before)))}
    if wrappers:
        out, _ = _read(seen, wrappers)
    best = max((at for kind, value, at in out if kind in ("plain", "link") and value.strip()), default=0) if marks else 0
    return [(kind, value, 0 < best <= at) for kind, value, at in out]


def counts_of(page: str) -> tuple[Counter, Counter] | None:
    """Of a labelled page: how often each kind of word and each tag stands inside the marks and outside."""
    seen = tokens(page)
    if not any(mark and kind != "<" and kind != "aside" for kind, _, mark in seen):
        return None
    inside, outside = Counter(), Counter()
    for kind, value, mark in seen:
        if kind == "<":
            if value not in MARKS:
                (inside if mark else outside)["<" + value] += 1
        else:
            where = inside if mark and kind != "aside" else outside
            where["unmarked" if kind == "plain" and not mark else kind] += len(value.split())
    return inside, outside


def learn(pages: list[str]) -> dict[str, float]:
    """Scores of kinds of words and of tags, at most 4 either way."""
    inside, outside = Counter(), Counter()
    for page in pages:
        if got := counts_of(page):
            inside.update(got[0])
            outside.update(got[1])
    odds = lambda k, a, b: max(-4.0, min(4.0, math.log((inside[k] + a) / (outside[k] + b))))
    scores = {"plain": max(0.5, min(1.5, odds("plain", 8, 1))), "link": odds("link", 1, 2), "aside": min(-0.5, odds("aside", 1, 8)), "unmarked": min(-0.5, odds("unmarked", 1, 8))}
    for k in {*inside, *outside}:
        if k[0] == "<":
            # A tag that stands inside as a rule costs next to nothing.
            scores[k] = -min(4.0, math.log(1 + (outside[k] + 0.1) / (inside[k] + 1)))
    return scores


def best_region(values: list[float]) -> tuple[int, int] | None:
    """Start and end of the contiguous region of the greatest sum, the first and shortest of equal ones; None if no sum is positive."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def best_region(values: list[float]) -> tuple[int, int] | None:
    """Start and end of the contiguous region of the greatest sum, the first and shortest of equal ones; None if no sum is positive."""
    best, found, total, start = 0.0, None, 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, scores: dict[str, float], marks: bool = True) -> str:
    """The region of the greatest sum, without the words of other elements, white space as one space. Without ``marks`` it is as if the page marked nothing."""
    seen = tokens(page or "", marks)
    marked = any(mark and kind in ("plain", "link") and value.strip() for kind, value, mark in seen)

    def value_of(kind: str, value: str, mark: bool) -> float:
        if kind == "<":
            return -0.001 if mark else scores.get("<" + value, -0.5)  # inside a mark, a tag is a tag of the content
        n = len(value.split())
        if marked and not mark:
            return min(scores["unmarked"], scores["aside"]) * n
        if marked:
            return 0.0 if kind == "aside" else scores["plain"] * n  # a marked link is content
        return scores[kind] * n

    region = best_region([value_of(*x) for x in seen])
    if region is None:
        return ""
    parts = []
    for kind, value, mark in seen[slice(*region)]:
        if kind == "<":
            if value not in INLINE:
                parts.append(" ")
        elif kind != "aside" and (mark or not marked):
            parts.append(value)
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """page_id, url, text, n_chars and n_words of each page (page_id, url, html)."""
    labelled = pages.filter(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.char_length("html") <= sample_chars))
    hashes = F.struct(F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("t"))
    # Which pages are the sample's is found by hashes alone, since every task sends its candidates to the driver.
    chosen = labelled.select(hashes.alias("k")).orderBy("k").limit(sample_pages).collect()
    sample = []
    if chosen:
        last = chosen[-1]["k"]
        upto = (F.col("k.h") < last["h"]) | ((F.col("k.h") == last["h"]) & (F.col("k.t") <= last["t"]))
        sample = labelled.select("html", hashes.alias("k")).filter(upto).dropDuplicates(["k"]).orderBy("k").collect()
    scores = pages.sparkSession.sparkContext.broadcast(learn([r["html"] for r in sample]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), scores.value) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())], schema=FIELDS)

    return pages.select("page_id", "url", "html").mapInArrow(of, SCHEMA)
