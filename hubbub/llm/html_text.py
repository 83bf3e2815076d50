"""Operator 3, main text of web pages by the maximum-scoring subsequence.

A page is a run of blocks (text between block-level tags). Every word adds its weight and
every tag its weight, which is negative; one linear scan over the blocks' sums finds the
best contiguous region. Weights are learned from labelled pages: pages that mark their
article (article, main) tell, for each element name and each class, id or role, how many of
the words in it stand inside; and for each tag, how often it does. A block's words weigh the
more the likelier its enclosing elements are to be in an article.

Blocks of the region that stand aside are left out of its text: in elements that HTML
defines as navigation, footers, sidebars, forms or dialogs, and in elements one of whose
classes, ids or roles is learned to lie outside. STARTING names begin with START words
outside, and pages can teach otherwise. Names count as a whole (has-sidebar is not
sidebar), but one whose first part is comment or the like begins as that part does. What a
page hides (hidden, display:none) stands aside whatever is learned. Inline elements never cut
a block; the words of one that stands aside are left out of its block. An element that holds the article, or more than half of the page's words, does
not stand aside, but for reader comments, which do unless they hold `main`.

The fit reads at most SAMPLE distinct pages, those of the smallest hashes. A null or empty
html gives empty text; unclosed and stray tags are tolerated; work is linear in the page's
length, however long and deep it is; a page with no block of positive score has empty text;
of equally good regions the first is taken; repeated rows repeat their result; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 2000
START = 50
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count only behind an equals sign.
REST = re.compile(r"""(?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>""")
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|aria-hidden|style)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
QUOTED = re.compile(r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)""")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
#: The name that what a page hides has; no class can be called so.
HIDDEN = "hidden attribute"
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "canvas", "title", "select", "audio", "video")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "ms", "msqrt", "msub", "msup", "mtext", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Elements that an opening tag of this name ends, where they are the innermost block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
COMMENTS = {"comment", "comments", "comment-list", "commentlist", "comment-body", "comments-area", "comment-form", "reply", "replies", "response", "responses", "respond", "disqus_thread", "discussion"}
#: First parts of names of comment containers, and last parts of names that only tell of comments.
COMMENT_HEADS, COMMENT_TELLS = {"comment", "comments", "disqus", "replies", "responses"}, {"open", "opened", "closed", "enabled", "disabled", "on", "off", "count", "allowed"}
#: Classes, ids and roles that begin with START words outside the article.
STARTING = COMMENTS | {
    "ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsored", "sponsor", "banner", "promo", "promotion", "cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "notification", "alert",
    "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "complementary", "footer", "site-footer", "site-header", "contentinfo", "masthead",
    "topbar", "toolbar", "share", "sharing", "share-buttons", "social", "social-share", "related", "related-posts", "recommended", "recommendations", "widget", "newsletter", "subscribe", "signup", "login", "disclaimer", "copyright", "legal", "search", "tags", "hidden",
}


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    block: int  # the innermost element that is not inline: itself or one above
    names: tuple[str, ...]  # classes, ids and roles
    words: int = 0  # in it and below; of an inline element those of its block's share are in own
    own: int = 0
    holds: str = ""  # "main" or "article", if one stands in it and has no name of comments
    article: bool = False
    hidden: bool = False
    aside: bool = False


@dataclass(slots=True)
class Block:
    element: int  # the innermost that is not inline
    parts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)  # the innermost element of each part
    tags: list[str] = field(default_factory=list)
    text: str = ""
    n: int = 0


def _names(attributes: str) -> tuple[str, ...]:
    found = [HIDDEN] if _hidden(attributes) else []
    if "=" not in attributes:
        return tuple(found)
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        match name.lower():
            case "aria-hidden":
                found += ["hidden"] if value == "true" else []
            case "style":
                found += [HIDDEN] if HIDES.search(value) else []
            case _:
                found += value.split()
    return tuple(dict.fromkeys(found))


def _hidden(attributes: str) -> bool:
    """Whether the attribute `hidden` is set, with or without a value."""
    return "hidden" in attributes.lower() and "hidden" in QUOTED.sub(" ", attributes).lower().replace("/", " ").split()


def comments_name(name: str) -> bool:
    """Whether a class, id or role names a container of reader comments, as a whole or by its first part."""
    if name in COMMENTS:
        return True
    parts = re.split(r"[-_]+", name)
    return len(parts) > 1 and parts[0] in COMMENT_HEADS and parts[-1] not in COMMENT_TELLS


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's blocks in order, and its elements (parents first) with the words that each holds."""
    elements = [Element("body", -1, 0, ())]
    stack, places = [0], {}  # open elements; for each name where it stands in the stack
    out: list[Block] = []
    now = Block(0)
    pos, n = 0, len(page)

    def fresh() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
            now = Block(elements[stack[-1]].block)
        else:
            now.element = elements[stack[-1]].block

    def add(text: str) -> None:
        now.parts.append(text)
        now.owners.append(stack[-1])

    def close(at: int) -> None:
        while len(stack) > at:
            places[elements[stack.pop()].tag].pop()

    while pos < n:
        at = page.find("<", pos)
        end = at if at >= 0 else n
        if end > pos:
            text = entities.unescape(page[pos:end])
            if now.parts or not text.isspace():
                add(text)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            pos = end + 3 if end >= 0 else n
            continue
        closing = page.startswith("/", at + 1)
        named = NAME.match(page, at + 1 + closing)
        if not named:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                pos = end + 1 if end >= 0 else n
            else:
                add("<")
                pos = at + 1
            continue
        rest = REST.match(page, named.end())
        if not rest:  # no tag ends from here on: the rest is text
            add(entities.unescape(page[at:]))
            break
        pos, tag = rest.end(), named[0].lower()
        attributes = page[named.end() : pos - 1]
        empty = attributes.endswith("/")
        if tag == "br":
            add(" ")
            now.tags.append(tag)
            continue
        if tag in RAW_END and not closing:
            if not empty:
                over = RAW_END[tag].search(page, pos)
                end = page.find(">", over.end()) if over else -1
                pos = end + 1 if end >= 0 else n
            continue
        inline = tag in INLINE
        innermost = elements[stack[-1]].block
        if closing:
            if places.get(tag):
                at = places[tag][-1]
                if not inline or elements[stack[at]].block == innermost:
                    close(at)
        elif tag not in VOID and not (empty and inline):
            ended = elements[innermost].tag
            if ended == "p" and tag in CLOSES_P or ended in ENDS.get(tag, ()):
                close(places[ended][-1])
            k, above = len(elements), elements[stack[-1]]
            elements.append(Element(tag, stack[-1], above.block if inline else k, _names(attributes)))
            places.setdefault(tag, []).append(len(stack))
            stack.append(k)
        if not inline:
            fresh()
        now.tags.append(tag)
    fresh()
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.n = len(b.text.split())
        elements[b.element].words += b.n
        for k, part in zip(b.owners, b.parts, strict=True):
            if k != b.element and elements[k].block == b.element:  # words of inline elements are the block's, too
                elements[k].own += len(part.split())
    for e in elements[1:]:
        e.article = elements[e.parent].article or e.tag in ("article", "main")
        e.hidden = elements[e.parent].hidden or HIDDEN in e.names
    for e in reversed(elements[1:]):
        above = elements[e.parent]
        above.words += e.words
        holds = "main" if "main" in (e.tag, e.holds) or "main" in e.names else "article" if e.tag == "article" or e.holds else ""
        if holds and (holds == "main" or not any(map(comments_name, e.names))):
            above.holds = max(above.holds, holds)  # main before article
    return out, elements


@dataclass
class Weights:
    """Log odds of words to stand inside, by enclosing element name and by class, id or role; and of tags, always negative."""

    elements: dict[str, float]
    names: dict[str, float]
    tags: dict[str, float]

    def name(self, name: str) -> float:
        return self.names.get(name, math.log(1 / (START + 1)) if name in STARTING or comments_name(name) else 0.0)

    def mark(self, elements: list[Element]) -> list[float]:
        """Sets which elements stand aside; the weight of a word in each."""
        total = elements[0].words
        out = [0.5]
        for e in elements[1:]:
            above = elements[e.parent]
            names = [self.name(x) for x in e.names]
            comments = any(map(comments_name, e.names)) and min(names) < -1
            if e.hidden:
                own = True
            elif e.tag in ("html", "body"):
                own = False
            elif comments:
                own = e.holds != "main"
            elif e.tag in ASIDE_TAGS - {"form"} or e.tag == "header" and not above.article:
                own = not e.holds
            else:
                own = (e.tag == "form" or bool(names) and min(names) < -2) and not e.holds and e.tag != "main" and 2 * max(e.words, e.own) <= total
            e.aside = own or above.aside and not (e.tag == "main" and not comments)
            out.append(max(-3.0, min(3.0, out[e.parent] + self.elements.get(e.tag, 0.0) + max(-1.0, min(1.0, sum(names)))) if not e.aside else -1.0))
        return out


def main_text(page: str | None, weights: Weights) -> str:
    """The best contiguous region's blocks, without those that stand aside."""
    if not page:
        return ""
    found, elements = blocks(page)
    word = weights.mark(elements)
    for b in found:
        drop_aside(b, elements)
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for k, b in enumerate(found):
        words, tags = score(b, elements, word, weights)
        total += tags
        if total <= 0:  # a region begins behind its first block's tags
            total, start = 0.0, k
        total += words
        if total > best:
            best, best_range = total, (start, k + 1)
    return "\n\n".join(b.text for b in found[slice(*best_range)] if b.n and not elements[b.element].aside)


def drop_aside(b: Block, elements: list[Element]) -> None:
    """Leaves the words of inline elements that stand aside out of a block that does not."""
    if not elements[b.element].aside and any(elements[k].aside for k in b.owners):
        b.text = " ".join("".join(p for p, k in zip(b.parts, b.owners, strict=True) if not elements[k].aside).split())
        b.n = len(b.text.split())


def score(b: Block, elements: list[Element], word: list[float], weights: Weights) -> tuple[float, float]:
    """Of a block's words and of the tags before them; what is hidden, or stands aside within an article, costs nothing, so that it does not cut it in two."""
    e = elements[b.element]
    if e.aside and (e.article or e.hidden):
        return 0.0, 0.0
    return b.n * word[b.element], sum(weights.tags.get(t, -0.5) for t in b.tags)


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Log odds of standing inside a marked article, by element, name and tag."""
    key = F.xxhash64("html").alias("key")
    some = pages.where(F.length("html") > 0).select(key).distinct().orderBy("key").limit(sample)  # at most `sample` rows
    chosen = pages.select(key, "html").join(F.broadcast(some), "key").groupBy("key").agg(F.any_value("html").alias("html")).select("html")
    plain = Weights({}, {}, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for page in batch.column(0):
                found, elements = blocks(page.as_py())
                if not any(e.tag in ("article", "main") for e in elements):
                    continue
                plain.mark(elements)
                own = [(Counter(), Counter()) for _ in elements]  # words inside and outside, by element
                for b in found:
                    e = elements[b.element]
                    inside = e.article and not e.aside
                    own[b.element][inside]["n"] += b.n
                    for k, part in zip(b.owners, b.parts, strict=True):
                        for name in elements[k].names if k != b.element and elements[k].block == b.element else ():
                            sums["name", name, inside and not elements[k].aside, 1] += len(part.split())
                    sums.update(("tag", t, inside, 1) for t in b.tags)
                for k in range(len(elements) - 1, -1, -1):
                    e = elements[k]
                    for inside in (True, False):
                        n = own[k][inside]["n"]
                        if k:
                            own[e.parent][inside]["n"] += n
                        if n:
                            for kind, name in [("element", e.tag), *(("name", x) for x in e.names)]:
                                sums[kind, name, inside, 1] += n
            rows = [(*k[:3], n) for k, n in sums.items()]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["kind", "name", "inside", "n"])

    rows = chosen.mapInArrow(count, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    learned = Weights({}, {}, {})
    for r in rows.collect():  # a row for each name on the sampled pages
        if r.kind == "tag":
            learned.tags[r.name] = max(-3.0, min(-0.1, math.log((r.a + 1) / (r.b + 1)) - 2))
        elif r.kind == "name":
            learned.names[r.name] = math.log((r.a + 1) / (r.b + 1 + START * (r.name in STARTING)))
        elif r.name not in ("html", "body"):
            learned.elements[r.name] = max(-0.25, min(1.0, math.log((r.a + 1) / (r.b + 1)) / 2))
    return learned


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(p.as_py(), weights) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
