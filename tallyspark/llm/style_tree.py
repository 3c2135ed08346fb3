"""Operator 6: main text of web pages by a site style tree (after Yi, Liu and Li 2003).

The pages of a host are merged: block elements with the same path of styles (tag, class and id words) are one node. A node's
presentation is the sequence of its children's styles, its content the text blocks directly in it.

- Importance of presentation: entropy of a node's presentations over its pages, as a part of the largest possible.
- Importance of content: the mean, over the node's different texts, of 1 - ln(pages with this text) / ln(pages with the node): 0 if
  all pages have the same text, 1 if all texts differ. A text counts once however many pages have it, so that an article of which
  there are many copies doesn't make its node look like a menu.
- Importance of a node: (1 - g^l) times that of its presentation plus g^l times that of its content, where l is the number of
  presentations and g is GAMMA.

The pages of all hosts are merged alike to one tree. A node that n pages of a host have gets n parts of its importance there and PRIOR
parts of its importance in the tree of all hosts, so that hosts of few pages need no switch. Where this is below LOW, the node is low;
a branch whose text stands in low nodes only is low, and goes from each page. Pages of a host with equal html are merged once, and in
its texts the host's name counts as a blank.

Marks decide what entropies leave open: what names itself as menu, header, footer, sidebar, notice, advert, form or reader comments
goes too, and if there are article or main elements with text, only this counts, unless they are several articles with less text than
stands beside them. A class or id word of several parts is a mark if each part is one or says nothing (`ad-slot`, not `share-price`).
Marks on html, body and what holds a main element count for nothing; if all articles stand in something marked, marks on what holds
them don't count either. If nothing is left, all text without a mark does. Without marks (marks=False) the tree alone decides.

Importance is sums of counts that are aggregated before and after a shuffle by (host, node, text), so a hot host is dealt out by its
nodes and texts; no group is held. A page gets its host's low nodes, whose number depends on templates and not on pages.

Null html gives an empty text; a null url, or one without host, belongs to the host of no name. Broken markup is read leniently:
unclosed elements end with their parent, an unfinished tag at the end is dropped, an element of no text that is never closed hides
nothing (an unclosed script or style only what stands before the next tag). Repeated rows give equal results; very long pages are read whole; an empty table gives an empty result. Texts with equal
counts weigh alike, so there are no ties. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, fitting, materialise

GAMMA, LOW, PRIOR = 0.9, 0.8, 20

# Elements of HTML and usual words in class and id attributes.
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset menu dialog details summary hr center".split())
DROPPED = frozenset("script style template noscript title svg math textarea select button iframe object canvas audio video".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager widget toolbar skip".split()
)
WEAK_WORDS = frozenset("header form".split())
FILLER_WORDS = frozenset("site page main post posts entry article articles content global primary secondary top bottom left right box bar block list item items wrap wrapper container inner outer section area link links button buttons text title head row col column slot unit mobile desktop sticky fixed".split())
MAIN_TAGS = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>])*+)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z""", re.S)
_CLOSING = re.compile(rf"</({'|'.join(sorted(DROPPED))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPLIT = re.compile(r"[^a-z]+")


def _marked(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id word is a mark: all of its parts are, or say nothing."""
    parts = {x for x in _SPLIT.split(name) if x}
    return bool(parts & words) and parts <= words | FILLER_WORDS


@lru_cache(100_000)
def key(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent} {label}".encode(), digest_size=8).digest(), "big", signed=True)


@lru_cache(100_000)
def style(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label, whether the style marks itself as no content (unless it holds the article), whether it is a weak mark."""
    words: set[str] = set()
    bad, weak = tag in CHROME_TAGS, tag == "header"
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(_SPLIT.split(value))
            bad |= any(_marked(x, CHROME_WORDS) for x in value.split())
            weak |= any(_marked(x, WEAK_WORDS) for x in value.split())
        elif name == "role":
            bad |= value in CHROME_ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            bad = True
    words.discard("")
    return f"{tag}.{'.'.join(sorted(words))}", bad, weak


class Page:
    """Block elements of a page: parent, key, label, whether it or what holds it is marked bad, whether it is in an article or main
    element; and its text blocks with the element that each stands in."""

    def __init__(self, html: str, marks: bool = True) -> None:
        self.parent, self.key, self.label, self.tag = [-1], [0], [""], [""]
        self.marks = [(False, False)]
        self.blocks: list[tuple[int, str]] = []
        stack, tags, parts = [0], [""], []
        at, end, skip = 0, len(html), ""
        inline, depth = "", 0  # a marked element inside a line, which hides its text
        closed = dict.fromkeys(DROPPED, -1)
        for m in _CLOSING.finditer(html):
            closed[m[1].lower()] = m.start()

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        for m in _TOKEN.finditer(html):
            if m.start() > at and not skip and not inline:
                parts.append(entities.unescape(html[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if skip:
                if m[1] and tag == skip:
                    skip = ""
                continue
            if inline and tag in BLOCK:
                inline = ""
            if inline:
                if tag == inline and not m[3].endswith("/"):
                    depth += -1 if m[1] else 1
                    inline = inline if depth else ""
                continue
            if m[1]:
                if tag in BLOCK and tag in tags:
                    flush()
                    while True:
                        stack.pop()
                        if tags.pop() == tag:
                            break
                continue
            if tag in DROPPED:
                skip = "" if m[3].endswith("/") or closed[tag] < m.end() else tag
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in BLOCK:
                if marks and tag not in VOID and m[3] and not m[3].endswith("/") and style(tag, m[3])[1]:
                    inline, depth = tag, 1
                continue
            flush()
            if tag == "hr":
                continue
            while tags[-1] == "p" or tags[-1] in CLOSES.get(tag, ()):
                stack.pop(), tags.pop()
            up = stack[-1]
            label, bad, weak = style(tag, m[3])
            self.parent.append(up), self.label.append(label), self.key.append(key(self.key[up], label))
            self.tag.append(tag), self.marks.append((bad, weak))
            stack.append(len(self.parent) - 1), tags.append(tag)
        if at < end and not skip and not inline:
            parts.append(entities.unescape(html[at:]))
        flush()

        self._judge({i for i, t in enumerate(self.tag) if t in ("html", "body")} | self.above(self._unmarked({"main"})))
        if not any(self.main):
            self._judge(self.ignored | self.above(self._unmarked(MAIN_TAGS)))

    def _unmarked(self, tags: set[str] | frozenset[str]) -> list[int]:
        return [i for i, t in enumerate(self.tag) if t in tags and not self.marks[i][0]]

    def above(self, some: list[int]) -> set[int]:
        """Elements that hold one of these."""
        out: set[int] = set()
        for i in some:
            while (i := self.parent[i]) > 0 and i not in out:
                out.add(i)
        return out

    def _judge(self, ignored: set[int]) -> None:
        """Marks go down to all that an element holds, but for those that are ignored."""
        self.ignored, self.bad, self.main = ignored, [False], [False]
        for i in range(1, len(self.parent)):
            (bad, weak), inside = self.marks[i], self.main[self.parent[i]]
            self.bad.append(self.bad[self.parent[i]] or i not in ignored and (bad or weak and not inside))
            self.main.append((inside or self.tag[i] in MAIN_TAGS and not bad) and not self.bad[i])

    def tops(self) -> list[int]:
        """The outermost article and main elements."""
        return [i for i, m in enumerate(self.main) if m and not self.main[self.parent[i]]]


_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>])(?>\"[^\"]*\"|'[^']*'|[^>])*+>", re.S | re.I)
_TAG = re.compile("<[/!]?[a-zA-Z-]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title")}


def _raw_text(html: str) -> str:
    """html without comments and without what elements hold whose content isn't markup (such as scripts). One scan, as each hides the other's signs; of
    such an element that is never closed only the tag goes, of a script or style also what follows up to the next tag."""
    out, at, open_ = [], 0, dict.fromkeys(_ENDS, True)
    while m := _RAW.search(html, at):
        out.append(html[at : m.start()])
        at = m.end()
        if tag := (m[1] or "").lower():
            end = _ENDS[tag].search(html, at) if open_[tag] else None
            if end:
                out.append(f"<{tag}></{tag}>")
                at = end.end()
            elif tag in ("script", "style"):
                at = m.start() if (m := _TAG.search(html, at)) else len(html)
            open_[tag] = bool(end)
    return "".join([*out, html[at:]])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of presentations (kind 0) and texts (kind 1) of each node, summed over a batch."""
    for batch in batches:
        count: Counter = Counter()
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(_raw_text(html or ""), marks=False)
            children: dict[int, list[str]] = {}
            for i in range(1, len(page.parent)):
                children.setdefault(page.parent[i], []).append(page.label[i])
            seen = {}
            for i, k in enumerate(page.key):
                seen.setdefault(k, key(0, "|".join(children.get(i, ()))))
            for k, feature in seen.items():
                count[host, k, 0, feature] += 1
            for k, text in {(page.key[i], text.replace(host, "") if host else text) for i, text in page.blocks}:
                count[host, k, 1, key.__wrapped__(1, text)] += 1
        columns = list(zip(*count, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(list(count.values()), pa.int64())], ["host", "node", "kind", "feature", "n"])


def _scored(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Nodes with text, their pages and importance (as `name`), from counts per keys, kind and feature."""
    shown, said = F.col("kind") == 0, F.col("kind") == 1
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(shown, F.col("n"))).alias("pages"), F.count_if(shown).alias("presentations"), F.sum(F.when(shown, F.col("n") * F.ln("n"))).alias("shown"),
        F.count_if(said).alias("texts"), F.sum(F.when(said, F.ln("n"))).alias("said"),
    ).where("texts > 0")
    ln = F.ln("pages")
    presentation = F.when(F.col("pages") > 1, (ln - F.col("shown") / F.col("pages")) / ln).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("said") / F.col("texts") / ln).otherwise(1.0)
    share = F.pow(F.lit(GAMMA), F.col("presentations"))
    return sums.select(*keys, "pages", ((1 - share) * presentation + share * content).alias(name))


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of all nodes with text. pages: (host, html)."""
    counts = materialise(pages.select("host", "html").mapInArrow(_merged, "host string, node long, kind int, feature long, n long").groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")))
    here = _scored(counts, ["host", "node"], "own")
    everywhere = _scored(counts.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n")), ["node"], "common").select("node", "common")
    both = here.join(everywhere, "node")
    return both.select("host", "node", "pages", ((F.col("pages") * F.col("own") + PRIOR * F.col("common")) / (F.col("pages") + PRIOR)).alias("importance"))


def once(pages: DataFrame) -> DataFrame:
    """pages (page_id, host, html) without those whose host and html an earlier page has; only keys are shuffled."""
    keyed = pages.withColumn("h", F.xxhash64("html"))
    several = fitting(keyed.groupBy("host", "h").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("host", "h", "first"))
    return keyed.join(several, ["host", "h"], "left").where("first is null or page_id = first").select("host", "html")


def main_text(html: str, low: frozenset[int], marks: bool = True) -> str:
    page = Page(_raw_text(html), marks)
    fine = [(i, t) for i, t in page.blocks if not (marks and page.bad[i])]
    left = [(i, t) for i, t in fine if page.key[i] not in low]
    if marks and any(page.main[i] for i, _ in left):
        tops = page.tops()
        size = lambda main: sum(len(t) for i, t in left if page.main[i] == main)
        cards = len(tops) > 1 and all(page.tag[i] == "article" for i in tops)
        if not (cards and size(False) > size(True)):
            left = [(i, t) for i, t in left if page.main[i]]
    return " ".join(t for _, t in left or fine)


def _extractor(marks: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", frozenset(n or ()), marks) for h, n in zip(batch.column("html").to_pylist(), batch.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return work


def extracted(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    bounded_batches(pages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    low = materialise(importance(once(rows.select("page_id", "host", "html"))).where(F.col("importance") < LOW).select("host", "node"))
    lists = low.groupBy("host").agg(F.collect_list("node").alias("nodes"))
    if low.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    return rows.join(lists, "host", "left").select("page_id", "url", "html", "nodes").mapInArrow(_extractor(marks), "page_id long, url string, text string, n_chars long")
