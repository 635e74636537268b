"""Main text of web pages by composite text density.

*Tree.* The tokenizer of the standard library gives tags and decoded text; a
stack of open elements applies the usual rules for omitted end tags (a block
ends an open paragraph, list items, cells and options end their like, head ends
at the first element of a body). Text belongs to the block element around it; a
run of text between two block borders is one block of the result.

*Pruning.* What never is article text goes first, with all below it: scripts,
styles and other invisible elements, forms and controls, menus, footers,
asides, headers outside an article, and elements whose class, id or role names
a sidebar, notice, advert, menu, comment list and so on.

*Density.* Every remaining element has its characters C, tags T, characters and
tags within links LC and LT, all of its subtree. With the body's C_b and LC_b,

    density = C / T * log(C / LC * T / LT) / log(1 + B)
    B = ln(C / (C - LC) * LC + LC_b / C_b * C + e)

(zero denominators count as one, and one is added to B so that a page without
links has a base above one): characters per tag, lowered by the share of link
text. The density sum of an element is the sum of its child elements' densities.

*Selection.* The block container with the largest density sum is the core (ties:
the first). The least density on the path from the core up to the body, the body
excluded, is the threshold. Going down from the body through elements of at
least that density, the container with the largest density sum below each one is
kept whole, so an article that is cut into several parts stays together. Blocks
of kept elements are joined in page order.

Pages that have text only in labelled elements are read again without labels.

Defined results: null or empty pages and pages without article text give the
empty text; text without any tag is one block; end tags without start tags are
ignored, missing end tags end with their parent; ``<br>`` and other white space
(also no-break spaces) become one space; null urls and ids pass through, repeated
rows give repeated rows, other columns do not matter. Nothing is cut: depth,
length and number of elements have no bound but a task's memory for one page.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements of a line; all others are block elements
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: may stand within a paragraph without ending it
WITHIN = INLINE | frozenset("script style noscript template iframe object embed canvas svg math audio video map button input select "
                            "option textarea".split())
#: never article text, with all below
GONE = frozenset("head title script style noscript template iframe object embed canvas svg math audio video map form button "
                 "input select option textarea datalist fieldset nav footer aside menu dialog".split())
#: what stands in a head; anything else begins the body
HEAD = frozenset("title meta link style script base noscript template".split())
#: an end tag does not reach beyond these
WALLS = frozenset("td th table caption html".split())
#: start tag -> open elements of its kind that it ends, and where the search for them stops
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
        "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
#: words of class, id and role that name what is around an article
LABELS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
                   "navigation menu menubar breadcrumb breadcrumbs sidebar complementary header masthead topbar toolbar footer "
                   "contentinfo cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
                   "subscription signup login share sharing social related recommended recommendations pagination pager comment "
                   "comments commentlist disqus respond replies reviews search widget skip".split())
#: an article may have a header of its own
OUTER = frozenset("header masthead".split())
#: a class name with one of these speaks about the page, not about the element
ABOUT = frozenset("has with without no is open closed enabled disabled layout".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _labelled(attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for one in value.split():
                words = {w.lower() for w in WORDS.findall(one)}
                if words & (LABELS - OUTER if inside else LABELS) and not words & ABOUT:
                    return True
        elif name == "hidden":
            return True
    return False


class Page(HTMLParser):
    """The elements that stay, in page order: parent, tag, and the text of each run between block borders.

    Element 0 is the body. ``runs`` are (element, [texts])."""

    def __init__(self, labels: bool = True):
        super().__init__(convert_charrefs=True)
        self.labels = labels
        self.parent, self.block, self.link = [-1], [True], [False]
        self.chars, self.link_chars = [0], [0]
        self.runs: list[tuple[int, list[str]]] = []
        #: (tag, element or None below a pruned one, block element around text)
        self.open: list[tuple[str, int | None, int | None]] = [("body", 0, 0)]
        self.fresh = True

    def _close(self, at: int) -> None:
        if any(tag not in WITHIN for tag, *_ in self.open[at:]):
            self.fresh = True
        del self.open[at:]

    def _end_like(self, kinds, stops) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in kinds:
                # the outermost of the kind below the next stop
                while at > 1 and self.open[at - 1][0] in kinds:
                    at -= 1
                self._close(at)
                return
            if tag in stops or tag in WALLS and tag not in kinds:
                return

    def handle_starttag(self, tag, attrs):
        if self.open[-1][0] in ("title", "textarea"):
            return
        if tag in ("html", "body"):
            self._end_like({"head"}, set())
            return
        if self.open[-1][0] == "head" and tag not in HEAD:
            self._close(len(self.open) - 1)
        inline = tag in INLINE
        if tag not in WITHIN:
            self.fresh = True
            self._end_like({"p"}, {"button", "object"})
            if tag in ENDS:
                self._end_like(*ENDS[tag])
        _, above, block = self.open[-1]
        if tag == "br":
            self.handle_data(" ")
        inside = any(t in ("article", "main") for t, *_ in self.open)
        if above is None or tag in GONE or tag == "header" and not inside or self.labels and _labelled(attrs, inside):
            node = block = None
        else:
            node = len(self.parent)
            self.parent.append(above)
            self.block.append(not inline)
            self.link.append(tag == "a" or self.link[above])
            self.chars.append(0)
            self.link_chars.append(0)
            block = block if inline else node
        if tag not in VOID:
            self.open.append((tag, node, block))

    def handle_startendtag(self, tag, attrs):
        # a slash ends nothing in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("body", "html"):
            return
        inline = tag in INLINE
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                self._close(at)
                return
            if inline and name not in INLINE or name in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data):
        _, node, block = self.open[-1]
        if node is None:
            return
        if self.fresh or not self.runs or self.runs[-1][0] != block:
            self.runs.append((block, []))
            self.fresh = False
        self.runs[-1][1].append(data)
        n = len("".join(data.split()))
        self.chars[node] += n
        if self.link[node]:
            self.link_chars[node] += n


def densities(page: Page) -> tuple[list[float], list[float]]:
    """(density, density sum) of every element."""
    n = len(page.parent)
    chars, link_chars, tags = list(page.chars), list(page.link_chars), [1] * n
    link_tags = [int(x) for x in page.link]
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        tags[up] += tags[k]
        link_tags[up] += link_tags[k]
    share = link_chars[0] / max(chars[0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n):
        c, t, lc, lt = chars[k], tags[k], link_chars[k], link_tags[k]
        if c:
            base = 1 + math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base)
        if k:
            sums[page.parent[k]] += density[k]
    return density, sums


def kept_elements(page: Page) -> list[bool]:
    """Which elements lie in a selected subtree."""
    n = len(page.parent)
    density, sums = densities(page)
    container = [False] * n
    container[0] = True
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[page.parent[k]].append(k)
        if page.block[k]:
            container[page.parent[k]] = page.block[page.parent[k]]
    # the best container of each subtree; of equal ones the first
    best = [k if container[k] else -1 for k in range(n)]
    for k in range(n - 1, 0, -1):
        up, b = page.parent[k], best[k]
        if b >= 0 and (best[up] < 0 or (sums[b], -b) > (sums[best[up]], -best[up])):
            best[up] = b
    core = best[0]
    threshold, k = math.inf, core
    while k > 0:
        threshold = min(threshold, density[k])
        k = page.parent[k]
    chosen = [False] * n
    chosen[core] = True
    ahead = list(children[0]) if core else []
    while ahead:
        k = ahead.pop()
        if page.block[k] and density[k] >= threshold:
            chosen[best[k] if best[k] >= 0 else k] = True
            ahead += children[k]
    for k in range(1, n):
        chosen[k] = chosen[k] or chosen[page.parent[k]]
    return chosen


def _read(html: str, labels: bool = True) -> Page:
    page = Page(labels)
    page.feed(html)
    page.close()
    return page


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, one a line."""
    page = _read(html or "")
    if not any(page.chars):
        page = _read(html or "", labels=False)
    chosen = kept_elements(page)
    blocks = (" ".join("".join(texts).split()) for element, texts in page.runs if chosen[element])
    return "\n".join(b for b in blocks if b)


def extract_main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points) of every row."""
    import pyarrow as pa
    batches_of(df.sparkSession, 200)
    rows = df.select(*keep, F.col(html_col).alias("_html"))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
