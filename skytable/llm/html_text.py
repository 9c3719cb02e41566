"""Main text of web pages by text-to-tag ratios.

Standard-library parser events are streamed to lines, one for each block of text. Each line has a ratio
of characters to tags; text of navigation, forms, notices, comments and the like counts as markup. Ratios are
smoothed with a Gaussian and split in two clusters by a threshold, and the lines of the high
cluster mark the content regions. A region holds all its lines, short ones too: those of the article
element it lies in, or else those of the innermost element about all marked lines. Headings that stand right before a
region belong to it.

Class and id names say what an element is only by whole words of its own, never as a part of a longer word or
behind a word like ``has`` or ``no``; an element with the page's main or article element in it is a frame, whatever its name.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytable.llm.common import bounded_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "aside button dialog fieldset footer form head iframe menu nav noscript object option script select style svg template textarea title".split()
)
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
# Words of class, id and role attributes that name parts which are not the article.
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
_OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead share sharing social related recommended "
    "newsletter subscribe signup login search toolbar complementary contentinfo".split()
)
# Before a name, these say that something else has, lacks or shows such a part; with these, a header is the article's own.
_MODIFIERS = frozenset("has have with no not without is are hide hides show shows js".split())
_OWN = frozenset("article post entry content story page section".split())
_COLLECTIONS = frozenset("result results page".split())


def _named(attrs, comments: bool = False) -> bool:
    """Do class, id or role name a part that is not the article, or, with ``comments``, reader comments?"""
    for key, value in attrs:
        if key not in ("class", "id", "role"):
            continue
        for token in (value or "").lower().split():
            words = [w for w in re.split(r"[\W_]+", token) if w]
            if not words or words[0] in _MODIFIERS:
                continue
            if _COMMENTS.intersection(words):
                return True
            found = _OTHERS.intersection(words)
            if comments or not found:
                continue
            # The article's own header, and lists of results, are content.
            if found == {"header"} and _OWN.intersection(words) or found == {"search"} and _COLLECTIONS.intersection(words):
                continue
            return True
    return False


SIGMA = 1.5
_KERNEL = np.exp(-0.5 * (np.arange(-4, 5) / SIGMA) ** 2)


class _Element:
    """An open element: the article element that holds it (0: none), and whether and why its text is left out."""

    __slots__ = ("tag", "article", "out", "up", "frame")

    def __init__(self, tag: str, article: int, out: str, up):
        self.tag, self.article, self.out, self.up, self.frame = tag, article, out, up, False

    def path(self) -> list:
        found, element = [], self
        while element is not None:
            found.append(element)
            element = element.up
        return found[::-1]

    def left_out(self) -> bool:
        """Some element about this one is left out; names do not count for a frame, nor beyond an article that began anew."""
        element = self
        while element is not None:
            if element.out == "stop":
                return False
            if element.out in ("tag", "comments") or (element.out == "name" and not element.frame):
                return True
            element = element.up
        return False


class _Lines(HTMLParser):
    """Lines of a page: text, tags, characters of links, the element they are in, and whether they are a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, _Element, bool]] = []
        self.open: list[_Element] = [_Element("", 0, "", None)]
        self.articles = 0
        self.parts: list[str] = []
        self.tags = self.links = self.inside_links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            place = self.open[-1]
            heading = any(e.tag in HEADINGS for e in self.open)
            self.lines.append((text, self.tags, self.links, place, heading))
            self.tags = 0
        self.parts.clear()
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if tag == "p":
            self.close_to("p", until=BLOCKS - {"p"})
        elif tag == "li":
            self.close_to("li", until=BLOCKS - {"li"} - {"p"})
        elif tag == "body":
            self.close_to("head")
        top = self.open[-1]
        article, out = top.article, ""
        if tag in CONTENT:
            if tag == "article" and _named(attrs):
                out = "comments" if _named(attrs, comments=True) else "name"
            elif not article:
                # An article begins anew, also inside a menu that was never closed, but not among comments, notes or footers.
                held = [e for e in self.open if e.out and not (e.out == "name" and e.frame)]
                if tag == "main" or all(e.out == "name" or (e.out == "tag" and e.tag not in ("aside", "footer", "template", "noscript")) for e in held):
                    self.articles += 1
                    article = self.articles
                    out = "stop" if any(e.out == "tag" for e in held) else ""
                    for element in self.open:
                        element.frame = True
        elif tag in LEFT_OUT or (tag == "header" and not article):
            out = "tag"
        elif tag not in ("html", "body") and _named(attrs):
            out = "comments" if _named(attrs, comments=True) else "name"
        if out in ("tag", "name", "comments"):
            # Text of one block that goes on in a part that is left out ends its line.
            self.end_line()
        if tag == "a":
            self.inside_links += 1
        self.open.append(_Element(tag, article, out, top))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def close_to(self, tag: str, until: frozenset = frozenset()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].tag
            if name == tag:
                if any(e.out in ("tag", "name", "comments") for e in self.open[k:]):
                    self.end_line()
                self.inside_links -= sum(e.tag == "a" for e in self.open[k:])
                del self.open[k:]
                return
            if name in until:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.close_to(tag)

    def handle_data(self, data):
        self.parts.append(data)
        if self.inside_links:
            self.links += len(data.strip())


def _threshold(values: np.ndarray) -> float:
    """Middle between the means of two clusters; values that are all much alike are one."""
    low, high = values.min(), values.max()
    if 2 * low > high:
        return low / 2
    for _ in range(20):
        cut = (low + high) / 2
        upper = values >= cut
        if upper.all() or not upper.any():
            return cut
        fresh = values[~upper].mean(), values[upper].mean()
        if fresh == (low, high):
            break
        low, high = fresh
    return (low + high) / 2


def _about(elements: list[_Element]) -> _Element:
    """The innermost element that holds all of some elements."""
    common = elements[0].path()
    for element in elements[1:]:
        path = element.path()
        k = 0
        while k < min(len(common), len(path)) and common[k] is path[k]:
            k += 1
        common = common[:k]
    return common[-1]


def main_text(html: str | None) -> str:
    """The article of a page; blocks are joined by an empty line."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    out = np.array([e.left_out() for _, _, _, e, _ in page.lines])
    article = np.array([e.article for _, _, _, e, _ in page.lines])
    ratio = np.array([0.0 if gone else len(t) / (1 + n) for (t, n, _, _, _), gone in zip(page.lines, out)])
    if not ratio.any():
        return ""
    smooth = np.convolve(np.pad(ratio, 4), _KERNEL, "valid") / np.convolve(np.pad(np.ones(len(ratio)), 4), _KERNEL, "valid")
    cut = _threshold(smooth)
    # Smoothing marks neighbours too; a region begins and ends with a line that is dense by itself.
    marked = np.flatnonzero((smooth >= cut) & (ratio >= cut))
    if not len(marked):
        marked = np.array([int(ratio.argmax())])
    keep = np.zeros(len(out), bool)
    if (article[marked] > 0).any():
        keep |= np.isin(article, np.unique(article[marked][article[marked] > 0]))
    else:
        keep[marked[0] : marked[-1] + 1] = True
        about = [page.lines[k][3] for k in marked]
        # The block of one line is no region; the element about it is.
        holder = _about([e for e in about if e.tag not in BLOCKS or e.up is None or e.tag in ("div", "section", "body", "td")] or about)
        if len(about) == 1 and holder.up is not None and holder.tag not in ("div", "section", "body", "td"):
            holder = holder.up
        while holder.up is not None and holder.tag not in ("div", "section", "body", "td", "html"):
            holder = holder.up
        # Lines beside the region are its own unless they are mostly links.
        beside = np.array([any(x is holder for x in e.path()) and 2 * n <= len(t) for t, _, n, e, _ in page.lines])
        keep |= beside
    keep &= ~out
    # Headings right before a region.
    for k in np.flatnonzero(keep):
        while k and not keep[k - 1] and not out[k - 1] and page.lines[k - 1][4]:
            k -= 1
            keep[k] = True
    return "\n\n".join(line[0] for line, k in zip(page.lines, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; other columns are not used).

    Null or empty html, and a page without text, give the empty text. Ids and addresses pass as they
    are, null or repeated. Whole pages of any length are read. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
