"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; every block-level tag ends a line. A line has its text,
its number of tags and its *container*: the outermost article or main element around it, or else the
nearest section, div, cell or the body. Lines inside menus, headers, footers, sidebars, notices,
adverts, forms, comments or code (by element, role, class or id) are no candidates. The text-to-tag
ratio of the candidates is smoothed by a Gaussian over neighbouring lines, and the lines above the
threshold (whose own ratio is at least 1/OWN of it) form the content clusters. Clusters choose containers; a chosen container (but for the body) gives all its
candidate lines and those of the containers in it, so that a short heading, paragraph or table cell inside an article stays. If a page marks
articles, only these can be chosen.

A class or id is weaker evidence than an element or role: names such as has-sidebar or sidebar-wrap
mark nothing, and a mark around a main element, or around the page's only articles, is lifted, unless
more text stands outside. Marks of comments and related pages hold articles of others, and are lifted
only where no other text is. End tags that HTML lets authors omit are supplied.

Threshold: the standard deviation of the smoothed ratios, but no more than their maximum, so that a
page with any candidate has a cluster.

Defined results: NULL and empty pages, and pages without candidates, have the empty text. Character
references are decoded; any run of white space is one space. Pages are parsed whole, one at a time, in time
proportional to their length: open elements are found by tag, not by a walk.
Rows keep their ids, also NULL or repeated ones; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
RADIUS = 2
OWN = 4

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article body div main section td th".split())
ARTICLES = frozenset(("article", "main"))
BOILERPLATE = frozenset(
    "aside button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea".split()
)
BOILERPLATE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark boilerplate; names are split at anything but letters and at capitals.
BOILERPLATE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted"
    " related replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Names with one of these words tell of a layout, not of the element's own role.
LAYOUT_NAMES = frozenset("has have layout no with without wrap wrapper".split())
#: What holds articles of others.
FOREIGN_NAMES = frozenset("ad ads comment comments disqus promo promoted related replies respond sponsor sponsored".split())
#: Elements that an open head may hold; any other begins the body.
IN_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
#: Start tag: (elements that it closes, elements beyond which it does not look). None: any block but address, div and p.
_TABLE_PARTS = frozenset("tbody tfoot thead".split())
_P_SCOPE = frozenset("body button caption html object table td template th".split())
CLOSES: dict[str, list[tuple[frozenset[str], frozenset[str] | None]]] = {
    **{
        tag: [(frozenset(("p",)), _P_SCOPE)]
        for tag in (
            "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
            " header hgroup hr main menu nav ol p pre search section table ul"
        ).split()
    },
    "li": [(frozenset(("li",)), None), (frozenset(("p",)), _P_SCOPE)],
    **{tag: [(frozenset(("dd", "dt")), None), (frozenset(("p",)), _P_SCOPE)] for tag in ("dd", "dt")},
    **{tag: [(frozenset(("td", "th")), frozenset(("table", "template", "tr")))] for tag in ("td", "th")},
    "tr": [(frozenset(("tr",)), frozenset(("table", "template")))],
    **{tag: [(_TABLE_PARTS, frozenset(("table", "template")))] for tag in _TABLE_PARTS},
    "option": [(frozenset(("option",)), frozenset(("datalist", "optgroup", "select")))],
    "optgroup": [(frozenset(("optgroup",)), frozenset(("datalist", "select")))],
}
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _is_boilerplate(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """By element, role or visibility."""
    if tag in BOILERPLATE:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attributes:
        if name == "role" and (value or "").strip().lower() in BOILERPLATE_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _marks(tag: str, attributes: list[tuple[str, str | None]]) -> set[str]:
    """Boilerplate words of the class and id."""
    found: set[str] = set()
    if tag not in ("html", "body"):
        for name, value in attributes:
            if name in ("class", "id"):
                for one in (value or "").split():
                    split = {w.lower() for w in NAME_WORD.findall(one)}
                    if not split & LAYOUT_NAMES:
                        found |= split & BOILERPLATE_NAMES
    return found


class _Lines(HTMLParser):
    """Collects (text, tags, container, in an article) of the candidate lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []  # (): a tag; (text, innermost mark); (container, in an article, None): a line's end
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, boilerplate, container or 0, mark or 0
        self.open: dict[str, list[int]] = {}  # of a tag: its places in the stack
        self.blocks: list[int] = []  # places of what an omitted end tag does not reach beyond
        self.solid: list[int] = []  # places of what a stray inline end tag does not close
        self.open_containers: list[int] = []
        self.open_articles: list[int] = []
        self.boilerplate = 0
        self.mark = 0  # the innermost open one; 0 is none
        self.outer = {0: (0, 0, False)}  # of a mark: the one around it, how many there are, whether any is foreign
        self.articles: list[tuple[str, int]] = []
        self.pending = False
        self.body = 0
        self.around = [0]  # of a container: the one around it, 0 for none and for the body

    def _end_line(self) -> None:
        if self.pending:
            own = self.open_articles[:1] or self.open_containers[-1:] or [0]
            self.events.append((own[0], bool(self.open_articles), None))
            self.pending = False

    def _push(self, tag: str, boilerplate: bool, container: int, mark: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, boilerplate, container, mark))
        self.open.setdefault(tag, []).append(at)
        if tag not in INLINE and tag not in ("address", "div", "p"):
            self.blocks.append(at)
        if boilerplate or container or mark:
            self.solid.append(at)
        if container:
            self.open_containers.append(container)
        if tag in ARTICLES:
            self.open_articles.append(container)

    def _close(self, at: int) -> None:
        while len(self.stack) > at:
            tag, boilerplate, container, mark = self.stack.pop()
            self.open[tag].pop()
            self.boilerplate -= boilerplate
            if mark:
                self.mark = self.outer[mark][0]
            if container:
                self.open_containers.pop()
            if tag in ARTICLES:
                self.open_articles.pop()
        for places in (self.blocks, self.solid):
            while places and places[-1] >= at:
                places.pop()

    def _last(self, tags) -> int:  # type: ignore[no-untyped-def]
        """Place of the innermost open one of the tags, -1 if none is open."""
        return max((self.open[tag][-1] for tag in tags if self.open.get(tag)), default=-1)

    def _close_omitted(self, tag: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD or tag == "body":
            if self.open.get("head"):
                self._close(self.open["head"][0])
        for closed, beyond in CLOSES.get(tag, ()):
            at = self._last(closed)
            limit = self._last(beyond) if beyond is not None else self.blocks[-1] if self.blocks else -1
            if at >= 0 and at >= limit:
                self._close(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._end_line()
        self.events.append(())
        self._close_omitted(tag)
        if tag in VOID:
            return
        container = mark = 0
        if tag in CONTAINERS:
            container = len(self.around)
            outside = self.open_containers[-1] if self.open_containers else 0
            self.around.append(0 if outside and outside == self.body else outside)
            if tag == "body":
                self.body = container
        boilerplate = _is_boilerplate(tag, attrs)
        self.boilerplate += boilerplate
        # The main element is what it is, by any name.
        names = _marks(tag, attrs) if tag != "main" and not self.boilerplate else ()
        if tag in ARTICLES and not self.boilerplate and not names:
            self.articles.append((tag, self.mark))
        if names:
            mark = len(self.events)
            _, around, foreign = self.outer[self.mark]
            self.outer[mark] = (self.mark, around + 1, foreign or bool(FOREIGN_NAMES.intersection(names)))
            self.mark = mark
        self._push(tag, boilerplate, container, mark)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self._end_line()
        self.events.append(())

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.events.append(())
        at = self._last((tag,))
        # A stray inline end tag does not close the element around it.
        if at >= 0 and not (tag in INLINE and self.solid and self.solid[-1] > at):
            self._close(at)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._close(len(self.stack) - 1)
        if not self.boilerplate:
            self.events.append((data, self.mark))
            self.pending = True

    def _lines(self, lifted: set[int]) -> list[tuple[str, int, int, bool]]:
        """The candidate lines when the lifted marks do not count."""
        lines: list[tuple[str, int, int, bool]] = []
        free = {0}
        for mark, (around, *_) in self.outer.items():
            if mark in lifted and around in free:
                free.add(mark)
        parts: list[str] = []
        tags = 0
        for event in self.events:
            if not event:
                tags += 1
            elif len(event) == 2:
                if event[1] in free:
                    parts.append(event[0])
            else:
                text = " ".join("".join(parts).split())
                if text:
                    lines.append((text, max(1, tags), event[0], event[1]))
                    tags = 0
                parts = []
        return lines

    def _lifted(self, lifted: set[int], marks: list[int]) -> set[int]:
        out = set(lifted)
        for mark in marks:
            while mark and mark not in out:
                out.add(mark)
                mark = self.outer[mark][0]
        return out

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        lifted = self._lifted(set(), [mark for tag, mark in self.articles if tag == "main" and not self.outer[mark][2]])
        lines = self._lines(lifted)
        around = [mark for tag, mark in self.articles if tag == "article"]
        own = [mark for mark in around if not self.outer[mark][2]]
        if own and not any(mark == 0 or mark in lifted for mark in around):
            fewest = min(self.outer[mark][1] for mark in own)
            more = self._lines(self._lifted(lifted, [mark for mark in own if self.outer[mark][1] == fewest]))
            if sum(len(text) for text, *_ in more) >= 2 * sum(len(text) for text, *_ in lines):
                lines = more
        if not lines and self.articles:
            lines = self._lines(self._lifted(lifted, [mark for _, mark in self.articles]))
        return lines


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian mean over neighbouring lines; at the ends over those that exist."""
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[i + d]) for d, w in zip(range(-RADIUS, RADIUS + 1), weights, strict=True) if 0 <= i + d < len(ratios)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(html or "")
    lines = parser.finish()
    if any(in_article for *_, in_article in lines):
        lines = [x for x in lines if x[3]]
    if not lines:
        return ""
    ratios = smoothed([len(text) / tags for text, tags, _, _ in lines])
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    cut = min(spread, max(ratios))
    # A line beside a long text is lifted by it, so its own ratio counts too.
    own = [len(text) / tags for text, tags, _, _ in lines]
    chosen = {x[2] for x, ratio, alone in zip(lines, ratios, own, strict=True) if ratio >= cut and OWN * alone >= cut}
    inside = [0 in chosen]
    for container in range(1, len(parser.around)):
        around = parser.around[container]
        inside.append(container in chosen or bool(around) and inside[around])
    return " ".join(text for text, _, container, _ in lines if inside[container])


def _extract(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        texts = [main_text(html) for html in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars (its code points) of every page."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
