"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Text is gathered into lines, one
per block element. A line's ratio is its characters outside links over its tags; ratios
are smoothed with a Gaussian over neighbouring lines, and a threshold between the two
clusters of smoothed ratios (high: content) picks lines. Picked lines only find the
region: all lines of the outermost article (else the main element) around a picked line
belong to the text; on pages without, all lines of the lowest container around all
picked lines, or, where that is the page itself, what lies between the first and the
last of the containers picked. So short sections, titles, quotes and cells stay. Lines inside elements that are never content (navigation, forms,
scripts, asides and whatever a class, id or role calls a menu, an advert, a notice or
comments) count as lines of no text, whatever they hold. A class or id may also name the
layout around the text: the main element, or the articles, inside the fewest such
elements start afresh, so that a wrapper does not take them along.

White space is what Python's ``str.split`` takes for it. Characters come decoded from
the parser. Nothing is cut off.

Defined cases: a null page is an empty one and has an empty text; a page without any
block text too; markup that is never closed ends with the page; repeated rows get equal
results; other columns are left alone; no pages give no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame

from boxloom.llm.tables import by_batch, narrow

#: Width of the Gaussian in lines.
SIGMA = 1.0
#: Rounds that move the two cluster centres.
CLUSTER_ROUNDS = 10

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video select option textarea title head".split())
_NEVER = _RAW | frozenset("nav header footer aside form button dialog menu figcaption label fieldset".split())
_CONTAINER = frozenset("html body main article section div td th table blockquote".split())
_PAGE = frozenset(("", "html", "body"))
_LINE = _CONTAINER | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre tr tbody thead tfoot caption figure address hr details summary".split()
)
#: Elements whose start closes an open paragraph, and what closes what.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
#: What may stand in a head; the start of anything else ends it.
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: What may stand in a select; the start of anything else that makes a line ends an option and its select.
_IN_SELECT = frozenset("option optgroup hr".split())
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|menu|nav\w*|breadcrumbs?|sidebar|side|widget|header|masthead|"
    r"footer|comments?|comment-?list|replies|disqus|cookies?|consent|notice|alert|popup|modal|subscribe|newsletter|social|share|"
    r"sharing|related|recommend\w*|pagination|pager|login|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names of what holds articles of its own: readers' comments.
_COMMENTS = re.compile(r"(?:^|\s)(?:comments?|comment-?list|replies|disqus)(?:$|\s)", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class _Page(HTMLParser):
    """Lines of a page: ``[pieces, tags, linked characters, never, container, named]``, where
    never is by element or role and named counts the enclosing elements never by class."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.never = 0
        self.named = 0
        self.raw = 0
        self.links = 0
        self.inner = 0
        self.containers = [0]
        #: Of every container: tag, enclosing container, and for main and article the
        #: elements never by class around it, if it is open to start afresh.
        self.made: list[tuple[str, int, int | None]] = [("", 0, None)]
        self._line()

    def _line(self) -> None:
        self.lines.append([[], 0, 0, self.never > 0, self.containers[-1], self.named])

    def _close(self, tag: str) -> None:
        name, never, named, raw = self.open.pop()
        self.never -= never
        self.named -= named
        self.raw -= raw
        if name in _CONTAINER:
            self.containers.pop()
            self.inner -= name in ("main", "article")
        if name == "a":
            self.links -= 1
        if name in _LINE or never or named:
            self._line()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1][1] += 1
        if self.raw:
            self._end_unclosed(tag)
        closes = _CLOSES.get(tag, ())
        if tag in _LINE and self.open and self._top_block() == "p":
            closes = {"p"}
        if closes and self._top_block() in closes:
            while self.open[-1][0] not in closes:
                self._close(self.open[-1][0])
            self._close(self.open[-1][0])
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.lines[-1][0].append(" ")
            return
        named = dict(attrs)
        # inside main and article, ids name parts of the text
        words = f"{named.get('class') or ''} {'' if self.inner else named.get('id') or ''}"
        never = tag in _NEVER or (named.get("role") or "").lower() in _ROLES or "hidden" in named
        whole = tag in ("html", "body", "main", "article")
        never = never or (not whole and _COMMENTS.search(words) is not None)
        by_name = not never and not whole and _BOILERPLATE.search(words) is not None
        raw = tag in _RAW
        self.open.append((tag, never, by_name, raw))
        self.never += never
        self.named += by_name
        self.raw += raw
        if tag in _CONTAINER:
            depth = self.named if tag in ("main", "article") and not self.never else None
            self.made.append((tag, self.containers[-1], depth))
            self.containers.append(len(self.made) - 1)
            self.inner += tag in ("main", "article")
        if tag == "a":
            self.links += 1
        if tag in _LINE or never or by_name:
            self._line()
            self.lines[-1][1] += 1

    def _end_unclosed(self, tag: str) -> None:
        """Close a head or a select whose end the page leaves out."""
        tops = [name for name, _, _, _ in self.open[:2]]
        if "head" in tops and (tag in ("body", "main", "article") or (self.open[-1][0] == "head" and tag not in _IN_HEAD)):
            while len(self.open) > tops.index("head"):
                self._close(self.open[-1][0])
        elif tag in _LINE and tag not in _IN_SELECT and self.open[-1][0] in ("option", "select"):
            while self.open and self.open[-1][0] in ("option", "optgroup", "select"):
                self._close(self.open[-1][0])

    def _top_block(self) -> str:
        """The innermost open element that makes a line."""
        return next((name for name, never, named, _ in reversed(self.open) if name in _LINE or never or named), "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        for back in range(len(self.open) - 1, -1, -1):
            name = self.open[back][0]
            if name == tag:
                while len(self.open) > back:
                    self._close(self.open[-1][0])
                return
            if name in _CONTAINER and tag not in _CONTAINER and tag not in _NEVER:
                return

    def handle_data(self, data: str) -> None:
        if self.raw:
            return
        self.lines[-1][0].append(data)
        if self.links:
            self.lines[-1][2] += len(data)

    def afresh(self) -> list[int]:
        """Of every container: how many elements never by class a main or article that
        starts afresh leaves behind for it."""

        def least(tag: str, among: set[int]) -> set[int]:
            depths = {i: d for i, (name, _, d) in enumerate(self.made) if name == tag and d is not None and i in among}
            return {i for i, d in depths.items() if d == min(depths.values())}

        everything = set(range(len(self.made)))
        mains = least("main", everything)
        inside = set(mains)
        for i, (_, parent, _) in enumerate(self.made):
            if parent in inside:
                inside.add(i)
        fresh = mains | least("article", inside or everything)
        left = [0]
        for i, (_, parent, depth) in enumerate(self.made[1:], 1):
            left.append(depth if i in fresh else left[parent])
        return left


def _threshold(values: list[float]) -> float:
    """The middle between the centres of the low and the high cluster."""
    low, high = min(values), max(values)
    for _ in range(CLUSTER_ROUNDS):
        middle = (low + high) / 2
        below, above = [v for v in values if v < middle], [v for v in values if v >= middle]
        if not below or not above:
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    return (low + high) / 2


_WINDOW = max(1, round(3 * SIGMA))
_KERNEL = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-_WINDOW, _WINDOW + 1)]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines, left = [], page.afresh()
    for pieces, tags, linked, never, container, named in page.lines:
        never = never or named > left[container]
        text = " ".join("".join(pieces).split())
        if text or tags:
            # ratios fall off slowly, so that one long line does not hide the others
            ratio = 0.0 if never else max(0, len(text) - linked) / (tags + 1)
            lines.append((text, ratio**0.5, never, container))
    usable = [bool(text) and not never for text, _, never, _ in lines]
    if not any(usable):
        return ""
    ratios = [r for _, r, _, _ in lines]
    padded = [ratios[0]] * _WINDOW + ratios + [ratios[-1]] * _WINDOW
    total = sum(_KERNEL)
    smooth = [sum(k * padded[i + j] for j, k in enumerate(_KERNEL)) / total for i in range(len(ratios))]
    least = _threshold(smooth)
    picked = {line[3] for line, value, ok in zip(lines, smooth, usable, strict=True) if ok and value >= least}
    if not picked:
        # smoothing moved the peak onto lines that are never content: take the best usable one
        best = max((i for i, ok in enumerate(usable) if ok), key=lambda i: smooth[i])
        picked = {lines[best][3]}
    region = _region(page.made, picked, [line[3] for line in lines])
    return " ".join(line[0] for i, (line, ok) in enumerate(zip(lines, usable, strict=True)) if ok and i in region)


def _region(made: list[tuple], picked: set[int], containers: list[int]) -> set[int]:
    """The lines, by place in ``containers``, of the regions that the picked containers find."""

    def within(tops: set[int]) -> set[int]:
        """Places of the lines inside; a container comes after the one around it."""
        inside = set(tops)
        for i, (_, parent, _) in enumerate(made[1:], 1):
            if parent in inside:
                inside.add(i)
        return {k for k, at in enumerate(containers) if at in inside}

    outer: dict[str, list[int]] = {"article": [0], "main": [0]}
    for i, (name, parent, _) in enumerate(made[1:], 1):
        for tag, tops in outer.items():
            tops.append(tops[parent] or (i if name == tag else 0))
    regions = {outer["article"][at] or outer["main"][at] for at in picked} - {0}
    others = set()
    for at in picked:
        if not (outer["article"][at] or outer["main"][at]):
            out = at
            while made[out][0] in ("section", "blockquote"):  # a part of what is around it
                out = made[out][1]
            others.add(at if made[out][0] in _PAGE else out)
    if regions:
        return within(regions) | {k for k, at in enumerate(containers) if at in others}
    level = set(others)
    while len(level) > 1:
        latest = max(level)
        level = level - {latest} | {made[latest][1]}
    top = level.pop()
    if made[top][0] not in _PAGE:
        return within({top})
    own = within({at for at in others if made[at][0] not in _PAGE}) | {k for k, at in enumerate(containers) if at in others}
    return set(range(min(own), max(own) + 1))


def _extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(html) for html in batch.column("html").to_pylist()]
    return pa.record_batch(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    own = narrow(pages, page_id="page_id", url="url", html="html")
    return own.mapInArrow(by_batch(_extracted), "page_id bigint, url string, text string, n_chars bigint")
