"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block of text is one line, and what surrounds the article becomes
blank. A window over the following lines sums their lengths. The text starts at a surge, where the
sum rises to a threshold, and ends at a dive, where it falls to nothing; the lines between belong
to the article. Outside article and main elements lines that are mostly link text have no length, so that link lists do not surge, and make
text dive.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

WINDOW = 3
#: Length of a window at which text surges, if the page has any such window; inside an article or main element any length does.
SURGE = 86
#: Share of the main text from which on an element is the text itself, whatever its class says, unless it holds comments.
MOST = 0.5

# fixed values: element names
_RAW = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"
_DROPPED = frozenset("nav footer aside form button dialog menu head label fieldset option".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset("article main".split())
#: Elements that a start tag of the same kind closes.
_SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

# fixed values: whole words of class and id that mark what is not the article, words that only go along with these, that say of comments something else than that they are there, and roles
_COMMENTS = frozenset("comment comments commentlist respond disqus".split())
_NOISE = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion sidebar cookie cookies consent gdpr notice alert menu menus nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay pagination pager "
    "toolbar skip".split()
)
_NO_LIST = frozenset("no open closed has with without enabled disabled off allow count on and the of about from".split())
_BESIDE = frozenset(
    "site page global main primary secondary top bottom left right side inner outer list item items box bar button buttons link links icons area wrap wrapper container row col block slot unit "
    "section widget form media posts articles stories message text policy google to content".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S | re.I)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
#: Class and id names are words joined by hyphens, underscores or capitals.
_NAME_BREAK = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Elements inside a line, whose class says nothing of what the line is.
_INLINE = frozenset("a abbr b cite code em i mark small span strong sub sup u".split())
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _noise(name: str, attributes: str, in_main: bool) -> str:
    """Why an element is left out: 'never' for what never is text, 'comments', 'maybe' for what is not if it holds most of it, or ''."""
    if attributes and _HIDDEN.search(_QUOTED.sub('""', attributes)):
        return "never"
    if name in _DROPPED or name == "header" and not in_main:
        return "maybe" if name == "form" else "never"
    if not attributes or name in _HEADINGS or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for kind, *values in _MARKS.findall(attributes):
        for token in "".join(values).split():
            if kind.lower() == "role":
                if token.lower() in _ROLES:
                    return "never"
                continue
            words = [w.lower() for w in _NAME_BREAK.split(token) if w]
            # one word is enough for comments, whatever stands beside it
            if name not in _INLINE and any(w in _COMMENTS for w in words) and not any(w in _NO_LIST for w in words):
                found = "comments"
            if words and all(w in _NOISE or w in _BESIDE for w in words) and any(w in _NOISE for w in words):
                found = "comments" if any(w in _COMMENTS for w in words) else found or "maybe"
    return found


class _Lines:
    """Blocks of a page; every step of the walk takes constant time, but for elements that it closes."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, bool, int]] = []  # text, characters of it in links, in main, heading, innermost left-out element
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}  # depths of the open elements of each name
        self.noise: list[tuple[str, int]] = []  # reason and parent of every left-out element
        self.open_noise: list[tuple[int, int]] = []  # depth and number
        self.main: list[int] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.rows.append((text, min(self.linked, len(text)), bool(self.main), self.heading, self.open_noise[-1][1] if self.open_noise else -1))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.rows.extend([("", 0, False, False, -1)] * WINDOW)

    def take(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.at.get("a"):
                self.linked += len(text)

    def open(self, name: str, attributes: str) -> None:
        depth = len(self.names)
        reason = _noise(name, attributes, bool(self.main))
        if reason:
            self.flush()
            self.noise.append((reason, self.open_noise[-1][1] if self.open_noise else -1))
            self.open_noise.append((depth, len(self.noise) - 1))
        if name in _MAIN and not self.open_noise:
            self.gap()
            self.main.append(depth)
        elif name in _MAIN and all(self.noise[n][0] == "maybe" for _, n in self.open_noise[-1:]) and not self.main:
            self.gap()
            self.main.append(depth)
        self.heading = name in _HEADINGS or self.heading and name not in _BLOCKS
        self.names.append(name)
        self.at.setdefault(name, []).append(depth)

    def close(self, depth: int) -> None:
        """Close all elements from that depth on."""
        if self.open_noise and self.open_noise[-1][0] >= depth:
            self.flush()
        for name in reversed(self.names[depth:]):
            self.at[name].pop()
        del self.names[depth:]
        while self.open_noise and self.open_noise[-1][0] >= depth:
            self.open_noise.pop()
        while self.main and self.main[-1] >= depth:
            self.main.pop()
            self.gap()
        self.heading = any(self.at.get(h) for h in _HEADINGS)

    def last(self, names: frozenset[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


_NESTING = frozenset("ul ol dl table".split())


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of it in links, in an article or main element, a heading) of each block that is not left out, blank ones kept as separators."""
    lines, at = _Lines(), 0
    for tag in _TAG.finditer(page):
        lines.take(page[at : tag.start()])
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue
        if tag[2]:
            if name in _BLOCKS:
                lines.flush()
            if lines.at.get(name):
                lines.close(lines.at[name][-1])
            continue
        if name in _BLOCKS:
            lines.flush()
        elif name == "br":
            lines.take(" ")
        if name in _VOID or tag[4].endswith("/"):
            continue
        # a nested list or table keeps its outer item open
        if name in _SELF_CLOSING and lines.at.get(name) and lines.last(_NESTING) < lines.at[name][-1]:
            lines.close(lines.at[name][-1])
        lines.open(name, tag[4])
    lines.take(page[at:])
    lines.flush()
    return _without_noise(lines)


def _without_noise(lines: _Lines) -> list[tuple[str, int, bool, bool]]:
    main = any(row[0] and row[2] for row in lines.rows)
    size, total = [0] * len(lines.noise), 0
    for text, _, inside, _, noise in lines.rows:
        if inside or not main:
            total += len(text)
            if noise >= 0:
                size[noise] += len(text)
    for i in reversed(range(len(size))):
        if lines.noise[i][1] >= 0:
            size[lines.noise[i][1]] += size[i]
    out: list[bool] = []
    for i, (reason, parent) in enumerate(lines.noise):
        out.append(parent >= 0 and out[parent] or not (reason == "maybe" and size[i] > MOST * total))
    return [(text, linked, inside, heading) for text, linked, inside, heading, noise in lines.rows if noise < 0 or not out[noise]]


def main_text(page: str) -> str:
    """The article's blocks, joined by one space."""
    lines = lines_of(page)
    # with an article or main element, only lines inside count
    inside = any(main and text for text, _, main, _ in lines)
    # in an article links are text too: what leads away stands in elements that are left out
    weight = [len(text) * main if inside else 0 if 2 * linked > len(text) else len(text) - linked for text, linked, main, _ in lines]
    if not any(weight):
        return ""
    n = len(lines)
    sums = np.concatenate(([0], np.cumsum(weight), np.full(WINDOW, sum(weight)))) if n else np.zeros(1, int)
    window = sums[WINDOW : WINDOW + n] - sums[:n]
    surge = 1 if inside else min(SURGE, int(window.max()))
    kept: list[str] = []
    at = 0
    while at < n:
        if window[at] < surge:
            at += 1
            continue
        end = at
        while end < n and window[end] > 0:
            end += 1
        # links before the first text are no part of it, headings are
        while at < end and not weight[at] and not lines[at][3]:
            at += 1
        kept += [text for text, _, main, _ in lines[at:end] if text and (main or not inside)]
        at = end + 1
    return " ".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    The text is the article's blocks in page order, joined by one space; character references are
    decoded and white space inside a block is one space. Class and id words leave an element out only
    as whole words, never a heading, and, comments apart, never one that holds most of the text. A word for
    comments does so beside any other word. A null or empty page, and one without an
    article, gives an empty text and 0. Whole pages are read, however long or broken: unclosed
    elements end with their parents, an unended comment or script with the page. Repeated rows give
    repeated results; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "") for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_main_text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
