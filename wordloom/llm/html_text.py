"""Main text of web pages by line-block distribution.

A page is cut into lines at block elements, markup is stripped, and the text lengths of sliding windows of
lines show where running text begins (surge) and ends (dive); the text between is kept.  What the markup
itself marks as menu, header, footer, sidebar, notice, advert, form, script, style or comments is left out,
within a line too; links have length 0.

If there are article or main elements, each outermost one has a distribution of its own, and all of them are kept,
in page order.  Inside, running text goes on to both sides of surge and dive as far as lines have text or are text
blocks: what markup calls the article loses a beginning or an end only where it is bare links.

A null or empty page, one without text and one with nothing but menus give an empty text.  Broken markup is
read to the end of the page; a box that is never closed counts as ordinary text, and a link that is not closed
before the next one ends with its line.  An anchor without href is no link.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import arrow_bounded

# Blocks whose text may be one link within running text; a bare div of links is a teaser or a menu.
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption dd dt li pre".split())
# Lines summed up for a point of the distribution, and the sum that marks running text.
WINDOW = 3
SURGE = 86

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = frozenset("script style noscript template textarea title xmp iframe svg math object".split())
_BOXES = frozenset("nav footer aside form menu dialog select button fieldset".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACED = frozenset("br td th".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies disqus disclaimer footer gdpr header menu modal nav navbar navigation newsletter notice "
    "popup promo promoted promotion related replies respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(text)}


def _is_marked(text: str) -> bool:
    """Whether attributes call the element a menu, an advert and so on."""
    if "=" not in text and "hidden" not in text:
        return False
    own = _attributes(text)
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in _ROLES:
        return True
    names = re.split(r"[^a-z0-9]+", f"{own.get('class', '')} {own.get('id', '')}".lower())
    return not _MARKS.isdisjoint(names)


def _closes(tokens: list[tuple[str, str, str]]) -> list[int | None]:
    """For each opening token the one that closes its element, if any."""
    found: list[int | None] = [None] * len(tokens)
    open_: dict[str, list[int]] = {}
    for at, (closing, name, _) in enumerate(tokens):
        own = open_.setdefault(name, [])
        if not closing:
            own.append(at)
        elif own:
            found[own.pop()] = at
    return found


def _next_blocks(tokens: list[tuple[str, str, str]]) -> list[int | None]:
    """For each token the next one of a block element."""
    found: list[int | None] = [None] * len(tokens)
    following = None
    for at in range(len(tokens) - 1, -1, -1):
        found[at] = following
        if tokens[at][1] in _BLOCKS:
            following = at
    return found


def lines_of(page: str) -> list[tuple[str, int, int | None, bool]]:
    """Lines of a page in order: text, length without links, number of the article, whether a block of text.

    What stands in a marked box is no part of them.
    """
    tokens, place = [], 0
    pieces = [""]
    while True:
        found = _TOKEN.search(page, place)
        if found is None:
            break
        pieces[-1] += page[place : found.start()]
        place = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in _RAW and not found[1]:
            if found[0].endswith("/>"):
                continue
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        tokens.append((found[1], name, found[3]))
        pieces.append("")
    pieces[-1] += page[place:]

    close_of, next_block = _closes(tokens), _next_blocks(tokens)
    # Whether the next anchor token closes the one at hand.
    closes = [False] * len(tokens)
    closing_next = False
    for at in range(len(tokens) - 1, -1, -1):
        if tokens[at][1] == "a":
            closes[at] = closing_next
            closing_next = bool(tokens[at][0])

    lines: list[tuple[str, int, int | None, bool]] = []
    parts: list[tuple[str, bool]] = []
    boxed_until = -1
    article: list[int] = []
    articles = 0
    links, open_link, breaks, block = 0, False, 0, ""

    def end_line() -> None:
        nonlocal links, open_link
        text = " ".join(html.unescape("".join(text for text, _ in parts)).split())
        own = " ".join(html.unescape("".join(text for text, linked in parts if not linked)).split())
        if text:
            lines.append((text, len(own), article[0] if article else None, block in _TEXT_BLOCKS))
        parts.clear()
        if open_link:
            links, open_link = 0, False

    for i, piece in enumerate(pieces):
        if i:
            closing, name, rest = tokens[i - 1]
            at = i - 1
            if name in _BLOCKS:
                # A box within a line does not end it.
                if boxed_until < 0 or at == boxed_until:
                    end_line()
                    block = "" if closing else name
            elif name in _SPACED:
                if boxed_until < 0:
                    breaks = breaks + 1 if name == "br" else breaks
                    if breaks > 1:
                        end_line()
                    parts.append((" ", links > 0))
            elif name == "a":
                links = 0 if closing or "href" not in _attributes(rest) else 1
                open_link = links > 0 and not closes[at]
            if at == boxed_until:
                boxed_until = -1
                parts.append((" ", links > 0))
            if not closing and name not in _VOID and boxed_until < 0:
                box = name in _BOXES or (name == "header" and not article)
                if (box or _is_marked(rest)) and name not in ("html", "body", "main"):
                    close = close_of[at]
                    if name in ("p", "li"):
                        # These end by themselves where the next block begins.
                        stop = next_block[at]
                        close = stop if close is None or (stop is not None and stop < close) else close
                    if close is not None:
                        boxed_until = close
                elif name in ("article", "main"):
                    if not article:
                        articles += 1
                    article.append(articles)
            if closing and name in ("article", "main") and article and boxed_until < 0 and at != boxed_until:
                article.pop()
        if boxed_until >= 0:
            continue
        if piece.strip():
            breaks = 0
        if piece:
            parts.append((piece, links > 0))
    end_line()
    return lines


def window_sums(lengths: list[int]) -> list[int]:
    """The distribution: text lengths of each line and the next ones, ``WINDOW`` in all."""
    sums, total = [0] * len(lengths), 0
    for i in range(len(lengths) - 1, -1, -1):
        total += lengths[i]
        if i + WINDOW < len(lengths):
            total -= lengths[i + WINDOW]
        sums[i] = total
    return sums


def _running(lines: list[tuple[str, int, int | None, bool]], inside: bool) -> list[str]:
    """Lines between the surge and the dive of a distribution."""
    lengths = [length for _, length, _, _ in lines]
    if not any(lengths):
        return []
    sums = window_sums(lengths)
    # Where all lines are short, the fullest window is running text.
    surge = min(SURGE, max(sums))
    rising = [i for i, total in enumerate(sums) if total >= surge and lengths[i] > 0]
    if not rising:
        rising = [i for i, length in enumerate(lengths) if length > 0]

    def goes_on(i: int) -> bool:
        return lengths[i] > 0 or (inside and lines[i][3])

    first, last = rising[0], rising[-1]
    while last + 1 < len(lines) and goes_on(last + 1):
        last += 1
    while inside and first > 0 and goes_on(first - 1):
        first -= 1
    # A line of nothing but links inside running text belongs to it where markup names the article, or text.
    return [text for text, length, _, block in lines[first : last + 1] if length > 0 or block or inside]


def main_lines(lines: list[tuple[str, int, int | None, bool]]) -> list[str]:
    """The main text's lines: those of all articles, or of the page if it has none with text."""
    articles: dict[int, list] = {}
    for line in lines:
        if line[2] is not None:
            articles.setdefault(line[2], []).append(line)
    found = [text for own in articles.values() for text in _running(own, True)]
    return found or _running(lines, False)


def main_text(page: str | None) -> str:
    return "\n".join(main_lines(lines_of(page))) if page else ""


def extracted(page: Column | str) -> Column:
    """The main text of an html column; never null."""

    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    page = F.col(page) if isinstance(page, str) else page
    return F.arrow_udf(texts, "string")(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    arrow_bounded(pages.sparkSession)
    return pages.select("page_id", "url", extracted("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
