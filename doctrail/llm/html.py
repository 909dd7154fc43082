"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from doctrail.llm.common import arrow_map

#: Fixed names: elements whose content is never main text, those that hold raw text, those that begin a block, and void ones.
DROPPED = frozenset("nav header footer aside form menu dialog template noscript iframe object svg canvas select button head video audio math".split())
RAW = ("script", "style", "textarea", "title", "noembed", "noframes", "xmp")
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Stands for an open article element that is a comment or a card; no tag has this name.
CARD = "article "
#: Words of a class, id or role that mark furniture: adverts, menus, notices, sidebars and reader comments.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget related recommended share sharing social newsletter subscribe signup login cookie cookies consent gdpr notice notices "
    "popup modal alert overlay footer header masthead comment comments respond reply replies disqus complementary contentinfo search pagination pager".split()
)
#: Class, id or role of an article element that is a reader's comment or a card, not the page's article.
ASIDE = re.compile(r"(?:comment|reply|respond|teaser|card|promo|related|recommended|sponsored|ad|advert)s?(?:[-_].*)?", re.IGNORECASE)
TAG = re.compile(r"<(?:!--(?:.*?-->|>|->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(>|$)|[!?/][^>]*(?:>|$))", re.DOTALL)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
#: Sliding windows of so many lines; text of a window that surges to this many characters opens a region.
WINDOW, SURGE = 3, 120


def _furniture(attributes: str) -> bool:
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    for m in MARKS.finditer(attributes):
        if not FURNITURE.isdisjoint(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())):
            return True
    return False


def _card(attributes: str) -> bool:
    """Whether an article element is a comment or a card, by a whole name of its class, id or role."""
    return any(ASIDE.fullmatch(x) for m in MARKS.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split())


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's text blocks in order: (text, its element, whole text of links).

    The element is the number of the outermost article or main element around
    the block, 0 where there is none and -1 in an article that is a comment or
    a card.

    Markup goes; what stands in furniture is left out. Character references are
    decoded once, and white space inside a block, line breaks included, becomes
    one blank.
    """
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []
    dropped = main = cards = element = links = linked = plain = 0
    at, lower = 0, None

    def data(x: str) -> None:
        nonlocal linked, plain
        if x and not dropped:
            text.append(html.unescape(x) if "&" in x else x)
            if not x.isspace():
                if links:
                    linked += 1
                else:
                    plain += 1

    def flush() -> None:
        nonlocal linked, plain
        if text and (block := " ".join("".join(text).split())):
            out.append((block, -1 if cards else element if main else 0, bool(linked) and not plain))
        text.clear()
        linked = plain = 0

    for m in iter(lambda: TAG.search(page, at), None):
        data(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS or name in DROPPED:
                flush()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (name, CARD if name == "article" else name)), None)
            # A stray end tag closes nothing, and one inside furniture does not close what is around it.
            if depth is not None:
                for gone, drops in stack[depth:]:
                    dropped -= drops
                    main -= gone in MAIN
                    cards -= gone == CARD
                    links -= gone == "a"
                del stack[depth:]
            continue
        if name in BLOCKS or name in DROPPED:
            flush()
        elif name == "br":
            data(" ")
        if name in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{name}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            gone, drops = stack.pop()
            dropped -= drops
        # A header inside an article holds its title; elsewhere it is the page's.
        drops = (name in DROPPED and not (name == "header" and main)) or (name not in MAIN and name not in ("body", "html") and _furniture(m[3]))
        card = name == "article" and _card(m[3])
        stack.append((CARD if card else name, drops))
        dropped += drops
        cards += card
        if name in MAIN and not card:
            element += not main
            main += 1
        links += name == "a"
    data(page[at:])
    flush()
    return out


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines between a surge and a dive of the block distribution.

    Each line has the sum of the lengths of the ``window`` lines from it on. A
    region begins where that sum surges to ``surge`` and the next ones are not
    empty, and it dives where the sum is zero twice running or the lines end.
    """
    x = np.array(lengths, np.int64)
    total = np.concatenate([[0], np.cumsum(x)])
    sums = total[np.minimum(np.arange(len(x)) + window, len(x))] - total[:-1]
    out, start = [], None
    for k in range(len(x)):
        if start is None and sums[k] >= surge and x[k]:
            start = k
        if start is not None and sums[k] == 0 and (k + 1 == len(x) or sums[k + 1] == 0):
            out.append((start, k))
            start = None
    if start is not None:
        out.append((start, len(x)))
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by an empty line; '' where there are none.

    The regions of the line-block distribution are found on every page, where
    lines of links alone and those of comments and cards count as empty. Where
    an article or main element holds most of the text found, its borders are
    the region's, so that short paragraphs stay; else each region has the
    borders of the element that holds most of it, and its own where none does.
    A page whose text never surges is one region.
    """
    found = lines(page)
    if all(element < 0 or links for _, element, links in found):
        found = [(text, max(element, 0), links) for text, element, links in found]
    lengths = [0 if links or element < 0 else len(text) for text, element, links in found]
    spans = regions(lengths) or [(0, len(found))]

    def holder(places: list[int]) -> int:
        held: dict[int, int] = {}
        for k in places:
            held[found[k][1]] = held.get(found[k][1], 0) + lengths[k]
        return next((x for x, n in held.items() if x > 0 and 2 * n > sum(held.values())), 0)

    def bounded(places: list[int], element: int) -> list[int]:
        return [k for k in range(len(found)) if found[k][1] == element] if element else [k for k in places if lengths[k]]

    regioned = [list(range(a, b)) for a, b in spans]
    if main := holder([k for places in regioned for k in places]):
        kept = set(bounded([], main))
    else:
        kept = {k for places in regioned for k in bounded(places, holder(places))}
    return "\n\n".join(found[k][0] for k in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    A null or empty html has an empty text; null ids and urls stay null;
    repeated rows are each extracted; an empty table gives no rows; other
    columns are ignored. Work is by row: nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return arrow_map(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
