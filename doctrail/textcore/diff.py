"""Comparison of two versions of a text: matching, alignment, opcodes, counts and rendering."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np

from doctrail.textcore import markdown as md
from doctrail.textcore import similarity

THRESHOLD = 0.5
MOST_SEGMENTS = 6
#: Section titles that stand for each other, and the least similarity of others.
ALIASES = {
    "the llm network game": "the latent space",
    "game overview and setup": "game overview and components",
    "economy scoring and victory objective": "economy tolerance and scoring",
    "the 5step round loop": "the 5phase gameplay loop",
    "expansion modules": "modular architectural expansions",
    "game calibration via largescale monte carlo simulation": "game balance verification via insilico simulation",
}
FUZZY = 0.55
#: What one token is: formulas, comments, code spans, blanks, words, single marks.
TOKEN = re.compile(
    r"\$\$.*?\$\$|(?<!\$)\$(?!\$)(?:\\.|[^$\\\n])+(?<!\$)\$(?!\$)|<!--.*?-->|"
    r"(?<!`)`{3}(?!`)(?:[^`\n]|`{1,2}(?!`))+`{3}(?!`)|(?<!`)`{2}(?!`)(?:[^`\n]|`(?!=`))+`{2}(?!`)|(?<!`)`[^`\n]+`(?!`)|"
    r"\s+|\w+|[^\w\s]",
    re.DOTALL,
)
#: The same for texts without formulas, comments and code spans.
PLAIN = re.compile(r"\s+|\w+|[^\w\s]")
#: The styles of marks.
STYLE = 'style="background-color: {}; color: {}; padding: 2px 4px; border-radius: 3px;"'
#: A changed block of code: title, colours, stroke, language, content.
PRE = '<pre{} style="background-color: {}; color: {}; padding: 10px 12px; border-radius: 6px; overflow-x: auto; white-space: pre-wrap; margin: 8px 0;{}"><code{} style="background-color: transparent; color: inherit; padding: 0;">{}</code></pre>'
STRUCK, AUTHORED = " text-decoration: line-through;", {"del": "Supprimé par", "ins": "Ajouté par"}
COLOURS = {("del", False): ("#fee2e2", "#991b1b"), ("ins", False): ("#dcfce7", "#166534"), ("del", True): ("#ffedd5", "#9a3412"), ("ins", True): ("#dbeafe", "#1e40af")}
#: Gains of the alignment: same unit, table or code, and the least ratios of formulas and prose.
SAME, BLOCK, MATH_RATIO, PROSE_RATIO, BORDER_GAP = 2.0, 1.5, 0.35, 0.20, -0.1


class Op(NamedTuple):
    op: str
    i1: int
    i2: int
    j1: int
    j2: int
    old: str
    new: str


def opcodes(old: list[str], new: list[str]) -> list[Op]:
    if old == new:
        return [Op("equal", 0, len(old), 0, len(new), "".join(old), "".join(new))] if old else []
    out, i, j = [], 0, 0
    for x, y, n in [*sorted(similarity.blocks(old, new)), (len(old), len(new), 0)]:
        for op, a, b, c, d in (("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y), ("equal", x, x + n, y, y + n)):
            if a < b or c < d:
                out.append(Op(op, a, b, c, d, "".join(old[a:b]), "".join(new[c:d])))
        i, j = x + n, y + n
    return out


def ratio(old: str, new: str, least: float) -> float:
    """The similarity of two texts, or 0 below ``least``."""
    r = similarity.ratio(old, new)
    return r if r >= least else 0.0


def match_sections(old: list[md.Section], new: list[md.Section]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions in the order of the new text, then the old sections left over.

    A new section takes the first unused old one of its title, of the title's
    alias, or of the most similar title; the first new one falls back on the
    first old one.
    """
    titles: dict[str, list[int]] = {}
    for k, s in enumerate(old):
        titles.setdefault(md.normal_title(s.title), []).append(k)
    both = ALIASES | {v: k for k, v in ALIASES.items()}
    used: set[int] = set()

    def free(title: str | None) -> int | None:
        return next((k for k in titles.get(title, ()) if k not in used), None)

    def similar(title: str) -> int | None:
        best, at, mine = 0.0, None, set(title.split())
        for other in titles:
            theirs = set(other.split())
            score = max(SequenceMatcher(None, title, other, autojunk=False).ratio(), len(mine & theirs) / max(1, len(mine | theirs)))
            spare = [k for k in titles[other] if k not in used]
            if spare and score > FUZZY and score > best:
                best, at = score, spare[-1]
        return at

    out: list[tuple[int | None, int | None]] = []
    for k, s in enumerate(new):
        title = md.normal_title(s.title)
        at = free(title)
        if at is None:
            at = free(both.get(title))
        if at is None:
            at = similar(title)
        if at is None and k == 0 and old and 0 not in used:
            at = 0
        if at is not None:
            used.add(at)
        out.append((at, k))
    return out + [(k, None) for k in range(len(old)) if k not in used]


def _bounds(old: list[str], new: list[str], kinds: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds of what pairing two units is worth, whether they are the values themselves) of all units with all; 0 for units that must not be paired."""
    gains, exact = np.zeros((len(old), len(new))), np.ones((len(old), len(new)), bool)
    places: dict[str, int] = {}
    signs = [Counter(x) for x in new]
    for sign in signs:
        for x in sign:
            places.setdefault(x, len(places))
    # A row for each character, a column for each new unit.
    counts = np.zeros((len(places), len(new)), np.int32)
    for j, sign in enumerate(signs):
        counts[[places[x] for x in sign], j] = list(sign.values())
    theirs, texts, sizes = np.array(kinds[1]), np.array([hash(x) for x in new]), np.array([len(x) for x in new])
    for i, (text, kind) in enumerate(zip(old, kinds[0], strict=True)):
        alike = theirs == kind
        if kind in ("table", "code_block"):
            gains[i, alike] = BLOCK
        elif kind != "heading" and alike.any():
            least, extra = (MATH_RATIO, 1.0) if kind == "math" else (PROSE_RATIO, 0.0)
            mine = [(places[x], n) for x, n in Counter(text).items() if x in places]
            # No more characters can match than both have in common.
            common = np.minimum(counts[[x for x, _ in mine]], np.array([[n] for _, n in mine], np.int32)).sum(0) if mine else np.zeros(len(new), np.int64)
            quick = 2.0 * common / np.maximum(1, len(text) + sizes)
            open_ = alike & (quick >= least)
            gains[i, open_], exact[i, open_] = quick[open_] + extra, False
        for j in np.flatnonzero(alike & (texts == hash(text))).tolist():
            if new[j] == text:
                gains[i, j], exact[i, j] = SAME, True
    return gains, exact


def _path(gains: np.ndarray) -> list[tuple[str, int | None, int | None]]:
    """The best monotone path. Gaps cost on the border alone; on equal value a deletion is preferred to an insertion and either to a pair."""
    n, m = gains.shape
    best = np.empty((n + 1, m + 1))
    best[0] = BORDER_GAP * np.arange(m + 1)
    for i in range(1, n + 1):
        above, worth = best[i - 1], gains[i - 1]
        best[i, 0] = BORDER_GAP * i
        np.maximum(above[1:], np.where(worth > 0, above[:-1] + worth, -np.inf), out=best[i, 1:])
        np.maximum.accumulate(best[i], out=best[i])
    i, j, path = n, m, []
    while i or j:
        move = "delete" if i else "insert"
        if i and j:
            value, left, worth = best[i - 1, j], best[i, j - 1], gains[i - 1, j - 1]
            if left > value:
                value, move = left, "insert"
            if worth > 0 and best[i - 1, j - 1] + worth > value:
                move = "pair"
        i, j = i - (move != "insert"), j - (move != "delete")
        path.append((move, i if move != "insert" else None, j if move != "delete" else None))
    return path[::-1]


def align(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Monotone alignment of greatest gain; in a run of gaps deletions come first.

    The similarity of two units is costly, so the path is first sought with
    upper bounds; the pairs on it are then measured, until a path has none left
    to measure. What is off the path is worth its bound at most.
    """
    if old == new:
        return [("pair", k, k) for k in range(len(old))]
    kinds = [[md.unit_type(x) for x in us] for us in (old, new)]
    gains, exact = _bounds(old, new, kinds)
    while True:
        path = _path(gains)
        open_ = [(i, j) for move, i, j in path if move == "pair" and not exact[i, j]]
        if not open_ and old:
            break
        if not old:
            path = [("insert", None, j) for j in range(len(new))]
            break
        for i, j in open_:
            math = kinds[0][i] == "math"
            least = MATH_RATIO if math else PROSE_RATIO
            if len(old) == len(new) == 1:
                # No other pair competes: that the ratio is enough is all that counts.
                r = least if similarity.reaches(old[i], new[j], least) else 0.0
            else:
                r = ratio(old[i], new[j], least)
            gains[i, j], exact[i, j] = (r + 1.0 if math and r else r), True
    out = []
    for paired, run in groupby(path, key=lambda x: x[0] == "pair"):
        out += list(run) if paired else sorted(run, key=lambda x: x[0] != "delete")
    return out


def _unquote(text: str) -> str:
    return re.sub(r"^>+\s*", "", text, flags=re.MULTILINE)


def _words(text: str) -> int:
    return len(re.findall(r"\w+", text))


def tokens(text: str) -> list[str]:
    return (TOKEN if any(x in text for x in "$`<") else PLAIN).findall(text)


class UnitDiff(NamedTuple):
    mode: str
    ops: list[Op]
    added: int
    deleted: int
    change_rate: float
    word_rate: float


def _lines(text: str) -> int:
    return sum(md.substantive(x) for x in text.splitlines())


def _scattered(old: list[str], new: list[str], threshold: float) -> bool:
    """Whether two token lists surely change by more than ``threshold`` or in more than MOST_SEGMENTS segments: they have no common run long enough, or too few common tokens or words."""
    both, most = len(old) + len(new), MOST_SEGMENTS + 1
    if not both:
        return False
    # So many blocks of this length, the greatest for which that holds, leave more than the threshold.
    short = max(0, int((1.0 - threshold) * both / (2 * most)))
    while short and not 1.0 - 2.0 * most * short / both > threshold:
        short -= 1
    if short and not similarity.may_share(old, new, short + 1):
        return True
    signs = Counter(old), Counter(new)
    common = signs[0] & signs[1]
    if 1.0 - 2.0 * common.total() / both > threshold:
        return True
    # No word reaches over the end of a token.
    total, kept = (sum(_words(x) * n for x, n in c.items()) for c in (signs[0] + signs[1], common))
    return total > 0 and (total - 2 * kept) / total > threshold


def diff_pair(old: str, new: str, threshold: float = THRESHOLD, whole: bool = True) -> UnitDiff:
    """How two paired units differ: same, image, math, block or word, with opcodes and counts.

    Counts are of lines for a block and of opcode sides with words for a word
    diff; a new image replaces an old one without counting. Where not ``whole``,
    a block that is known to be one without its opcodes has none and rates 1.
    """
    if old.strip() == new.strip():
        return UnitDiff("same", [], 0, 0, 0.0, 0.0)
    kinds = md.unit_type(old), md.unit_type(new)
    if kinds in (("image", "image"), ("math", "math")):
        return UnitDiff(kinds[0], [], *((0, 0) if kinds[0] == "image" else (1, 1)), 0.0, 0.0)
    a, b = tokens(_unquote(old)), tokens(_unquote(new))
    # Between two matching blocks there is a segment that is not equal.
    if not whole and (_scattered(a, b, threshold) or len(list(islice(similarity.blocks(a, b), MOST_SEGMENTS + 2))) == MOST_SEGMENTS + 2):
        return UnitDiff("block", [], _lines(new), _lines(old), 1.0, 1.0)
    ops = opcodes(a, b)
    equal = sum(x.i2 - x.i1 for x in ops if x.op == "equal")
    change = 1.0 - (2.0 * equal / (len(a) + len(b)) if a or b else 1.0)
    total = _words("".join(a)) + _words("".join(b))
    moved = sum(_words(x.old) * (x.op in ("delete", "replace")) + _words(x.new) * (x.op in ("insert", "replace")) for x in ops)
    rate = moved / total if total else 0.0
    if change > threshold or rate > threshold or sum(x.op != "equal" for x in ops) > MOST_SEGMENTS:
        return UnitDiff("block", ops, _lines(new), _lines(old), change, rate)
    quoted = [all(x.strip().startswith(">") for x in t.splitlines() if x.strip()) for t in (old, new)]
    bare = [tokens(re.sub(r"(?m)^>+\s*", "", t) if q else t) for t, q in zip((old, new), quoted, strict=True)]
    ops = ops if bare == [a, b] else opcodes(*bare)
    deleted = sum(x.op in ("delete", "replace") and md.substantive(x.old) for x in ops)
    added = sum(x.op in ("insert", "replace") and md.substantive(x.new) for x in ops)
    return UnitDiff("word", ops, added, deleted, change, rate)


class SectionDiff(NamedTuple):
    alignment: list[tuple[str, int | None, int | None]]
    units: list[tuple[str | None, str | None, UnitDiff]]
    added: int
    deleted: int
    blocks: dict[str, str]


def masked_units(old: str, new: str) -> tuple[list[list[str]], dict[str, str]]:
    """(units of both sides, masked blocks) of two versions of a section; nothing where there is nothing to compare."""
    if old.strip() == new.strip() or not (md.substantive(old) or md.substantive(new)):
        return [[], []], {}
    blocks: dict[str, str] = {}
    masked = []
    for text in (old, new):
        text, code = md.mask_code(text)
        text, tables = md.mask_tables(text)
        blocks |= code | tables
        masked.append(md.units(text))
    return masked, blocks


def _lone(old: list[str], new: list[str], threshold: float) -> UnitDiff | None:
    """How the only units of two sections differ, if they are of one type and no code or table.

    A block reads and counts the same whether its two sides are paired or not,
    so their similarity need not be measured.
    """
    if not len(old) == len(new) == 1 or old == new:
        return None
    kind = md.unit_type(old[0])
    return diff_pair(old[0], new[0], threshold, False) if kind == md.unit_type(new[0]) and kind not in ("code_block", "table") else None


def diff_section(old: str, new: str, threshold: float = THRESHOLD, whole: bool = True) -> SectionDiff:
    """The units of two versions of a section, aligned and compared; code and tables count by lines.

    For ``whole`` see ``diff_pair``; where not ``whole``, a block that is all of a section counts as a pair without being measured.
    """
    masked, blocks = masked_units(old, new)
    lone = None if whole else _lone(*masked, threshold)
    path = [("pair", 0, 0)] if lone and lone.mode == "block" else align(*masked)
    found = []
    for op, i, j in path:
        a, b = (None if k is None else us[k] for us, k in zip(masked, (i, j), strict=True))
        if op == "pair" and md.unit_type(a) in ("code_block", "table") and a != b:
            one = UnitDiff("block", [], _lines(md.unmask(b, blocks)), _lines(md.unmask(a, blocks)), 1.0, 1.0)
        elif op == "pair":
            one = lone or diff_pair(a, b, threshold, whole)
        else:
            one = UnitDiff(op, [], _lines(md.unmask(b, blocks)) if b else 0, _lines(md.unmask(a, blocks)) if a else 0, 1.0, 1.0)
        found.append((a, b, one))
    return SectionDiff(path, found, sum(x.added for *_, x in found), sum(x.deleted for *_, x in found), blocks)


class DocumentDiff(NamedTuple):
    rows: list[tuple[int | None, int | None, str, SectionDiff]]
    added: int
    deleted: int
    modified: list[str]


def section_texts(old: str, new: str) -> Iterator[tuple[int | None, int | None, str, list[str]]]:
    """(place in the old text, in the new one, title, both texts) of the matched sections, in the order of the new text."""
    a, b = md.sections(old), md.sections(new)
    for i, j in match_sections(a, b):
        yield i, j, (a[i] if j is None else b[j]).title, ["" if k is None else "\n".join(s[k].lines) for s, k in ((a, i), (b, j))]


def alignments(old: str, new: str) -> Iterator[list[tuple[str, int | None, int | None]]]:
    """The alignment of the units of each matched section, without their comparison."""
    for i, j, _, texts in section_texts(old, new):
        yield [] if i is None or j is None else align(*masked_units(*texts)[0])


def diff_document(old: str, new: str, threshold: float = THRESHOLD, whole: bool = True) -> DocumentDiff:
    """All matched sections in the order of the new text; deleted ones count but are not listed as modified. For ``whole`` see ``diff_pair``."""
    rows, modified = [], []
    for i, j, title, texts in section_texts(old, new):
        if i is None or j is None:
            gone, text = j is None, texts[j is not None]
            n = _lines(text)
            one = SectionDiff([], [], 0 if gone else n, n if gone else 0, {})
        else:
            one = diff_section(*texts, threshold, whole)
        rows.append((i, j, title, one))
        if j is not None and one.added + one.deleted:
            modified.append(title)
    return DocumentDiff(rows, sum(x[3].added for x in rows), sum(x[3].deleted for x in rows), modified)


HEAD = re.compile(r"(?:\s*>+\s*|\s*[-*+]\s+|\s*\d+\.\s+|\s*#{1,6}\s+)?\s*")


def mark(text: str, kind: str, collab: bool = False) -> str:
    """A run of text in its colour, line by line, with blanks left outside the mark."""
    style = STYLE.format(*COLOURS[kind, collab])
    out = []
    for line in text.split("\n"):
        at = HEAD.match(line).end()
        core = line[at:].rstrip()
        head, tail = line[:at], line[at + len(core) :]
        out.append(f"{head}<span {style}>{f'<del>{core}</del>' if kind == 'del' else core}</span>{tail}" if core else line)
    return "\n".join(out)


def fence_parts(block: str) -> tuple[str, str, str]:
    """(quote prefix, info, content) of a fenced block; a block without a fence is all content."""
    lines = block.strip("\r\n").splitlines()
    filled = [x.lstrip() for x in lines if x.strip()]
    quote = ""
    if filled and all(x.startswith(">") for x in filled):
        quote = re.match(r"\s*>+\s?", next(x for x in lines if x.strip()))[0]
        lines = [re.sub(r"^\s*>+\s?", "", x) for x in lines]
    first = md.FENCE.fullmatch(lines[0]) if lines else None
    if not first:
        return quote, "", "\n".join(lines)
    rest, fence = lines[1:], md.Fence()
    fence.feed(lines[0])
    if rest and [fence.feed(x) for x in rest] and not fence.mark:
        rest = rest[:-1]
    return quote, first["info"].strip(), "\n".join(rest)


def mark_code(block: str, kind: str, collab: bool = False, author: str = "") -> str:
    """A fenced block as coloured HTML, escaped, behind its quote marks, so that no fence is left open."""
    quote, info, body = fence_parts(block)
    back, fore = COLOURS[kind, collab]
    title = f' title="{AUTHORED[kind]} {html.escape(author)}"' if collab and author else ""
    shown = PRE.format(title, back, fore, STRUCK if kind == "del" else "", f' data-lang="{html.escape(info)}"' if info else "", html.escape(body, quote=False))
    return "\n".join(quote + x for x in shown.splitlines()) if quote else shown


RULER = re.compile(r"[>\s]*\|[\s:|-]+")


def mark_table(block: str, kind: str, collab: bool = False) -> str:
    """A table with the text of each cell marked; bars, blanks, quote marks and the ruler stay as they are."""
    out = []
    for row in block.splitlines():
        quote, cells = re.fullmatch(r"(>*\s*)(.*)", row).groups()
        if RULER.fullmatch(row) or not cells.startswith("|"):
            out.append(row if RULER.fullmatch(row) else mark(row, kind, collab))
            continue
        parts = re.split(r"(?<!\\)\|", cells)
        inner = [mark(x, kind, collab) if x.strip() else x for x in parts[1:-1]]
        out.append(quote + "|".join([parts[0], *inner, *([parts[-1]] if len(parts) > 1 else [])]))
    return "\n".join(out)


def render_unit(old: str | None, new: str | None, diff: UnitDiff, blocks: dict[str, str], collab: bool = False, author: str = "") -> str:
    """Markdown of one aligned unit, with coloured marks."""

    def whole(text: str, kind: str) -> str:
        if md.unit_type(text) == "code_block":
            return mark_code(md.unmask(text, blocks), kind, collab, author)
        if md.unit_type(text) == "table":
            return mark_table(md.unmask(text, blocks), kind, collab)
        return mark(text, kind, collab)

    if diff.mode in ("same", "image"):
        return md.unmask(new.strip(), blocks)
    if diff.mode == "math":
        return f"{old.strip()}\n\n{new.strip()}"
    if diff.mode == "word":
        parts = []
        for x in diff.ops:
            for text, kind in ((x.old, "del"), (x.new, "ins")):
                if x.op == "equal":
                    parts.append(x.new if kind == "ins" else "")
                elif text:
                    parts.append(mark(text, kind, collab) if md.substantive(text) else text)
        text = "".join(parts)
        quoted = all(t.strip().startswith(">") for t in (old, new))
        return "\n".join(f"> {x}" if x.strip() else ">" for x in text.splitlines()) if quoted else text
    return "\n\n".join(whole(t, k) for t, k in ((old, "del"), (new, "ins")) if t)


def callout_pair(old: str, new: str, threshold: float = THRESHOLD, collab: bool = False) -> tuple[str, int, int]:
    """(the new callout with marks, lines or runs added, and deleted) of two versions of one callout; its head stays a head."""
    if old.strip() == new.strip():
        return new, 0, 0
    (head, *body), (was, *gone) = new.rstrip("\n").split("\n"), old.rstrip("\n").split("\n")
    kind = re.match(r">\s*\[![a-zA-Z]+\]", head)[0]
    titles = diff_pair(was[len(re.match(r">\s*\[![a-zA-Z]+\]", was)[0]) :].strip(), head[len(kind) :].strip(), threshold)
    inner = diff_section(*("\n".join(_unquote(x) for x in rows) for rows in (gone, body)), threshold)
    title = render_unit(was.partition("]")[2].strip(), head.partition("]")[2].strip(), titles, {}, collab).replace("\n\n", " ")
    text = "\n\n".join(render_unit(x, y, d, inner.blocks, collab) for x, y, d in inner.units) if inner.units else "\n".join(_unquote(x) for x in body)
    lines = [f"{kind} {title}".rstrip(), *[f"> {x}" if x.strip() else ">" for x in text.splitlines()]]
    return "\n".join(lines) + ("\n" if new.endswith("\n") else ""), titles.added + inner.added, titles.deleted + inner.deleted


#: How a paragraph begins that is never shown as two blocks.
NO_PARAGRAPH = ("#", "|", "$$", "![", ">", "<pre", "```", "~~~")
MARKED = re.compile(r"<span\b[^>]*(?:" + "|".join(md.DELETED + md.INSERTED) + r")")


def whole_paragraphs(text: str, threshold: float = THRESHOLD) -> str:
    """An annotated text whose much changed paragraphs are shown as the whole old one and the whole new one."""

    def one(part: str) -> str:
        if part.strip().startswith(NO_PARAGRAPH) or not MARKED.search(part):
            return part
        old, new = (re.sub(r"[ \t]+", " ", md.strip_marks(part, side)).strip() for side in ("old", "new"))
        if old and new and diff_pair(old, new, threshold, False).mode != "block":
            return part
        collab = any(x in part for x in (COLOURS["del", True][0], COLOURS["ins", True][0]))
        return "\n\n".join(mark(t, kind, collab) for t, kind in ((old, "del"), (new, "ins")) if t)

    return "\n\n".join(map(one, text.split("\n\n")))


_GUARDED = re.compile(r"<pre\b[^>]*>[\s\S]*?</pre>|^ {0,3}(?P<f>`{3,}|~{3,})[^\r\n]*\r?\n[\s\S]*?^ {0,3}(?P=f)[ \t]*$|(?<!`)(?P<q>`{1,3})(?!`)(?P<code>[^\r\n]+?)(?<!`)(?P=q)(?!`)", re.MULTILINE)
_CHANGE = re.compile(r"(<(?:span|ins|del)\b[^>]*>.*?</(?:span|ins|del)>)")


def free_code_spans(text: str) -> str:
    """Marks taken out of inline code: each piece of the code stands in backticks of its own, inside or beside the marks."""

    def piece(x: str, ticks: str) -> str:
        m = re.fullmatch(r"((?:<(?:span|ins|del)\b[^>]*>)*)(\s*)(.*?)(\s*)((?:</(?:span|ins|del)>)*)", x)
        done = not m[3] or m[3].startswith(ticks) and m[3].endswith(ticks) and len(m[3]) >= 2 * len(ticks)
        return x if done else f"{m[1]}{m[2]}{ticks}{m[3]}{ticks}{m[4]}{m[5]}"

    def write(m: re.Match) -> str:
        return "".join(piece(x, m["q"]) for x in _CHANGE.split(m["code"])) if m["q"] and _CHANGE.search(m["code"]) else m[0]

    return _GUARDED.sub(write, text) if "`" in text else text


def free_pipes(text: str) -> str:
    """Marks that no bar of a table crosses: each is closed before the bar and opened behind it; rulers have none."""

    def write(m: re.Match) -> str:
        return "|".join(f"{x[: len(x) - len(x.lstrip())]}{m[1]}{x.strip()}{m[4]}{x[len(x.rstrip()) :]}" if x.strip() else x for x in m[3].split("|"))

    if "|" not in text:
        return text
    out = []
    for row in text.split("\n"):
        bare = re.sub(r"</?(?:ins|del|span)\b[^>]*>", "", row)
        if "--" in bare and RULER.fullmatch(bare.strip()):
            row = bare
        elif re.match(r"[>\s]*\|", row):
            row = re.sub(r"(<(ins|del|span)\b[^>]*>)([^<]*\|[^<]*)(</\2>)", write, row)
        out.append(row)
    return "\n".join(out)


def balance_math(text: str) -> str:
    """A text whose display formulas are closed and stand on lines of their own."""
    if text.count("$$") % 2:
        text += "\n$$"
    return re.sub(r"\n{3,}", "\n\n", text)


def render(old: str, new: str, threshold: float = THRESHOLD, collab: bool = False) -> tuple[str, str]:
    """(body, table of contents) of the annotated new text."""
    return render_document(diff_document(old, new, threshold, False), new, collab)


def render_document(found: DocumentDiff, new: str, collab: bool = False) -> tuple[str, str]:
    """The same of a comparison made before."""
    b = md.sections(new)
    body, toc = [], []
    for i, j, title, one in found.rows:
        if j is None:
            continue
        s = b[j]
        if s.heading:
            body.append(s.heading)
            toc.append(f"{'  ' * (s.level - 1)}- {title}" + (f" (+{one.added} / -{one.deleted})" if one.added + one.deleted else ""))
        if one.units:
            units = "\n\n".join(render_unit(x, y, d, one.blocks, collab) for x, y, d in one.units)
            body.append(balance_math(free_pipes(free_code_spans(units))))
        else:
            text = "\n".join(s.lines).strip()
            body.append(mark(text, "ins", collab) if i is None and text else text)
    return "\n\n".join(x for x in body if x), "\n".join(toc)
