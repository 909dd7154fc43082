"""Markdown structure: sections, callouts, masks and units of one text."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

PREAMBLE = "Préambule"
FENCE = re.compile(r"(?:\s*>+[ \t]*)?[ \t]*(?P<mark>`{3,}|~{3,})(?P<info>.*)")
HEADING = re.compile(r"(#{1,6})\s+(.+)")
#: LaTeX commands around a title's words.
FONT = r"\\(?:textsf|textsc|textup|textmd|textrm|textnormal|text|underline|textbf|textit|emph|textsl|texttt)\b\s*\{?"
#: Signs of words; blanks and marks, the underscore among them, are none.
WORDS = re.compile(r"[^\W_]")
#: The tokens that stand for masked blocks.
CODE_TOKEN, TABLE_TOKEN, CALLOUT_TOKEN = "___MD_CODE_BLOCK_{}___", "___MD_TABLE_BLOCK_{}___", "___MD_CALLOUT_BLOCK_{}___"
CODE_MARK = r"(?:>+[ \t]*)?___MD_CODE_BLOCK_[0-9a-f]+___"
ADMONITION = re.compile(r">\s*\[![A-Z]+\]")


class Section(NamedTuple):
    heading: str
    level: int
    title: str
    lines: list[str]


def normal_title(title: str) -> str:
    """The title for matching: no numbering in front, words alone, lower case."""
    return " ".join(re.sub(r"[^\w\s]", "", re.sub(r"^[0-9.\s\-:#]+", "", title.lower())).split())


def clean_title(raw: str) -> str:
    raw = re.sub(r"\\label\{[^}]+\}", "", re.sub(r"<[^>]+>", "", raw)).strip()
    raw = re.sub(r"^\*\*(.*?)\*\*$", r"\1", raw).strip()
    return " ".join(re.sub(r"[{}]", "", re.sub(FONT, "", raw)).split())


class Fence:
    """Whether lines fed in order stand inside a fence, by its own character and length."""

    def __init__(self):
        self.mark = ""

    def feed(self, line: str) -> bool:
        """True for lines of a fence, its first and last included."""
        m = FENCE.fullmatch(line)
        if self.mark:
            if m and m["mark"][0] == self.mark[0] and len(m["mark"]) >= len(self.mark) and not m["info"].strip(" \t"):
                self.mark = ""
            return True
        if m and not (m["mark"][0] == "`" and "`" in m["info"]):
            self.mark = m["mark"]
            return True
        return False


def sections(text: str) -> list[Section]:
    """Sections by headings outside fences; what precedes the first heading is the preamble."""
    out, fence = [], Fence()
    current = Section("", 0, PREAMBLE, [])
    for line in text.splitlines():
        m = None if fence.feed(line) else HEADING.fullmatch(line)
        if not m:
            current.lines.append(line)
            continue
        if current.lines or current.heading:
            out.append(current)
        title = clean_title(m[2].strip())
        current = Section(f"{m[1]} {title}", len(m[1]), title, [])
    if current.lines or current.heading:
        out.append(current)
    return out


def substantive(text: str) -> bool:
    """True if a word is left without tags and marks."""
    return bool(text) and bool(WORDS.search(re.sub(r"<[^>]+>", " ", text) if "<" in text else text))


def _token(shape: str, block: str) -> str:
    return shape.format(hashlib.md5(block.strip().encode()).hexdigest()[:12])


def mask_code(text: str) -> tuple[str, dict[str, str]]:
    """Fenced blocks replaced by tokens of their content, behind the quote marks of their first line."""
    out, blocks, held, fence = [], {}, [], Fence()

    def put() -> None:
        block = "".join(held)
        token = _token(CODE_TOKEN, block)
        blocks[token] = block.rstrip("\n")
        quote = re.match(r"\s*(?:>+[ \t]*)?", held[0])[0].lstrip("\n")
        out.append((quote if ">" in quote else "") + token + ("\n" if block.endswith("\n") else ""))
        held.clear()

    for line in text.splitlines(keepends=True):
        if fence.feed(line.rstrip("\r\n")):
            held.append(line)
            if not fence.mark:
                put()
        else:
            out.append(line)
    if held:
        # A fence that never closes runs to the end.
        put()
    return "".join(out), blocks


def _table_line(line: str) -> bool:
    bare = line.strip().lstrip(">").strip()
    return bare.startswith("|") and "|" in bare[1:]


def mask_tables(text: str) -> tuple[str, dict[str, str]]:
    """Tables, two lines or more of cells of which one is a ruler, replaced by tokens."""
    out, blocks, held = [], {}, []

    def put() -> None:
        if len(held) > 1 and any(re.fullmatch(r"[>\s]*\|[\s:|-]+", x.strip()) for x in held):
            block = "".join(held)
            token = _token(TABLE_TOKEN, block)
            blocks[token] = block.rstrip("\n")
            out.append(token + ("\n" if block.endswith("\n") else ""))
        else:
            out.extend(held)
        held.clear()

    for line in text.splitlines(keepends=True):
        if _table_line(line):
            held.append(line)
        else:
            put()
            out.append(line)
    put()
    return "".join(out), blocks


FIGURE = re.compile(r"!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)")


def mask_figures(text: str) -> tuple[str, dict[str, str]]:
    """Images replaced by tokens."""
    figures: dict[str, str] = {}

    def put(m: re.Match) -> str:
        token = f"___MD_FIGURE_BLOCK_{len(figures)}___"
        figures[token] = m[0]
        return token

    return FIGURE.sub(put, text), figures


def unmask(text: str, *maps: dict[str, str]) -> str:
    for blocks in maps:
        for token, block in blocks.items():
            text = text.replace(token, block)
    return text


class Callout(NamedTuple):
    kind: str
    title: str
    lines: list[str]


_CALLOUT = re.compile(r">\s*\[!([a-zA-Z]+)\]\s*(.*)")


def _line_kind(line: str) -> str:
    """What a line is to the blocks around it."""
    bare = line.strip()
    return "callout" if _CALLOUT.match(bare) else "quote" if bare.startswith(">") else "text" if bare else "blank"


def callouts(text: str) -> tuple[str, list[Callout]]:
    """Callouts, replaced in the text by numbered tokens.

    A callout takes the quoted lines that follow, and an empty line where a
    quoted one comes after it, up to the next callout.
    """
    rows = text.splitlines(keepends=True)
    kinds = [*map(_line_kind, rows), "text"]
    # An empty line before a quoted one, callouts included, belongs to what precedes.
    inner = [kind == "quote" or kind == "blank" and after in ("quote", "callout") for kind, after in zip(kinds, kinds[1:], strict=False)]
    out, found = [], []
    for k, row in enumerate(rows):
        head = _CALLOUT.fullmatch(row.strip())
        if head:
            found.append(Callout(head[1].upper(), head[2].strip(), [row]))
            out.append([CALLOUT_TOKEN.format(len(found) - 1), row])
        elif out and len(out[-1]) == 2 and inner[k]:
            found[-1].lines.append(row)
            out[-1][1] = row
        else:
            out.append([row])
    return "".join(x[0] + "\n" * x[1].endswith("\n") if len(x) == 2 else x[0] for x in out), found


#: What gets an empty line before it and, where the second value is true, after it; what it always holds.
APART = ((r"\$\$.*?\$\$", True, "$$"), (CODE_MARK, True, "___MD_CODE_BLOCK_"), (r">\s*\[![A-Z]+\]", False, "[!"))


def units(text: str) -> list[str]:
    """The blocks of a section: paragraphs, formulas, code, quotes, callouts and tables.

    Display formulas, code tokens and callouts get empty lines around them; a
    block with an odd number of ``$$`` takes the next ones in; quotes are cut at
    their empty lines.
    """
    for block, after, sign in APART:
        if sign not in text:
            continue
        text = re.sub(rf"([^\n])\s*({block})", r"\1\n\n\2", text, flags=re.DOTALL)
        text = re.sub(rf"({block})\s*([^\n])", r"\1\n\n\2", text, flags=re.DOTALL) if after else text
    whole: list[list[str]] = []
    open_ = False
    for block in re.split(r"\n\s*\n+", text.strip()):
        block = block.strip()
        if open_:
            whole[-1].append(block)
        elif block:
            whole.append([block])
        else:
            continue
        open_ ^= block.count("$$") % 2 == 1
    out: list[str] = []
    for unit in map("\n\n".join, whole):
        quoted = unit.startswith(">") and not ADMONITION.match(unit)
        out += filter(None, map(str.strip, re.split(r"\n>\s*\n", unit))) if quoted else [unit]
    return out


#: Types of a unit with their tests of its stripped text; the first that holds counts.
TYPES = (
    ("code_block", lambda x: "___MD_CODE_BLOCK_" in x or re.match(r"(?:>+\s*)?[ \t]*(?:`{3,}|~{3,})", x)),
    ("table", lambda x: "___MD_TABLE_BLOCK_" in x or _table_line(x)),
    ("math", lambda x: x.startswith("$$") and x.endswith("$$")),
    ("image", lambda x: re.fullmatch(r"!\[.*?\]\(.*?\)|!\[\[.*?\]\]", x)),
)
FIRST_SIGN = {">": "quote", "#": "heading"}


def unit_type(unit: str) -> str:
    bare = unit.strip()
    found = next((kind for kind, holds in TYPES if holds(bare)), None)
    return found or ("callout" if ADMONITION.match(unit) else FIRST_SIGN.get(bare[:1], "paragraph"))


def manuscript(text: str) -> str:
    """A text without front matter, comments, summary blocks and the marks of an earlier diff: deletions go, insertions stay."""
    text = re.sub(r"\A\s*---\r?\n.*?\r?\n---\r?\n", "", text, flags=re.DOTALL)
    text = re.sub(r"<!--.*?-->", "", text, flags=re.DOTALL)
    text = re.sub(r"<details\b.*?</details>", "", text, flags=re.DOTALL | re.IGNORECASE)
    return strip_marks(text).strip()


#: Background colours of deletions and insertions, local and collaborator.
DELETED, INSERTED = ("#fee2e2", "#ffedd5"), ("#dcfce7", "#dbeafe")


def strip_marks(text: str, keep: str = "new") -> str:
    """One side of an annotated text: its other colour family is dropped, its own unwrapped."""
    drop, own = (DELETED, INSERTED) if keep == "new" else (INSERTED, DELETED)
    tag = r"<(span|del|ins|div)\b[^>]*(?:{})[^>]*>(.*?)</\1>"
    text = re.sub(tag.format("|".join(drop)), "", text, flags=re.DOTALL)
    text = re.sub(tag.format("|".join(own)), r"\2", text, flags=re.DOTALL)
    text = re.sub(r"<del\b[^>]*>.*?</del>" if keep == "new" else r"<ins\b[^>]*>.*?</ins>", "", text, flags=re.DOTALL)
    return re.sub(r"</?(?:ins|del)\b[^>]*>", "", text)


def accept_up_to(text: str, line: int) -> tuple[str, int, int]:
    """The text with the revisions above a line accepted, how many those were, and how many remain."""
    mark = re.compile(r"<(span|del|ins)\b[^>]*(?:#fee2e2|#ffedd5|#dcfce7|#dbeafe)[^>]*>.*?</\1>")
    rows, done, left = text.split("\n"), 0, 0
    for k, row in enumerate(rows):
        n = len(mark.findall(row))
        if k + 1 < line:
            rows[k], done = strip_marks(row), done + n
        else:
            left += n
    return "\n".join(rows), done, left
