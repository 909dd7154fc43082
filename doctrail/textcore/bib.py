"""BibTeX entries and citations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

#: Combining characters of LaTeX accents, and letters with names of their own.
ACCENTS = {"\\'": "́", "\\`": "̀", "\\^": "̂", '\\"': "̈", "\\~": "̃", "\\v": "̌", "\\c": "̧"}
LETTERS = {r"\ss": "ß", r"\oe": "œ", r"\OE": "Œ", r"\ae": "æ", r"\AE": "Æ", r"\L": "Ł", r"\l": "ł"}
_ACCENT = re.compile(r"\{?(\\['`^\"~]|\\[vc](?![a-zA-Z]{2,}))\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))\}?")
#: What stands for missing fields in a reference, and names by their number.
MISSING = {"author": "Auteurs inconnus", "year": "s.d.", "title": "Sans titre"}
NAMES = {1: "{0}", 2: "{0} & {1}"}
MORE_NAMES = "{0} et al."


def decode_accents(text: str) -> str:
    """Accented letters for their LaTeX commands."""
    for name, letter in LETTERS.items():
        text = re.sub(rf"\{{{re.escape(name)}\}}|{re.escape(name)}(?![a-zA-Z])(?:\{{\}})?", letter, text)

    def put(m: re.Match) -> str:
        return unicodedata.normalize("NFC", (m[2] or m[3]) + ACCENTS[m[1]])

    return re.sub(r"\\&", "&", _ACCENT.sub(put, text))


def _skip(text: str, at: int) -> int:
    """The first place from ``at`` on that is no white space."""
    return len(text) - len(text[at:].lstrip())


def _fields(body: str) -> Iterator[tuple[str, str]]:
    """Names and values: a value stands in braces or quotes, whose last sign is that before a comma or the end."""
    at = 0
    while (sign := body.find("=", at)) >= 0:
        name = re.search(r"\w*$", body[at:sign].rstrip())[0]
        start = end = _skip(body, sign + 1)
        at = sign + 1
        if not name or body[start : start + 1] not in ("{", '"'):
            continue
        while (end := min((x for x in (body.find("}", end + 1), body.find('"', end + 1)) if x >= 0), default=-1)) >= 0:
            after = _skip(body, end + 1)
            if after == len(body) or body[after] == ",":
                yield name, body[start + 1 : end]
                at = after + 1
                break


def parse(content: str) -> dict[str, dict[str, str]]:
    """Fields by key; an entry's body ends before the next @, and a later entry of the same key counts."""
    out: dict[str, dict[str, str]] = {}
    at = content.find("@")
    while at >= 0:
        kind = re.match(r"\w*", content[at + 1 :])[0]
        brace = _skip(content, at + 1 + len(kind))
        comma = content.find(",", brace)
        after = content.find("@", comma + 1) if comma >= 0 else -1
        close = content.rfind("}", comma + 1, after if after >= 0 else len(content)) if comma >= 0 else -1
        if kind and content[brace : brace + 1] == "{" and comma > brace + 1 and close >= 0:
            fields = {name.lower(): re.sub(r"[{}]", "", decode_accents(value.strip())) for name, value in _fields(content[comma + 1 : close])}
            out[content[brace + 1 : comma].strip()] = {"_type": kind.lower()} | fields
            at = content.find("@", close + 1)
        else:
            at = content.find("@", at + 1)
    return out


def citation(entries: dict[str, dict[str, str]], key: str, in_text: bool = False) -> str:
    """[Author, year], or Author [year] in the running text; a key without an entry stands for itself."""
    key = key.strip()
    if key not in entries:
        return key if in_text else f"[{key}]"
    entry = entries[key]
    names = [x.partition(",")[0].strip() for x in map(str.strip, entry["author"].split(" and "))] if entry.get("author") else [entry.get("title", key)[:30]]
    who, year = NAMES.get(len(names), MORE_NAMES).format(*names), entry.get("year", MISSING["year"])
    return f"{who} [{year}]" if in_text else f"[{who}, {year}]"


def reference(entries: dict[str, dict[str, str]], key: str) -> str:
    """The line of a reference list."""
    if key not in entries:
        return f"- **[{key}]** : Référence BibTeX non trouvée."
    told = MISSING | entries[key]
    venue = next((f" In *{told[x]}*." for x in ("booktitle", "journal", "publisher") if told.get(x)), "")
    return "- **[{0}]** : {author} ({year}). *{title}*.".format(key, **{x: told[x] for x in MISSING}) + venue
