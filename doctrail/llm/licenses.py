"""Fuzzy search for short licence notices: pigeonhole seeds, then bounded-error matching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from doctrail.llm.common import arrow_map, utf8

#: Words after A-Z are lower-cased: ASCII digits and letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Exact phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices that are found with errors too, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "eclipse public license version 2 0": "epl-2",
    "all rights reserved": "all-rights-reserved",
}
#: Words that tell notices apart, besides the one after "version": they are matched without errors.
TELLING = frozenset(("mit", "nc", "sa"))
FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, word: bigint, words: bigint, errors: int>>"
)


def errors_allowed(notice: str) -> int:
    """One edit for each ten characters; none in a notice too short for two seeds."""
    return len(notice) // 10 if len(notice) >= 20 else 0


def seeds(notice: str) -> list[tuple[str, int]]:
    """The notice in k + 1 pieces with their places: k edits leave one of them whole."""
    n = errors_allowed(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def telling(notice: str) -> set[str]:
    """The words of a notice in which no error is allowed."""
    words = notice.split()
    return {b for a, b in zip(["", *words], words, strict=False) if b in TELLING or a == "version"}


class Finder:
    """Finds notices in texts of words joined by single blanks (as Latin-1 strings)."""

    def __init__(self, notices: dict[str, str]):
        import ahocorasick
        import regex

        self.notices = list(notices.items())
        self.telling = [telling(x) for x, _ in self.notices]
        self.allowed = [errors_allowed(x) for x, _ in self.notices]
        self.exact = [regex.compile(rf"(?b)(?:{regex.escape(x, special_only=True)}){{e<={k}}}") for (x, _), k in zip(self.notices, self.allowed, strict=True)]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (x, _) in enumerate(self.notices):
            for piece, at in seeds(x):
                where.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(notice, where it would start), by seeds that stand in the text unchanged."""
        out = {(i, end + 1 - length - at) for end, (length, places) in self.automaton.iter(text) for i, at in places}
        return sorted(out)

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of each verified place.

        Of places of a notice that overlap, that with the fewest errors stays;
        of those of a label, the longest; then of all, that with the fewest
        errors, and of equals the longest.
        """
        found: list[tuple[int, int, int, int]] = []
        for i, at in self.candidates(text):
            k, n = self.allowed[i], len(self.notices[i][0])
            low = max(0, at - k)
            if m := self.exact[i].search(text, low, at + n + k):
                if self.telling[i] and not self.telling[i] <= set(text[text.rfind(" ", 0, m.start() + 1) + 1 : text.find(" ", m.end() - 1) if " " in text[m.end() - 1 :] else len(text)].split()):
                    continue
                hit = (i, m.start(), m.end(), sum(m.fuzzy_counts))
                if found and found[-1][0] == i and hit[1] < found[-1][2]:
                    found[-1] = min(found[-1], hit, key=lambda x: (x[3], x[1]))
                else:
                    found.append(hit)
        label = lambda x: self.notices[x[0]][1]
        apart = lambda x, y: x[2] <= y[1] or y[2] <= x[1]
        whole: list[tuple[int, int, int, int]] = []
        for hit in sorted(found, key=lambda x: (x[1] - x[2], x[3])):
            if all(label(hit) != label(y) or apart(hit, y) for y in whole):
                whole.append(hit)
        out: list[tuple[int, int, int, int]] = []
        for hit in sorted(whole, key=lambda x: (x[3], x[1] - x[2])):
            if all(apart(hit, y) for y in out):
                out.append(hit)
        return sorted(out)


def scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row a document: base phrases, notices within their error bounds, and spans.

    ``spans`` lists each notice found by label, first word, words and errors;
    ``score`` is the best share of unchanged characters (1 for a base phrase or
    an exact notice, 0 for none). A null or empty text has no words; a null
    doc_id stays null; repeated rows are each scanned; an empty table gives no
    rows; other columns are ignored. Work is by row: nothing is shuffled.
    """
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Base phrases are found with errors too, those long enough for any.
        find, phrases = Finder({x: label for x, label in base.items() if errors_allowed(x)} | notices), [(f" {x} ".encode(), label) for x, label in base.items()]
        kinds = [pa.field(x.split()[0], pa.int64()) for x in FOUND.split(", ")[:5]] + [pa.field("base_labels", pa.string()), pa.field("labels", pa.string()), pa.field("score", pa.float64())]
        kinds.append(pa.field("spans", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("errors", pa.int32())]))))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                words = WORD.findall(text.lower())
                line = b" " + b" ".join(words) + b" "
                places, labels = [], set()
                for phrase, label in phrases:
                    at = line.find(phrase)
                    while at >= 0:
                        places.append(line.count(b" ", 0, at))
                        labels.add(label)
                        at = line.find(phrase, at + 1)
                plain = line.decode("latin-1")
                spans, best = [], 1.0 if places else 0.0
                for i, start, end, errors in find(plain):
                    notice, label = find.notices[i]
                    first = max(0, line.count(b" ", 0, start + 1) - 1)
                    spans.append({"label": label, "word": first, "words": plain.count(" ", start, end) + 1, "errors": errors})
                    best = max(best, 1 - errors / len(notice))
                every = labels | {x["label"] for x in spans}
                rows.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), best, spans))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    return arrow_map(docs.select("doc_id", "text"), work, FOUND)
