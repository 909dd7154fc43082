"""LaTeX to Markdown.

A text passes a fixed order of steps: comments, macros, metadata, formulas,
citations, floats, tables, lists, other environments, headings, inline
commands, paragraphs. Commands are read with their optional and braced
arguments by one scanner, so nested braces need no pattern of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from doctrail.textcore import bib

#: Structure that a document's macros never redefine.
PROTECTED = frozenset(
    "section subsection subsubsection paragraph subparagraph chapter part caption tableofcontents listoffigures listoftables bibliography "
    "bibliographystyle title author date abstract maketitle appendix table figure tabular tabularx".split()
)
#: Headings and their level in Markdown.
HEADINGS = {"section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
CITES = ("cite", "citep", "citet", "citealt", "citeauthor", "citeyear", "autocite")
#: What wraps a command's text, and commands that go with their arguments or leave only their last one.
WRAPPED = {"textbf": "**", "textit": "*", "emph": "*", "textsl": "*", "texttt": "`", "underline": "", "textsf": "", "textsc": "", "textup": "", "textmd": "", "textrm": "", "textnormal": "", "text": "", "mbox": "", "fbox": ""}
DROPPED = {"label": 1, "vspace": 1, "hspace": 1, "color": 1, "rowcolor": 1, "cellcolor": 1, "columncolor": 1, "arrayrulecolor": 1, "bibliographystyle": 1, "bibliography": 1, "thanks": 1, "inst": 1, "orcid": 1, "orcidID": 1, "setlength": 2, "addtolength": 2, "input": 1, "include": 1, "usepackage": 1, "documentclass": 1, "pagestyle": 1, "thispagestyle": 1, "needspace": 1, "Needspace": 1, "cmidrule": 1, "index": 1}
LAST = {"textcolor": 2, "colorbox": 2, "fcolorbox": 3, "parbox": 2, "makebox": 1, "framebox": 1, "raisebox": 2, "resizebox": 3, "scalebox": 2, "rotatebox": 2, "adjustbox": 2, "shortstack": 1, "centerline": 1, "hbox": 1, "vbox": 1, "footnotetext": 1, "uline": 1, "hl": 1}
SWITCHES = (
    "noindent centering raggedright raggedleft vfill hfill newpage clearpage cleardoublepage maketitle tableofcontents listoffigures listoftables appendix "
    "toprule midrule bottomrule hline addlinespace tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge bfseries itshape ttfamily "
    "sffamily rmfamily selectfont protect relax par bigskip medskip smallskip nopagebreak pagebreak xspace allowbreak".split()
)
CALLOUTS = {"theorem": "INFO", "lemma": "INFO", "proposition": "INFO", "corollary": "INFO", "definition": "INFO", "proof": "NOTE", "remark": "NOTE", "example": "EXAMPLE", "warning": "WARNING", "tcolorbox": "NOTE", "mdframed": "NOTE", "quote": "", "quotation": ""}
MATH = re.compile(r"\\begin\{(equation|align|gather|multline)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.*?)\\\]|\$\$(.*?)\$\$", re.DOTALL)
INLINE_MATH = re.compile(r"(?<!\$)\$(?!\$)(?:\\.|[^$\\\n])+(?<!\$)\$(?!\$)")
MARKDOWN = re.compile(r"\A\s*---\r?\n[\s\S]*?\r?\n---\r?\n|(?m:^#{1,6}\s+\S)|\[\[")
STRUCTURED = re.compile(r"\\(?:documentclass|begin\{document\}|section\*?\s*\{|subsection\*?\s*\{|usepackage)")
MOST_PASSES = 5


def group(text: str, at: int) -> tuple[str, int]:
    """The content of the braces that open at ``at``, and where they end; an open group runs to the end."""
    depth = 0
    k = at
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        depth += (text[k] == "{") - (text[k] == "}")
        k += 1
        if not depth:
            return text[at + 1 : k - 1], k
    return text[at + 1 :], len(text)


def _blanks(text: str, at: int) -> int:
    return at + len(text[at:]) - len(text[at:].lstrip())


def replace(text: str, names, write: Callable[[str, list[str], list[str]], str | None], args: int | dict[str, int] = 1) -> str:
    """Each command of these names, with its star, options and so many arguments, replaced by what ``write`` gives; None or too few arguments leave it."""
    pattern = re.compile(r"\\(" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")\*?(?![a-zA-Z])")
    out, last = [], 0
    for m in iter(lambda: pattern.search(text, last), None):
        at, options, found = m.end(), [], []
        want = args if isinstance(args, int) else args[m[1]]
        while True:
            k = _blanks(text, at)
            if k < len(text) and text[k] == "[" and not found and (end := text.find("]", k)) > 0 and "\n\n" not in text[k:end]:
                options.append(text[k + 1 : end])
                at = end + 1
            elif k < len(text) and text[k] == "{" and len(found) < want:
                inner, at = group(text, k)
                found.append(inner)
            else:
                break
        new = write(m[1], options, found) if len(found) == want else None
        out += [text[last : m.start()], text[m.start() : m.end()] if new is None else new]
        last = m.end() if new is None else at
    return "".join(out) + text[last:]


def strip_comments(text: str) -> str:
    """Lines up to a per cent sign that no backslash precedes."""
    return "\n".join(re.sub(r"(?<!\\)%.*", "", x) for x in text.splitlines())


def macros(text: str) -> tuple[str, dict[str, tuple[int, str]]]:
    """The text without its definitions, and (arguments, body) by name."""
    text = re.sub(r"\\makeatletter.*?\\makeatother|\\makeat(?:letter|other)\b", "", text, flags=re.DOTALL)
    head = re.compile(r"\\(?:(?:new|renew|provide)command\*?\s*(?:\{\\([a-zA-Z]+)\}|\\([a-zA-Z]+))\s*(?:\[(\d+)\])?|def\s*\\([a-zA-Z]+)((?:#\d)*))\s*(?=\{)")
    found: dict[str, tuple[int, str]] = {}
    out, last = [], 0
    for m in iter(lambda: head.search(text, last), None):
        body, end = group(text, m.end())
        name = m[1] or m[2] or m[4]
        if name.lower() not in PROTECTED:
            found[name] = (int(m[3] or 0) if not m[4] else m[5].count("#"), body)
        out.append(text[last : m.start()])
        last = end
    return "".join(out) + text[last:], found


def expand(text: str, found: dict[str, tuple[int, str]], passes: int = MOST_PASSES) -> str:
    """Macros written out, in a bounded number of passes, so that one that uses itself ends too."""
    if not found:
        return text

    def write(name: str, options: list[str], given: list[str]) -> str:
        body = found[name][1]
        for k, x in enumerate(given, 1):
            body = body.replace(f"#{k}", x)
        return body

    with_args = {k: n for k, (n, _) in found.items() if n}
    plain = [k for k, (n, _) in found.items() if not n]
    bare = re.compile(r"\\(" + "|".join(sorted(map(re.escape, plain), key=len, reverse=True)) + r")(?:\\(?:\s+|$)|\{\}|(?![a-zA-Z]))") if plain else None
    for _ in range(passes):
        before = text
        if bare:
            text = bare.sub(lambda m: found[m[1]][1] + (" " if m[0][-1:].isspace() else ""), text)
        if with_args:
            text = replace(text, with_args, write, with_args)
        if text == before:
            break
    return re.sub(r"\\xspace\b\s*", " ", re.sub(r"\\xspace\s*([,.:;!?'\")\}\]])", r"\1", text))


def formulas(text: str) -> str:
    """Display formulas between lines of ``$$``, inline ones between ``$``."""

    def write(m: re.Match) -> str:
        body = next(x for x in (m[3], m[4], m[5]) if x is not None)
        body = re.sub(r"\\label\{[^}]+\}", "", body).strip()
        if m[1] == "align":
            body = f"\\begin{{aligned}}\n{body}\n\\end{{aligned}}"
        return f"\n\n$$\n{body}\n$$\n\n"

    return re.sub(r"\\\((.*?)\\\)", r"$\1$", MATH.sub(write, text), flags=re.DOTALL)


class _Hidden:
    """Formulas taken out of the way of the inline steps."""

    def __init__(self):
        self.held: list[str] = []

    def hide(self, text: str) -> str:
        def put(m: re.Match) -> str:
            self.held.append(m[0])
            return f"\x01{len(self.held) - 1}\x02"

        return INLINE_MATH.sub(put, re.sub(r"\$\$.*?\$\$", put, text, flags=re.DOTALL))

    def show(self, text: str) -> str:
        while "\x01" in text:
            text = re.sub("\x01(\\d+)\x02", lambda m: self.held[int(m[1])], text)
        return text


def inline(text: str, marked: bool = True) -> str:
    """Fonts, boxes, links, spaces and special characters of running text."""
    for _ in range(MOST_PASSES):
        before = text
        text = replace(text, DROPPED, lambda n, o, a: "", DROPPED)
        text = replace(text, LAST, lambda n, o, a: a[-1].replace("\\\\", " "), LAST)
        text = replace(text, WRAPPED, lambda n, o, a: f"{WRAPPED[n] if marked else ''}{a[0].strip()}{WRAPPED[n] if marked else ''}")
        text = replace(text, ["href"], lambda n, o, a: f"[{a[1]}]({a[0]})", 2)
        text = replace(text, ["url"], lambda n, o, a: f"<{a[0]}>")
        text = replace(text, ["footnote"], lambda n, o, a: f" ({a[0].strip()})")
        text = replace(text, ["ref", "autoref", "eqref", "cref", "Cref"], lambda n, o, a: f"({a[0]})" if n == "eqref" else a[0])
        if text == before:
            break
    text = re.sub(r"\\(?:" + "|".join(SWITCHES) + r")\b[ \t]*", " ", text)
    text = re.sub(r"\\(?:ldots|dots)\b(?:\{\})?", "…", text)
    text = text.replace("``", "“").replace("''", "”") if marked else text
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\\textbackslash(?:\{\}|\b\s*)", "\x03", text)
    text = bib.decode_accents(text)
    text = re.sub(r"\\([%#_{}$])", r"\1", text)
    text = re.sub(r"(?<!\\)~", " ", text)
    text = re.sub(r"(?<![\\$\w])\{([^{}]*)\}", r"\1", text)
    return re.sub(r"[ \t]{2,}", " ", text).replace("\x03", "\\")


def title_of(text: str) -> str:
    text = re.sub(r"[{}]", "", inline(text, marked=False))
    return " ".join(re.sub(r"^\*\*(.*?)\*\*$", r"\1", text.strip()).split())


def metadata(text: str) -> tuple[str, dict[str, str]]:
    """The body, and title, authors, keywords and abstract."""
    found: dict[str, str] = {}

    def keep(name: str, options: list[str], given: list[str]) -> str:
        raw = re.sub(r"\\and\b", " & " if name == "author" else ", ", given[0])
        value = title_of(raw)
        if name == "author":
            value = "Anonymous Submission" if re.search("anonymous", value, re.IGNORECASE) else re.sub(r"\s+", " ", value)
        if name == "keywords":
            value = ", ".join(x for x in (y.strip().strip(";") for y in re.split(r"\s*[,;]\s*", value)) if x)
        found.setdefault(name, value)
        return ""

    text = replace(text, ["title", "author", "keywords"], keep)
    if m := re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", text, re.DOTALL):
        found["abstract"] = " ".join(inline(m[1].strip()).split())
        text = text[: m.start()] + text[m.end() :]
    m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.DOTALL)
    return (m[1] if m else text), found


def citations(text: str, entries: dict[str, dict[str, str]]) -> tuple[str, list[str]]:
    """Citations written out, and the keys in the order of their first use."""
    cited: dict[str, None] = {}

    def write(name: str, options: list[str], given: list[str]) -> str:
        keys = [x.strip() for x in given[0].split(",") if x.strip()]
        cited.update(dict.fromkeys(keys))
        in_text = name in ("citet", "citeauthor")
        done = [bib.citation(entries, k, in_text) for k in keys]
        return " ".join(done) if in_text else f"[{'; '.join(x.strip('[]') for x in done)}]"

    return replace(text, CITES, write), list(cited)


def _environment(name: str) -> re.Pattern:
    """An environment that holds none of its own name."""
    return re.compile(rf"\\begin\{{({name})\*?\}}((?:(?!\\begin\{{\1\*?\}}).)*?)\\end\{{\1\*?\}}", re.DOTALL)


def figures(text: str) -> str:
    def write(m: re.Match) -> str:
        caption: list[str] = []
        replace(m[2], ["caption"], lambda n, o, a: caption.append(" ".join(inline(a[0]).split())))
        images: list[str] = []
        replace(m[2], ["includegraphics"], lambda n, o, a: images.append(a[0].strip()))
        label = caption[0] if caption else "image"
        lines = [f"![{label}]({x})" for x in images] + ([f"*{label}*"] if caption else [])
        return "\n\n" + "\n\n".join(lines) + "\n\n"

    text = _environment("figure|wrapfigure|subfigure").sub(write, text)
    return replace(text, ["includegraphics"], lambda n, o, a: f"\n\n![image]({a[0].strip()})\n\n")


def _cells(row: str) -> list[str]:
    out: list[str] = []
    for cell in re.split(r"(?<!\\)&", row):
        wide = [1]

        def span(name: str, options: list[str], given: list[str]) -> str:
            if name == "multicolumn":
                wide[0] = int(given[0]) if given[0].isdigit() else 1
            return given[2]

        cell = replace(cell, ["multicolumn", "multirow"], span, 3)
        text = " ".join(inline(cell).split()).replace("|", r"\|").replace(r"\&", "&")
        out += [text] + [""] * (wide[0] - 1)
    return out


def tables(text: str) -> str:
    def grid(m: re.Match) -> str:
        body = m[2].lstrip()
        if m[1].startswith("tabularx") or m[1] == "tabular*":
            body = group(body, 0)[1:][0] and body[group(body, 0)[1] :].lstrip() if body.startswith("{") else body
        if body.startswith("["):
            body = body[body.find("]") + 1 :].lstrip()
        if body.startswith("{"):
            body = body[group(body, 0)[1] :]
        body = re.sub(r"\\(?:toprule|midrule|bottomrule|hline|addlinespace)\b(?:\[[^\]]*\])?|\\c(?:mid)?(?:rule|line)(?:\([^)]*\))?\{[^}]*\}", "", body)
        rows = [r for r in (_cells(x) for x in re.split(r"\\\\(?:\[[^\]]*\])?", body)) if any(r)]
        if not rows:
            return ""
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        rows.insert(1, [":---"] * width)
        return "\n\n" + "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n\n"

    text = _environment(r"tabularx|tabular|longtable|array").sub(grid, text)

    def frame(m: re.Match) -> str:
        caption: list[str] = []
        body = replace(m[2], ["caption"], lambda n, o, a: caption.append(" ".join(inline(a[0]).split())) or "")
        body = re.sub(r"\A\s*\[[^\]]*\]", "", replace(body, ["label"], lambda n, o, a: ""))
        return "\n\n" + (f"**{caption[0]}**\n\n" if caption else "") + body.strip() + "\n\n"

    return _environment("table|wraptable").sub(frame, text)


def lists(text: str) -> str:
    """Lists, the innermost first, each level indented by two blanks."""
    pattern = _environment("itemize|enumerate|description")
    for _ in range(MOST_PASSES):

        def write(m: re.Match) -> str:
            items = re.split(r"\\item\b", re.sub(r"\A\s*\[[^\]]*\]", "", m[2]))[1:]
            out = []
            for k, item in enumerate(items, 1):
                label = re.match(r"\s*\[([^\]]*)\]", item)
                body = item[label.end() :] if label else item
                first, *rest = [x for x in body.strip().split("\n") if x.strip()] or [""]
                mark = f"{k}." if m[1] == "enumerate" else "-"
                kept, deeper = [first.strip()], []
                for x in rest:
                    (deeper if deeper or re.match(r"\s*(?:-|\d+\.)\s", x) else kept).append(x)
                head = f"**{label[1]}** " if label else ""
                out.append(f"{mark} {head}{' '.join(x.strip() for x in kept)}" + "".join(f"\n  {x}" for x in deeper))
            return "\n\n" + "\n".join(out) + "\n\n"

        new = pattern.sub(write, text)
        if new == text:
            break
        text = new
    return text


def environments(text: str) -> str:
    """Code, algorithms, quotes and theorems; environments of other names become notes."""
    text = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\\end\{\1\*?\}", lambda m: f"\n\n```\n{m[2].strip(chr(10))}\n```\n\n", text, flags=re.DOTALL)

    def steps(m: re.Match) -> str:
        body = replace(m[2], ["caption"], lambda n, o, a: f"\n**{a[0].strip()}**\n")
        body = re.sub(r"\A\s*\[[^\]]*\]", "", body)
        body = replace(body, ["If", "ElsIf", "For", "ForAll", "While", "Until"], lambda n, o, a: f"\n{n} {a[0]}:")
        body = replace(body, ["Comment"], lambda n, o, a: f" // {a[0]}")
        body = re.sub(r"\\(?:begin|end)\{algorithmic\}(?:\[\d+\])?", "", body)
        body = re.sub(r"\\(Require|Ensure|Return)\b", r"\n\1:", body)
        body = re.sub(r"\\(?:Statex?|EndFor|EndIf|EndWhile|Else|Repeat)\b", "\n", body)
        return "\n\n> [!ABSTRACT] Algorithm\n" + "\n".join(f"> {x.strip()}" for x in body.splitlines() if x.strip()) + "\n\n"

    text = _environment("algorithm|algorithm2e").sub(steps, text)
    text = re.sub(r"\\(?:begin|end)\{(?:center|flushleft|flushright|minipage|document|small|footnotesize|spacing|multicols|sloppypar|appendices)\*?\}(?:\[[^\]]*\])*(?:\{[^}]*\})?", "\n", text)
    pattern = _environment(r"[a-zA-Z]+")
    for _ in range(MOST_PASSES):

        def write(m: re.Match) -> str:
            body, kind = m[2].strip(), CALLOUTS.get(m[1], "NOTE")
            option = re.match(r"\[([^\]]*)\]", body)
            body = body[option.end() :].strip() if option else body
            title = m[1].capitalize() + (f" ({option[1]})" if option else "")
            rows = ([f"[!{kind}] {title}"] if kind else []) + body.splitlines()
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in rows) + "\n\n"

        new = pattern.sub(write, text)
        if new == text:
            break
        text = new
    return text


def headings(text: str) -> str:
    return replace(text, HEADINGS, lambda n, o, a: f"\n\n{'#' * HEADINGS[n]} {title_of(a[0])}\n\n")


def paragraphs(text: str) -> str:
    """Blocks apart by one empty line; lines of running text joined, those of marked blocks kept."""
    out, fence = [], False
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n").strip()):
        rows = [x.rstrip() for x in block.split("\n") if x.strip()]
        if not rows:
            continue
        ticks = sum(x.lstrip().startswith("```") for x in rows)
        marked = any(x.strip().startswith(("|", ">", "$$", "![")) for x in rows) or re.match(r"\s*(?:#|[-*+]\s|\d+\.\s)", rows[0])
        out.append("\n".join(rows) if fence or ticks or marked else " ".join(x.strip() for x in rows))
        fence ^= ticks % 2
    return "\n\n".join(out)


def is_markdown(text: str) -> bool:
    """True for notes that merely hold formulas: they pass unchanged."""
    return bool(MARKDOWN.search(text)) and not STRUCTURED.search(text)


def convert(text: str, entries: dict[str, dict[str, str]] | None = None) -> str:
    """Markdown of a LaTeX text, with a reference list of what it cites."""
    if not text or not text.strip():
        return ""
    if is_markdown(text):
        return text
    body, found = macros(strip_comments(text))
    body, meta = metadata(expand(body, found))
    body, cited = citations(formulas(body), entries or {})
    hidden = _Hidden()
    body = hidden.hide(body)
    for step in (figures, tables, lists, environments, headings, inline):
        body = step(body)
    parts = [
        f"# {meta['title']}" if meta.get("title") else "",
        f"**Auteurs :** {meta['author']}" if meta.get("author") else "",
        f"**Mots-clés :** {meta['keywords']}" if meta.get("keywords") else "",
        f"## Abstract\n\n{meta['abstract']}" if meta.get("abstract") else "",
        hidden.show(body),
    ]
    if cited:
        parts.append("## 📚 Références Bibliographiques\n\n" + "\n".join(bib.reference(entries or {}, k) for k in cited))
    return paragraphs("\n\n".join(x for x in parts if x))


def resolve_inputs(path: str, files: dict[str, str], seen: frozenset[str] = frozenset()) -> str:
    """A file with the files it includes, from a table of texts by path; one that includes itself is left out, a missing one stays as it is."""

    def write(name: str, options: list[str], given: list[str]) -> str | None:
        target = given[0].strip()
        target = target if target in files or target.endswith(".tex") else f"{target}.tex"
        if target in seen or target == path:
            return ""
        return resolve_inputs(target, files, seen | {path}) if target in files else None

    return replace(files.get(path, ""), ["input", "include"], write)
