"""What other formats leave in a text: HTML tags, styles and LaTeX commands.

Both cleaners first set aside what they must not touch, work on the rest, and
put it back, so code and formulas come out as they went in.
"""

from __future__ import annotations

import re

from doctrail.textcore import latex

#: The span that stands for red text, and the colours of an earlier diff.
RED = '<span style="color:#e11d48;font-weight:600">'
DIFF_COLOURS = ("#dcfce7", "#fee2e2", "#dbeafe", "#ffedd5")
#: Tags that go, and whether they also go alone.
TAGS = {"span": True, "font": True, "div": True, "style": True, "p": False}
_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n[\s\S]*?^ {0,3}\1[ \t]*$", re.MULTILINE)
_CODE = re.compile(r"(?<!`)(`+)(?!`)([^`\n]+?)(?<!`)\1(?!`)")
_STYLE = re.compile(r"<style\b[^>]*>.*?</style>", re.DOTALL)
_TAG = re.compile(r"<(/?)(" + "|".join(TAGS) + r")\b[^>]*>")
_ARBITRATION = re.compile(r"<XXX\b[^>]*>")


class _Aside:
    """Pieces set aside, each behind a number between signs that the text does not hold."""

    def __init__(self, text: str):
        self.sign = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in text)
        self.held: list[str] = []

    def put(self, piece: str) -> str:
        self.held.append(piece)
        return f"{self.sign}{len(self.held) - 1}{self.sign}"

    def back(self, text: str) -> str:
        while self.sign in text:
            text = re.sub(f"{self.sign}(\\d+){self.sign}", lambda m: self.held[int(m[1])], text)
        return text


def strip_markup(text: str) -> str:
    """A text without style blocks, spans, divs, fonts, paired paragraphs and style attributes.

    Code, arbitration tags ``<XXX ...>`` and red spans that hold no other span
    stay; so does a paragraph tag without its partner.
    """
    aside = _Aside(text)
    text = _FENCED.sub(lambda m: aside.put(m[0]), text)
    text = _CODE.sub(lambda m: m[0] if any(x in m[2] for x in DIFF_COLOURS) else aside.put(m[0]), text)
    text = _STYLE.sub("", _ARBITRATION.sub(lambda m: aside.put(m[0]), text))
    found = list(_TAG.finditer(text))
    partner: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    inner: set[int] = set()
    for k, m in enumerate(found):
        mine = open_.setdefault(m[2], [])
        if not m[1]:
            mine.append(k)
        elif mine:
            first = mine.pop()
            partner[first], partner[k] = k, first
            inner.update(mine)
    out, last = [], 0
    for k, m in enumerate(found):
        first = min(k, partner.get(k, k))
        red = k in partner and found[first][0] == RED and first not in inner
        keep = red or (not TAGS[m[2]] and k not in partner)
        out += [text[last : m.start()], aside.put(m[0]) if red else m[0] if keep else ""]
        last = m.end()
    text = "".join(out) + text[last:]
    return aside.back(re.sub(r'\s*style="[^"]*"', "", text))


#: Environments whose content stays as a block of its own, and those that become quotes.
BLOCKS = ("minipage", "boxedminipage", "center", "flushleft", "flushright", "tcolorbox", "shaded", "framed", "mdframed", "abstract")
QUOTES = ("quote", "quotation", "verse")
#: Commands that go with so many arguments.
GONE = {
    "fontsize": 2, "label": 1, "needspace": 1, "vspace": 1, "hspace": 1, "setlength": 2, "addtolength": 2, "keywords": 1, "rule": 2, "definecolor": 3, "color": 1, "rowcolor": 1,
    "columncolor": 1, "cellcolor": 1, "arrayrulecolor": 1, "titlespacing": 4, "setlist": 1, "hypersetup": 1, "settopmatter": 1, "acmConference": 1, "acmBooktitle": 1, "acmYear": 1,
    "copyrightyear": 1, "acmDOI": 1, "acmISBN": 1, "acmPrice": 1, "acmSubmissionID": 1, "ccsdesc": 1, "Description": 1, "affiliation": 1, "institution": 1, "city": 1, "country": 1,
    "state": 1, "postcode": 1, "streetaddress": 1, "nocite": 1, "bibliography": 1, "bibliographystyle": 1, "cmidrule": 1,
}
#: Commands without arguments that go, and those that are a sign.
SILENT = (
    "selectfont small footnotesize scriptsize normalsize large Large LARGE huge Huge normalfont bfseries itshape slshape scshape sffamily ttfamily rmfamily centering noindent "
    "frenchspacing medskip bigskip smallskip clearpage newpage vfill hfill raggedleft raggedright toprule midrule bottomrule hline addlinespace Statex State Require Ensure EndFor "
    "EndIf EndWhile relax linewidth textwidth columnwidth paperwidth paperheight fboxsep fboxrule thesection thesubsection thesubsubsection"
).split()
SIGNS = {"and": " • ", "textbar": "|", "quad": " ", "qquad": "  ", "rightarrow": "->", "leftarrow": "<-", "checkmark": "✓", "texttimes": "×"}
DINGS = {"51": "✓", "55": "✗"}


def _environments(text: str) -> str:
    """Layout environments as blocks, quotations as quotes, the innermost first; other begins and ends go."""
    env = re.compile(r"\\begin\{(" + "|".join(BLOCKS + QUOTES) + r")\}((?:\[[^\]]*\]|\{[^{}]*\})*)((?:(?!\\begin\{).)*?)\\end\{\1\}%?", re.DOTALL)

    def write(m: re.Match) -> str:
        lines = m[3].strip().splitlines()
        body = "\n".join(f"> {x}" if x.strip() else ">" for x in lines) if m[1] in QUOTES else "\n".join(lines)
        return f"\n\n{body}\n\n"

    before = None
    while before != text:
        before, text = text, env.sub(write, text)
    text = re.sub(r"\\begin\{CCSXML\}.*?\\end\{CCSXML\}", "", text, flags=re.DOTALL)
    return re.sub(r"\\item(?:\s*\[[^\]]*\])?\s*", "- ", re.sub(r"\\(?:begin|end)\{[^}]+\}", "", text))


def clean_latex(text: str) -> str:
    """Markdown without what is left of LaTeX: layout, fonts, sizes, rules, colours, metadata and groups; formulas stay as they are."""
    if not text:
        return ""
    aside = _Aside(text)
    text = re.sub(r"\$\$.*?\$\$", lambda m: aside.put(m[0]), text, flags=re.DOTALL)
    text = re.sub(r"(?<!\$)\$(?!\$)[^\n]*?(?<!\$)\$(?!\$)", lambda m: aside.put(m[0]), text)
    text = _environments(strip_markup(text))
    text = latex.macros(text)[0]
    text = re.sub(r"\\hrule\b(?:[ \t]*(?:height|width|depth)[ \t]+[\d.]+\s*[a-zA-Z%]+)*", "\n\n---\n\n", text)
    text = re.sub(r"\\vrule\b(?:\s*(?:width|height|depth)\s*[\d.]+\s*[a-zA-Z%]+)*|\\dimexpr\b[^{}]*(?:\\relax)?", "", text)
    text = latex.replace(text, GONE, lambda n, o, a: "", GONE)
    text = latex.replace(text, latex.LAST, lambda n, o, a: a[-1], latex.LAST)
    before = None
    while before != text:
        before = text
        text = latex.replace(text, latex.WRAPPED, lambda n, o, a: f"{latex.WRAPPED[n]}{a[0].strip()}{latex.WRAPPED[n]}" if a[0].strip() else "")
        text = latex.replace(text, ("textsuperscript", "textsubscript"), lambda n, o, a: a[0])
    text = latex.replace(text, ("ding",), lambda n, o, a: DINGS.get(a[0]))
    text = re.sub(r"\\(" + "|".join(SIGNS) + r")\b", lambda m: SIGNS[m[1]], text)
    text = re.sub(r"\\(?:" + "|".join(SILENT) + r")\b", "", text)
    text = re.sub(r"\\(?:" + "|".join(x for x in latex.WRAPPED if x not in ("mbox", "fbox")) + r")\b\s*\{?", "", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", text)
    text = re.sub(r"\\xspace\b\s*", " ", re.sub(r"\\xspace\s*([,.:;!?'\")\}\]])", r"\1", text))
    text = re.sub(r"\\([&_#%])", r"\1", text.replace("~", " ").replace("\\,", " "))
    for dashes, sign in (("---", "—"), ("--", "–")):
        text = re.sub(rf"(?<![\n:|\-]){dashes}(?![\n:|\-a-zA-Z])", sign, text)
    text = re.sub(r"\\+\s*\|", "|", re.sub(r"(?m)\\+\s*$", "", text))
    before = None
    while before != text:
        before, text = text, re.sub(r"(?<![\\$\w])\{([^{}]*)\}", r"\1", text)
    text = aside.back(re.sub(r"(\*\*|`)\}[ \t]*", r"\1 ", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", text)).strip()
