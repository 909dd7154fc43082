"""What is left of other formats, and the marks of a diff, on cases worked out by hand."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from doctrail.operators import reports
from doctrail.textcore import residue

RED = '<span style="color:#e11d48;font-weight:600">x</span>'


def test_markup():
    assert residue.strip_markup('<div style="a"><p>a</p> <span class="b">b <span>c</span></span></div>') == "a b c"
    assert residue.strip_markup("a <p> b </span> c<style>p{}\n</style>") == "a <p> b  c"
    assert residue.strip_markup(RED + " <XXX why?> `<div>`\n```html\n<p>k</p>\n```") == RED + " <XXX why?> `<div>`\n```html\n<p>k</p>\n```"
    assert residue.strip_markup('`<span style="background-color: #dcfce7">y</span>`') == "`y`"
    assert residue.strip_markup('<img style="w" src="a">') == '<img src="a">'
    assert residue.strip_markup("") == ""


def test_latex():
    clean = residue.clean_latex
    assert clean(r"\textbf{a \emph{b}} \label{x}c \fontsize{9}{1}\selectfont d") == "**a *b*** c d"
    assert clean("$a_{1} \\label{k}$ and $$\\textbf{x}\n\\small$$") == "$a_{1} \\label{k}$ and $$\\textbf{x}\n\\small$$"
    assert clean("\\begin{quote}\na\n\nb\n\\end{quote}") == "> a\n>\n> b"
    assert clean("\\begin{center}\\begin{minipage}[t]{3cm}x\\end{minipage}\\end{center}") == "x"
    assert clean("\\begin{itemize}\\item a\n\\item[1] b\\end{itemize}") == "- a\n- b"
    assert clean("a\\quad b\\textbar c \\ding{51} x\\textsuperscript{2} 5\\% \\rightarrow d") == "a b| c ✓ x2 5% -> d"
    assert clean("a \\hrule height 1pt\nb") == "a \n\n---\n\n\nb".replace("\n\n\n", "\n\n")
    assert clean("\\newcommand{\\x}[1]{y#1} t -- u") == "t – u"
    assert clean("") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a \n{}\\$`<>span/*", max_size=60))
def test_any_text_comes_to_an_end(text):
    residue.clean_latex(text)
    residue.strip_markup(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab c.", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_plain_words_stay(words):
    text = " ".join(" ".join(words).split())
    assert residue.clean_latex(text) == text == residue.strip_markup(text)


def test_many_open_tags_are_linear():
    began = time.perf_counter()
    residue.strip_markup("<span>" * 50_000 + "</div>" * 50_000)
    assert time.perf_counter() - began < 5


def test_an_audit_needs_an_id(spark):
    held = spark.createDataFrame([("a", "PASS", 1)], "commit_id string, verdict string, write_seq long")
    new = spark.createDataFrame([("a", "FAIL", 0), ("b", "WARN", 5), ("b", "PASS", 6)], held.schema)
    assert sorted(map(tuple, reports.record_audits(held, new).collect())) == [("a", "FAIL", 0), ("b", "PASS", 6)]
    try:
        reports.record_audits(held, spark.createDataFrame([("", "x", 1)], held.schema)).collect()
    except Exception as e:
        assert "needs a commit_id" in str(e)
    else:
        raise AssertionError("an empty id passed")


def test_report_without_segments(spark):
    runs = spark.createDataFrame([(1, "cpu", 2.5, 0, 0)], "report_id long, engine_mode string, elapsed_ms double, rewritten int, modified int")
    none = spark.createDataFrame([], "report_id long, pos long, lines string, risk_before double, risk_after double, status string")
    text = reports.rewrite_report(runs, none).first().callout
    assert text.startswith("> [!NOTE]\n") and "`2.5 ms`" in text and "`0/0`" in text and text.endswith(":---: |\n\n")
