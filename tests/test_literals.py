"""Operators on small rows written by hand, against answers written by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from doctrail.operators import convert, links, segment, store, style, versions
from doctrail.sources import readers

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _sql_values(rows):
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


TARGETS = [
    (1, "notes/a.md"), (2, " virtual: x "), (3, "scratch:y"), (4, "/vault/notes/b.md"), (5, "~/docs/c.md"), (6, "/home/me/d.md"), (7, "C:\\Users\\Me\\e.md"),
    (8, "/opt/f.md"), (9, ""), (10, "sub/g.md"), (11, "/VAULT/h.md"), (12, "~"),
]


KEYS = [(1, "notes/a.md"), (2, "virtual:x"), (3, "scratch:y"), (4, "notes/b.md"), (5, "~/docs/c.md"), (6, "~/d.md"), (7, "~/e.md"), (8, "/opt/f.md"), (9, ""), (10, "~/work/sub/g.md"), (11, "h.md"), (12, "/home/me")]


@query(f"SELECT * FROM ({_sql_values(KEYS)}) t(id, key)")
def normalize_targets(spark):
    key = store.normalize_target(F.col("target"), "/vault", "/home/me", ["notes/a.md"], "/home/me/work")
    return _values(spark, TARGETS, "id int, target string").select("id", key.alias("key"))


STEMS = [("plan alpha",), ("beta",), ("gamma",), ("delta x",)]


NOTES = [
    ("notes/1.md", "See [[🤖 Plan Alpha]] today"), ("notes/2.md", "a [link](_agents/project_diffs/%F0%9F%A4%96%20Beta.md)"), ("_agents/project_diffs/x.md", "🤖 gamma"),
    ("a/.git/y.md", "🤖 gamma"), ("notes/3.md", "project_diffs/delta x and more"),
]


@query(f"SELECT * FROM ({_sql_values([STEMS[0], STEMS[1], STEMS[3]])}) t(stem)")
def mentioned_artifacts(spark):
    return store.mentioned_stems(_values(spark, NOTES, "path string, text string"), _values(spark, STEMS, "stem string"))


@query("SELECT * FROM (VALUES ('notes/beta.md'), ('virtual:v'), ('src/kept.tex')) t(target)")
def protected_targets(spark):
    commits = _values(spark, [(x,) for x in ("notes/beta.md", "~/beta.md", "virtual:v", "src/kept.tex", "notes/other.md")], "target string")
    named = _values(spark, [("virtual:v",)], "key string")
    arts = _values(spark, [("beta", "<!-- SOURCE_FILE: src/kept.tex -->\n"), ("other", "<!-- SOURCE_FILE: notes/other.md -->")], "stem string, text string")
    keys = store.protected_keys(named, _values(spark, [("Beta",)], "stem string"), arts)
    return store.protected(commits, keys)


GIT = [("a1|Ann|2024-01-02T00:00:00Z|fix | pipes",), ("b2|Bob|2024-01-03T00:00:00Z|second",), ("broken",)]


@query("SELECT * FROM (VALUES ('a1', 'Ann', '2024-01-02T00:00:00Z', 'fix | pipes'), ('b2', 'Bob', '2024-01-03T00:00:00Z', 'second')) t(\"commit\", author, date, subject)")
def git_log_lines(spark):
    return readers.git_log(_values(spark, GIT, "line string"))


@query("SELECT * FROM (VALUES ('a.md', 'UU'), ('b.md', 'DU')) t(path, code)")
def git_conflicts(spark):
    return readers.git_conflicts(_values(spark, [("UU a.md",), (" M c.md",), ("DU b.md",), ("?? d.md",)], "line string"))


SEEDS = [
    (1, "en", "We delve into a robust paradigm.\nMoreover, it is seamless."),
    (2, "en", "Plain words about a plain thing — with a dash.\nAnother -- one."),
    (3, "fr", "Il est cependant clair.\nCependant, bien sûr ! En outre, tout va."),
    (4, "en", "Nothing here to see."),
    (5, "en", "`robust` in code\n```\ndelve — inside\n```\nholistic robust Robust"),
    (6, "en", "# References\nrobust pivotal delve\n"),
    (7, "fr", "Le texte — avec un tiret, crucial et crucial."),
    (8, "en", "see [[a — b]] and in conclusion\nin conclusion"),
    (9, "en", ""),
]


FOUND = [
    (1, "tier1a", 1, "delve"), (1, "tier1a", 1, "robust"), (1, "tier1a", 1, "paradigm"), (1, "transition", 2, "Moreover"), (1, "tier1a", 2, "seamless"),
    (2, "em-dash", 1, "—"), (2, "em-dash ('--')", 2, "--"),
    (3, "Ouverture chatbot", 2, "bien sûr !"), (3, "transition", 2, "En outre"), (3, "tier2", 1, "cependant"), (3, "tier2", 2, "Cependant"),
    (5, "tier1a", 5, "holistic"), (5, "tier1a", 5, "robust"),
    (7, "em-dash", 1, "—"), (7, "tier2", 1, "crucial"),
    (8, "transition", 1, "in conclusion"), (8, "transition", 2, "in conclusion"),
]


def _seeds(spark, table=SEEDS):
    return _values(spark, table, "doc_id long, language string, text string").withColumn("allowed", F.array().cast("array<string>"))


@query(f"SELECT doc_id::BIGINT AS doc_id, type, line, term FROM ({_sql_values(FOUND)}) t(doc_id, type, line, term)")
def style_issues(spark):
    """All scans over the seeded texts, deduplicated, against issues read off by hand."""
    return style.dedup(style.scan(_seeds(spark))).select("doc_id", "type", "line", "term")


RAW = [(1, 0, "hard", 3, "Robust"), (1, 1, "hard", 3, "robust"), (1, 2, "soft", 3, "robust"), (1, 3, "hard", 4, "robust"), (2, 0, "hard", 3, "robust"), (2, 1, "hard", None, "x"), (2, 2, "hard", None, "X")]


@query(f"SELECT doc_id::BIGINT AS doc_id, seq::BIGINT AS seq, term FROM ({_sql_values(RAW)}) t(doc_id, seq, severity, line, term) QUALIFY row_number() OVER (PARTITION BY doc_id, severity, line, lower(term) ORDER BY seq) = 1")
def issue_dedup(spark):
    return style.dedup(_values(spark, RAW, "doc_id long, seq long, severity string, line int, term string")).select("doc_id", "seq", "term")


VERDICTS = [
    (1, 10, 0, 5, 0, "FAIL"), (2, 11, 0, 2, 0, "FAIL"), (3, 11, 0, 2, 2, "FAIL"), (4, 4, 0, 0, 0, "PASS"), (5, 8, 0, 2, 0, "FAIL"), (6, 4, 0, 0, 0, "PASS"), (7, 8, 0, 1, 1, "FAIL"),
    (8, 8, 0, 2, 0, "FAIL"), (9, 0, 0, 0, 0, "PASS"),
]


@query(f"SELECT doc_id::BIGINT AS doc_id, word_count::BIGINT AS word_count, budget_max, n_hard::BIGINT AS n_hard, n_soft::BIGINT AS n_soft, verdict FROM ({_sql_values(VERDICTS)}) t(doc_id, word_count, budget_max, n_hard, n_soft, verdict)")
def style_verdict(spark):
    return style.check_style(_seeds(spark))


@query("SELECT * FROM (VALUES ('chatbot', 'hard'), ('tier2', 'soft'), ('uniformity', 'stylometric'), ('new-thing', 'hard'), ('other', 'soft')) t(type, severity)")
def external_classes(spark):
    rows = [(1, "Chatbot", "a", "", None), (1, "tier2", "b", "", "high"), (1, "uniformity", "c", "", None), (1, "new-thing", "d", "", "P1"), (1, "other", "e", "", "low")]
    return style.classify_external(_values(spark, rows, "doc_id long, type string, text string, suggestion string, severity string")).select("type", "severity")


AUDITS = [
    (1, None, False, None, []), (2, " done ", False, None, []), (3, None, True, None, []), (4, None, False, "PASS", []),
    (5, None, False, None, [(1, "PASS", 0, 0, 0, {}, [])]), (6, None, False, None, [(1, "FAIL", 3, 2, 1, {"Tier 1": 2}, [])]),
    (7, None, False, None, [(1, "FAIL", 3, 3, 0, {}, []), (2, "PASS", 0, 0, 0, {}, [])]),
]


SUMMARIES = [(1, "N/A"), (2, "done"), (3, "N/A (commit Overleaf)"), (4, "1 tour (0 pb - Conforme)"), (5, "1 tour (0 pb - Conforme)"), (6, "1 tour (3 pb (Tier 1: 2) - FAIL)"), (7, "2 itérations (T1: 3 pb ➔ T2: 0 pb - PASS)")]


@query(f"SELECT * FROM ({_sql_values(SUMMARIES)}) t(id, summary)")
def audit_summary(spark):
    from doctrail.schema import ITERATION

    rows = _values(spark, AUDITS, f"id int, summary string, is_overleaf boolean, final_verdict string, iterations array<{ITERATION}>")
    return rows.select("id", style.audit_summary(F.col("summary"), F.col("is_overleaf"), F.col("final_verdict"), F.col("iterations")).alias("summary"))


@query("SELECT * FROM (VALUES ('abcdef0123', 'abcdef01'), ('ffff0000ab', 'ffff0000abcd')) t(asked, commit_id)")
def audit_lookup(spark):
    asked = _values(spark, [("abcdef0123",), ("ffff0000ab",), ("0123456789",)], "asked string")
    return style.find_audits(asked, _values(spark, [("abcdef01",), ("ffff0000abcd",), ("abcd",)], "commit_id string"))


MARKDOWN = [
    (1, "intro\n# One **x**\ntext\n## 2. Two\n```\n# not a heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n"),
    (2, "> [!NOTE] Title\n> body\n\npara $$x\n\ny$$ end\n\n![i](p.png)\n\n> q1\n>\n> q2"),
]


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 0, 'Préambule', 'préambule'), (1, 1, 1, 'One x', 'one x'), (1, 2, 2, '2. Two', 'two'), (2, 0, 0, 'Préambule', 'préambule')) t(doc_id, sec_pos, level, title, norm_title)")
def section_split(spark):
    docs = _values(spark, [(k, t.replace("**", "")) for k, t in MARKDOWN], "doc_id long, text string")
    return segment.split_sections(docs).select("doc_id", "sec_pos", "level", "title", "norm_title")


@query("""
SELECT * FROM (VALUES (1::BIGINT, 0, 0, 'paragraph'), (1, 1, 0, 'paragraph'), (1, 2, 0, 'code_block'), (1, 2, 1, 'table'), (2, 0, 0, 'callout'), (2, 0, 1, 'paragraph'),
  (2, 0, 2, 'math'), (2, 0, 3, 'paragraph'), (2, 0, 4, 'image'), (2, 0, 5, 'quote'), (2, 0, 6, 'quote')) t(doc_id, sec_pos, unit_pos, unit_type)""")
def unit_split(spark):
    docs = _values(spark, MARKDOWN, "doc_id long, text string")
    return segment.split_units(segment.split_sections(docs)).select("doc_id", "sec_pos", "unit_pos", "unit_type")


@query("SELECT * FROM (VALUES (2::BIGINT, 0, 'NOTE', 'Title')) t(doc_id, pos, c_type, title)")
def callout_extract(spark):
    return segment.split_callouts(_values(spark, MARKDOWN, "doc_id long, text string")).select("doc_id", "pos", "c_type", "title")


@query("""
SELECT * FROM (VALUES (1::BIGINT, 0, '<le mot juste>', 'lexical'), (1, 1, '<montant à vérifier>', 'factual'), (1, 2, '<12 avril>', 'factual'), (2, 0, '<qui ?>', 'factual')) t(doc_id, tag_pos, raw_tag, typology)""")
def draft_tags(spark):
    docs = _values(spark, [(1, "a <le mot juste> b <montant à vérifier> <b>x</b> <12 avril>"), (2, "< > <qui ?> </span>")], "doc_id long, text string")
    return versions.draft_tags(docs).select("doc_id", "tag_pos", "raw_tag", "typology")


@query("SELECT * FROM (VALUES (1::BIGINT, 1, 0.30), (3, 2, 0.14)) t(frag_id, rank, risk)")
def rewrite_gate(spark):
    rows = [(1, 1, "a", 0.30, 0.40, 0.30, "PASS"), (2, 1, "b", 0.40, 0.40, 0.40, "PASS"), (3, 1, "c", 0.20, 0.10, 0.14, "PASS"), (3, 2, "d", 0.14, 0.10, 0.14, "WARN"), (4, 1, "e", 0.1, 0.5, 0.1, "FAIL")]
    return segment.gate(_values(spark, rows, "frag_id long, rank int, text string, risk double, score_before double, score_after double, style_verdict string")).select("frag_id", "rank", "risk")


BIB = "@article{a, author = {Doe, Jane}, year = {2020}, title = {T}, journal = {J}}\n@book{b, author = {Doe, Jane and Roe, R.}, year = {2021}, title = {U}}\n@misc{c, author = {A, B and C, D and E, F}, title = {V}}\n"


CITED = [("a", "[Doe, 2020]", "Doe [2020]"), ("b", "[Doe & Roe, 2021]", "Doe & Roe [2021]"), ("c", "[A et al., s.d.]", "A et al. [s.d.]"), ("k", "[k]", "k")]


def _bib(spark):
    return convert.parse_bib(_values(spark, [(1, BIB)], "doc_id long, text string"))


@query(f"SELECT * FROM ({_sql_values(CITED)}) t(key, short, in_text)")
def bib_citation(spark):
    asked = _values(spark, [(x[0],) for x in CITED], "key string").join(_bib(spark).select("key", "fields"), "key", "left")
    return asked.select("key", convert.format_citation(F.col("fields"), F.col("key")).alias("short"), convert.format_citation(F.col("fields"), F.col("key"), True).alias("in_text"))


@query("SELECT * FROM (VALUES ('a', '- **[a]** : Doe, Jane (2020). *T*. In *J*.'), ('c', '- **[c]** : A, B and C, D and E, F (s.d.). *V*.'), ('k', '- **[k]** : Référence BibTeX non trouvée.')) t(key, line)")
def bib_reference(spark):
    asked = _values(spark, [("a",), ("c",), ("k",)], "key string").join(_bib(spark).select("key", "fields"), "key", "left")
    return asked.select("key", convert.format_reference(F.col("fields"), F.col("key")).alias("line"))


TEX = "\\documentclass{article}\n\\newcommand{\\who}[1]{\\textbf{#1}}\n\\title{A \\emph{title}}\n\\begin{document}\n\\section{One % no\n}\nHello \\who{you} \\cite{a}. 5\\% % gone\n\\subsection*{Two \\label{x}}\n\\begin{itemize}\n\\item x\n\\item y\n\\end{itemize}\n\\begin{equation}a=b\\end{equation}\n\\end{document}\n"


@query("SELECT * FROM (VALUES (1::BIGINT, 0, 2, 'One'), (1, 1, 3, 'Two')) t(doc_id, pos, level, title)")
def latex_headings(spark):
    return convert.latex_headings(_values(spark, [(1, TEX)], "doc_id long, text string"))


@query("SELECT 1::BIGINT AS doc_id, '# A title\n\n## One\n\nHello **you** [Doe, 2020]. 5%\n\n### Two\n\n- x\n- y\n\n$$\na=b\n$$\n\n## 📚 Références Bibliographiques\n\n- **[a]** : Doe, Jane (2020). *T*. In *J*.' AS markdown")
def latex_to_markdown(spark):
    return convert.latex_to_markdown(_values(spark, [(1, TEX)], "doc_id long, text string"), _bib(spark))


@query("SELECT * FROM (VALUES ('main.tex', 'a.tex'), ('main.tex', 'b/c.tex'), ('a.tex', 'main.tex')) t(path, included)")
def latex_includes(spark):
    return convert.include_edges(_values(spark, [("main.tex", "\\input{a} \\include{b/c.tex}"), ("a.tex", "\\input{main}")], "path string, text string"))


FILES = [("notes/Alpha.md",), ("notes/beta.md",), ("attachments/pic.png",), ("other/pic.png",), ("gamma.md",), ("deep/er/beta.md",)]


LINKS = [(1, "see [[Alpha]] and [[beta|B]], ![[pic.png]]"), (2, "[[gamma#part]] [[missing]] [[notes/beta]]")]


RESOLVED = [(1, 0, "Alpha", "notes/Alpha.md"), (1, 1, "beta", "notes/beta.md"), (1, 2, "pic.png", "attachments/pic.png"), (2, 0, "gamma", "gamma.md"), (2, 1, "missing", None), (2, 2, "notes/beta", "notes/beta.md")]


@query(f"SELECT doc_id::BIGINT AS doc_id, pos, target, rel_path FROM ({_sql_values(RESOLVED)}) t(doc_id, pos, target, rel_path)")
def wikilink_resolve(spark):
    index = links.file_index(_values(spark, FILES, "rel_path string"))
    return links.resolve_targets(links.wikilinks(_values(spark, LINKS, "doc_id long, text string")), index).select("doc_id", "pos", "target", "rel_path")


@query("SELECT * FROM (VALUES (1::BIGINT, 'see [Alpha](file:///notes/Alpha.md) and [B](file:///notes/beta.md), ![pic.png](file:///attachments/pic.png)'), (2, '[gamma#part](file:///gamma.md) missing [notes/beta](file:///notes/beta.md)')) t(doc_id, text)")
def wikilink_rewrite(spark):
    index = links.file_index(_values(spark, FILES, "rel_path string"))
    return links.rewrite_links(_values(spark, LINKS, "doc_id long, text string"), index)


@query("SELECT * FROM (VALUES ('a/x.md', '🤖 x (a).md'), ('b/x.md', '🤖 x (b).md'), ('y.md', '🤖 y.md')) t(target, artifact)")
def artifact_names(spark):
    return links.artifact_names(_values(spark, [("a/x.md",), ("b/x.md",), ("y.md",)], "target string"))


@query("SELECT * FROM (VALUES ('p/doc.tex', 'p/doc.pdf'), ('p/q/r.tex', 'p/paper/main.pdf'), ('z.tex', NULL)) t(target, pdf)")
def companion_pdf(spark):
    index = spark.sql("SELECT * FROM VALUES ('p/doc.pdf', TIMESTAMP '2024-01-01'), ('p/paper/main.pdf', TIMESTAMP '2024-01-01'), ('p/doc.tex', TIMESTAMP '2024-01-01') AS t(rel_path, mtime)")
    return links.companion_pdf(_values(spark, [("p/doc.tex",), ("p/q/r.tex",), ("z.tex",)], "target string"), index)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_literal(spark, name):
    assert rows(QUERIES[name](spark).toPandas()) == rows(duckdb.sql(SQL[name]).df())
