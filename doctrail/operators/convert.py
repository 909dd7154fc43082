"""LaTeX, HTML and BibTeX conversion as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctrail.functions.rows import flat_map, row_map
from doctrail.textcore import bib, html_markdown, latex, residue


#: What tells HTML, anywhere in a text.
HTML_HEAD = r"(?i)<!DOCTYPE\s+html|<html\b|<body\b"


def is_html(text: Column, path: Column | None = None) -> Column:
    """True for texts with an HTML head, or with a path that says so."""
    found = F.coalesce(text, F.lit("")).rlike(HTML_HEAD)
    if path is not None:
        found = found | ((F.coalesce(text, F.lit("")) != "") & F.coalesce(F.lower(path).rlike(r"\.html?$"), F.lit(False)))
    return found


def is_latex(text: Column, path: Column | None = None) -> Column:
    found = F.coalesce(text, F.lit("")).contains("\\begin{document}")
    return found if path is None else found | F.coalesce(F.lower(path).endswith(".tex"), F.lit(False))


def html_to_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, markdown of docs (doc_id, text)."""
    return row_map(docs, ["text"], lambda t: html_markdown.convert(t or ""), "markdown", "string", ["doc_id"])


def clean_latex(docs: DataFrame) -> DataFrame:
    """doc_id, text without what a conversion left of LaTeX; texts without a backslash or tag are tidied the same way."""
    return row_map(docs, ["text"], lambda t: residue.clean_latex(t or ""), "text", "string", ["doc_id"])


def strip_markup(docs: DataFrame) -> DataFrame:
    """doc_id, text without spans, styles and layout tags; texts without a tag or style pass without Python."""
    marked = F.coalesce(F.col("text").rlike(r"<|style="), F.lit(False))
    done = row_map(docs.where(marked), ["text"], lambda t: residue.strip_markup(t), "text", "string", ["doc_id"])
    return docs.where(~marked).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(done)


def parse_bib(files: DataFrame) -> DataFrame:
    """doc_id, key, fields of files (doc_id, text)."""
    return flat_map(files, ["text"], lambda t: bib.parse(t or "").items(), "key string, fields map<string,string>", ["doc_id"])


def latex_to_markdown(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """doc_id, markdown; the entries (key, fields) that a document cites reach it by a join on the key.

    Notes that are Markdown already pass unchanged.
    """
    if entries is None:
        return row_map(docs, ["text"], lambda t: latex.convert(t or ""), "markdown", "string", ["doc_id"])
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    keys = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(r"\\(?:cite|citep|citet|citealt|citeauthor|citeyear|autocite)\s*(?:\[[^\]]*\]\s*)*\{([^}]+)\}"), F.lit(1)), lambda x: F.split(x, r"\s*,\s*")))
    asked = keyed.select("doc_id", "__h", F.explode(F.array_distinct(F.transform(keys, lambda x: F.trim(x)))).alias("key")).distinct()
    got = asked.join(entries.select("key", "fields"), "key").groupBy("doc_id", "__h").agg(F.map_from_entries(F.collect_list(F.struct("key", "fields"))).alias("bib"))
    met = keyed.join(got, ["doc_id", "__h"], "left")
    return row_map(met, ["text", "bib"], lambda t, b: latex.convert(t or "", {k: dict(v) for k, v in (dict(b) if b else {}).items()}), "markdown", "string", ["doc_id"])


def latex_headings(docs: DataFrame) -> DataFrame:
    """doc_id, pos, level, title of the headings of LaTeX texts."""

    def rows(text: str | None):
        lines = [x for x in latex.headings(latex.strip_comments(text or "")).split("\n") if x.startswith("##")]
        for k, x in enumerate(lines):
            mark, _, title = x.partition(" ")
            yield k, len(mark), title

    return flat_map(docs, ["text"], rows, "pos int, level int, title string", ["doc_id"])


def latex_macros(docs: DataFrame) -> DataFrame:
    """doc_id, name, args, body of the macros that texts define."""
    return flat_map(docs, ["text"], lambda t: ((k, *v) for k, v in latex.macros(latex.strip_comments(t or ""))[1].items()), "name string, args int, body string", ["doc_id"])


def include_edges(files: DataFrame) -> DataFrame:
    """path, included: the files (path, text) that each file includes."""
    target = F.explode(F.regexp_extract_all("text", F.lit(r"\\(?:input|include)\s*\{([^}]+)\}"), F.lit(1)))
    out = files.select("path", target.alias("t"))
    return out.select("path", F.when(F.col("t").rlike(r"\.[A-Za-z]+$"), F.trim("t")).otherwise(F.concat(F.trim("t"), F.lit(".tex"))).alias("included"))


def format_citation(fields: Column, key: Column, in_text: bool = False) -> Column:
    """The short citation of an entry, in built-in functions."""
    author, year = F.element_at(fields, "author"), F.coalesce(F.element_at(fields, "year"), F.lit("s.d."))
    names = F.transform(F.split(author, " and "), lambda x: F.trim(F.substring_index(F.trim(x), ",", 1)))
    who = (
        F.when(F.coalesce(author, F.lit("")) == "", F.substring(F.coalesce(F.element_at(fields, "title"), key), 1, 30))
        .when(F.size(names) == 1, names[0])
        .when(F.size(names) == 2, F.concat(names[0], F.lit(" & "), names[1]))
        .otherwise(F.concat(names[0], F.lit(" et al.")))
    )
    known = F.concat(who, F.lit(" ["), year, F.lit("]")) if in_text else F.concat(F.lit("["), who, F.lit(", "), year, F.lit("]"))
    missing = key if in_text else F.concat(F.lit("["), key, F.lit("]"))
    return F.when(fields.isNull(), missing).otherwise(known)


def format_reference(fields: Column, key: Column) -> Column:
    """The line of a reference list, in built-in functions."""
    get = lambda name, other: F.coalesce(F.element_at(fields, name), F.lit(other))
    venue = F.coalesce(*[F.when(F.element_at(fields, x) != "", F.element_at(fields, x)) for x in ("booktitle", "journal", "publisher")])
    line = F.format_string("- **[%s]** : %s (%s). *%s*.", key, get("author", "Auteurs inconnus"), get("year", "s.d."), get("title", "Sans titre"))
    line = F.concat(line, F.coalesce(F.concat(F.lit(" In *"), venue, F.lit("*.")), F.lit("")))
    return F.when(fields.isNull(), F.format_string("- **[%s]** : Référence BibTeX non trouvée.", key)).otherwise(line)
