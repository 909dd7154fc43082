"""The parts of a written artefact, as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRONT_MATTER = r"(?s)\A(---\n.*?\n---\n)"


def header(source: Column, target: Column, commit: Column) -> Column:
    """Comments that say what an artefact was made from."""
    return F.concat(F.lit("<!-- SOURCE_FILE: "), source, F.lit(" -->\n<!-- TARGET: "), target, F.lit(" -->\n<!-- COMMIT: "), commit, F.lit(" -->\n"))


def recent_table(commits: DataFrame, most: int = 5) -> DataFrame:
    """target, table: the latest commits of each target as Markdown; only ``most`` rows of a target are held."""
    time = F.date_format(F.try_to_timestamp("timestamp"), "yyyy-MM-dd HH:mm")
    row = F.concat_ws(" | ", F.concat(F.lit("`"), F.substring("commit_id", 1, 8), F.lit("`")), time, "author", F.replace("message", F.lit("|"), F.lit("\\|")))
    latest = Window.partitionBy("target").orderBy(F.desc("timestamp"), "commit_id")
    ranked = commits.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= most)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("__n", F.concat(F.lit("| "), row, F.lit(" |")).alias("row")))), lambda x: x["row"])
    head = F.lit("| Commit | Date | Auteur | Message |\n| :--- | :--- | :--- | :--- |\n")
    return ranked.groupBy("target").agg(F.concat(head, F.array_join(lines, "\n")).alias("table"))


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, four at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(4), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def after_front_matter(text: Column, block: Column) -> Column:
    """The text with a block after its front matter, or before it all."""
    front = F.regexp_extract(text, FRONT_MATTER, 1)
    return F.concat(front, block, F.lit("\n\n"), F.substring(text, F.length(front) + 1, F.length(text)))


def explanation(text: Column, note: Column) -> Column:
    """The text with an explanation as a callout."""
    lines = F.concat(F.lit("> [!INFO] Explication\n> "), F.replace(note, F.lit("\n"), F.lit("\n> ")))
    return F.when(F.coalesce(F.trim(note), F.lit("")) == "", text).otherwise(after_front_matter(text, lines))


def pdf_banner(text: Column, pdf: Column) -> Column:
    return F.when(pdf.isNull(), text).otherwise(after_front_matter(text, F.concat(F.lit("> [!TIP] PDF\n> ["), pdf, F.lit("]("), pdf, F.lit(")"))))


def for_copy(text: Column) -> Column:
    """The plain new text: no comments, no marks, no more than one empty line."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    plain = F.regexp_replace(plain, r"(?s)<del\b[^>]*>.*?</del>|<(span|div)\b[^>]*(?:#fee2e2|#ffedd5)[^>]*>.*?</\1>", "")
    plain = F.regexp_replace(plain, r"</?(?:span|ins|div)\b[^>]*>", "")
    return F.trim(F.regexp_replace(plain, r"\n{3,}", "\n\n"))


def assembled() -> Column:
    """The text of an artefact, of the columns that ``assemble`` names."""
    return F.concat(
        header(F.col("source"), F.col("target"), F.col("commit_id")),
        F.lit("\n## 🔄 Synthèse des Changements & Diffs Récents\n\n"),
        F.format_string("+%d / -%d — %s\n\n", F.col("n_added"), F.col("n_deleted"), F.coalesce("audit", F.lit("N/A"))),
        F.coalesce(F.concat("table", F.lit("\n\n")), F.lit("")),
        F.coalesce(F.concat("toc", F.lit("\n\n")), F.lit("")),
        F.col("body"),
        F.lit("\n\n## 💬 Commentaires & Retours d'Arbitrage\n"),
    )


def assemble(parts: DataFrame) -> DataFrame:
    """target, artifact of parts (target, source, commit_id, body, toc, table, audit, n_added, n_deleted)."""
    return parts.select("target", assembled().alias("artifact"))
