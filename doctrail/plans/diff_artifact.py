"""The composite query: two versions of each target, converted, compared, audited and assembled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail.functions.tables import stored
from doctrail.operators import artifact, convert, store, style, versions

COLUMNS = "pair_id long, target string, old_text string, new_text string, mode string"


def versions_of(commits: DataFrame, blobs: DataFrame, baseline_author: str = store.BASELINE_AUTHOR) -> DataFrame:
    """pair_id, target, old_text, new_text, commit_id of every target: its baseline, else its oldest commit, against its newest."""
    base = store.is_baseline("author", baseline_author)
    when = F.struct("timestamp", "write_seq")
    ends = commits.groupBy("target").agg(
        F.coalesce(F.max_by(F.when(base, F.col("blob_hash")), F.when(base, when)), F.min_by("blob_hash", when)).alias("old_hash"),
        F.max_by("blob_hash", when).alias("new_hash"),
        F.max_by("commit_id", when).alias("commit_id"),
    )
    text = lambda side: blobs.select(F.col("blob_hash").alias(f"{side}_hash"), F.col("content").alias(f"{side}_text"))
    met = ends.join(text("old"), "old_hash").join(text("new"), "new_hash")
    return met.select(F.xxhash64("target").alias("pair_id"), "target", "old_text", "new_text", "commit_id")


def to_markdown(pairs: DataFrame) -> DataFrame:
    """Pairs with both texts as Markdown: HTML and LaTeX are converted, other texts pass without Python."""
    from doctrail.functions.rows import row_map
    from doctrail.textcore import html_markdown, latex

    def run(text: str | None) -> str:
        text = text or ""
        return html_markdown.convert(text) if re.search(convert.HTML_HEAD, text) else latex.convert(text)

    out = pairs
    for side in ("old_text", "new_text"):
        marked = convert.is_html(F.col(side)) | convert.is_latex(F.col(side))
        plain = out.where(~F.coalesce(marked, F.lit(False)))
        done = row_map(out.where(marked), [side], run, "__text", "string", out.columns)
        out = plain.unionByName(done.withColumn(side, F.col("__text")).drop("__text"))
    return out


def diff_artifacts(pairs: DataFrame, language: str = "en", threshold: float = 0.5, history: DataFrame | None = None) -> DataFrame:
    """target, verdict, retention_percent, added, deleted, preserved, artifact of pairs (pair_id, target, old_text, new_text, commit_id).

    ``history`` (target, table) is the table of each target's recent commits. A
    failed style check does not stop a row; its verdict stands in the result.
    Texts are converted once and written; one comparison of a pair gives its
    marks and its counts, and the steps meet on pair_id.
    """
    pairs = stored(to_markdown(pairs))
    docs = pairs.select(F.col("pair_id").alias("doc_id"), F.col("new_text").alias("text"), F.lit(language).alias("language"), F.array().cast("array<string>").alias("allowed"))
    verdict = style.check_style(docs).select(F.col("doc_id").alias("pair_id"), "verdict", "n_hard", "n_soft")
    same = style.preservation(pairs).select("pair_id", "preserved")
    parts = pairs.select("pair_id", "target", "commit_id")
    for step in (verdict, same, versions.compare(pairs, threshold)):
        parts = parts.join(step, "pair_id")
    parts = parts.withColumn("table", F.lit(None).cast("string")) if history is None else parts.join(history.select("target", "table"), "target", "left")
    audit = F.concat(F.col("verdict"), F.lit(" ("), F.col("n_hard").cast("string"), F.lit(" / "), F.col("n_soft").cast("string"), F.lit(")"))
    full = parts.withColumns({"source": F.col("target"), "audit": audit, "n_added": F.col("added"), "n_deleted": F.col("deleted")})
    return full.select("target", "verdict", "retention_percent", "added", "deleted", "preserved", artifact.assembled().alias("artifact"))
