"""Differences between two versions of a document as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctrail import schema
from doctrail.functions.rows import flat_map, row_map
from doctrail.textcore import diff, draft
from doctrail.textcore import markdown as md

COUNTS = "sections int, modified int, added int, deleted int"


def _split_same(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose texts are equal, which need no comparison, and the others."""
    same = F.col("old_text").eqNullSafe(F.col("new_text"))
    return pairs.where(same), pairs.where(~same)


def _spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out by id: comparing is the cost here, not the bytes by which Spark sizes partitions."""
    spark = pairs.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(n, "pair_id")


def match_sections(pairs: DataFrame) -> DataFrame:
    """pair_id, ord, old_pos, new_pos, title."""

    def rows(old: str | None, new: str | None):
        a, b = md.sections(old or ""), md.sections(new or "")
        for k, (i, j) in enumerate(diff.match_sections(a, b)):
            yield k, i, j, (a[i] if j is None else b[j]).title

    return flat_map(_spread(pairs), ["old_text", "new_text"], rows, "ord int, old_pos int, new_pos int, title string", ["pair_id"])


def align_units(pairs: DataFrame) -> DataFrame:
    """pair_id, sec_ord, ord, op, old_pos, new_pos: the units of matched sections, aligned."""

    def rows(old: str | None, new: str | None):
        for s, path in enumerate(diff.alignments(old or "", new or "")):
            for k, (op, i, j) in enumerate(path):
                yield s, k, op, i, j

    return flat_map(_spread(_split_same(pairs)[1]), ["old_text", "new_text"], rows, f"sec_ord int, {schema.ALIGNMENT}", ["pair_id"])


def word_ops(pairs: DataFrame, threshold: float = diff.THRESHOLD) -> DataFrame:
    """pair_id, sec_ord, unit_ord, mode and the opcodes of the tokens of each changed pair of units."""

    def rows(old: str | None, new: str | None):
        for s, (_, _, _, one) in enumerate(diff.diff_document(old or "", new or "", threshold).rows):
            for k, (_, _, unit) in enumerate(one.units):
                for op in unit.ops:
                    yield s, k, unit.mode, *op

    return flat_map(_spread(_split_same(pairs)[1]), ["old_text", "new_text"], rows, f"sec_ord int, unit_ord int, mode string, {schema.OPCODE}", ["pair_id"])


def diff_counts(pairs: DataFrame, threshold: float = diff.THRESHOLD) -> DataFrame:
    """pair_id, sections, modified, added, deleted; equal texts are settled without Python."""

    def rows(old: str | None, new: str | None):
        found = diff.diff_document(old or "", new or "", threshold, False)
        yield len(found.rows), len(found.modified), found.added, found.deleted

    same, other = _split_same(pairs)
    out = flat_map(_spread(other), ["old_text", "new_text"], rows, COUNTS, ["pair_id"])
    zero = [F.lit(None).cast("int").alias("sections"), *[F.lit(0).alias(x) for x in ("modified", "added", "deleted")]]
    return out.unionByName(same.select("pair_id", *zero))


def section_totals(pairs: DataFrame, threshold: float = diff.THRESHOLD) -> DataFrame:
    """pair_id, sec_ord, title, status, added, deleted of each section."""

    def rows(old: str | None, new: str | None):
        for k, (i, j, title, one) in enumerate(diff.diff_document(old or "", new or "", threshold, False).rows):
            status = "deleted" if j is None else "inserted" if i is None else "modified" if one.added + one.deleted else "same"
            yield k, title, status, one.added, one.deleted

    return flat_map(_spread(pairs), ["old_text", "new_text"], rows, "sec_ord int, title string, status string, added int, deleted int", ["pair_id"])


def annotate(pairs: DataFrame, threshold: float = diff.THRESHOLD, collab: bool = False) -> DataFrame:
    """pair_id, body, toc: the new text with coloured marks."""
    return flat_map(_spread(pairs), ["old_text", "new_text"], lambda a, b: [diff.render(a or "", b or "", threshold, collab)], "body string, toc string", ["pair_id"])


def compare(pairs: DataFrame, threshold: float = diff.THRESHOLD, collab: bool = False) -> DataFrame:
    """pair_id, body, toc, added, deleted, retention_percent: all that a report needs, of one comparison of each pair."""

    def one(old: str | None, new: str | None):
        a, b = old or "", new or ""
        found = diff.diff_document(a, b, threshold, False)
        yield *diff.render_document(found, b, collab), found.added, found.deleted, draft.retention(a, b)

    return flat_map(_spread(pairs), ["old_text", "new_text"], one, "body string, toc string, added int, deleted int, retention_percent double", ["pair_id"])


def callout_pairs(pairs: DataFrame, threshold: float = diff.THRESHOLD, collab: bool = False) -> DataFrame:
    """pair_id, text, added, deleted of pairs whose old_text and new_text are callouts; a side that is none makes the row null."""

    def one(old: str | None, new: str | None):
        whole = all(x and md.ADMONITION.match(x) for x in (old, new))
        yield diff.callout_pair(old, new, threshold, collab) if whole else (None, None, None)

    return flat_map(pairs, ["old_text", "new_text"], one, "text string, added int, deleted int", ["pair_id"])


def whole_paragraphs(docs: DataFrame, threshold: float = diff.THRESHOLD) -> DataFrame:
    """doc_id, text: annotated texts whose much changed paragraphs show the whole old and the whole new one.

    The texts are read once, as each may be the result of a comparison.
    """
    return row_map(docs, ["text"], lambda t: diff.whole_paragraphs(t, threshold) if t and "<span" in t else t or "", "text", "string", ["doc_id"])


def accept_revisions(docs: DataFrame, line: int) -> DataFrame:
    """doc_id, text, validated, remaining: the revisions above a line accepted."""
    return flat_map(docs, ["text"], lambda t: [md.accept_up_to(t or "", line)], "text string, validated int, remaining int", ["doc_id"])


def annotate_accepted(pairs: DataFrame, line: int, threshold: float = diff.THRESHOLD, collab: bool = False) -> DataFrame:
    """pair_id, text, validated, remaining: the new text with coloured marks, the revisions above a line accepted; one pass over each pair."""
    return flat_map(_spread(pairs), ["old_text", "new_text"], lambda a, b: [md.accept_up_to(diff.render(a or "", b or "", threshold, collab)[0], line)], "text string, validated int, remaining int", ["pair_id"])


def one_side(docs: DataFrame, keep: str = "new") -> DataFrame:
    """doc_id, text: one side of annotated texts."""
    return row_map(docs, ["text"], lambda t: md.strip_marks(t or "", keep), "text", "string", ["doc_id"])


def unit_set_diff(pairs: DataFrame) -> DataFrame:
    """pair_id, n_kept, n_lost, n_new: lines of two texts as sets, in built-in functions."""
    a, b = (F.array_distinct(F.split(F.coalesce(F.col(x), F.lit("")), "\n")) for x in ("old_text", "new_text"))
    return pairs.select("pair_id", F.size(F.array_intersect(a, b)).alias("n_kept"), F.size(F.array_except(a, b)).alias("n_lost"), F.size(F.array_except(b, a)).alias("n_new"))


def draft_tags(docs: DataFrame) -> DataFrame:
    """doc_id and the open questions of drafts."""
    return flat_map(docs, ["text"], lambda t: draft.tags(t or ""), schema.TAGS.replace("start", "`start`").replace("end int", "`end` int"), ["doc_id"])


def retention(pairs: DataFrame, threshold: float = 90.0) -> DataFrame:
    """pair_id, retention_percent, is_compliant."""
    out = row_map(_spread(pairs), ["old_text", "new_text"], lambda a, b: draft.retention(a or "", b or ""), "retention_percent", "double", ["pair_id"])
    return out.withColumn("is_compliant", F.col("retention_percent") >= threshold)


def draft_changes(pairs: DataFrame) -> DataFrame:
    """pair_id, change_pos, old, new, kind."""
    return flat_map(_spread(pairs), ["old_text", "new_text"], lambda a, b: draft.changes(a or "", b or ""), "change_pos int, old string, new string, kind string", ["pair_id"])


def audit_drafts(pairs: DataFrame, threshold: float = 90.0) -> DataFrame:
    """pair_id, retention_percent, is_compliant, tags_count, em_dash, diff_table."""

    def rows(old: str | None, new: str | None):
        a, b = old or "", new or ""
        kept = draft.retention(a, b)
        yield kept, kept >= threshold, len(draft.tags(a)), "—" in b or "–" in b, draft.change_table(a, b)

    return flat_map(_spread(pairs), ["old_text", "new_text"], rows, "retention_percent double, is_compliant boolean, tags_count int, em_dash boolean, diff_table string", ["pair_id"])
