"""Audits kept with commits, commits taken from a log of revisions, and the report of a rewriter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctrail.operators.style import find_audits

#: Digits of a revision's id that name its commit.
SHORT_ID = 8


def record_audits(audits: DataFrame, new: DataFrame) -> DataFrame:
    """The audits after a write: the new ones take the place of those of the same commit_id; of several new ones the last by write_seq counts.

    Both tables have commit_id and write_seq; a null or empty commit_id is an error.
    """
    named = F.when(F.coalesce("commit_id", F.lit("")) == "", F.raise_error(F.lit("an audit needs a commit_id")).cast("string")).otherwise(F.col("commit_id"))
    both = audits.withColumn("__new", F.lit(0)).unionByName(new.withColumn("commit_id", named).withColumn("__new", F.lit(1)))
    rest = [x for x in audits.columns if x != "commit_id"]
    last = F.max_by(F.struct(*rest), F.struct("__new", "write_seq"))
    return both.groupBy("commit_id").agg(last.alias("__a")).select(*[F.col("commit_id") if x == "commit_id" else F.col("__a")[x].alias(x) for x in audits.columns])


def with_audits(commits: DataFrame, audits: DataFrame, column: str = "style_audit") -> DataFrame:
    """Commits with ``column``: the audit that they hold already, else the one found by id or prefix, else null.

    ``audits`` has commit_id and ``column``.
    """
    found = find_audits(commits.where(F.col(column).isNull()).select(F.col("commit_id").alias("asked")).distinct(), audits)
    known = found.select(F.col("asked").alias("commit_id"), F.col(column).alias("__found"))
    met = commits.join(known, "commit_id", "left")
    return met.select(*[F.coalesce(column, "__found").alias(x) if x == column else F.col(x) for x in commits.columns])


def revisions_to_write(log: DataFrame, held: DataFrame, first_seq: int = 0) -> DataFrame:
    """commit_id, target, author, timestamp, message, write_seq of the revisions that a store lacks.

    ``log`` has target, pos (0 for the newest), commit, author, date and
    subject; ``held`` the commit_id of known commits. Revisions are written as
    the log lists them, newest first, under the first digits of their ids; one
    is known where a commit's id begins with those. write_seq follows pos, so
    targets number their own writes and no order of the whole log is needed.
    """
    short = F.substring("commit", 1, SHORT_ID)
    known = held.select(F.substring("commit_id", 1, SHORT_ID).alias("commit_id")).distinct()
    rows = log.select(short.alias("commit_id"), "target", "author", F.col("date").alias("timestamp"), F.col("subject").alias("message"), (F.col("pos") + first_seq).cast("long").alias("write_seq"))
    return rows.join(known, "commit_id", "left_anti")


def average_risk(fragments: DataFrame) -> DataFrame:
    """seg_id, risk_before, risk_after: mean scores of a segment's fragments, to four digits; unscored fragments count as nought."""
    mean = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 4)
    return fragments.groupBy("seg_id").agg(mean("score_before").alias("risk_before"), mean("score_after").alias("risk_after"))


def _per_cent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def rewrite_report(reports: DataFrame, segments: DataFrame, title: str = "Réécriture automatique") -> DataFrame:
    """report_id, callout: the summary of a rewriter's run as a callout.

    ``reports`` has report_id, engine_mode, elapsed_ms, rewritten and modified;
    ``segments`` report_id, pos, lines, risk_before, risk_after and status. A
    report without segments has the head alone.
    """
    change = (F.col("risk_before") - F.col("risk_after")) * 100
    delta = F.when(F.abs(change) < 0.05, "0.0%").when(change > 0, F.format_string("-%.1f%%", change)).otherwise(F.format_string("+%.1f%%", -change))
    status = F.when(F.col("status") == "VALIDÉ", "🟢 Validé").when(F.col("status") == "ALREADY_CLEAN", "🟢 Certifié (≤ 20%)").otherwise(F.concat(F.lit("⚠️ "), "status"))
    cells = F.concat_ws(" | ", F.coalesce("lines", F.lit("—")), _per_cent(F.col("risk_before")), _per_cent(F.col("risk_after")), delta, status)
    rows = segments.select("report_id", F.struct("pos", cells.alias("cells")).alias("row")).groupBy("report_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    listed = F.transform("rows", lambda x, k: F.concat(F.lit("> | "), (k + 1).cast("string"), F.lit(" | "), x["cells"], F.lit(" |\n")))
    head = F.concat(
        F.lit(f"> [!NOTE]\n> **🛡️ {title}**\n"),
        F.format_string("> - **Mode Moteur** : `%s` | **Latence GPU** : `%.1f ms` | **Passages réécrits** : `%d/%d`\n", "engine_mode", "elapsed_ms", "rewritten", "modified"),
        F.lit(">\n> | Passage | Lignes | Risque Avant | Risque Après | Delta | Statut |\n> | :--- | :--- | :---: | :---: | :---: | :---: |\n"),
    )
    return reports.join(rows, "report_id", "left").select("report_id", F.concat(head, F.array_join(F.coalesce(listed, F.array().cast("array<string>")), ""), F.lit("\n")).alias("callout"))
