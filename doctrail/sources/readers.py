"""Where documents, commits and logs come from, and where they go."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctrail import schema

CONFLICTS = ("UU", "AA", "UD", "DU", "DD", "AU", "UA")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files (Markdown, LaTeX, HTML, BibTeX); bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def commit_files(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a folder of JSON records, one record a file; unreadable ones are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(schema.COMMITS).json(path)
    return rows.where("commit_id is not null")


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """blob_hash, content of a folder of deflated blobs named by their hash in two parts."""

    @F.pandas_udf("binary")
    def inflate(data: pd.Series) -> pd.Series:
        return data.map(zlib.decompress)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.split("path", "/")
    return files.select(F.concat(F.element_at(name, -2), F.element_at(name, -1)).alias("blob_hash"), F.make_valid_utf8(inflate("content").cast("string")).alias("content"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, mtime, size of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.replace(".", r"\."), "").alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def git_log(lines: DataFrame) -> DataFrame:
    """commit, author, date, subject of lines ``%H|%an|%aI|%s``; the subject may hold bars; shorter lines are left out."""
    part = F.split("line", r"\|", 4)
    return lines.where(F.size(part) == 4).select(*[part[k].alias(n) for k, n in enumerate(("commit", "author", "date", "subject"))])


def git_conflicts(lines: DataFrame) -> DataFrame:
    """path, code of the porcelain status lines that tell a conflict."""
    code = F.substring("line", 1, 2)
    return lines.where(code.isin(*CONFLICTS)).select(F.trim(F.substring("line", 4, 1 << 30)).alias("path"), code.alias("code"))


def pulled_commits(lines: DataFrame) -> DataFrame:
    """short, author, subject of lines ``%h|%an|%s``."""
    part = F.split("line", r"\|", 3)
    return lines.where(F.size(part) == 3).select(*[part[k].alias(n) for k, n in enumerate(("short", "author", "subject"))])


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Append blobs, in folders by the first two digits of the hash, so that a lookup reads one of 256."""
    blobs.withColumn("prefix", F.substring("blob_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artefacts (target, artifact) as JSON rows, so that each text keeps its target and its line breaks."""
    artifacts.select("target", "artifact").write.mode("overwrite").json(path)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """target, artifact as written."""
    return spark.read.schema("target string, artifact string").json(path)
