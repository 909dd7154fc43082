"""Language by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctrail.llm.common import Rows, arrow_map, checkpoint, stored, utf8

#: Cells of the hashed byte trigrams, and pseudo-count of each.
CELLS, SMOOTH = 1 << 15, 0.5
#: Labelled documents of each language that the text model is fitted on: a bounded sample, the first by a hash of their texts.
SAMPLE = 200
#: Parts of a language that are ranked apart first.
PARTS = 256
#: No language: text of evenly spread trigrams.
NONE = "und"
#: Trigrams count as this many independent ones at most, as neighbours depend on each other.
EVIDENCE = 60
#: How often a declared language is right, and the prior share of texts in no language.
TRUST, NONE_PRIOR = 0.9, 0.02
#: Pseudo-documents of the suffix prior in a host's, and of the global prior in a suffix's.
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 50.0
#: The least posterior of the best language with which a text is accepted.
ACCEPT = 0.5
NOT_LETTER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def trigrams(text: bytes) -> np.ndarray:
    """Cells of the byte trigrams of the lower-cased letters, words set apart by one blank."""
    x = np.frombuffer(b" " + NOT_LETTER.sub(b" ", text.lower()).strip() + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    return ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) & 0xFFFFFFFF) >> 17


class TextModel:
    """Log-probabilities of trigram cells for each language, and for none of them."""

    def __init__(self, labelled: list[tuple[str, bytes]]):
        self.languages = sorted({x for x, _ in labelled}) + [NONE]
        counts = np.full((len(self.languages), CELLS), SMOOTH)
        for language, text in labelled:
            counts[self.languages.index(language)] += np.bincount(trigrams(text), minlength=CELLS)
        counts[-1] = 1.0
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()

    def __call__(self, text: bytes) -> list[float]:
        """Log-likelihoods, tempered to EVIDENCE trigrams."""
        cells = trigrams(text)
        if not len(cells):
            return [0.0] * len(self.languages)
        total = np.zeros(len(self.languages))
        for k in range(0, len(cells), 1 << 18):
            total += self.logs[cells[k : k + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return (total * min(1.0, EVIDENCE / len(cells))).tolist()


def fit(labelled: DataFrame) -> TextModel:
    """A text model of at most SAMPLE labelled texts (columns lang, text) of each language.

    The sample is the first texts by hash, so it is the same in every run; no
    more than SAMPLE rows of a language leave a task.
    """
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # The first of each part of a language, then of those: a frequent language is not gathered in one task.
    chosen = labelled.select("lang", "h", F.pmod("h", F.lit(PARTS)).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):
        chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("k") <= SAMPLE).drop("k")
    chosen = chosen.select("lang", "h")
    rows = labelled.join(F.broadcast(checkpoint(chosen)), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return TextModel(sorted((x.lang, x.text.encode()) for x in rows))


def _likelihoods(texts: DataFrame, model: TextModel) -> DataFrame:
    """rid, suffix, host, declared, logs of rows rid, suffix, host, declared, text."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [shared.value(x) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("rid", "suffix", "host", "declared")), pa.array(logs, pa.list_(pa.float64()))], ["rid", "suffix", "host", "declared", "logs"])

    return arrow_map(texts, work, "rid long, suffix string, host string, declared string, logs array<double>")


def _argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)).cast("int")


def _counts(languages: int) -> list[Column]:
    return [F.sum((F.col("best") == k + 1).cast("long")).cast("double").alias(f"n{k}") for k in range(languages)]


def fuse(texts: DataFrame, model: TextModel) -> DataFrame:
    """rid, declared, text_lang, lang, probability, accepted of rows rid, suffix, host, declared, text.

    Each text's own evidence, text likelihood times declaration, votes for its
    host; votes are summed by host, suffix and over all, with partial sums
    before each shuffle. A host's prior is its votes smoothed by its suffix's
    prior, and that by the global one; a text's own vote is taken out of its
    host's. The posterior is prior times likelihoods.
    """
    n = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages])
    declared = F.array(*[F.when(F.col("declared") == x, math.log(TRUST)).otherwise(math.log((1 - TRUST) / max(1, n - 2))) for x in model.languages[:-1]], F.lit(math.log((1 - TRUST) / max(1, n - 2))))
    spoken = F.col("declared").isin(model.languages[:-1])
    texts = texts.withColumns({x: F.coalesce(x, F.lit("")) for x in ("suffix", "host")})
    marked = _likelihoods(texts, model).withColumn("own", F.when(spoken, F.zip_with("logs", declared, lambda a, b: a + b)).otherwise(F.col("logs")))
    seen = stored(marked.withColumn("best", _argmax(F.col("own"))))
    hosts = checkpoint(seen.groupBy("suffix", "host").agg(*_counts(n)))
    add = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    overall = hosts.agg(*add).first()
    votes = [x or 0.0 for x in overall]
    first = [(v + 1) / (sum(votes[:-1]) + n - 1) * (1 - NONE_PRIOR) for v in votes[:-1]] + [NONE_PRIOR]
    suffixes = hosts.groupBy("suffix").agg(*add)
    total = sum((F.col(f"n{k}") for k in range(n)), F.lit(0.0))
    suffixes = suffixes.select("suffix", F.array(*[(F.col(f"n{k}") + SUFFIX_WEIGHT * first[k]) / (total + SUFFIX_WEIGHT) for k in range(n)]).alias("suffix_prior"))
    priors = hosts.join(suffixes, "suffix").select("suffix", "host", F.array(*[F.col(f"n{k}") for k in range(n)]).alias("votes"), "suffix_prior")
    met = seen.join(priors, ["suffix", "host"])
    others = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x) - 1
    prior = F.transform(F.arrays_zip("votes", "suffix_prior"), lambda x, k: (x["votes"] - (k + 1 == F.col("best")).cast("double") + HOST_WEIGHT * x["suffix_prior"]) / (others + HOST_WEIGHT))
    joint = met.withColumn("joint", F.zip_with("own", prior, lambda a, b: a + F.log(b)))
    top = F.array_max("joint")
    posterior = joint.withColumn("weights", F.transform("joint", lambda x: F.exp(x - top)))
    share = F.array_max("weights") / F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    out = posterior.select("rid", "declared", F.element_at(names, _argmax(F.col("logs"))).alias("text_lang"), F.element_at(names, _argmax(F.col("joint"))).alias("lang"), share.alias("probability"))
    return out.withColumn("accepted", (F.col("lang") != NONE) & (F.col("probability") >= ACCEPT))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, url, declared, text_lang, lang, probability, accepted of each page.

    The declared language is that of the html element, the suffix the last
    label of the host. A null html has no text evidence, a null url the host
    ''; such rows are decided by what is left. Repeated rows each have a row;
    an empty table gives no rows; other columns are ignored.
    """
    rows = Rows(pages).numbered("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    texts = rows.select("rid", F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"), host.alias("host"), declared.alias("declared"), text.alias("text"))
    found = fuse(texts, fit(labelled))
    return rows.select("rid", "page_id", "url").join(found, "rid").drop("rid")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language is accepted.

    ``source`` serves as the host and ``lang`` as the declared language. A
    text without letters says nothing of its own and is decided by declaration
    and source; null sources make one host; a null text is as an empty one;
    repeated rows are each decided; an empty table gives no rows; columns of
    any other name pass as they are.
    """
    rows = Rows(docs)
    texts = rows.numbered("source", "lang", "text").select("rid", F.lit("").alias("suffix"), F.col("source").alias("host"), F.col("lang").alias("declared"), "text")
    return rows.without(checkpoint(fuse(texts, fit(docs)).where("not accepted").select("rid")))
