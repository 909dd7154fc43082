"""Registered queries over the shared tables, and their SQL.

Tables stand in for the engine's own: documents as blobs and drafts (source as
target, doc_id as write order), events as a commit log (user as target, type as
author), conversations as version chains, pages as HTML. Queries over markup
that the tables lack, such as LaTeX, are in ``composed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctrail.functions.text import WORD, lines, matches_with_lines, word_count
from doctrail.operators import artifact, convert, segment, store, style, versions
from doctrail.plans import composed, diff_artifact
from doctrail.plans.registry import QUERIES, SQL, query
from doctrail.plans.registry import table as _table

NOW = "2024-07-01T00:00:00+00:00"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


#: A log of commits made of documents: one second apart, in the order of their ids.
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return _documents(spark, sf_dir).select(
        F.col("doc_id").alias("write_seq"), F.col("source").alias("target"), F.col("lang").alias("author"), time.alias("timestamp"),
        store.blob_hash("text").alias("blob_hash"), F.octet_length("text").cast("long").alias("byte_size"), F.lit("paper").alias("mode"), F.lit(False).alias("is_pinned"),
    ).withColumn("commit_id", store.commit_id(F.col("target"), F.col("timestamp"), F.col("blob_hash"), F.col("write_seq").cast("string"), F.col("author"), F.lit(None).cast("string")))


LOG_SQL = """
log AS (
  SELECT *, sha256(concat_ws('|', target, timestamp, blob_hash, write_seq::VARCHAR, author, '')) AS commit_id FROM (
    SELECT doc_id AS write_seq, source AS target, lang AS author, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp,
      sha256(text) AS blob_hash, strlen(text) AS byte_size, 'paper' AS mode FROM documents)
)"""


# ---------------------------------------------------------------- snapshot store


@query("SELECT doc_id, sha256(text) AS blob_hash, strlen(text)::BIGINT AS byte_size FROM documents")
def blob_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", store.blob_hash("text").alias("blob_hash"), F.octet_length("text").cast("long").alias("byte_size"))


@query("""
SELECT source, count(*) AS commits, count(DISTINCT sha256(text)) AS blobs, sum(strlen(text))::BIGINT AS bytes,
  (SELECT sum(b)::BIGINT FROM (SELECT any_value(strlen(d2.text)) AS b FROM documents d2 WHERE d2.source = d.source GROUP BY sha256(d2.text))) AS stored_bytes
FROM documents d GROUP BY source""")
def blob_dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("source", store.blob_hash("text").alias("h"), F.octet_length("text").cast("long").alias("n"))
    # Copies collapse by blob before the blobs of a source meet.
    blobs = rows.groupBy("source", "h").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return blobs.groupBy("source").agg(F.sum("c").alias("commits"), F.count("*").alias("blobs"), F.sum(F.col("c") * F.col("n")).alias("bytes"), F.sum("n").alias("stored_bytes"))


@query("""
SELECT DISTINCT sha256(text) AS blob_hash, strlen(text)::BIGINT AS byte_size FROM documents n WHERE doc_id % 2 = 1
  AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)""")
def blob_put_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held, new = (store.blobs(docs.where(f"doc_id % 2 = {k}"), "text") for k in (0, 1))
    return store.put_absent(held, new).select("blob_hash", "byte_size")


@query("""
SELECT event_id, sha256(concat_ws('|', 'user-' || user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00'), sha256(coalesce(props, '')), event_type, 'agent', '')) AS commit_id FROM events""")
def commit_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    made = store.commit_id(F.concat(F.lit("user-"), F.col("user_id").cast("string")), time, store.blob_hash(F.coalesce("props", F.lit(""))), F.col("event_type"), F.lit("agent"), F.lit(None).cast("string"))
    return e.select("event_id", made.alias("commit_id"))


@query(f"WITH {LOG_SQL} SELECT target, arg_max(commit_id, write_seq) AS commit_id FROM log GROUP BY target")
def heads_last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.heads(_log(spark, sf_dir))


@query("""
WITH RECURSIVE c AS (SELECT conv_id || '-' || turn AS commit_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent, role, conv_id % 5 AS hour FROM conversations WHERE role <> 'system'),
up AS (SELECT commit_id, parent AS at, 1 AS depth FROM c UNION ALL SELECT u.commit_id, c.parent, u.depth + 1 FROM up u JOIN c ON c.commit_id = u.at)
SELECT commit_id, rank::INTEGER AS rank FROM (
  SELECT commit_id, row_number() OVER (ORDER BY hour DESC, max(depth) DESC, commit_id) AS rank FROM up JOIN c USING (commit_id) GROUP BY commit_id, hour) WHERE rank <= 200""")
def list_commits_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as commits on their predecessors, many of one time: the depth within the filter decides their order."""
    c = _table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    commits = c.select(
        name(F.col("turn")).alias("commit_id"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_commit_id"),
        F.when(F.col("role") == "system", "notes/other.md").otherwise("notes/Chat.md").alias("target"),
        F.concat(F.lit("2024-01-01T0"), (F.col("conv_id") % 5).cast("string"), F.lit(":00:00+00:00")).alias("timestamp"),
        F.lit("paper").alias("mode"),
    )
    listed = store.list_commits(commits, "chat.md", "PAPER", 200)
    # The listed rows are at most the limit.
    return listed.withColumn("rank", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("int")).select("commit_id", "rank")


WRITES_SQL = """
w AS (SELECT doc_id AS seq, source AS target, lang AS author, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS ts, sha256(text) AS h, strlen(text)::BIGINT AS n FROM documents),
ends AS (SELECT target, coalesce(max(seq) FILTER (author = 'es'), min(seq)) AS a, max(seq) AS l FROM w GROUP BY target),
anchors AS (SELECT w.*, sha256(concat_ws('|', w.target, ts, h, 'm', author, '')) AS commit_id, NULL AS parent_commit_id FROM w JOIN ends e ON w.target = e.target AND w.seq = e.a),
others AS (SELECT w.*, sha256(concat_ws('|', w.target, w.ts, w.h, 'm', w.author, p.commit_id)) AS commit_id, p.commit_id AS parent_commit_id
  FROM w JOIN ends e ON w.target = e.target AND w.seq = e.l AND e.l <> e.a JOIN anchors p ON p.target = w.target),
after AS (SELECT * FROM anchors UNION ALL SELECT * FROM others)"""


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents written in two lots: the first half into an empty store, the others into what that leaves."""
    docs = _documents(spark, sf_dir)
    time = F.date_format(F.timestamp_seconds(F.col("doc_id") + 1700000000), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    writes = docs.select(
        F.col("doc_id").alias("write_seq"), F.col("source").alias("target"), F.lit("m").alias("message"), F.col("lang").alias("author"), time.alias("timestamp"),
        F.lit(False).alias("is_pinned"), F.lit("paper").alias("mode"), F.col("text").alias("content"),
    )
    half = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0] or 0
    kinds = "commit_id string, target string, message string, author string, timestamp string, is_pinned boolean, mode string, blob_hash string, byte_size long, parent_commit_id string, write_seq long"
    state = spark.createDataFrame([], kinds), spark.createDataFrame([], "blob_hash string, content string, byte_size long")
    for part in (writes.where(F.col("write_seq") <= half), writes.where(F.col("write_seq") > half)):
        *state, heads = store.write(*state, part, "es")
    return *state, heads


@query(f"WITH {WRITES_SQL} SELECT commit_id, parent_commit_id, target, author = 'es' AS is_pinned, n AS byte_size FROM after")
def commit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[0].select("commit_id", "parent_commit_id", "target", "is_pinned", "byte_size")


@query(f"WITH {WRITES_SQL} SELECT DISTINCT h AS blob_hash, n AS byte_size FROM after")
def commit_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[1].select("blob_hash", "byte_size")


@query(f"WITH {WRITES_SQL} SELECT target, arg_max(commit_id, seq) AS commit_id FROM after GROUP BY target")
def commit_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir)[2]


@query("""
WITH ids AS (SELECT DISTINCT sha256(text) AS commit_id FROM documents),
asked AS (SELECT DISTINCT asked FROM (
  SELECT substr(sha256(text), 1, 2) AS asked FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT substr(sha256(text), 1, 12) FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT sha256(text) FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'zz'))
SELECT a.asked, CASE WHEN bool_or(i.commit_id = a.asked) THEN a.asked WHEN count(i.commit_id) = 1 THEN min(i.commit_id) END AS commit_id,
  CASE WHEN bool_or(i.commit_id = a.asked) THEN 'exact' WHEN count(i.commit_id) = 1 THEN 'prefix' WHEN count(i.commit_id) > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome
FROM asked a LEFT JOIN ids i ON starts_with(i.commit_id, a.asked) GROUP BY a.asked""")
def commit_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _documents(spark, sf_dir).select("doc_id", store.blob_hash("text").alias("commit_id"))
    some = lambda n, k: ids.where(f"doc_id % {k} = 0").select(F.substring("commit_id", 1, n).alias("asked"))
    asked = some(2, 7).unionByName(some(12, 5)).unionByName(some(64, 11)).unionByName(spark.range(1).select(F.lit("zz").alias("asked")))
    return store.lookup(ids, asked)


EVENT_LOG = """
log AS (SELECT user_id::VARCHAR AS target, event_id AS write_seq, event_type AS author FROM events),
base AS (SELECT target, max(write_seq) FILTER (author = 'signup') AS b, min(write_seq) AS f, max(write_seq) AS l FROM log GROUP BY target)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("target"), F.col("event_id").alias("write_seq"), F.col("event_type").alias("author"))


@query(f"""WITH {EVENT_LOG}
SELECT l.target, l.write_seq, l.author, CASE WHEN l.write_seq <> coalesce(b.b, b.f) THEN coalesce(b.b, b.f) ELSE -1 END AS parent_seq, l.author = 'signup' AS by_baseline
FROM log l JOIN base b USING (target) WHERE l.write_seq IN (coalesce(b.b, b.f), b.l)""")
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.survivors(_events(spark, sf_dir), "signup").fillna(-1, ["parent_seq"])


@query(f"""WITH {EVENT_LOG}
SELECT l.target, l.write_seq, CASE WHEN l.write_seq <> coalesce(b.b, b.f) THEN coalesce(b.b, b.f) ELSE -1 END AS parent_seq
FROM log l JOIN base b USING (target) WHERE l.write_seq IN (coalesce(b.b, b.f), b.l)""")
def retention_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general fold, on the same monotone log, where it must agree with the window."""
    log = _events(spark, sf_dir).withColumn("timestamp", F.lpad(F.col("write_seq").cast("string"), 20, "0"))
    return store.fold(log, "signup").fillna(-1, ["parent_seq"])


@query("""
WITH RECURSIVE c AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent FROM conversations),
up AS (SELECT id, parent AS at, 0 AS depth FROM c UNION ALL SELECT u.id, c.parent, u.depth + 1 FROM up u JOIN c ON c.id = u.at)
SELECT id AS commit_id, (max(depth) + 1)::INTEGER AS depth FROM up GROUP BY id""")
def lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    commits = c.select(name(F.col("turn")).alias("commit_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_commit_id"))
    return store.ancestry(commits)


def _event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("commit_id"), F.col("user_id").cast("string").alias("target"), F.col("event_type").alias("author"), (F.col("event_id") % 17 == 0).alias("is_pinned"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
    )


@query(f"""
WITH c AS (SELECT event_id, event_type = 'signup' OR event_id % 17 = 0 AS p, date_diff('microsecond', date_trunc('second', ts), TIMESTAMP '{NOW[:10]} 00:00:00') / 86400000000.0 AS age FROM events)
SELECT CASE WHEN NOT p AND age > 14 THEN 'expired' ELSE 'keep' END AS fate, p AS is_protected, count(*) AS commits FROM c GROUP BY 1, 2""")
def prune_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = store.prune_plan(_event_commits(spark, sf_dir), NOW, 14, True, baseline_author="signup")
    return plan.groupBy("fate", "is_protected").agg(F.count("*").alias("commits"))


@query(f"""
WITH {LOG_SQL}, own AS (
  SELECT *, author = 'es' AS p, CASE WHEN row_number() OVER (PARTITION BY blob_hash ORDER BY timestamp DESC, commit_id DESC) = 1 THEN byte_size ELSE 0 END AS b FROM log
), run AS (
  SELECT *, coalesce(sum(CASE WHEN p THEN 0 ELSE b END) OVER (ORDER BY timestamp, commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(b) OVER () AS total FROM own)
SELECT commit_id, NOT p AND total - gone > 1000000 AS evicted FROM run""")
def prune_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _log(spark, sf_dir).withColumn("is_protected", F.col("author") == "es")
    return store.prune_quota(commits, 1_000_000).select("commit_id", "evicted")


PRUNE_SQL = f"""{LOG_SQL}, aged AS (
  SELECT *, author = 'es' AS p, date_diff('microsecond', strptime(timestamp[:19], '%Y-%m-%dT%H:%M:%S'), TIMESTAMP '2023-11-28 22:20:00') / 86400000000.0 > 14 AS old FROM log
), left_ AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY blob_hash ORDER BY timestamp DESC, commit_id DESC) = 1 THEN byte_size ELSE 0 END AS b FROM aged WHERE p OR NOT old
), run AS (
  SELECT *, coalesce(sum(CASE WHEN p THEN 0 ELSE b END) OVER (ORDER BY timestamp, commit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(b) OVER () AS total FROM left_
), fates AS (
  SELECT commit_id, blob_hash, 'expired' AS fate FROM aged WHERE NOT p AND old
  UNION ALL SELECT commit_id, blob_hash, CASE WHEN NOT p AND total - gone > 1000000 THEN 'evicted' ELSE 'keep' END FROM run)"""


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits a second apart: those of the first 400 ids are older than 14 days, others go by quota."""
    log = _log(spark, sf_dir).withColumn("is_pinned", F.lit(False))
    return store.prune(log, "2023-11-28T22:20:00+00:00", 14, 1_000_000, baseline_author="es")


@query(f"WITH {PRUNE_SQL} SELECT commit_id, fate FROM fates")
def prune_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir).select("commit_id", "fate")


@query("""
SELECT DISTINCT sha256(text) AS blob_hash, strlen(text)::BIGINT AS byte_size FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def orphan_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    left = docs.where("lang = 'en'").select(store.blob_hash("text").alias("blob_hash"))
    return store.orphan_blobs(store.blobs(docs, "text"), left).select("blob_hash", "byte_size")


@query(f"""
WITH {PRUNE_SQL}, b AS (SELECT sha256(text) AS h, any_value(strlen(text)) AS n, sha256(text) IN (SELECT blob_hash FROM fates WHERE fate = 'keep') AS held FROM documents GROUP BY 1)
SELECT (SELECT count(*) FROM fates WHERE fate <> 'keep') AS pruned_commits, (SELECT count(*) FROM fates WHERE fate = 'keep') AS kept_commits,
  count(*) FILTER (NOT held) AS pruned_blobs, coalesce(sum(n) FILTER (NOT held), 0)::BIGINT AS freed_bytes, coalesce(sum(n) FILTER (held), 0)::BIGINT AS kept_bytes FROM b""")
def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prune_report(_pruned(spark, sf_dir), store.blobs(_documents(spark, sf_dir), "text"))


@query(f"""
SELECT user_id::VARCHAR AS target, strftime(max(date_trunc('second', ts)), '%Y-%m-%dT%H:%M:%S+00:00') AS newest FROM events WHERE user_id % 3 <> 0 GROUP BY user_id
HAVING date_diff('microsecond', max(date_trunc('second', ts)), TIMESTAMP '{NOW[:10]} 00:00:00') / 86400000000.0 > 14""")
def stale_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("target")).distinct()
    return store.stale_targets(_event_commits(spark, sf_dir), NOW, 14, named)


@query(f"WITH {LOG_SQL} SELECT commit_id, byte_size::BIGINT AS bytes, CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || '...' ELSE d.text END AS preview FROM log JOIN documents d ON d.doc_id = log.write_seq")
def restore_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.restore_preview(_log(spark, sf_dir), store.blobs(_documents(spark, sf_dir), "text"))


# ---------------------------------------------------------------- style audit


def _duck_count(words: list[str]) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"len(list_filter(toks, lambda w: w IN ({listed})))"


@query(f"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_''-]+'), lambda w: trim(w, '''-')) AS toks FROM documents)
SELECT doc_id, CASE WHEN {_duck_count(style.rules.FR_STOPWORDS)} > {_duck_count(style.rules.EN_STOPWORDS)} THEN 'fr' ELSE 'en' END AS language FROM t""")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", style.detect_language(F.col("text")).alias("language"))


@query("""
SELECT doc_id, n AS words, CASE WHEN n < 500 THEN 0 WHEN n <= 1500 THEN 1 ELSE 2 END AS budget
FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::BIGINT AS n FROM documents)""")
def word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = word_count(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", n.alias("words"), style.budget(n).alias("budget"))


TERMS = ("the", "of", "with", "dans", "nicht", "idiot")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT doc_id, n, unnest(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')) AS term FROM l)
SELECT doc_id, n::INTEGER AS line, term, count(*) AS hits FROM m WHERE term IN ('the', 'of', 'with', 'dans', 'nicht', 'idiot') GROUP BY ALL""")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon over all documents, with the line of every match."""
    pattern = style.bounded("|".join(TERMS))
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(matches_with_lines(F.col("text"), pattern)).alias("m"))
    return rows.groupBy("doc_id", F.col("m.line").alias("line"), F.lower("m.term").alias("term")).agg(F.count("*").alias("hits"))


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)
SELECT doc_id, term, count(*) AS hits FROM m WHERE term IN ('idiot', 'clown', 'loser') GROUP BY ALL HAVING count(*) >= 2""")
def tier2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = style.bounded("idiot|clown|loser")
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    return rows.groupBy("doc_id", F.lower("m").alias("term")).agg(F.count("*").alias("hits")).where("hits >= 2")


# ---------------------------------------------------------------- segments and versions


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents), t AS (SELECT doc_id, u, regexp_replace(regexp_replace(u, '^\\s+', ''), '\\s+$', '') AS b FROM l)
SELECT doc_id, CASE WHEN regexp_matches(b, '^(?:>+\\s*)?[ \\t]*(?:`{3,}|~{3,})') THEN 'code_block' WHEN regexp_matches(regexp_replace(b, '^[>\\s]+', ''), '^\\|[^|]*\\|') THEN 'table'
  WHEN starts_with(b, '$$') AND ends_with(b, '$$') THEN 'math' WHEN regexp_matches(b, '^!\\[[^\\n]*?\\]\\([^\\n]*?\\)$') THEN 'image' WHEN regexp_matches(u, '^>\\s*\\[![A-Z]+\\]') THEN 'callout'
  WHEN starts_with(b, '>') THEN 'quote' WHEN starts_with(b, '#') THEN 'heading' ELSE 'paragraph' END AS unit_type, count(*) AS units FROM t GROUP BY ALL""")
def unit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("u"))
    return rows.groupBy("doc_id", segment.unit_type(F.col("u")).alias("unit_type")).agg(F.count("*").alias("units"))


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return segment.split_sentences(c)


@query()
def window_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.group_windows(sentence_split(spark, sf_dir))


@query()
def prose_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.prose_segments(_documents(spark, sf_dir).select("doc_id", "text", F.lit(False).alias("is_latex")))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn against the one of the same role before it."""
    c = _table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id", "role").orderBy("turn")
    pairs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.lag("text").over(before).alias("old_text"), F.col("text").alias("new_text"))
    return pairs.where("old_text is not null")


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it of the same first 40 characters: versions of one text."""
    before = Window.partitionBy(F.substring("text", 1, 40)).orderBy("doc_id")
    pairs = _documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.lag("text").over(before).alias("old_text"), F.col("text").alias("new_text"))
    return pairs.where("old_text is not null")


@query()
def rewrite_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.rewrite_plan(_turn_pairs(spark, sf_dir))


@query()
def word_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.retention(_turn_pairs(spark, sf_dir))


@query("""
WITH p AS (SELECT conv_id * 1000 + turn AS pair_id, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS o, text AS n FROM conversations),
s AS (SELECT pair_id, list_distinct(string_split(o, chr(10))) AS a, list_distinct(string_split(n, chr(10))) AS b FROM p WHERE o IS NOT NULL)
SELECT pair_id, len(list_intersect(a, b))::INTEGER AS n_kept, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS n_lost, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INTEGER AS n_new FROM s""")
def unit_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.unit_set_diff(_turn_pairs(spark, sf_dir))


@query()
def section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.match_sections(_near_pairs(spark, sf_dir))


@query()
def align_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.align_units(_near_pairs(spark, sf_dir))


@query()
def word_diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.word_ops(_near_pairs(spark, sf_dir)).where("op <> 'equal'")


@query()
def word_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.diff_counts(_near_pairs(spark, sf_dir))


@query()
def modified_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.section_totals(_near_pairs(spark, sf_dir))


@query()
def draft_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.draft_changes(_turn_pairs(spark, sf_dir))


@query()
def draft_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.audit_drafts(_turn_pairs(spark, sf_dir))


@query("""
WITH p AS (SELECT doc_id AS pair_id, lag(text) OVER (PARTITION BY substr(text, 1, 40) ORDER BY doc_id) AS o, text AS n FROM documents),
c AS (SELECT pair_id, regexp_extract_all(o, 'https?://[^\\s)>\\]"'']+') AS uo, regexp_extract_all(n, 'https?://[^\\s)>\\]"'']+') AS un,
  regexp_extract_all(o, '(?m)^#{1,6}[ \\t]+[^\\n]+$') AS ho, regexp_extract_all(n, '(?m)^#{1,6}[ \\t]+[^\\n]+$') AS hn FROM p WHERE o IS NOT NULL)
SELECT pair_id, len(list_distinct(list_filter(uo, lambda x: NOT list_contains(un, x))))::INTEGER AS lost_urls, len(list_distinct(list_filter(ho, lambda x: NOT list_contains(hn, x))))::INTEGER AS lost_headings FROM c""")
def preservation_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.preservation(_near_pairs(spark, sf_dir)).select("pair_id", "lost_urls", "lost_headings")


@query()
def annotated_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.annotate(_near_pairs(spark, sf_dir))


@query()
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.whole_paragraphs(versions.annotate(_near_pairs(spark, sf_dir)).select(F.col("pair_id").alias("doc_id"), F.col("body").alias("text")))


@query("""
WITH p AS (SELECT conv_id * 1000 + turn AS pair_id, lag(role) OVER w AS o, role AS n, lag(text) OVER w AS a, text AS b FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn))
SELECT pair_id, '> [!NOTE] ' || n || chr(10) || '> ' || replace(b, chr(10), ' ') || chr(10) AS text FROM p WHERE a IS NOT NULL""")
def callout_pair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as callouts against the ones before them: the new side of the marked callout is the new callout."""
    as_callout = lambda x: F.concat(F.lit("> [!NOTE] "), F.col("role"), F.lit("\n> "), F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("\n"))
    c = _table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    pairs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "role", before.alias("old"), F.col("text").alias("new")).where("old IS NOT NULL")
    marked = versions.callout_pairs(pairs.select("pair_id", as_callout(F.col("old")).alias("old_text"), as_callout(F.col("new")).alias("new_text")))
    return versions.one_side(marked.select(F.col("pair_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "pair_id").withColumn("text", F.regexp_replace("text", r"(?m)^>[ \t]*\n", ""))


@query()
def accept_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.annotate_accepted(_near_pairs(spark, sf_dir), 2).withColumnRenamed("pair_id", "doc_id")


# ---------------------------------------------------------------- conversion


@query("SELECT page_id, regexp_matches(html, '(?i)<!DOCTYPE\\s+html|<html\\b|<body\\b') AS is_html FROM pages")
def html_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", convert.is_html(F.col("html")).alias("is_html"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.html_to_markdown(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


# ---------------------------------------------------------------- links and artefacts


@query("""
SELECT doc_id, repeat('`', greatest(4, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))) AS fence FROM documents""")
def dynamic_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", artifact.fence(F.col("text")).alias("fence"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::INTEGER AS n_lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(lines(F.col("text"))).alias("n_lines"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY timestamp DESC, commit_id) AS n FROM log)
SELECT target, '| Commit | Date | Auteur | Message |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10) ||
  string_agg('| `' || substr(commit_id, 1, 8) || '` | ' || substr(replace(timestamp, 'T', ' '), 1, 16) || ' | ' || author || ' | m' || write_seq || ' |', chr(10) ORDER BY n) AS "table" FROM r WHERE n <= 5 GROUP BY target""")
def recent_commits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact.recent_table(_log(spark, sf_dir).withColumn("message", F.concat(F.lit("m"), F.col("write_seq").cast("string"))))


@query()
def diff_artifact_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite: each source's oldest document against its newest, compared, audited and assembled."""
    log = _log(spark, sf_dir)
    blobs = store.blobs(_documents(spark, sf_dir), "text")
    history = artifact.recent_table(log.withColumn("message", F.concat(F.lit("m"), F.col("write_seq").cast("string"))))
    return diff_artifact.diff_artifacts(diff_artifact.versions_of(log, blobs), history=history)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the retention rule leaves of each source's log, latest first, with how often each blob is held."""
    log = _log(spark, sf_dir)
    kept = store.survivors(log)
    held = log.groupBy("blob_hash").agg(F.count("*").alias("held_by"))
    return kept.join(held, "blob_hash").select("target", "write_seq", "parent_seq", "commit_id", "blob_hash", "byte_size", "timestamp", "held_by").orderBy(F.desc("timestamp"), "commit_id")


__all__ = ["QUERIES", "SQL", "WORD", "composed", "flagship"]
