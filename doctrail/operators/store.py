"""The snapshot store: content addresses, retention, listing, lineage and pruning.

Commits are rows with an explicit ``write_seq``; blobs are rows by hash. Every
function takes tables and parameters and gives a table; nothing is written.
"""

from __future__ import annotations

import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctrail.functions.tables import checkpoint

#: The author whose commits are baselines; a parameter wherever it counts.
BASELINE_AUTHOR = "baseline"


def blob_hash(content: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, in hex."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def commit_id(target: Column, timestamp: Column, blob: Column, message: Column, author: Column, parent: Column) -> Column:
    return F.sha2(F.concat_ws("|", target, timestamp, blob, message, author, F.coalesce(parent, F.lit(""))), 256)


def is_baseline(author: Column | str, baseline_author: str = BASELINE_AUTHOR) -> Column:
    return F.lower(F.trim(author)) == baseline_author


def with_compressed_size(contents: DataFrame, content: str = "content") -> DataFrame:
    """Rows with compressed_size: bytes of the content under zlib level 9, only for parity with stored blobs."""

    @F.pandas_udf("long")
    def size(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else len(zlib.compress(x.encode(), 9))).astype("Int64")

    return contents.withColumn("compressed_size", size(content))


def blobs(contents: DataFrame, content: str = "content") -> DataFrame:
    """blob_hash, content, byte_size: each content once."""
    return contents.select(blob_hash(content).alias("blob_hash"), F.col(content).alias("content"), F.octet_length(content).cast("long").alias("byte_size")).dropDuplicates(["blob_hash"])


def put_absent(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose hash the store does not hold: what a put writes."""
    return new.dropDuplicates(["blob_hash"]).join(store.select("blob_hash"), "blob_hash", "left_anti")


def get_blobs(commits: DataFrame, store: DataFrame) -> DataFrame:
    """Commits with their content; a missing blob is an error."""
    met = commits.join(store.select("blob_hash", F.col("content")), "blob_hash", "left")
    return met.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("blob not found: "), F.coalesce("blob_hash", F.lit("null"))))).otherwise(F.col("content")))


def heads(commits: DataFrame) -> DataFrame:
    """target, commit_id of the commit written last, whatever its timestamp."""
    return commits.groupBy("target").agg(F.max_by("commit_id", "write_seq").alias("commit_id"))


def lookup(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, commit_id, outcome for each asked id: an exact match wins, else a single prefix match.

    ``outcome`` is exact, prefix, ambiguous or missing. Ids are joined by their
    first eight characters where the asked prefix has them; shorter ones are
    exploded from the ids, so no pair of all rows is tried.
    """
    ids = commits.select("commit_id").distinct()
    lengths = asked.select(F.length("asked").alias("n")).distinct()
    # A request has few different lengths; an id gives one key for each.
    keys = ids.join(F.broadcast(lengths.where("n <= 64")), F.length("commit_id") >= F.col("n")).select("commit_id", F.expr("substr(commit_id, 1, n)").alias("asked"))
    found = asked.select("asked").distinct().join(keys, "asked", "left").groupBy("asked").agg(
        F.count("commit_id").alias("n"), F.max((F.col("commit_id") == F.col("asked")).cast("int")).alias("exact"), F.min("commit_id").alias("one")
    )
    outcome = F.when(F.col("exact") == 1, "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return found.select("asked", F.when(F.col("exact") == 1, F.col("asked")).when(F.col("n") == 1, F.col("one")).alias("commit_id"), outcome.alias("outcome"))


def survivors(log: DataFrame, baseline_author: str = BASELINE_AUTHOR) -> DataFrame:
    """The commits that a write-ordered log leaves of each target, where timestamps rise with writes.

    A baseline commit clears its target and is pinned; after it only the last
    commit stays with it. Without one the first and the last stay. Partial
    aggregates find them, so a target with many commits meets in no one task.
    """
    base = F.max(F.when(is_baseline("author", baseline_author), F.col("write_seq")))
    ends = log.groupBy("target").agg(F.coalesce(base, F.min("write_seq")).alias("anchor"), F.max("write_seq").alias("last"))
    kept = ends.select("target", "anchor", F.explode(F.array_distinct(F.array("anchor", "last"))).alias("write_seq"))
    parent = F.when(F.col("write_seq") != F.col("anchor"), F.col("anchor"))
    return log.join(kept, ["target", "write_seq"]).select(*[log[x] if x not in ("target", "write_seq") else F.col(x) for x in log.columns], parent.alias("parent_seq"), is_baseline("author", baseline_author).alias("by_baseline"))


def write(commits: DataFrame, held: DataFrame, writes: DataFrame, baseline_author: str = BASELINE_AUTHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store after writes: its commits, blobs and heads.

    ``commits`` has commit_id, target, message, author, timestamp, is_pinned,
    mode, blob_hash, byte_size, parent_commit_id and write_seq, ``held`` the
    blobs (blob_hash, content, byte_size); ``writes`` has write_seq, target,
    message, author, timestamp, is_pinned, mode and content, written after all
    commits, by write_seq. A baseline write is pinned. A commit's id names its
    parent, the target's anchor. Blobs that only commits evicted here referred
    to go; others that nothing refers to stay until a prune.
    """
    made = writes.select(
        *"write_seq target message author timestamp mode content".split(),
        (F.coalesce("is_pinned", F.lit(False)) | is_baseline("author", baseline_author)).alias("is_pinned"),
        blob_hash("content").alias("blob_hash"),
        F.octet_length("content").cast("long").alias("byte_size"),
    )
    none = F.lit(None).cast("string")
    log = commits.unionByName(made.drop("content").withColumns({"commit_id": none, "parent_commit_id": none}))
    left = checkpoint(survivors(log, baseline_author))
    named = lambda parent: F.coalesce("commit_id", commit_id(*[F.col(x) for x in "target timestamp blob_hash message author".split()], parent))
    anchors = left.where("parent_seq IS NULL").withColumn("commit_id", named(none))
    others = left.where("parent_seq IS NOT NULL").drop("parent_commit_id").join(anchors.select("target", F.col("commit_id").alias("parent_commit_id")), "target")
    others = others.withColumn("commit_id", named(F.col("parent_commit_id")))
    after = anchors.unionByName(others).select(*commits.columns)
    gone = log.select("blob_hash").distinct().join(left.select("blob_hash"), "blob_hash", "left_anti")
    kept = held.unionByName(put_absent(held, blobs(made))).join(gone, "blob_hash", "left_anti")
    return after, kept, heads(after)


def fold(log: DataFrame, baseline_author: str = BASELINE_AUTHOR) -> DataFrame:
    """As ``survivors`` for logs whose timestamps do not follow the writes: target, write_seq, parent_seq.

    The oldest of a target is then a matter of the state, so each target's
    writes are folded in order; at most two commits are held at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: list[tuple] = []
        for seq, author, ts in pdf.sort_values("write_seq")[["write_seq", "author", "timestamp"]].itertuples(index=False):
            own = (author or "").strip().lower() == baseline_author
            if own:
                parent, state = None, []
            else:
                base = [x for x in state if x[1]]
                keep = max(base, key=lambda x: (x[2], x[0])) if base else min(state, key=lambda x: (x[2], x[0]), default=None)
                parent, state = (keep[0] if keep else None), ([keep] if keep else [])
            state.append((seq, own, ts, parent))
        rows = [(pdf["target"].iloc[0], x[0], x[3]) for x in state]
        out = pd.DataFrame(rows, columns=["target", "write_seq", "parent_seq"])
        return out.astype({"write_seq": "int64", "parent_seq": "Int64"})

    return log.select("target", "write_seq", "author", "timestamp").groupBy("target").applyInPandas(run, "target string, write_seq long, parent_seq long")


def ancestry(commits: DataFrame, chains: bool = False) -> DataFrame:
    """commit_id, depth (commits on the way to the last known ancestor, itself included) and, if asked for, chain (itself first).

    Every commit points to an ancestor, and each round to its ancestor's, so
    the rounds grow with the logarithm of the longest chain, and no chain is too
    long. A chain ends where there is no parent, where it is missing, or before
    it would repeat.
    """
    up = commits.where("commit_id IS NOT NULL").groupBy("commit_id").agg(F.min("parent_commit_id").alias("up"))
    up = up.withColumn("up", F.when(F.col("up") != F.col("commit_id"), F.col("up")))
    known = up.select(F.col("commit_id").alias("up"))
    none = F.lit(None).cast("string")
    first = up.join(known, "up", "left_semi").unionByName(up.join(known, "up", "left_anti").withColumn("up", none))
    first = first.select("commit_id", "up", F.lit(1).alias("depth"), *([F.array("commit_id").alias("chain")] if chains else []))
    state = checkpoint(first)
    todo, rounds = state.where("up IS NOT NULL").count(), max(1, state.count()).bit_length()
    for _ in range(rounds):
        if not todo:
            break
        far = state.select(F.col("commit_id").alias("up"), F.col("up").alias("farther"), F.col("depth").alias("more"), *([F.col("chain").alias("rest")] if chains else []))
        met = state.join(far, "up", "left")
        longer = [F.when(F.col("more").isNull(), F.col("chain")).otherwise(F.concat("chain", "rest")).alias("chain")] if chains else []
        state = checkpoint(met.select("commit_id", F.col("farther").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), *longer))
        todo = state.where("up IS NOT NULL").count()
    if not todo:
        return state.drop("up")
    # Only circles of parents, and what leads into them, are left: they are followed step by step until they would repeat.
    step = first.select("commit_id", "up")
    walk = checkpoint(state.where("up IS NOT NULL").select("commit_id").join(step, "commit_id").select("commit_id", "up", F.array("commit_id").alias("chain")))
    while walk.where("up IS NOT NULL").count():
        hop = step.select(F.col("commit_id").alias("up"), F.col("up").alias("farther"))
        seen = F.array_contains("chain", F.col("farther"))
        met = walk.join(hop, "up", "left").withColumn("chain", F.when(F.col("up").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("up"))))
        walk = checkpoint(met.select("commit_id", F.when(~seen, F.col("farther")).alias("up"), "chain"))
    circles = walk.select("commit_id", F.size("chain").alias("depth"), *(["chain"] if chains else []))
    return state.where("up IS NULL").drop("up").unionByName(circles)


def lineage(commits: DataFrame) -> DataFrame:
    """commit_id, depth, chain (itself first): parents followed until there is none, it is missing, or it would repeat."""
    return ancestry(commits, True)


def list_commits(commits: DataFrame, target: str = "", mode: str = "", limit: int | None = 10) -> DataFrame:
    """Commits, newest first, children before parents of the same time, then by id.

    A target with a slash or colon must be equal; another may be equal to the
    last part of the path. The depth is that within what the filters leave.
    """
    out = commits
    if target:
        key = target.strip().lower()
        same = F.lower("target") == key
        if not any(x in target for x in "/\\:"):
            same = same | (F.element_at(F.split(F.lower("target"), r"[/\\]"), -1) == key)
        out = out.where(same)
    if mode:
        out = out.where(F.lower("mode") == mode.lower())
    out = out.join(ancestry(out.select("commit_id", "parent_commit_id")), "commit_id", "left")
    out = out.orderBy(F.desc("timestamp"), F.desc("depth"), "commit_id").select(*commits.columns)
    return out if limit is None else out.limit(limit)


def normalize_target(target: Column, vault_root: str, home: str, in_vault: list[str] | None = None, cwd: str = "/") -> Column:
    """A portable key of a target, from its text alone.

    Virtual and scratch names keep their prefix; paths below the vault become
    relative to it, those below the home or a Windows user folder begin with
    ``~/``. Relative paths are of the vault if ``in_vault`` lists them, else of ``cwd``.
    """
    t = F.trim(target)
    plain = F.regexp_replace(t, r"\\", "/")
    listed = plain.isin(in_vault) if in_vault else F.lit(False)
    full = (
        F.when(plain == "~", F.lit(home))
        .when(plain.startswith("~/"), F.concat(F.lit(home), F.substring(plain, 2, 1 << 30)))
        .when(plain.startswith("/") | plain.rlike(r"^[A-Za-z]:/"), plain)
        .when(listed, F.concat(F.lit(vault_root + "/"), plain))
        .otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), plain))
    )

    def below(root: str) -> tuple[Column, Column]:
        return F.lower(full).startswith(root.lower() + "/"), F.substring(full, len(root) + 2, 1 << 30)

    (in_v, v), (in_h, h) = below(vault_root), below(home)
    user = F.regexp_extract(full, r"(?i)^[A-Z]:/Users/[^/]+/(.*)$", 1)
    path = F.when(in_v, v).when(in_h, F.concat(F.lit("~/"), h)).when(user != "", F.concat(F.lit("~/"), user)).otherwise(full)
    named = F.regexp_extract(t, r"(?s)^(virtual:|scratch:)(.*)$", 1)
    return F.when(t == "", "").when(named != "", F.concat(named, F.trim(F.regexp_extract(t, r"(?s)^(virtual:|scratch:)(.*)$", 2)))).otherwise(path)


def _stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _local(key: Column) -> Column:
    """Keys of the vault, whose stem protects them too."""
    outside = key.startswith("~/") | key.contains(":") | key.startswith("/")
    return ~outside | key.startswith("notes/")


def mentioned_stems(notes: DataFrame, stems: DataFrame, skipped: tuple[str, ...] = ("_agents/project_diffs", "_agents/store")) -> DataFrame:
    """stem: the artefact names that some note (columns path, text) speaks of, in plain or URL-coded form.

    Notes are cut at every mark that may precede a name. What begins the rest
    of the line is tried in each length that names of its first word have, and
    joined whole, so names that share their first word never meet all notes.
    """
    skip = rf"(?i)^({'|'.join(skipped)})(/|$)|(^|/)(\.git|\.obsidian|node_modules|\.trash|\.venv|__pycache__)(/|$)"
    # Only lines with a mark, plain or coded, are decoded.
    marked = F.filter(F.split("text", "\n"), lambda x: x.contains("🤖") | x.contains("%") | F.lower(x).contains("project_diffs/"))
    lines = notes.where(~F.col("path").rlike(skip)).select(F.explode(marked).alias("text"))
    # A per cent sign that codes nothing stays, as in plain texts.
    coded = F.regexp_replace(F.regexp_replace("text", r"\+", "%2B"), "%(?![0-9A-Fa-f]{2})", "%25")
    text = F.lower(F.coalesce(F.try_url_decode(coded), F.col("text")))
    tails = lines.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?=(?:🤖 |project_diffs/(?:🤖 )?)([^\n]+))"), F.lit(1))).alias("tail")).distinct()
    names = stems.select(F.lower(F.trim("stem")).alias("stem")).where("stem <> ''").distinct().withColumn("head", F.substring_index("stem", " ", 1))
    lengths = names.select(F.length("head").alias("n")).distinct()
    keyed = tails.join(F.broadcast(lengths), F.length(F.substring_index("tail", " ", 1)) >= F.col("n")).withColumn("head", F.expr("substr(tail, 1, n)")).drop("n")
    sizes = names.groupBy("head").agg(F.collect_set(F.length("stem")).alias("sizes"))
    tried = keyed.join(sizes, "head").select("tail", F.explode("sizes").alias("n")).where(F.length("tail") >= F.col("n")).select(F.expr("substr(tail, 1, n)").alias("stem")).distinct()
    return names.select("stem").join(tried, "stem", "left_semi")


def protected_keys(targets: DataFrame | None, mentioned: DataFrame | None, artifacts: DataFrame | None) -> DataFrame:
    """key: what protects a target. ``targets`` has normalised keys (key), ``mentioned`` stems (stem), ``artifacts`` stem and text."""
    parts = []
    if targets is not None:
        key = F.lower("key")
        parts += [targets.select(key.alias("key")), targets.where(_local(key)).select(_stem(key).alias("key"))]
    if mentioned is not None:
        parts.append(mentioned.select(F.lower("stem").alias("key")))
    out = reduce(DataFrame.unionByName, parts).distinct()
    if artifacts is not None:
        source = F.regexp_extract("text", r"<!--\s*SOURCE_FILE:\s*([^\r\n]+?)\s*-->", 1)
        named = artifacts.select(F.lower(F.trim("stem")).alias("key"), source.alias("source")).join(out, "key", "left_semi").where("source <> ''")
        out = out.unionByName(named.select(F.lower("source").alias("key"))).distinct()
    return out


def protected(commits: DataFrame, keys: DataFrame) -> DataFrame:
    """target: those of the commits that a key, or for vault notes the stem, protects."""
    names = commits.select("target").distinct().withColumn("k", F.lower("target"))
    tried = names.select("target", F.explode(F.when(_local(F.col("k")), F.array("k", _stem(F.col("k")))).otherwise(F.array("k"))).alias("key"))
    return tried.join(keys, "key", "left_semi").select("target").distinct()


def _age_days(now: str) -> Column:
    return (F.lit(1) * (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.try_to_timestamp("timestamp")))) / F.lit(86_400_000_000)


def prune_plan(commits: DataFrame, now: str, ttl_days: float = 14, keep_baselines: bool = True, protected_targets: DataFrame | None = None, baseline_author: str = BASELINE_AUTHOR) -> DataFrame:
    """Commits with ``is_protected`` and ``fate`` (keep or expired): older than the limit, strictly, and not protected; no timestamp never expires."""
    guard = (F.col("is_pinned") | is_baseline("author", baseline_author)) if keep_baselines else F.lit(False)
    out = commits
    if protected_targets is not None:
        out = out.join(protected_targets.select("target", F.lit(True).alias("named")), "target", "left")
        guard = guard | F.coalesce("named", F.lit(False))
    out = out.withColumn("is_protected", F.coalesce(guard, F.lit(False)))
    expired = ~F.col("is_protected") & F.coalesce(_age_days(now) > ttl_days, F.lit(False))
    return out.withColumn("fate", F.when(expired, "expired").otherwise("keep")).drop("named")


def exclusive_sizes(commits: DataFrame) -> DataFrame:
    """Commits with the bytes that go when they and all older ones go: a blob counts with its newest holder."""
    newest = Window.partitionBy("blob_hash").orderBy(F.desc("timestamp"), F.desc("commit_id"))
    return commits.withColumn("own_bytes", F.when(F.row_number().over(newest) == 1, F.col("byte_size")).otherwise(0))


def prune_quota(commits: DataFrame, quota_bytes: int) -> DataFrame:
    """Commits with ``evicted``: the oldest unprotected ones until what is left is within the quota.

    Sizes are measured after blobs that nothing refers to are gone. The running
    sum over all commits is taken in two steps, by day and within a day, so it
    never sorts the whole store in one task.
    """
    sized = exclusive_sizes(commits).withColumn("day", F.substring("timestamp", 1, 10))
    free = F.when(F.col("is_protected"), 0).otherwise(F.col("own_bytes"))
    days = sized.groupBy("day").agg(F.sum(free).alias("freed"), F.sum("own_bytes").alias("held"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    # A row a day: a few thousand for decades of commits.
    days = days.select("day", F.coalesce(F.sum("freed").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("day").orderBy("timestamp", "commit_id").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(days, "day").withColumn("gone", F.col("before") + F.coalesce(F.sum(free).over(within), F.lit(0)))
    evicted = ~F.col("is_protected") & (F.col("total") - F.col("gone") > quota_bytes)
    return out.withColumn("evicted", evicted).drop("day", "before", "total", "gone", "own_bytes")


def orphan_blobs(store: DataFrame, commits: DataFrame) -> DataFrame:
    """Blobs that no commit refers to."""
    return store.join(commits.select("blob_hash"), "blob_hash", "left_anti")


def prune(commits: DataFrame, now: str, ttl_days: float = 14, quota_bytes: int = 500 << 20, keep_baselines: bool = True, protected_targets: DataFrame | None = None, baseline_author: str = BASELINE_AUTHOR) -> DataFrame:
    """Commits with ``is_protected`` and ``fate``: expired by age first, then evicted, oldest first, until the rest is within the quota, else keep."""
    plan = checkpoint(prune_plan(commits, now, ttl_days, keep_baselines, protected_targets, baseline_author))
    left = prune_quota(plan.where("fate = 'keep'"), quota_bytes)
    left = left.withColumn("fate", F.when(F.col("evicted"), "evicted").otherwise("keep")).select(*plan.columns)
    return plan.where("fate <> 'keep'").unionByName(left)


def prune_report(plan: DataFrame, store: DataFrame) -> DataFrame:
    """One row: pruned and kept commits, pruned blobs, freed bytes (of blobs alone), kept bytes."""
    left = plan.where("fate = 'keep'")
    gone = orphan_blobs(store, left).agg(F.count("*").alias("pruned_blobs"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("freed_bytes"))
    held = store.join(left.select("blob_hash"), "blob_hash", "left_semi").agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("kept_bytes"))
    counts = plan.agg(F.count_if(F.col("fate") != "keep").alias("pruned_commits"), F.count_if(F.col("fate") == "keep").alias("kept_commits"))
    return counts.join(gone, F.lit(True)).join(held, F.lit(True))


def stale_targets(commits: DataFrame, now: str, max_age_days: float = 14, protected_targets: DataFrame | None = None) -> DataFrame:
    """target, newest: targets whose newest commit is too old or undated, pinned or not, unless the target is protected."""
    newest = commits.groupBy("target").agg(F.max("timestamp").alias("timestamp"))
    if protected_targets is not None:
        newest = newest.join(protected_targets.select("target"), "target", "left_anti")
    return newest.where(F.coalesce(_age_days(now) > max_age_days, F.lit(True))).select("target", F.col("timestamp").alias("newest"))


def restore_preview(commits: DataFrame, store: DataFrame, chars: int = 300) -> DataFrame:
    """commit_id, byte_size, preview of the content."""
    got = get_blobs(commits, store)
    cut = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content"))
    return got.select("commit_id", F.octet_length("content").cast("long").alias("bytes"), cut.alias("preview"))
