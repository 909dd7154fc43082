"""The snapshot store against hand-derived cases and a plain fold."""

import random

import duckdb
from pyspark.sql import functions as F

from doctrail.operators import store
from doctrail.streaming import commits as streaming

LOG = "target string, write_seq long, author string, timestamp string"


def log(spark, writes):
    return spark.createDataFrame([(t, k, a, f"2024-01-01T00:00:{k:02d}+00:00") for k, (t, a) in enumerate(writes)], LOG)


def plain(writes):
    state = {}
    for k, (t, a) in enumerate(writes):
        held = state.get(t, [])
        base = [x for x in held if x[1] == "b"]
        keep = [] if a == "b" else base[-1:] or held[:1]
        state[t] = [*keep, (k, a, keep[0][0] if keep else None)]
    return {(t, x[0], x[2] if len(x) > 2 else None) for t, xs in state.items() for x in xs}


def test_addresses(spark):
    row = spark.range(1).select(store.blob_hash(F.lit("alpha")).alias("h")).first()
    assert row.h == "8ed3f6ad685b959ead7022518e1af76cd816f8e8ec7ccdda1ed4018e8f2223f8"
    made = store.commit_id(F.lit("notes/a.md"), F.lit("2024-01-01T00:00:00+00:00"), F.lit(row.h), F.lit("m1"), F.lit("agent"), F.lit(None).cast("string"))
    assert spark.range(1).select(made.alias("c")).first().c == "8537b9c1372c5ddeabe3ef98bf7f8721ea8eb4b03eeb8f182e4dff7bbe68a8ad"


def test_retention(spark):
    r = random.Random(5)
    writes = [(r.choice("xyz"), r.choice("aaab")) for _ in range(60)]
    want = {(t, k) for t, k, _ in plain(writes)}
    for found in (store.survivors(log(spark, writes), "b"), store.fold(log(spark, writes), "b")):
        got = {(x.target, x.write_seq): x.parent_seq for x in found.collect()}
        assert set(got) == want
        assert all(p is None or (t, p) in want for (t, _), p in got.items())


def test_list_filters(spark):
    rows = [("c1", "notes/a.md", "t1", None), ("c2", "notes/a.md", "t1", "c1"), ("c3", "x/b.md", "t2", None)]
    commits = spark.createDataFrame([(*x, "paper") for x in rows], "commit_id string, target string, timestamp string, parent_commit_id string, mode string")
    ids = lambda **k: [x.commit_id for x in store.list_commits(commits, **k).collect()]
    assert ids(target="a.md") == ["c2", "c1"] and ids(target="x/a.md") == [] and ids() == ["c3", "c2", "c1"] and ids(mode="DRAFT") == []


def test_children_stand_before_their_parents_however_long_the_chain(spark):
    rows = [("z", None), ("m", "z"), ("x", "m"), ("a", "gone"), ("s", "s")]
    commits = spark.createDataFrame([(c, p, "t", "t1", "paper") for c, p in rows], "commit_id string, parent_commit_id string, target string, timestamp string, mode string")
    assert [x.commit_id for x in store.list_commits(commits).collect()] == ["x", "m", "a", "s", "z"]
    assert store.list_commits(commits.where("1 = 0")).count() == 0


def test_ancestry(spark):
    """A chain of 1,000, a missing parent, a commit that is its own parent, and a circle with a way into it."""
    parent = {f"c{k}": f"c{k - 1}" if k else None for k in range(1000)} | {"a": "gone", "s": "s", "p": "q", "q": "r", "r": "p", "w": "v", "v": "q"}

    def chain(c):
        out = []
        while c in parent and c not in out:
            out.append(c)
            c = parent[c]
        return out

    commits = spark.createDataFrame(list(parent.items()), "commit_id string, parent_commit_id string")
    assert {x.commit_id: x.depth for x in store.ancestry(commits).collect()} == {c: len(chain(c)) for c in parent}
    few = commits.where("commit_id NOT LIKE 'c%' OR length(commit_id) < 4")
    parent = {c: p for c, p in parent.items() if c[0] != "c" or len(c) < 4}
    assert {x.commit_id: (x.depth, x.chain) for x in store.lineage(few).collect()} == {c: (len(chain(c)), chain(c)) for c in parent}


def test_write_keeps_blobs_that_commits_share(spark):
    kinds = "write_seq long, target string, message string, author string, timestamp string, is_pinned boolean, mode string, content string"
    none = spark.createDataFrame([], "commit_id string, target string, message string, author string, timestamp string, is_pinned boolean, mode string, blob_hash string, byte_size long, parent_commit_id string, write_seq long")
    lots = [[("x", "a", "one"), ("x", "a", "two"), ("y", "a", "two")], [("x", "a", "three")], [("y", "B ", "four"), ("y", "a", "one")]]
    state, at = (none, spark.createDataFrame([("h0", "lost", 4)], "blob_hash string, content string, byte_size long")), 0
    for lot in lots:
        rows = [(at + k, t, "m", a, f"2024-01-01T00:00:{at + k:02d}+00:00", None, "paper", c) for k, (t, a, c) in enumerate(lot)]
        at += len(lot)
        *state, heads = store.write(*state, spark.createDataFrame(rows, kinds), "b")
    commits = {x.write_seq: x for x in state[0].collect()}
    assert {(x.target, k) for k, x in commits.items()} == {("x", 0), ("x", 3), ("y", 4), ("y", 5)}
    assert commits[3].parent_commit_id == commits[0].commit_id and commits[5].parent_commit_id == commits[4].commit_id and commits[4].is_pinned and not commits[5].is_pinned
    # "two" is evicted with its last commit; "one" is held by two; what nothing ever referred to stays.
    assert {x.content for x in state[1].collect()} == {"one", "three", "four", "lost"}
    assert {x.target: x.commit_id for x in heads.collect()} == {"x": commits[3].commit_id, "y": commits[5].commit_id}


def test_quota_and_undated(spark):
    rows = [("c1", "t", "a", "2024-01-01T00:00:00+00:00", False, "h1", 10), ("c2", "t", "a", "2024-01-02T00:00:00+00:00", True, "h2", 10), ("c3", "u", "a", None, False, "h1", 10)]
    commits = spark.createDataFrame(rows, "commit_id string, target string, author string, timestamp string, is_pinned boolean, blob_hash string, byte_size long")
    fates = {x.commit_id: x.fate for x in store.prune_plan(commits, "2024-03-01T00:00:00+00:00").collect()}
    assert fates == {"c1": "expired", "c2": "keep", "c3": "keep"}
    assert [x.target for x in store.stale_targets(commits.where("target = 'u'"), "2024-03-01T00:00:00+00:00").collect()] == ["u"]


def test_stream_retains_as_the_fold(spark, tmp_path):
    writes = [("x", "a"), ("x", "a"), ("y", "b"), ("x", "b"), ("y", "a"), ("x", "a")]
    log(spark, writes).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    run = streaming.retained(stream, "b").writeStream.format("memory").queryName("retained").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    assert {(x.target, x.write_seq) for x in spark.table("retained").collect()} == {(t, k) for t, k, _ in plain(writes)}


def test_stray_per_cent_sign_does_not_hide_a_mention(spark):
    notes = spark.createDataFrame([("a.md", "100 %% [x](_agents/project_diffs/%F0%9F%A4%96%20Beta%20one.md)")], "path string, text string")
    stems = spark.createDataFrame([("beta one",), ("gamma",)], "stem string")
    assert [x.stem for x in store.mentioned_stems(notes, stems).collect()] == ["beta one"]


def test_audits_of_short_ids(spark):
    from doctrail.operators import style

    asked = spark.createDataFrame([("abc",), ("abcdef0123456789",), ("",), ("zz",), (None,)], "asked string")
    audits = spark.createDataFrame([("abcdef01",), ("abcd",), ("zy",)], "commit_id string")
    found = {(x.asked, x.commit_id) for x in style.find_audits(asked, audits).collect()}
    assert found == {("abc", "abcd"), ("abcdef0123456789", "abcdef01")}


def test_audits_of_another_target_are_not_found(spark, tmp_path):
    from doctrail.plans.queries import QUERIES, SQL

    # The ids of both texts begin with b30a892c; the fourth document's audit is known by these digits, the third has none.
    spark.createDataFrame([(4, "text 859"), (3, "text 4460")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = [tuple(x) for x in QUERIES["audit_lookup"](spark, str(tmp_path)).collect()]
    assert found == con.execute(SQL["audit_lookup"]).fetchall() and len(found) == 1


def test_names_of_one_first_word_do_not_meet_all_notes(spark):
    notes = spark.createDataFrame([("a.md", "see 🤖 Plan 7 of May\n🤖 plan 70"), ("b.md", "🤖 planet"), ("c.md", "🤖 plan")], "path string, text string")
    stems = spark.createDataFrame([(f"plan {k}",) for k in range(100)] + [("plan",), ("plan 7 of",), ("plan 7 of June",), ("",), (None,)], "stem string")
    found = store.mentioned_stems(notes, stems)
    assert sorted(x.stem for x in found.collect()) == ["plan", "plan 7", "plan 7 of", "plan 70"]
    # Names are joined whole: no pair is made first and tested for its beginning then.
    assert "StartsWith" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_citation_keys_that_end_in_nought(spark):
    from doctrail.operators import convert

    docs = spark.createDataFrame([(1, "\\begin{document}x \\cite{doe2020}\\end{document}")], "doc_id long, text string")
    entries = spark.createDataFrame([("doe2020", {"author": "Doe, J.", "year": "2020", "title": "T"})], "key string, fields map<string,string>")
    assert "[Doe, 2020]" in convert.latex_to_markdown(docs, entries).first().markdown


def test_artifacts_keep_their_targets(spark, tmp_path):
    from doctrail.sources import readers

    rows = [("a/x.md", "one\n\ntwo   é"), ("b.md", "")]
    readers.write_artifacts(spark.createDataFrame(rows, "target string, artifact string"), str(tmp_path / "out"))
    assert sorted(map(tuple, readers.artifacts(spark, str(tmp_path / "out")).collect())) == rows


def test_files_of_the_store(spark, tmp_path):
    import hashlib
    import json
    import zlib

    from doctrail.sources import readers

    text = "a\n\né"
    name = hashlib.sha256(text.encode()).hexdigest()
    for folder, file, data in (("blobs/" + name[:2], name[2:], zlib.compress(text.encode(), 9)), ("commits", "c.json", json.dumps({"commit_id": "c", "target": "t", "byte_size": 5}, indent=1).encode()), ("commits", "bad.json", b"{"), ("notes", "n.md", b"x\xff")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / file).write_bytes(data)
    assert [tuple(x) for x in readers.blob_files(spark, str(tmp_path / "blobs")).collect()] == [(name, text)]
    assert [(x.commit_id, x.byte_size) for x in readers.commit_files(spark, str(tmp_path / "commits")).collect()] == [("c", 5)]
    assert [x.text for x in readers.texts(spark, str(tmp_path / "notes")).collect()] == ["x�"]
    assert [(x.rel_path, x.size) for x in readers.file_listing(spark, str(tmp_path / "notes")).collect()] == [("n.md", 2)]


def test_composite_is_one_comparison_of_each_pair(spark):
    from doctrail.operators import versions
    from doctrail.plans import diff_artifact
    from doctrail.textcore import diff, draft

    old = "# A\n\nOne two three four five.\n\n## B\n\nKept.\n"
    new = "# A\n\nOne two three four six.\n\n## B\n\nKept.\n\nA robust end.\n"
    pairs = spark.createDataFrame([(1, "x.md", old, new, "c1"), (2, "y.md", old, old, "c2")], "pair_id long, target string, old_text string, new_text string, commit_id string")
    history = spark.createDataFrame([("x.md", "| T |")], "target string, table string")
    out = {x.target: x for x in diff_artifact.diff_artifacts(pairs, history=history).collect()}
    body, toc = diff.render(old, new)
    x, y = out["x.md"], out["y.md"]
    assert (x.verdict, y.verdict, y.added, y.deleted, y.retention_percent) == ("FAIL", "PASS", 0, 0, 100.0)
    assert x.retention_percent == draft.retention(old, new) and body in x.artifact and toc in x.artifact and "| T |\n\n" in x.artifact and "| T |" not in y.artifact
    counts = {c.pair_id: (c.added, c.deleted) for c in versions.diff_counts(pairs).collect()}
    assert counts[1] == (x.added, x.deleted)


def test_texts_are_annotated_once_for_whole_paragraphs(spark):
    from doctrail.operators import versions

    pairs = spark.createDataFrame([(1, "one two three", "four five six"), (2, "same", "same")], "pair_id long, old_text string, new_text string")
    found = versions.whole_paragraphs(versions.annotate(pairs).selectExpr("pair_id AS doc_id", "body AS text"))
    assert {x.doc_id: x.text.count("<span") for x in found.collect()} == {1: 2, 2: 0}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
