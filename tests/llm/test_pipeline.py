"""The pipeline's stages on planted cases, each judged on its own input."""

import random

import corpus_pipeline
from doctrail.llm import neardup

WORDS = "the of and to in is that with for was this are by on from have not but what all".split()


def spoken(r, n):
    return " ".join(x + str(r.randrange(30)) if r.random() < 0.5 else x for x in r.choices(WORDS, k=n))


def test_stages(spark, tmp_path):
    r = random.Random(12)
    item = spoken(r, 45)
    clean = {k: "\n".join(spoken(r, r.randint(20, 60)) for _ in range(3)) for k in range(60)}
    shared = spoken(r, 60)
    rows = dict(clean)
    rows |= {100: clean[1], 101: clean[1], 102: clean[2] + " more", 110: clean[3] + "\n" + shared, 111: clean[4] + "\n" + shared}
    rows |= {120: spoken(r, 30) + "\n" + item + "\n" + spoken(r, 30), 130: "qzx jvk wqp xzj kqv " * 40, 131: "", 132: None}
    table = [(k, t, None if k == 130 else "en", None if k == 130 else f"s{k % 4}", len(t or ""), "x") for k, t in rows.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, rid string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        columns = columns or docs.columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x for x in docs.collect()}
    assert set(clean) <= set(seen["language_id"]) and 130 not in seen["language_id"]
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["language_id"]) and all(lines[k].text == t for k, t in clean.items())
    assert lines[100].text == "" and shared in lines[110].text and shared not in lines[111].text and lines[111].n_chars == len(lines[111].text)
    groups = {}
    for k, x in lines.items():
        groups.setdefault(neardup.fingerprint((x.text or "").encode()), []).append(k)
    near = seen["near_dedup"]
    assert all(sum(k in near for k in ks) <= 1 for ks in groups.values()) and set(clean) <= set(near)
    left = seen["benchmark_decontamination"]
    assert 120 in near and 120 not in left and set(clean) <= set(left)
    assert set(seen["sequence_packing"]) == set(left)
