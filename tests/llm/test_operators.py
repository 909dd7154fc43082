"""The training-data operators against brute force, on small tables with every odd row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctrail.llm import chat, common, decontaminate, html, language, licenses, linededup, lm, media, neardup, packing
from doctrail.llm.components import components
from doctrail.llm.queries import HOSTILE, tokenizer_path

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo", "xe") for b in ("ra", "ti", "no", "le", "mu", "da")]


def prose(r, n):
    return " ".join(r.choices(VOCABULARY, k=n))


def varied(r, text, n=1):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """(doc_id, text): nulls, empty and repeated rows, copies, near copies, shared lines, one long text."""
    r = random.Random(11)
    base = [prose(r, r.randint(1, 60)) for _ in range(60)]
    rows = [(k, "\n".join(r.choices(base, k=r.randint(1, 4)))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(6)] + [(200 + k, varied(r, prose(random.Random(7), 80))) for k in range(12)]
    rows += [(300, ""), (301, None), (302, " \n\t"), (None, "null id " + prose(r, 12)), (None, None), (303, prose(r, 20_000)), (304, "Ünïcode ßtraße ÉTÉ 日本語 " * 5)]
    return rows + [rows[0], (305, "<s>[INST] x [/INST]</s> ~1 ~~ \x01 end")]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h string, did string, score string, kept string, `row` string, lines string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "documents")
    rows = [(d, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), *["x"] * 7) for k, (d, t) in enumerate(corpus())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def texts(docs):
    return [(x.doc_id, x.text or "") for x in docs.collect()]


def test_rows_keep_their_numbers_however_a_scan_is_split(spark, tmp_path):
    """A stage's second scan may be split otherwise than its first, as when executors come and go; another join may precede it."""
    r = random.Random(12)
    rows = [(k, spoken(r, "en", 12) if k % 7 else "qzx jvk wqp xzj kqv " * 30, "en" if k % 7 else None, "s" if k % 7 else None) for k in range(900)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    seen = []
    try:
        for size in ("1k", "1m"):
            spark.conf.set(split, size)
            found = common.Rows(spark.read.parquet(path)).numbered("doc_id").collect()
            seen.append({x.rid: x.doc_id for x in found})
            assert len(seen[-1]) == 900
        numbers = common.Rows(spark.read.parquet(path))
        gone = common.checkpoint(numbers.numbered("doc_id").where("doc_id % 3 = 0").select("rid"))
        spark.conf.set(split, "1k")
        assert sorted(x.doc_id for x in numbers.without(gone).collect()) == [k for k in range(900) if k % 3]
    finally:
        spark.conf.set(split, before)
    assert seen[0] == seen[1]
    other = common.Rows(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string, source string").union(spark.read.parquet(path)))
    assert other.numbered("doc_id").select("rid").distinct().count() == 920
    assert sorted(x.doc_id for x in language.keep_identified(spark.read.parquet(path)).collect()) == [k for k in range(900) if k % 7]


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], ["text"])
    found = list(common.pieces([batch], 5000))
    assert sum(x.num_rows for x in found) == 50 and max(x.num_rows for x in found) <= 5


def test_line_dedup(docs, none):
    rows = texts(docs)
    low = -(1 << 63)
    lines = sorted((low if d is None else d, k, line, frozenset(w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w)) for d, t in set(rows) for k, line in enumerate(t.split("\n")))
    gone = {(d, k, line) for i, (d, k, line, s) in enumerate(lines) if s and any(o and len(s & o) >= 0.8 * len(s | o) - 1e-9 and (e, j) < (d, k) for e, j, _, o in lines[:i])}
    want = Counter((d, "\n".join(x for k, x in enumerate(t.split("\n")) if (low if d is None else d, k, x) not in gone)) for d, t in rows)
    found = linededup.dedup_lines(docs)
    assert found.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in found.collect()) == want and gone
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_of_a_large_group_of_near_copies(spark, tmp_path):
    """Lines about the threshold from each other: most are settled by the first ones, the rest by the join; any order of words gives the same rows."""
    r = random.Random(43)
    base = [f"w{k}" for k in range(70)]

    def edited():
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(len(words))] = f"n{r.randrange(300)}"
        return " ".join(words)

    rows = [(k, edited() + "\n" + prose(r, r.randint(0, 12))) for k in range(250)] + [(9, "a\tb\rc D e"), (3, "a b c d E\n" + edited())]
    lines = sorted((d, k, x, frozenset(re.split(r"[ \t\r]+", x.lower())) - {""}) for d, t in rows for k, x in enumerate(t.split("\n")))
    gone = {(d, k, x) for i, (d, k, x, s) in enumerate(lines) if s and any((e, j) < (d, k) and len(s & o) >= 0.8 * len(s | o) - 1e-9 for e, j, _, o in lines[:i])}
    want = Counter((d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k, x) not in gone)) for d, t in rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for heads in (linededup.HEADS, 0):
        kept, linededup.HEADS = linededup.HEADS, heads
        try:
            assert Counter((x.doc_id, x.text) for x in linededup.dedup_lines(docs).collect()) == want
        finally:
            linededup.HEADS = kept


def test_line_dedup_counts_words_by_blanks_alone_and_in_any_order(spark, tmp_path, monkeypatch):
    """The count of words is an order only: it does without other white space, leaves no setting behind, and any order gives the same rows."""
    r = random.Random(47)
    base = [f"W{k}" for k in range(30)]

    def edited():
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(30)] = f"n{r.randrange(90)}"
        return "".join(w + r.choice([" ", " ", " ", "\t", "\r"]) for w in words)

    rows = [(k, edited() + "\n" + prose(r, r.randint(0, 6))) for k in range(120)] + [(500, None), (501, ""), (502, "\n \t\n")]
    texts = [(d, (t or "").split("\n")) for d, t in rows]
    lines = [(d, k, frozenset(re.split(r"[ \t\r]+", x.lower())) - {""}) for d, t in texts for k, x in enumerate(t)]
    gone = {(d, k) for i, (d, k, s) in enumerate(lines) if s and any(o and len(s & o) >= 0.8 * len(s | o) - 1e-9 for _, _, o in lines[:i])}
    want = {d: "\n".join(x for k, x in enumerate(t) if (d, k) not in gone) for d, t in texts}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    room = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(room, None)
    assert {x.doc_id: x.text for x in linededup.dedup_lines(docs).collect()} == want and len(gone) > 20
    assert spark.conf.get(room, None) == before
    plan = linededup.rarity(docs.select("text"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "split(" in plan and "contains(" not in plan and "translate(" not in plan
    mixed = F.transform(F.sequence(F.lit(0), F.lit(linededup.CELLS - 1)), lambda k: F.shiftleft(k.cast("long") * 40503 % linededup.CELLS - linededup.CELLS // 2, 64 - linededup.CELL_BITS))
    monkeypatch.setattr(linededup, "_ranks", lambda texts: common.checkpoint(spark.range(1).select(mixed.alias("ranks"))).scalar())
    assert {x.doc_id: x.text for x in linededup.dedup_lines(docs).collect()} == want


def test_short_lines_are_compared_too(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(41)
    rows = [(k, "\n".join(prose(r, r.randint(0, 7)) for _ in range(4)) + "\nRead more\nka lo mi ne" + (" su" if k % 2 else "")) for k in range(60)]
    lines = sorted((d, k, frozenset(x.lower().split())) for d, t in rows for k, x in enumerate(t.split("\n")))
    gone = {(d, k) for i, (d, k, s) in enumerate(lines) if s and any(o and len(s & o) >= 0.8 * len(s | o) - 1e-9 for _, _, o in lines[:i])}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = corpus_pipeline.line_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert {x.doc_id: x.text for x in found.collect()} == want and len(gone) > 100


def test_near_duplicates(docs, none):
    rows = texts(docs)
    ids = {t: neardup.fingerprint(t.encode()) for _, t in rows}
    assert ids[""] == 0 and neardup.fingerprint(b" \n\t") == 0
    group = {f: f for f in ids.values()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 4:
                group[root(a)] = root(b)
    least = defaultdict(list)
    for d, t in rows:
        least[root(ids[t])].append(d)
    want = Counter((d, ids[t], min((x for x in least[root(ids[t])] if x is not None), default=None)) for d, t in rows)
    found = neardup.near_duplicates(docs).collect()
    assert Counter((x.doc_id, x.fp % (1 << 64), x.component_id) for x in found) == want
    assert sum(x.representative for x in found) == len(least)
    kept = neardup.keep_representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert neardup.near_duplicates(none).count() == 0


def test_documents_at_a_similarity_of_0_8_are_found(spark, docs, tmp_path):
    r = random.Random(31)
    rows = texts(docs)
    for k in range(40):
        base = prose(r, 300)
        rows += [(5000 + 10 * k + j, varied(r, base, r.randint(2, 8))) for j in range(3)]
    for j in range(60):
        rows.append((7000 + j, varied(r, prose(random.Random(77), 200), 3)))

    def shingled(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {t: shingled(t) for _, t in rows}
    group = {t: t for t in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    far = 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                far += (neardup.fingerprint(a.encode()) ^ neardup.fingerprint(b.encode())).bit_count() > 4
                group[root(a)] = root(b)
    least = {}
    for d, t in rows:
        least[root(t)] = min(least.get(root(t), (True, 0)), (d is None, d or 0))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = neardup.keep_dissimilar(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert far > 40 and Counter((x.doc_id is None, x.doc_id or 0) for x in kept) == Counter(least.values())
    assert neardup.keep_dissimilar(spark.read.parquet(str(tmp_path / "d")).where("1 = 0")).count() == 0


def test_near_copies_come_from_trees_first(spark, tmp_path, monkeypatch):
    r = random.Random(31)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(base), " ".join([*base[:200], "new", *base[201:]]), " ".join(f"x{r.randrange(5000)}" for _ in range(400)), "", None]
    sets = [neardup.shingles((x or "").encode()) for x in texts]
    fps = [neardup.simhash(x) for x in sets]
    assert fps[0].bit_count() == sum(2 * sum(int(h) >> k & 1 for h in sets[0]) > len(sets[0]) for k in range(64))
    assert (fps[0] ^ fps[1]).bit_count() <= 4 and fps[3] == 0
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(k, x) for k, x in enumerate([*signed[:3], signed[2]])], "c long, fp long")
    assert {frozenset(x) for x in neardup.tree_pairs(classes).collect()} == {frozenset((0, 1)), frozenset((2, 3))}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    asked, real = [], neardup.links
    monkeypatch.setattr(neardup, "links", lambda *x: asked.append(x) or real(*x))
    assert {x.doc_id for x in neardup.keep_dissimilar(spark.read.parquet(str(tmp_path / "d"))).collect()} == {0, 2, 3} and asked


def test_large_shards_are_cut(spark):
    r = random.Random(2)
    values = {((7 << 40) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for _ in range(120)}
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    whole, cut = (components(neardup.links(fps, 4, n)).count() for n in (4096, 8))
    assert whole == cut == len(values) - 1


def test_tree_finds_all_within_the_radius():
    r = random.Random(4)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = neardup.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 3)) == [k for k, v in enumerate(values) if (q ^ v).bit_count() <= 3]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want: dict[int, int] = {}
    for k in sorted(near):
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = k
                todo += near[x]
    got = {x.u: x.v for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}


def test_licences(docs, none):
    notice = "prefix words Released under the MIT-License, yes; apache LICENSE, version 2; CC BY-NC"
    bad = "Licensed undr the Apache Licence Version 2.0"
    extra = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(900, notice), (901, bad)], "doc_id long, text string"))
    found = {x.doc_id: x for x in licenses.scan(extra).collect() if x.doc_id is not None}
    x = found[900]
    assert (x.n_base, x.first_word, x.last_word, x.base_labels, x.score) == (3, 3, 12, "apache-2,cc-by-nc,mit", 1.0) and x.n_words == 15
    x = found[901]
    assert (x.n_base, x.first_word, x.base_labels, x.labels) == (0, None, "", "apache-2") and 0.9 < x.score < 1 and x.spans[0].errors == 2 and x.spans[0].word == 0
    assert (found[300].n_words, found[300].labels, found[300].score) == (0, "", 0.0) and licenses.scan(none).count() == 0
    for words, label in licenses.NOTICES.items():
        hits = licenses.Finder(licenses.NOTICES)(f" aa {words} bb ")
        assert any(licenses.NOTICES[list(licenses.NOTICES)[i]] == label and e == 0 for i, _, _, e in hits)


def test_each_notice_has_its_own_label(spark):
    cases = ["Licensed under CC BY-NC 4.0", "GNU General Public License, version 3", "This code is under the MIT Licence", "Apache Licence, version 2", "released under the BSD license", "GNU General Public License, version 4", "GNU Lesser General Public License version 3", "Mozilla Public License, version 2", "Apache License, version 22"]
    want = ["cc-by-nc", "gpl-3", "mit", "apache-2", "", "", "lgpl", "mpl-2", ""]
    found = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert [x.labels for x in sorted(found)] == want


def test_packing_is_whole(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path(), capacity=512).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for x in found:
        windows[x.sequence_id].append((x.offset, x.length))
        pieces[x.doc_id, x.doc_tokens].append((x.start, x.length, x.ids_crc32))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= 512
    used = sum(x.length for x in found)
    assert used / (len(windows) * 512) > 0.97
    for d, t in texts(docs):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        mine = sorted(set(pieces[d, len(ids)]))
        if d in (0, None):
            continue
        assert [x[0] for x in mine] == list(np.cumsum([0, *(x[1] for x in mine)]))[:-1]
        assert all(zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in mine) and sum(x[1] for x in mine) == len(ids)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_sum_of_squares_choice():
    r = random.Random(1)
    packer = packing.SumOfSquares(32)
    for _ in range(300):
        size = r.randint(1, 32)
        counts = packer.counts.copy()
        options = {}
        for h in range(33 - size):
            if h == 0 or counts[h]:
                after = counts.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 32
                options[h] = int((after[1:32] ** 2).sum())
        assert options[packer.level(size)] == min(options.values())
        packer.put("x", size)


def test_plain_chunks_equal_the_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    for text in ("don't It's HELLO!!world 12x <|endoftext|> İst ΣΑΣ ½x² naïve‘s a\u0085b ʼn x y ''re 've", "ÀÉÎ straße ñandú œuvre --- ... #tag @me 3.14"):
        assert np.frombuffer(mine(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, None, "a ~1 [b] <c>"), (None, 0, "user", "n"), (3, 1, "assistant", HOSTILE), (3, 0, "user", HOSTILE), (3, 0, "user", HOSTILE), (4, 0, "we[INST]ird", "</s>" * 3 + "\\")]
    rows += [(5, k, "assistant", "x" * 50_000 + "é日") for k in range(2)]
    frame = spark.createDataFrame([(*x, "z") for x in rows], "conv_id long, turn long, role string, text string, turns string")
    source = defaultdict(list)
    for c, t, r, x in rows:
        source[c].append((t, r or "", x or ""))
    made = {x.conv_id: x for x in chat.format_chats(frame).collect()}
    assert {c: [(t.role, t.text) for t in x.turns] for c, x in made.items()} == {c: [x[1:] for x in sorted(v)] for c, v in source.items()}
    assert made[3].escaped and made[4].escaped and made[2].escaped and not made[1].escaped
    told = {x.conv_id: x for x in chat.digests(chat.format_chats(frame)).collect()}
    assert told[5].loss_chars == 100_004 and told[5].loss_sha256 == hashlib.sha256((("x" * 50_000 + "é日") * 2).encode()).hexdigest()
    assert chat.format_chats(frame.where("1 = 0")).count() == 0


def test_html(spark):
    long = "word " * 60
    page = f"<html><body><header><p>Site</p></header><div id='cookie-notice'>c</div><div><h1>T &amp; U</h1><p>{long}</p><p>a\n b<br>c</p><p>{long}</p></div><aside>s</aside><div class='comments'><p>{long}</p></div><form>f</form></body></html>"
    assert html.main_text(page) == f"T & U\n\n{long.strip()}\n\na b c\n\n{long.strip()}"
    assert html.main_text("<nav>n</nav><article><p>Short.<p>Also<script>x('</p>')</script> here.</article><footer>f</footer>") == "Short.\n\nAlso here."
    assert html.main_text("") == "" and html.main_text("plain &lt;b&gt;") == "plain <b>"
    rows = [(1, "u", None), (2, None, "<p>x"), (None, "v", ""), (2, None, "<p>x")]
    found = html.extract(spark.createDataFrame([(*x, "e") for x in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(((x.page_id, x.text, x.n_chars) for x in found), key=repr) == sorted([(1, "", 0), (2, "x", 1), (None, "", 0), (2, "x", 1)], key=repr)
    assert html.regions([0, 200, 10, 0, 0, 0, 5, 0, 0, 0, 0, 300]) == [(1, 3), (11, 12)] or html.regions([0, 200, 10, 0, 0, 0]) == [(1, 3)]


def test_articles_that_are_cards_do_not_hide_the_text():
    text = "word " * 60
    for card in ("<article class='card'><p>Teaser.</p></article>", "<article><p>Other.</p></article>", f"<article class='comment'><p>{text}said</p></article>"):
        found = html.main_text(f"<body><div><p>{text}one</p><p>{text}two</p></div><p></p>{card}</body>")
        assert f"{text}one" in found and f"{text}two" in found and "Teaser" not in found and "said" not in found
    page = f"<p>{text}out</p><article><p>Short.</p><p>{text}</p><p>{text}</p><p>End.</p></article>"
    assert html.main_text(page) == f"Short.\n\n{text.strip()}\n\n{text.strip()}\n\nEnd."
    assert html.main_text("<article class='comment'><p>All there is.</p></article>") == "All there is."


LANGUAGES = {"en": "the of and to in is that with for was this are", "fr": "le la les des une est dans pour avec sur qui que", "de": "der die und das nicht ein ist mit auf für von dem"}


def spoken(r, name, n):
    return " ".join(r.choices(LANGUAGES[name].split(), k=n))


def test_language(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, spoken(r, name, r.randint(3, 40)), name, f"s-{name}") for k, name in enumerate(list(LANGUAGES) * 40)]
    rows += [(500, "qzx jvk wqp xzj kqv " * 30, None, None), (501, None, "en", None), (502, "", "fr", "s-fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = {x.doc_id for x in language.keep_identified(docs).collect()}
    assert set(range(120)) <= kept and 500 not in kept and 502 in kept
    pages = [(k, f"http://{n}.example.{n}/x", f"<html lang='{n}'><p>{spoken(r, n, 12)}</p></html>") for k, n in enumerate(list(LANGUAGES) * 10)]
    pages += [(100, "http://fr.example.fr/y", f"<html lang='en'><p>{spoken(r, 'fr', 30)}</p></html>"), (101, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    found = {x.page_id: x for x in language.identify_pages(spark.read.parquet(str(tmp_path / "p")), docs).collect()}
    assert len(found) == len(pages) and all(found[k].lang == n for k, n in enumerate(list(LANGUAGES) * 10))
    assert found[100].declared == "en" and found[100].lang == "fr"


def test_lm(docs, none):
    rows = texts(docs)
    tokens = lambda t: [*t.encode().lower().split(), lm.END]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    weight = lambda x: np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1)))
    want = Counter((d, held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(map(weight, tokens(t))), 6)) for d, t in rows)
    found = lm.score(docs).collect()
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in found) == want
    assert {x.train_tokens for x in found} == {total} and lm.score(none).count() == 0


@pytest.mark.parametrize("hot", [(lm.HOT_TOKENS, lm.HOT_ARCS), (9, 20), (0, 0)])
def test_every_repeated_bigram_is_an_arc(spark, docs, tmp_path, hot):
    r = random.Random(21)
    # Rare words that follow each other twice, among a word so frequent that no fixed share of all tokens reaches them.
    rows = texts(docs) + [(k, f"rare{k // 2} pair{k // 2} {prose(r, 9)}") for k in range(1000, 1100)] + [(2000 + k, "ka " * 40_000) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    tokens = lambda t: [*t.encode().lower().split(), lm.END]
    train = [tokens(t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    counts = Counter(x for t in train for x in t)
    pairs = Counter(p for t in train for p in zip([lm.END, *t], t, strict=False))
    states = sorted(counts.items())
    number = {x: k + 1 for k, (x, _) in enumerate(states)}
    arcs = {number[a] * (len(states) + 1) + number[b]: n for (a, b), n in pairs.items() if n > 1}
    model = lm.Automaton(states, arcs, sum(counts.values()), len(counts))

    def want(t):
        auto, base, _, rare = model.score(tokens(t))
        return round(auto + sum(rare.values()) * np.log10(0.5 / model.norm), 5)

    found = lm.score(spark.read.parquet(str(tmp_path / "d")), *hot).collect()
    assert Counter((x.doc_id, round(x.score, 5) + 0.0) for x in found) == Counter((d, want(t) + 0.0) for d, t in rows)


def test_automaton_is_a_distribution():
    states = [(b"a", 50), (b"b", 30), (lm.END, 20)]
    n = len(states) + 1
    model = lm.Automaton(states, {1 * n + 2: 20, 1 * n + 1: 10, 2 * n + 3: 15}, 100, 3)
    for history in ([b"a"], [b"b"], [lm.END], [b"zz"]):
        whole = 0.0
        for x in (b"a", b"b", lm.END):
            whole += 10 ** (model.score([*history, x])[0] - model.score(history)[0])
        unknown = 10 ** (model.score([*history, b"q"])[0] - model.score(history)[0]) * 0.5 / model.norm
        assert whole + unknown == pytest.approx(1.0)


def test_decontamination(spark, docs, none):
    r = random.Random(9)
    items = [(1, prose(r, 40)), (2, "Short item, of seven words only here"), (3, None), (4, ""), (None, prose(r, 30)), (5, prose(r, 25))]
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    edited = items[0][1].split(" ")
    edited[10], edited[25] = "other", "words"
    planted = [(700, prose(r, 50) + " " + items[0][1].upper() + ". " + prose(r, 9)), (701, prose(r, 30) + " " + " ".join(edited)), (702, "x " + items[1][1].lower() + " y"), (703, " ".join(items[0][1].split(" ")[:10])), (704, "Short item of seven other only here")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(x.doc_id, x.item_id): x.words for x in decontaminate.overlaps(frame, benchmark).collect()}
    assert {k: v for k, v in found.items() if k[0] and k[0] >= 700} == {(700, 1): 40, (701, 1): 40, (702, 2): 7}
    kept = {x.doc_id for x in decontaminate.remove_contaminated(frame, benchmark).collect()}
    assert {703, 704} <= kept and not {700, 701, 702} & kept
    assert decontaminate.overlaps(frame, benchmark.where("1 = 0")).count() == 0 and decontaminate.remove_contaminated(none, benchmark).count() == 0
    blocks = list(decontaminate.blocks(benchmark, 64))
    assert len(blocks) > 1 and sum(len(b.items) for b in blocks) == 4


def test_masks_hit_every_pattern():
    for n in range(10, 22):
        for wrong in combinations(range(n), n // 5):
            assert any(all(i + k not in wrong for k, x in enumerate(m) if x == "1") for m in decontaminate.MASKS for i in range(n - len(m) + 1)), (n, wrong)


def test_longest_stretch():
    r = random.Random(6)
    for _ in range(60):
        same = np.array([r.random() < 0.7 for _ in range(r.randint(1, 40))])
        want = max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i:j].mean() >= 0.8 - 1e-12), default=0)
        assert decontaminate.longest(same) == want


def test_media(docs, none):
    want = Counter()
    for d, t in texts(docs):
        raw = t.encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[d, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])] += 1
    found = media.round_trip(docs).collect()
    assert Counter((x.doc_id, x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) for x in found) == want
    same = defaultdict(set)
    for x in found:
        same[x.payload_sha256].add((x.media_bytes, x.media_sha256, x.feature))
    assert all(len(v) == 1 for v in same.values()) and media.round_trip(none).count() == 0


def test_media_values_against_a_plain_version(docs, spark):
    """The stored file written and read here by the wave module, and the feature by plain sums; a chunk lent to more places than one copy serves."""
    import io
    import wave

    kept, media.PLACES_SERVED = media.PLACES_SERVED, 3
    try:
        found = media.round_trip(docs).collect()
    finally:
        media.PLACES_SERVED = kept
    want = Counter()
    for d, t in texts(docs):
        raw = t.encode()
        data = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(1)
            f.setframerate(8000)
            f.writeframes(data)
        x = [b - 128 for b in data]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        told = f"mean={sum(x) / len(x):.4f};rms={(sum(b * b for b in x) / len(x)) ** 0.5:.4f};crossings={crossings}"
        want[d, len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest(), told] += 1
    assert Counter((x.doc_id, x.media_bytes, x.media_sha256, x.feature) for x in found) == want


def test_cuts_follow_content():
    r = random.Random(5)
    gear, data = media.gear_table(), bytes(r.randrange(97, 122) for _ in range(100_000))
    ends = media.cuts(data, gear)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))
    moved = media.cuts(b"some words in front" * 9 + data, gear)
    assert len({len(data) - x for x in ends} & {171 + len(data) - x for x in moved}) > len(ends) / 2
