"""Golden cases and properties of the text functions, without Spark."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from doctrail.textcore import bib, diff, draft, html_markdown, latex, prose, similarity
from doctrail.textcore import markdown as md

WORDS = st.lists(st.sampled_from("alpha beta gamma delta . , the".split()), max_size=30).map(" ".join)


def test_retention():
    cases = [("Le cours commence <date> à 8 heures", "Le cours commence lundi à 8 heures", 100.0), ("a b c d", "a b x d", 75.0), ("a b c", "c b a", 33.33), ("a", "", 0.0), ("", "x", 0.0), ("<x>", "y", 100.0)]
    assert [draft.retention(a, b) for a, b, _ in cases] == [c for *_, c in cases]


def test_tags():
    kinds = {t: [x[3] for x in draft.tags(t)] for t in ("<le mot juste>", "<montant à vérifier>", "<12 avril>", "<qui ?>", "<b>x</b>", "< >")}
    assert list(kinds.values()) == [["lexical"], ["factual"], ["factual"], ["factual"], [], []]


def test_change_kinds():
    assert [draft.classify(*x) for x in (("", "a"), ("désolé", ""), ("a", ""), ("mot", "mots"), ("a", "b"))] == ["added", "apology", "pruned", "spelling", "syntax"]
    assert draft.change_table("a b", "a b") == ""


def test_unit_types():
    units = {"```\nx\n```": "code_block", "| a | b |": "table", "$$x$$": "math", "![a](b.png)": "image", "> [!NOTE] t": "callout", "> t": "quote", "# t": "heading", "t": "paragraph"}
    assert {u: md.unit_type(u) for u in units} == units


def test_pairs():
    old = "one two three four five six seven eight"
    d = diff.diff_pair(old, old.replace("four", "FOUR"))
    assert (d.mode, d.added, d.deleted, round(d.change_rate, 4), d.word_rate) == ("word", 1, 1, 0.0667, 2 / 16)
    d = diff.diff_pair("a b c d", "w x y z")
    assert (d.mode, round(d.change_rate, 4)) == ("block", 0.5714)
    assert diff.diff_pair("![a](b.png)", "![a](c.png)")[:4] == ("image", [], 0, 0)
    assert diff.diff_pair("$$a$$", "$$b$$")[2:4] == (1, 1)


def test_alignment():
    old, new = ["Pp p p", "___MD_TABLE_BLOCK_1___", "Alpha beta gamma delta."], ["Pp p p", "___MD_TABLE_BLOCK_2___", "Zz! 9999"]
    assert diff.align(old, new) == [("pair", 0, 0), ("pair", 1, 1), ("delete", 2, None), ("insert", None, 2)]
    assert diff.align([], ["a"]) == [("insert", None, 0)] and diff.align(["a"], []) == [("delete", 0, None)] and diff.align([], []) == []


def test_deleted_section():
    found = diff.diff_document("# A\nx\n# B\none\ntwo\nthree", "# A\nx")
    assert (found.added, found.deleted, found.modified) == (0, 3, [])


def test_windows():
    sizes = [[len(s.split()) for s in w] for w in prose.windows([" ".join(["word"] * n) for n in (3, 80, 4, 1, 1, 1, 1, 90, 2)])]
    assert sizes == [[3, 80], [4, 1, 1], [1, 1], [90], [2]]


def test_sentences():
    assert prose.sentences("See Fig. 2 by A. Doe et al. Here. Next one! Yes?") == ["See Fig. 2 by A.", "Doe et al. Here.", "Next one!", "Yes?"]


def test_html():
    assert html_markdown.convert("<h2>T</h2><p>a <b>b</b></p>") == "## T\n\na **b**"
    assert html_markdown.convert("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| a | b\\|c |\n| :--- | :--- |\n| 1 | 2 |"
    assert html_markdown.convert("<nav>n</nav><script>s</script><style>t</style><footer>f</footer><p>x <XXX date></p>") == "f\n\nx <XXX date>"


def test_bib():
    entries = bib.parse("@article{d, author = {Doe, Jane}, year = {2020}}\n@book{e, author={M{\\\"u}ller, A and Roe, B and Poe, C}, title={T}}")
    assert [bib.citation(entries, "d"), bib.citation(entries, "d", True), bib.citation(entries, "e"), bib.citation(entries, "k"), bib.citation(entries, "k", True)] == ["[Doe, 2020]", "Doe [2020]", "[Müller et al., s.d.]", "[k]", "k"]


def test_latex():
    assert latex.convert("# A note\n$x$ [[l]]") == "# A note\n$x$ [[l]]"
    assert latex.convert("\\section{A \\textbf{b}} x\\footnote{n} 5\\% % gone") == "## A b\n\nx (n) 5%"
    assert latex.expand("\\f a", {"f": (0, "\\f x")}).startswith("\\f x")


@settings(max_examples=60, deadline=None)
@given(WORDS, WORDS)
def test_opcodes_rebuild_both(a, b):
    ops = diff.opcodes(diff.tokens(a), diff.tokens(b))
    assert ("".join(x.old for x in ops), "".join(x.new for x in ops)) == (a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(WORDS, max_size=6), st.lists(WORDS, max_size=6))
def test_alignment_is_monotone_and_whole(a, b):
    path = diff.align(a, b)
    assert [i for _, i, _ in path if i is not None] == list(range(len(a)))
    assert [j for _, _, j in path if j is not None] == list(range(len(b)))


@settings(max_examples=40, deadline=None)
@given(st.text("abc d", max_size=300), st.text("abc d", max_size=300))
def test_ratio_is_that_of_the_library(a, b):
    assert similarity.ratio(a, b) == SequenceMatcher(None, a, b, autojunk=False).ratio() or not (a or b)


@settings(max_examples=40, deadline=None)
@given(WORDS)
def test_retention_of_itself(a):
    assert draft.retention(a, a) == 100.0


def test_code_and_tables_are_marked_whole():
    assert diff.fence_parts("```py x\na < b\n```") == ("", "py x", "a < b")
    assert diff.fence_parts("> ~~~\n> a\n> ~~~") == ("> ", "", "a")
    assert diff.fence_parts("```\nopen\nb") == ("", "", "open\nb")
    assert diff.fence_parts("plain") == ("", "", "plain")
    shown = diff.mark_code("> ```py\n> a < b\n> ```", "del", True, "Ann")
    assert shown.startswith('> <pre title="Supprimé par Ann" style="background-color: #ffedd5;') and 'data-lang="py"' in shown and "a &lt; b</code></pre>" in shown
    rows = diff.mark_table("| a |  |\n|---|---|\n| b | c |", "ins").split("\n")
    assert rows[1] == "|---|---|" and rows[0].endswith("</span> |  |") and rows[2].count("<span") == 2
    assert md.strip_marks("\n".join(rows)) == "| a |  |\n|---|---|\n| b | c |"


def test_callouts_keep_their_head():
    old, new = "> [!NOTE] Title\n> one two three four five\n", "> [!NOTE] Title\n> one two three four six\n"
    text, added, deleted = diff.callout_pair(old, new)
    assert text.startswith("> [!NOTE] Title\n> one two three four ") and (added, deleted) == (1, 1)
    assert all(x.startswith(">") for x in text.splitlines())
    assert md.strip_marks(text) == new and diff.callout_pair(new, new) == (new, 0, 0)
    assert diff.callout_pair(old, new.replace("Title", "Other"))[0].startswith("> [!NOTE] <span")


def test_much_changed_paragraphs_become_two():
    old, new = diff.mark("all old words here", "del"), diff.mark("quite other things now", "ins")
    text = diff.whole_paragraphs(f"{old} {new}\n\nkept {diff.mark('a', 'del')}{diff.mark('b', 'ins')} " + "word " * 20 + f"\n\n# {old}")
    first, second, third, fourth = text.split("\n\n")
    assert (first, second, fourth) == (old, new, f"# {old}") and third.startswith("kept ")


def test_marks_leave_code_and_cells():
    a, b = diff.mark("x", "del"), diff.mark("y", "ins")
    assert md.strip_marks(diff.free_code_spans(f"see `f({a}{b})` end")) == "see `f(``y``)` end"
    assert diff.free_code_spans(f"```\n`{a}`\n```") == f"```\n`{a}`\n```"
    assert diff.free_pipes("| <span s>a | b</span> |\n| <span s>--- | ---</span> |") == "| <span s>a</span> | <span s>b</span> |\n| --- | --- |"
    assert diff.free_pipes("no | <span s>a | b</span>") == "no | <span s>a | b</span>"


def _unlike(n):
    """Two texts of n words that share their first sentence and many single words."""
    r = random.Random(n)
    return ("One first line of both.\n" + " ".join(r.choices(("the", "of", *(f"w{k}" for k in range(40))), k=n)) for _ in range(2))


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=250), st.text("ab c", max_size=250), st.integers(0, 5))
def test_blocks_are_those_of_the_library(a, b, k):
    a, b = a + b[:k] + a, b + a[k:] + b
    assert sorted(similarity.blocks(a, b)) == [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]
    assert [x[:5] for x in diff.opcodes(list(a), list(b))] == SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes() or a == b


def test_long_token_lists_do_not_reach_the_library(monkeypatch):
    a, b = map(diff.tokens, _unlike(900))
    cells = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda j, x, y, autojunk: cells.append(len(x) * len(y)) or SequenceMatcher(j, x, y, autojunk=autojunk))
    monkeypatch.setattr(diff, "SequenceMatcher", lambda j, x, y, autojunk: cells.append(len(x) * len(y)) or SequenceMatcher(j, x, y, autojunk=autojunk))
    found = diff.opcodes(a, b)
    assert max(cells) <= similarity.SMALL
    assert [x[:5] for x in found] == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_alignment_does_not_compare_words(monkeypatch):
    old, new = ("\n\n".join(_unlike(120)), "\n\n".join(_unlike(121)))
    expected = [x[3].alignment for x in diff.diff_document(old, new).rows]
    monkeypatch.setattr(diff, "diff_pair", None)
    assert list(diff.alignments(old, new)) == expected


def test_ratio_is_measured_as_far_as_needed(monkeypatch):
    old, new = _unlike(600)
    whole = similarity.ratio(old, new)
    assert similarity.reaches(old, new, whole) and not similarity.reaches(old, new, whole + 1e-9)
    monkeypatch.setattr(similarity, "matched", None)
    assert diff.align([old], [new]) == [("pair", 0, 0)]


def test_a_block_is_known_by_its_first_segments(monkeypatch):
    old, new = _unlike(600)
    found = diff.diff_document(old, new)
    monkeypatch.setattr(diff, "opcodes", None)
    fast = diff.diff_document(old, new, whole=False)
    assert (fast.added, fast.deleted, fast.modified) == (found.added, found.deleted, found.modified) and found.rows[0][3].units[0][2].mode == "block"


def test_sections_are_counted_without_opcodes(monkeypatch):
    old, new = ("# A\n" + x + "\n# B\nkept" for x in _unlike(600))
    expected = [(x[2], x[3].added, x[3].deleted) for x in diff.diff_document(old, new).rows]
    monkeypatch.setattr(diff, "opcodes", None)
    assert [(x[2], x[3].added, x[3].deleted) for x in diff.diff_document(old, new, whole=False).rows] == expected


def test_annotation_of_a_block_needs_no_opcodes(monkeypatch):
    old, new = _unlike(600)
    expected = diff.render_document(diff.diff_document(old, new), new)
    monkeypatch.setattr(diff, "opcodes", None)
    assert diff.render(old, new) == expected
    assert "#fee2e2" in diff.whole_paragraphs(expected[0])


def test_accepting_revisions_of_a_block_needs_no_opcodes(monkeypatch):
    old, new = _unlike(600)
    expected = md.accept_up_to(diff.render_document(diff.diff_document(old, new), new)[0], 2)
    monkeypatch.setattr(diff, "opcodes", None)
    assert md.accept_up_to(diff.render(old, new)[0], 2) == expected


def test_a_lone_block_is_known_without_its_similarity(monkeypatch):
    old, new = _unlike(600)
    pairs = [("# A\n" + x, "# A\n" + y) for x, y in ((old, new), (new, old), (old, old + new), (old, "other " + old), ("| a |\n|---|\n| b |", "| a |\n|---|\n| c |"), ("a `b|c` d", "e `f` g"), ("one", "two"), ("> q r", "> q s"))]
    expected = [md.accept_up_to(diff.render_document(diff.diff_document(*x), x[1])[0], 2) for x in pairs]
    assert [md.accept_up_to(diff.render(*x)[0], 2) for x in pairs] == expected
    monkeypatch.setattr(similarity, "blocks", None)
    assert md.accept_up_to(diff.render(*pairs[0])[0], 2) == expected[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", " ", "c d", "$x y$", "<!-- a b -->", "`a`", "\n", ">", "|"]), max_size=60), st.lists(st.sampled_from(["a", "b", "ab", " ", "c", "`a b`", "."]), max_size=60), st.integers(0, 60))
def test_blocks_told_early_are_blocks(a, b, k):
    old, new = "".join(a), "".join(a[:k] + b + a[k:])
    for x, y in ((old, new), (new, old), (old, "".join(b))):
        found, fast = diff.diff_pair(x, y), diff.diff_pair(x, y, whole=False)
        assert (fast.mode, fast.added, fast.deleted) == (found.mode, found.added, found.deleted) and fast.ops in (found.ops, [])
        sections = [diff.diff_section(x, y, whole=w) for w in (True, False)]
        assert len({(s.added, s.deleted) for s in sections}) == 1
        assert len({"\n\n".join(diff.render_unit(o, n, d, s.blocks) for o, n, d in s.units) for s in sections}) == 1
