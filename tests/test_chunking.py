"""Splitters against their invariants and small cases worked out by hand."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.embedding import hashed
from tessera.operators import chunking as c

PARAGRAPHS = st.lists(st.text("ab。.\n 1", min_size=0, max_size=300), max_size=12).map("\n\n".join)


def _bare(s: str) -> str:
    return "".join(s.split())


def test_structure_keeps_sections_and_drops_short_ones():
    body = "正文" * 120
    text = f"1 范围\n{body}\n2 短\n3 要求\n{body}"
    assert [f["section"] for _, f in c.split_structure(text, keep_short=False)] == ["1 范围", "3 要求"]
    kept = c.split_structure(text, keep_short=True)
    assert "".join(_bare(t) for t, _ in kept) == _bare(text)
    assert c.split_structure("") == [] and c.split_structure(" \n ") == []


def test_long_sections_are_cut_in_strides_and_packs_overlap():
    one = c.split_long("x" * 4500, "s", 1, 2000, 100)
    assert [len(t) for t, _ in one] == [2000, 2000, 700] and [f["part"] for _, f in one] == [0, 1, 2]
    two = c.split_long("a" * 1500 + "\n\n" + "b" * 1500, "s", 1, 2000, 100)
    assert two[1][0] == "a" * 100 + "\n\n" + "b" * 1500


def test_heading_may_cross_a_line_end():
    assert [h.title for h in c.headings("1\n范围\n正文")] == ["1 范围"]


@given(PARAGRAPHS)
@settings(max_examples=60, deadline=None)
def test_paragraph_packs_hold_whole_paragraphs_in_order(text):
    packs = c.split_paragraphs(text, 400, 1, keep_short=False)
    assert _bare("".join(t for t, _ in packs)) == _bare(text)


@given(PARAGRAPHS)
@settings(max_examples=60, deadline=None)
def test_length_split_without_overlap_loses_nothing(text):
    assert _bare("".join(c.split_length(text, 100, 20, 0))) == _bare(text)


def test_parents_and_children():
    text = "第一章 总则\n" + "内容。" * 400 + "\n2 短节\n很短\n3 要求\n" + "要求。" * 100
    rows = c.split_children(text)
    assert [f["chunk_idx"] for _, f in rows] == list(range(len(rows)))
    first = [t for t, f in rows if f["parent_idx"] == 0]
    assert len(first) > 1 and first[1].startswith("标题：第一章 总则\n")
    assert rows[0][1]["split_method"] == "length" and rows[-1][1]["parent_title"].startswith("3 要求")
    assert c.split_children("短文")[0][1]["split_method"] == "none"


def test_blocks_tell_lists_and_code():
    assert [k for *_, k in c.blocks("- a\n- b\n\nimport os\n\nwords")] == ["list", "code", "paragraph"]


def test_meaning_cuts_where_neighbours_differ():
    near, far = "alpha beta gamma delta " * 12, "omega sigma kappa lambda " * 12
    text = "\n\n".join([near.strip()] * 4 + [far.strip()] * 4)
    m = c.Meaning(hashed, most=900, least=80, overlap=0)
    chunks = m(text)
    assert _bare("".join(t for t, _ in chunks)) == _bare(text)
    assert m("short")[0][1] == {"split_method": "semantic", "chunk_idx": 0}
    assert np.allclose(m.smooth(np.arange(10.0))[3:7], np.arange(3.0, 7.0))
    assert m.smooth(np.arange(6.0)).tolist() == list(range(6))


def test_overlap_starts_after_a_sentence():
    m = c.Meaning(hashed, overlap=10)
    out = m.overlapped([("first. tail", {}), ("second", {})])
    assert out[1] == ("tail second", {"has_overlap": True})


def test_token_chunks_hold_all_words():
    words = [f"w{i}" for i in range(1000)]
    text = ". ".join(" ".join(words[i : i + 20]) for i in range(0, 1000, 20)) + "."
    chunks = c.split_tokens(text, 100, 0)
    assert _bare("".join(t for t, _ in chunks)) == _bare(text)
    assert all(len(t.split()) <= 100 for t, _ in c.split_tokens(text, 100, 40))
    levels = c.split_levels(text, (400, 300), floor=10)
    assert levels[0][1]["parent_idx"] is None and levels[1][1]["parent_idx"] == 0


def test_links_and_sections(spark):
    docs = spark.createDataFrame([("d1", "x"), ("d2", None), ("d3", "")], "doc_id string, text string")
    numbers = ["1 a", "1.1 b", "text", "1.2 c", "2 d", "text"]
    made = c.chunk(docs, lambda t: [(n, {"parent_idx": i // 3}) for i, n in enumerate(numbers)], "-sem-")
    rows = c.link_sections(c.link(made)).orderBy("chunk_idx").collect()
    assert len(rows) == 6
    ids = [r.chunk_id for r in rows]
    assert [r.prev_id for r in rows] == ["", *ids[:-1]] and [r.next_id for r in rows] == [*ids[1:], ""]
    assert [r.is_first_in_parent for r in rows] == [True, False, False] * 2
    root = rows[0].doc_node_id
    assert [r.parent_id for r in rows] == [root, ids[0], ids[1], ids[0], root, ids[4]]


def test_byte_limit_splits_and_gives_new_ids(spark):
    made = spark.createDataFrame([("a", "k", "x" * 50), ("b", "l", "para one\n\n" * 30)], "doc_id string, chunk_id string, text string")
    rows = c.limit_bytes(made, 100, 60).collect()
    assert [r.text for r in rows if r.doc_id == "a"] == ["x" * 50]
    parts = [r for r in rows if r.doc_id == "b"]
    assert len(parts) > 1 and len({r.chunk_id for r in parts}) == len(parts) and "l" in {r.chunk_id for r in parts}
    assert all(len(r.text.encode()) <= 100 for r in rows)


def test_line_sections_and_marks():
    text = "1 范围\n1.1 一般\n附录 A 说明\n表 1 参数\n图 A.1\n正文"
    assert [k for *_, k in c.line_sections(text)] == ["chapter", "section", "appendix", "table", "figure"]
    marked = c.mark_sections(text)
    assert marked.count("<!-- SECTION:") == 5 and c.mark_sections("x") == "x"


def test_sections_of_random_levels_follow_the_stack(spark):
    rng = random.Random(3)
    numbers = [".".join("1" for _ in range(rng.randint(1, 5))) + " t" if rng.random() < 0.8 else "text" for _ in range(60)]
    docs = spark.createDataFrame([("d", "x")], "doc_id string, text string")
    rows = c.link_sections(c.chunk(docs, lambda t: [(n, {}) for n in numbers])).orderBy("chunk_idx").collect()
    stack: list[tuple[int, str]] = []
    for r, n in zip(rows, numbers, strict=True):
        if n == "text":
            want = stack[-1][1] if stack else r.doc_node_id
        else:
            level = len(n.split()[0].split("."))
            while stack and stack[-1][0] >= level:
                stack.pop()
            want = stack[-1][1] if stack else r.doc_node_id
            stack.append((level, r.chunk_id))
        assert r.parent_id == want


def _survives(text, chunks):
    """Whether the characters of a text but for white space are, in order, among those of its chunks."""
    it = iter("".join("".join(t.split()) for t, _ in chunks))
    return all(x in it for x in "".join(text.split()))


PIECES = ["1 范围", "1.1 要求", "# Title", "附录A", "第一章 总则", "- an item", "短句。", "A short line.", "x" * 90, "长" * 60 + "。", "Sentence one. Sentence two! " * 12, "def f():", "...", "|a|b|"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from(["\n", "\n\n", " "]))
def test_no_splitter_loses_text(pieces, gap):
    text = gap.join(pieces)
    meaning = c.Meaning(hashed, most=100, least=40, overlap=0)
    for name, split in {
        "structure": lambda t: c.split_structure(t, 300, 80, 0), "paragraphs": lambda t: c.split_paragraphs(t, 300, 80), "children": lambda t: c.split_children(t, most=200, least=60, overlap=0),
        "meaning": meaning, "fallback": meaning.fallback, "tokens": lambda t: c.split_tokens(t, 20, 0), "levels": lambda t: [x for x in c.split_levels(t, (40, 20), 10) if x[1]["parent_level"] == 0],
    }.items():
        assert _survives(text, split(text)), name
    assert _survives(text, c.split_children(text, c.Meaning(hashed, most=100, least=40, overlap=0), 200, 60, 0))


def test_a_held_rest_is_not_overwritten():
    text = "a" * 29 + "\n" + "b" * 90
    assert _survives(text, c.Meaning(hashed, most=100, least=40).assemble(text, [30]))
    assert len(c.Meaning(hashed, most=100, least=40, keep_short=False).assemble(text, [30])) == 1


def test_chunks_are_passed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(c, "PIECE_CHARS", 1000)
    docs = spark.createDataFrame([(i, "One two three. " * 20 if i % 7 else None) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = c.chunk(docs, c.split_tokens).orderBy("doc_id").collect()
    assert len(rows) == 51 and {r.text for r in rows} == {("One two three. " * 20).strip()}
    # what a task holds: seen where the pieces of one batch come in
    import pyarrow as pa

    seen: list = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(60)]), pa.array(["One two three. " * 20] * 60)], names=["doc_id", "text"])
            seen.extend(b.num_rows for b in run(iter([batch])))
            return docs.selectExpr("text", "doc_id", "0 AS chunk_idx")

    c.chunk(Docs(), c.split_tokens)
    assert sum(seen) == 60 and max(seen) <= 4
