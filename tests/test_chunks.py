"""Chunks of texts and their places, worked out by hand and by plain rules."""

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.operators import structure as S


def test_short_paragraphs_are_joined_and_a_full_chunk_leaves_nothing_over():
    assert list(S.paragraph_spans("aaa\n\n bbb \n\n\n", 20, 5)) == [(0, 10, "aaa\n\nbbb")]
    assert list(S.paragraph_spans("aaaaaaaa\n\nbbbbbbbb", 12, 4)) == [(0, 10, "aaaaaaaa"), (10, 20, "bbbbbbbb")]


def test_what_is_left_over_is_carried_past_a_long_paragraph():
    body = "a" * 10 + "\n\n" + "b" * 25 + "\n\nccc"
    want = [(0, 12, "a" * 10), (12, 24, "b" * 12), (20, 32, "b" * 12), (28, 37, "b" * 9), (36, 37, "b"), (8, 44, "aaaa\n\nccc")]
    assert list(S.paragraph_spans(body, 12, 4)) == want


def test_long_paragraphs_are_cut_at_the_strongest_separator():
    body = "x" * 90 + "。" + "y" * 60 + "。" + "z" * 20
    assert S.split_recursively(body, 100) == ["x" * 90 + "。", "y" * 60 + "。" + "z" * 20]
    assert S.split_recursively("one two three four", 9) == ["one two", "three", "four"]
    assert S.split_recursively("abcdefghij", 4, 1) == ["abcd", "defg", "ghij", "j"]
    assert [(a, b) for a, b, _ in S.paragraph_spans("abcdefghij", 4, 1, recursive=True)] == [(0, 4), (3, 7), (6, 10), (9, 10)]


@given(st.lists(st.text("ab .", min_size=1, max_size=30), max_size=8), st.integers(20, 60), st.integers(0, 15))
def test_spans_grow_and_hold_their_text(paragraphs, size, overlap):
    kept = [p.strip() for p in "\n\n".join(paragraphs).split("\n\n") if p.strip()]
    whole = "\n\n".join(kept)
    chunks = list(S.paragraph_spans("\n\n".join(paragraphs), size, overlap))
    assert all(len(t) <= size for _, _, t in chunks) and [a for a, _, _ in chunks] == sorted(a for a, _, _ in chunks) or any(len(p) > size for p in kept)
    if all(len(p) <= size for p in kept):
        assert all(whole[a : a + len(t)] == t for a, _, t in chunks) and "\n\n".join(t for _, _, t in chunks) == whole


def test_structure_comes_before_size(spark):
    body = "\n".join(["intro", "<!-- doc:loc type=pdf_page page=2 -->", "# Head", "", "text " * 30, "", "```", "code", "```", '<!-- doc:loc type=sheet sheet_index=3 sheet_name="a\\"b" -->', "| a | b |", "| 1 | 2 |", "<!-- note -->"])
    got = list(S.structured_chunks(body, 80, 10))
    assert [(k, p, t, n, l) for _, _, k, p, t, n, l, _ in got] == [
        ("paragraph", "", None, None, None), ("heading", "Head", "pdf_page", 2, None), ("paragraph", "Head", "pdf_page", 2, None), ("paragraph", "Head", "pdf_page", 2, None), ("paragraph", "Head", "pdf_page", 2, None),
        ("code", "Head", "pdf_page", 2, None), ("table", "", "sheet", 3, 'a"b'), ("paragraph", "", "sheet", 3, 'a"b'),
    ]
    assert all(body[a:b].strip() == t or k == "paragraph" for a, b, k, *_, t in got) and all(len(c[-1]) <= 80 for c in got)
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string")
    rows = S.markdown_chunks(df, 80, 10).collect()
    assert [(r.char_start, r.char_end, r.kind, r.path, r.loc_type, r["loc"], r.loc_label, r.text) for r in sorted(rows, key=lambda r: r.chunk_index)] == got


def test_texts_become_objects_a_few_bytes_at_a_time():
    """Long texts stand in slices of few bytes, each row once and in order; a row alone may be larger."""
    import pyarrow as pa

    from sparkloom.storage import TEXT_BATCH_BYTES, small_batches

    texts = [("x" * (1 << 20))] * 20 + ["y" * (TEXT_BATCH_BYTES + 1), "z"]
    cut = list(small_batches([pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(texts)], names=["id", "text"])]))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(22))
    assert all(b.num_rows == 1 or b.nbytes <= TEXT_BATCH_BYTES for b in cut) and len(cut) >= 7


def test_pages_become_chunks_in_one_python_step(spark):
    """Mark-up and chunks are one function over slices of Arrow data: no second worker, no whole batch as pandas objects."""
    from sparkloom.plans.registry import QUERIES

    for name in ("markdown_chunks", "html_to_markdown", "markdown_blocks", "paragraph_chunks"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan, plan
