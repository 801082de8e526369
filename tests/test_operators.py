"""Operators on small inline tables, against plain Python."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions import vectors as V
from sparkloom.operators import graph as G
from sparkloom.operators import relational as R
from sparkloom.operators import retrieval as Q
from sparkloom.operators import structure as S
from sparkloom.operators.summary_tree import greedy_clusters
from sparkloom.plans.relational_queries import search_box
from sparkloom.plans.search import SearchOptions, search


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("Foo Bar", "foo-bar"), ("a__b", "a-b"), (" --X!-- ", "x"), ("ñ É", "ñ-é"), ("a" * 200, "a" * 128), ("", "")])
def test_slug(spark, raw, want):
    assert one(spark, T.slug(F.col("t")), t=raw) == want
    assert one(spark, T.slug(F.col("t")), t=want) == want


def test_text_functions(spark):
    assert one(spark, T.query_terms(F.col("t")), t="The the 知识库 x it's Alpha_1 beta gamma delta eps zeta") == ["the", "知识库", "it", "alpha_1", "beta", "gamma"]
    assert one(spark, T.key_values(F.col("t")), t="a=1 junk b=x=y a=1") == {"a": "1", "b": "x=y"}
    assert one(spark, T.file_bucket(F.col("t")), t="A.b.PDF") == "document"
    assert one(spark, T.modality(F.col("t")), t="show the Chart of x") == "figure"
    assert one(spark, T.strip_nul(F.col("t")), t="a\x00b") == "ab"
    assert one(spark, T.year_interval(F.col("t")), t="from 1999 to 2003, not 12345").asDict() == {"first": 1999, "last": 2003}
    links = "[[2]] `[[3]]` [[file:4]]\n```\n[[5]]\n```\n[[wiki:Foo Bar]] [[name|wiki:Bar Baz]] [[label|6]] [[nothing]] [a](x/b.md#c)"
    assert one(spark, T.wiki_links(F.col("t")), t=links) == ["file:2", "file:4", "wiki:foo-bar", "wiki:bar-baz", "file:6"]
    assert one(spark, T.markdown_links(F.col("t")), t=links) == ["x/b.md"]
    assert one(spark, V.similarity(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, V.norm(V.normalise(F.col("a"))), a=[3.0, 4.0]) == pytest.approx(1)


@given(st.lists(st.text("ab .\n", max_size=60), max_size=8), st.integers(20, 60), st.integers(0, 15))
def test_paragraph_packing(paragraphs, size, overlap):
    body = "\n\n".join(paragraphs)
    chunks = list(S.pack_paragraphs(body, size, overlap))
    assert all(0 < len(c) <= size for c in chunks)
    if not overlap and all(len(p.strip()) <= size for p in body.split("\n\n")):
        assert "".join("".join(chunks).split()) == "".join(body.split())


@given(st.text("ab。 \n", max_size=400), st.integers(5, 60))
def test_recursive_split_keeps_letters(body, size):
    pieces = S.split_recursively(body, size)
    assert all(0 < len(p) <= size + 1 for p in pieces)
    assert [c for c in "".join(pieces) if c in "ab"] == [c for c in body if c in "ab"]


def test_markdown_blocks():
    body = "# A\n\ntext one\nmore\n\n## B\n```py\n# not a heading\n\nx\n```\n| a | b |\n|---|---|\n\n# foo();\n# C\nend"
    got = [(k, p, body[a:b]) for k, p, a, b, _ in S.markdown_blocks(body)]
    assert [(k, p) for k, p, _ in got] == [("heading", "A"), ("paragraph", "A"), ("heading", "A > B"), ("code", "A > B"), ("table", "A > B"), ("paragraph", "A > B"), ("heading", "C"), ("paragraph", "C")]
    assert got[1][2] == "text one\nmore" and got[3][2].startswith("```py") and got[3][2].endswith("```") and got[7][2] == "end"


def test_html_to_markdown():
    page = "<html><head><title>x</title></head><body><h2>T &amp; U</h2><p>a  b</p><ul><li>one</li><li>two</li></ul><script>s()</script><div>c</div></body></html>"
    assert S.html_to_markdown(page) == "## T & U\n\na b\n\n- one\n- two\n\nc"
    assert S.html_to_markdown(None) == ""


def test_clusters_equal_plain_greedy():
    rng = np.random.default_rng(1)
    for v in (rng.normal(size=(24, 5)), np.ones((16, 4))):
        free, want = list(range(len(v))), []
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        while free:
            seed = free[0]
            near = sorted(free[1:], key=lambda i: (-round(float(unit[i] @ unit[seed]), 9), i))[:3]
            want.append([seed, *near])
            free = [i for i in free if i not in want[-1]]
        assert greedy_clusters(v, 4) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), min_size=1, max_size=12))
def test_interval_merge(spark, spans):
    got = sorted((r.start, r.end) for r in S.merge_intervals(spark.createDataFrame([(1, a, a + n) for a, n in spans], "doc_id int, start int, end int")).collect())
    want = []
    for a, b in sorted((a, a + n) for a, n in spans):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    assert got == want


def test_front_matter_and_layout(spark):
    meta, body = S.front_matter(F.col("t"))
    assert one(spark, F.struct(meta, body), t="---\ntitle: a: b\ntags: x\n---\nbody\n") == ({"title": "a: b", "tags": "x"}, "body\n")
    assert one(spark, F.struct(meta, body), t="no front") == ({}, "no front")
    blocks = spark.createDataFrame([([("text", 1, "hi", None), ("image", 1, "i.png", "cap"), ("equation", 2, "x=1", None)],)], "b array<struct<kind:string,page:int,text:string,caption:string>>")
    assert blocks.select(S.layout_markdown(F.col("b")).alias("x")).first().x == "<!-- page 1 -->\n\nhi\n\n![cap](i.png)\n\n<!-- page 2 -->\n\n$$\nx=1\n$$"


def test_mmr_prefers_another_file(spark):
    rows = [(1, 10, "f1", 0, "alpha beta", 0.9), (1, 11, "f1", 1, "alpha beta gamma", 0.88), (1, 20, "f2", 0, "totally different topic", 0.7)]
    hits = spark.createDataFrame(rows, "query_id long, id long, file_id string, chunk_index int, text string, score double")
    assert [r.id for r in Q.diversify(hits, 2).orderBy("pick").collect()] == [10, 20]


def test_fusion_dedupe_and_rerank(spark):
    a = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2)], Q.HITS)
    b = spark.createDataFrame([(1, 6, 3.0, 1)], Q.HITS)
    assert {r.id: round(r.rrf, 9) for r in Q.fuse([a, b]).collect()} == {5: round(1 / 61, 9), 6: round(1 / 62 + 1 / 61, 9)}
    dup = spark.createDataFrame([(1, 5, 0.1), (1, 5, 0.3), (1, None, 0.2), (1, None, 0.2)], "query_id long, id long, score double")
    assert sorted((r.id or 0, r.score) for r in Q.first_hit(dup).collect()) == [(0, 0.2), (0, 0.2), (5, 0.3)]
    assert Q.rerank(a) is a
    assert [r.id for r in Q.rerank(a, lambda p: -p["score"]).orderBy(F.desc("score")).collect()] == [6, 5]


def test_search_respects_readers_and_ranges(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "id long, terms array<string>")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, ["a", "b"], [1.0, 0.0]), (8, [], None)], "query_id long, terms array<string>, embedding array<double>")
    assert [(r.query_id, r.id) for r in search(docs, vecs, queries).orderBy("query_id", "rank").collect()] == [(7, 1), (7, 2)]
    mine = spark.createDataFrame([(2,), (3,)], "id long")
    assert [r.id for r in search(docs, vecs, queries, SearchOptions(top_k=1), mine).collect()] == [2]
    with pytest.raises(ValueError):
        SearchOptions(top_k=51)


def test_graph_cases(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: (r.hops, r.path) for r in G.shortest_paths(e, start, 4).collect()} == {1: (0, [1]), 2: (1, [1, 2]), 3: (1, [1, 3]), 4: (2, [1, 3, 4])}
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y")], "node string, parent string, name string")
    assert {r.node: r.label for r in G.tree_paths(nodes).collect()} == {"a": "A", "b": "A/B"}


def test_relational_cases(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"], "n").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert {r.k: r.state for r in R.sync(old, new, "k", "v").collect()} == {1: "deleted", 2: "updated", 3: "inserted"}
    names = spark.createDataFrame([(1, "100%"), (10, "100x"), (100, "z")], "i long, name string")
    ids = lambda q: sorted(r.i for r in search_box(names, q, "i", "name").collect())
    assert ids("100%") == [1] and ids("100") == [1, 10, 100] and ids("id: 10") == [10] and ids("") == [1, 10, 100]


def test_scores_of_a_full_block_are_small_matrices():
    """A full block of queries: matrices of 2 MB, and no more candidates held than a few of them make."""
    import numpy as np

    from sparkloom.operators.topk import BLOCK, Running, rows_at_once

    rng, running, n = np.random.default_rng(3), Running(BLOCK, 10), rows_at_once(BLOCK)
    assert BLOCK * n * 8 <= 2 << 20 and rows_at_once(10**9) == 1 and rows_at_once(0) >= 1
    whole, most = np.round(rng.random((BLOCK, 8 * n)), 6), 0
    for at in range(0, 8 * n, n):
        running.add(whole[:, at : at + n], np.arange(at, at + n))
        most = max(most, sum(len(p[0]) for p in running.parts))
    assert most <= 4 * BLOCK * n
    q, score, ids = running.best()
    order = np.argsort(-whole, axis=1, kind="stable")[:, :10]
    assert (ids.reshape(BLOCK, 10) == order).all() and (score.reshape(BLOCK, 10) == np.take_along_axis(whole, order, 1)).all()
