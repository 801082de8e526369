"""Evidence and association operators on small inline tables, against plain Python."""

import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import association as A
from sparkloom.operators import evidence as E


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def plain(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()


@given(st.text("aé́ ﬁ\n　½b", max_size=30), st.integers(0, 29), st.integers(1, 12))
def test_citations_lead_back_to_their_place(source, at, size):
    excerpt = source[at : at + size]
    found = E.squeezed(source)
    ok, start, end, context = E.verify(source, excerpt)
    if found is None or not plain(excerpt):
        assert not ok
    else:
        assert found[0] == plain(source) and ok == (plain(excerpt) in found[0])
    if ok:
        assert plain(excerpt) in plain(source[start:end]) and source[start:end] in context
    assert E.verify(source, "absent!") == (False, None, None, None) and not E.verify(None, "a")[0] and not E.verify("a", None)[0]


def test_citation_of_composed_characters():
    assert E.verify("x  ﬁne   café y", "fine café")[:3] == (True, 3, 14)


def test_renamed_slug(spark):
    note = "[[wiki:Old Page]] [[a|wiki:old_page]] [[wiki:old page 2]] `[[wiki:old-page]]` [x](y)\n```\n[[wiki:old-page]]\n``` [[3]] [["
    want = "[[wiki:new]] [[a|wiki:new]] [[wiki:old page 2]] `[[wiki:old-page]]` [x](y)\n```\n[[wiki:old-page]]\n``` [[3]] [["
    assert one(spark, T.renamed_slug(F.col("t"), "old-page", "new"), t=note) == want
    assert one(spark, T.renamed_slug(F.col("t"), "old-page", "new"), t="") == "" and one(spark, T.renamed_slug(F.col("t"), "a", "b"), t=None) is None


@pytest.mark.parametrize("question, want", [
    ("What is between  Ann Lee and Bob were they?", ["Ann Lee", "Bob"]),
    ("Ann, Bob and Cid coworkers?", ["Ann", "Bob", "Cid"]),
    ("张三和李四是不是同事？", ["张三", "李四"]),
    ("Between Tom and Isabel Island?", ["Tom", "Isabel"]),
    ("Ann and Bob worked together in 1999", ["Ann", "Bob"]),
    ("张三、李四与王五有什么关系", ["张三", "李四", "王五"]),
    ("张三和李四在2019年合作过吗", ["张三", "李四"]),
    ("Alice和张三什么关系", ["Alice", "张三"]),
    ("张三是谁？", ["张三是谁"]), ("什么关系", []),
    ("x " * 40 + "and Bob were here", [("x " * 40).strip(), "Bob"]),
    ("a, b, c, d, e, f, g, h, i related", []),
    ("a, b, c, d, e, f, g, h, i and j related", ["a , b , c , d , e , f , g , h , i", "j"]),
    ("Ann", []), ("", []), (None, []),
])
def test_anchors(spark, question, want):
    assert one(spark, A.anchors(F.col("q")), q=question) == want


def test_constraints(spark):
    c = lambda q: tuple(one(spark, A.constraints(F.col("q")), q=q))
    assert c("who worked  on it in 1999, 2003 or 12005?") == (1999, 2003, False, True)
    assert c("when was it?") == (None, None, True, False) and c(None) == (None, None, False, False)


def test_path_levels(spark):
    rows = [
        (1, 10, 20, "owns", 2000, 2001, None), (2, 10, 20, "not_owns", 2001, 2001, None), (3, 11, 21, "located_in", None, None, None), (4, 11, 22, "located_in", 1990, 1990, None),
        (5, 12, 23, "owns", 2000, 2000, "on"), (6, 12, 23, "owns", 1980, 1981, "off"), (7, 13, 24, "related_to", 2000, 2000, None), (8, 14, 99, "owns", 2000, 2000, None), (9, 15, 16, "owns", 1970, 1970, None), (10, 16, 17, "owns", 2000, 2000, None),
    ]
    claims = spark.createDataFrame(rows, "claim_id long, source long, target long, predicate string, first int, last int, status string")
    got = {(r.claim_id, r.other_id): r.reason for r in A.conflicts(claims).collect()}
    assert got == {(1, 2): "contradictory_predicate", (2, 1): "contradictory_predicate", (3, 4): "object_value_conflict", (4, 3): "object_value_conflict"}
    paths = spark.createDataFrame([(100, 1), (101, 5), (102, 7), (103, 8), (104, 9), (105, 9), (105, 10), (106, 10)], "path_id long, claim_id long")
    lost = spark.createDataFrame([(99,)], "node long")
    levels = {r.path_id: r.level for r in A.path_levels(paths, claims, lost, 2000, 2000).collect()}
    assert levels == {100: "conflicted", 101: "direct", 102: "adjacent_only", 103: "adjacent_only", 104: "insufficient", 105: "composed", 106: "direct"}
    assert A.path_levels(paths.limit(0), claims, lost, 1, 2).count() == 0


def test_pages_of_a_reconciliation_cover_everything(spark):
    items = spark.createDataFrame([(1, i) for i in range(1, 8)] + [(2, 5)], "workspace long, id long")
    state, seen = spark.createDataFrame([], "workspace long, cursor long, round int, complete boolean"), []
    for _ in range(4):
        page, after = E.reconcile_page(state, items, 3)
        seen.append(sorted((r.workspace, r.id) for r in page.collect()))
        state = spark.createDataFrame(after.collect(), "workspace long, cursor long, round int, complete boolean")
    assert seen == [[(1, 1), (1, 2), (1, 3), (2, 5)], [(1, 4), (1, 5), (1, 6), (2, 5)], [(1, 7), (2, 5)], [(1, 1), (1, 2), (1, 3), (2, 5)]]
    assert {(r.workspace, r["round"]) for r in state.collect()} == {(1, 1), (2, 3)}


def test_windows_hold_terms_first(spark):
    text = "x " * 900 + "needle " + "y " * 900
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = E.sampled_windows(df, ["needle", "a"], 20).collect()
    assert {r.doc_id for r in got} == {1} and len(got) <= 20 and all(0 <= r.start < r.end <= len(text) and r.end - r.start <= 800 for r in got)
    best = min(got, key=lambda r: r["rank"])
    assert "needle" in text[best.start : best.end]
    assert [tuple(r) for r in got] == [tuple(r) for r in E.sampled_windows(df, ["needle", "a"], 20).collect()]


def test_trace_keeps_one_id_at_least(spark):
    ids = spark.createDataFrame([(list(range(1000, 1300)),), ([],)], "ids array<long>").select(E.bounded_ids(F.col("ids"), 100, 61).alias("a"), E.bounded_ids(F.col("ids"), 100, 1).alias("b")).collect()
    assert ids[0].a == list(range(1000, 1012)) and ids[0].b == [1000] and ids[1].a == []


def test_sampled_windows_cut_a_text_once_a_term(spark):
    """The plan splits and lowers a text once for each use, not inside the loop over places."""
    docs = spark.createDataFrame([(1, "The and the " * 50 + "x" * 400)], "doc_id long, text string")
    found = E.sampled_windows(docs, ["the", "und"], 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2, plan.count("split(")
    assert found.count() == 3
