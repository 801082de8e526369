"""Access, wiki upkeep, rule entities and bounded answers on small inline tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import governance as V


def test_readable_files(spark):
    of = spark.createDataFrame
    asked = of([(u, w) for u in (1, 2, 3, 4) for w in (10, 20)], "user_id long, workspace_id long")
    users = of([(1, True), (2, False), (3, None), (4, False)], "user_id long, is_admin boolean")
    places = of([(10, False), (20, True)], "workspace_id long, personal boolean")
    members = of([(2, 10), (2, 10), (3, 10)], "user_id long, workspace_id long")
    grants = of([(2, 7, 2), (2, 7, 1), (3, 7, 1), (4, 7, 3)], "user_id long, folder_id long, level int")
    files = of([(100, 10, 7, 9), (101, 10, None, 2), (102, 10, 8, 3), (103, 20, None, 3), (104, 20, 5, 3), (105, 10, None, None)], "file_id long, workspace_id long, folder_id long, user_id long")
    got = {(r.user_id, r.file_id) for r in V.readable_files(asked, users, places, members, grants, files).collect()}
    assert got == {(1, f) for f in range(100, 106)} | {(2, 100), (2, 101), (3, 103), (3, 104)}


def test_readable_files_makes_each_pair_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Blocks of two users, repeated rows of each table; what comes behind the last shuffle are files, not pairs."""
    monkeypatch.setattr(V, "USERS", 2, raising=False)
    of = spark.createDataFrame
    asked = of([(u, 10) for u in range(8)] * 2, "user_id long, workspace_id long")
    users = of([(u, u == 0) for u in range(8)] * 2, "user_id long, is_admin boolean")
    places = of([(10, False)] * 2, "workspace_id long, personal boolean")
    members = of([(u, 10) for u in range(8)] * 2, "user_id long, workspace_id long")
    grants = of([(u, 7, 2) for u in range(7)], "user_id long, folder_id long, level int")
    files = of([(f, 10, 7, 1) for f in range(100, 150)] * 2 + [(200, 10, None, 3)], "file_id long, workspace_id long, folder_id long, user_id long")
    found = V.readable_files(asked, users, places, members, grants, files)
    got = sorted((r.user_id, r.file_id) for r in found.collect())
    assert got == sorted([(u, f) for u in range(7) for f in range(100, 150)] + [(0, 200), (3, 200)])
    top = found._jdf.queryExecution().optimizedPlan().nodeName()
    assert top == "Union", top


def test_answers_are_cut_in_their_order(spark):
    stub = len(V.CUT)
    rows = [(1, "r" * 100, "e" * 100, None, ""), (2, "r" * 300, "e" * 300, "a" * 10, ""), (3, "r" * 300, "", "a" * 300, "x" * 300)]
    got = {r.key: (r.n_bytes, r.cut, r.whole) for r in V.bounded_answer(spark.createDataFrame(rows, "key long, retrieval string, evidence string, answer string, extraction string"), 400).collect()}
    assert got == {1: (200, "", True), 2: (310 + stub, "retrieval", False), 3: (300 + 3 * stub if 300 + 3 * stub <= 400 else 4 * stub, "retrieval,evidence,answer" if 300 + 3 * stub <= 400 else "retrieval,evidence,answer,extraction", False)}


def test_budgets(spark):
    rows = [(1, 1, 50, True, False), (1, 2, 60, True, False), (1, 3, 40, False, False), (1, 4, 50, True, False), (1, 5, 1, True, False), (2, 1, 1, True, True), (2, 2, 1, True, False)]
    got = V.within_budget(spark.createDataFrame(rows, "run_id long, call long, chars long, readable boolean, stopped boolean"), 2, 100).collect()
    assert sorted((r.run_id, r.call, r.reason) for r in got) == [(1, 1, ""), (1, 2, "chars"), (1, 3, "not_readable"), (1, 4, ""), (1, 5, "calls"), (2, 1, "stopped"), (2, 2, "stopped")]
    assert all(r.accepted == (r.reason == "") for r in got)


def test_rule_entities(spark):
    rows = [(1, "table", "| a 1 | b |  |\n|--|--|\n| x | y |", "Cap 2"), (2, "table", "no table\n|--|", None), (3, "paragraph", "| a |\n|--|", " "), (4, "TABLE", "| a | a |\n|:-|-:|", None), (5, "table", None, None)]
    got = V.rule_entities(spark.createDataFrame(rows, "chunk_id long, kind string, text string, caption string")).collect()
    assert {(r.chunk_id, r.entity, r.relation, r.entity_type) for r in got} == {(1, "a 1", "column_header", "metric"), (1, "b", "column_header", "concept"), (1, "Cap 2", "caption", "metric"), (4, "a", "column_header", "concept")}


def test_links_caches_and_entities(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "source long, target string")
    found = spark.createDataFrame([(1, "b"), (1, "d"), (3, "e")], "source long, target string")
    assert {tuple(r) for r in V.rebuilt_links(links, spark.createDataFrame([(1,), (4,)], "source long"), found).collect()} == {(1, "b"), (1, "d"), (2, "c")}
    cache = spark.createDataFrame([(1, "x"), (2, "y")], "key long, value string")
    batch = spark.createDataFrame([(2, "p", 1), (2, "q", 5), (3, "r", 0)], "key long, value string, position int")
    assert {tuple(r) for r in V.put_many(cache, batch).collect()} == {(1, "x"), (2, "q"), (3, "r")}
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    said = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "entity string, file_id long")
    assert {r.entity for r in V.unreferenced(names, said, spark.createDataFrame([(2,)], "file_id long")).collect()} == {"b", "c"}


@pytest.mark.parametrize("raw, want", [("Ｆｏｏ　Ｂａｒ！", "foo-bar"), ("ａ＿b", "a-b"), (None, None)])
def test_slugs_of_full_width_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.slug(F.col("t")).alias("x")).first().x == want
