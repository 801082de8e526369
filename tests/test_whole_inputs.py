"""Queries over small tables whose rows must all count."""

import numpy as np
import pytest

from sparkloom.operators.structure import share_budget
from sparkloom.plans import graph_queries, relational_queries, retrieval_queries, structure_queries


@pytest.fixture
def saved(spark, tmp_path):
    def save(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


def nations(edges):
    """Tables with an order of a customer in ``src`` from a supplier in ``dst`` for each edge; no (order + line) is a multiple of 97."""
    nodes = sorted({x for e in edges for x in e})
    return {
        "lineitem": ([(97 * k + 1, 1, dst) for k, (_, dst) in enumerate(edges)], "l_orderkey long, l_linenumber int, l_suppkey long"),
        "orders": ([(97 * k + 1, src) for k, (src, _) in enumerate(edges)], "o_orderkey long, o_custkey long"),
        "customer": ([(x, x) for x in nodes], "c_custkey long, c_nationkey int"),
        "supplier": ([(x, x) for x in nodes], "s_suppkey long, s_nationkey int"),
    }


def test_links_of_all_rows_four_hops_and_wide_claims(spark, saved):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), *((0, x) for x in range(10, 20))]
    d = saved(**nations(edges))
    assert sorted((r.src, r.dst) for r in graph_queries.links(spark, d).collect()) == sorted(edges)
    assert {r.node: r.path for r in graph_queries.shortest_path_bfs(spark, d).collect()}[4] == "0>1>2>3>4"
    assert {r.node for r in graph_queries.claim_path_search(spark, d).collect() if r.hops == 1} == {1, *range(10, 20)}


def test_intervals_of_all_customers(spark, saved):
    d = saved(orders=([(k, 7, "1995-01-01") for k in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderdate string"))
    assert sorted((r.a, r.b) for r in relational_queries.interval_overlap(spark, d).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_budget_is_spent(spark, saved):
    assert share_budget(np.array([10, 1, 10, 2]), 15).tolist() == [6, 1, 6, 2]
    assert share_budget(np.array([10, 10, 10]), 11).tolist() == [4, 4, 3] and share_budget(np.array([3, 4]), 80).tolist() == [3, 4]
    d = saved(documents=([(1, "x" * 159_710), (2, "y" * 900)], "doc_id long, text string"))
    got = structure_queries.equal_share_budget(spark, d).collect()
    assert sum(r.share for r in got if r.doc_id == 1) == 80_000
    assert sorted(r.share for r in got if r.doc_id == 2) == [200, 800]


def test_every_chunk_has_an_embedding_input(spark, saved):
    d = saved(documents=([(1, "x" * 2000, "s", "en")], "doc_id long, text string, source string, lang string"), labels=([(1, 1)], "doc_id long, quality int"))
    got = structure_queries.embed_input_header(spark, d).collect()
    assert sorted(r.chunk_index for r in got) == [0, 1, 2] and len({r.input_sha for r in got}) == 2


def test_whole_texts_are_diversified(spark, monkeypatch):
    monkeypatch.setattr(retrieval_queries.R, "diversify", lambda hits, k: hits)
    hits = retrieval_queries.mmr_diversify(spark, "/root/testdata/sf0.001")
    assert hits.selectExpr("max(length(text)) AS n").first().n > 400
