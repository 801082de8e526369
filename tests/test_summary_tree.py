"""Clusters and trees against a plain loop; large files, stopped builds, limits."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from sparkloom.operators import summary_tree as S
from sparkloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
NODES = "file_id long, node_id long, embedding array<float>, text string"


def size_of(n, share, most):
    target = max(1, math.ceil(n * share - 1e-9))
    if most is not None and n > 2 * most:
        target = min(target, max(2 * most, most + 1))
    return max(2, min(8, math.ceil(n / target)))


def plain_clusters(vectors, size):
    """Lists of keys of ``vectors``."""
    keys = sorted(vectors)
    unit = {k: np.asarray(vectors[k], float) / max(1e-12, np.linalg.norm(vectors[k])) for k in keys}
    out = []
    while keys:
        seed, rest = keys[0], keys[1:]
        near = sorted(rest, key=lambda k: (-round(float(unit[k] @ unit[seed]), 9), k))[: size - 1] if len(rest) >= size - 1 else []
        out.append([seed, *near])
        keys = [k for k in rest if k not in near]
    return out


def plain_tree(file, nodes, share, levels=S.TREE_LEVELS, most=None):
    """{(file, level, node): (parent, text)} of ``nodes`` {id: (vector, text)}."""
    front, out, made, level = {k: (v, t, 0) for k, (v, t) in nodes.items()}, {}, 0, 1
    while len(front) > 1 and (most is None or made < most):
        if level > levels and len(front) <= S.ROOT_MEMBERS:
            clusters = [sorted(front)]
        else:
            clusters = plain_clusters({k: v for k, (v, _, _) in front.items()}, size_of(len(front), share, most))
        above = {}
        for n, members in enumerate(clusters):
            if most is not None and made >= most:
                out |= {(file, front[m][2], m): (None, front[m][1]) for m in members}
            elif len(members) == 1:
                above[members[0]] = front[members[0]]
            else:
                members, top = sorted(members), level * S.LEVEL_IDS + n
                out |= {(file, front[m][2], m): (top, front[m][1]) for m in members}
                said = [re.match(r"(?s)\s*(.*?[.!?。](?=\s|$)|.*)", front[m][1])[1] for m in members]
                above[top] = ([sum(x) / len(members) for x in zip(*(front[m][0] for m in members))], " ".join(said), level)
                made += 1
        front, level = above, level + 1
    return out | {(file, made_at, k): (None, t) for k, (_, t, made_at) in front.items()}


def tree(df):
    return {(r.file_id, r.level, r.node_id): (r.parent_id, r.text) for r in df.collect()}


def files(seed, sizes, same=0.0):
    rng = random.Random(seed)
    rows = []
    for f, n in enumerate(sizes):
        shared = [rng.gauss(0, 1) for _ in range(6)]
        rows += [(f, f * 100_000 + k, shared if rng.random() < same else [rng.gauss(0, 1) for _ in range(6)], f"Node {k} of {f}. More.") for k in range(n)]
    return rows


def by_file(rows):
    out = {}
    for f, k, v, t in rows:
        out.setdefault(f, {})[k] = (np.float32(v).astype(float).tolist(), t)
    return out


def test_queries(spark):
    rows = lambda sql: duckdb.sql(sql.replace("@", SF)).fetchall()
    texts = dict(rows("SELECT doc_id, text FROM '@/documents.parquet'"))
    vectors = dict(rows("SELECT vec_id, embedding FROM '@/embeddings.parquet'"))
    want_clusters, want_tree = {}, {}
    for file in {v // 50 for v in vectors}:
        own = {v: e for v, e in vectors.items() if v // 50 == file}
        want_clusters |= {v: (file, n) for n, members in enumerate(plain_clusters(own, size_of(len(own), 0.25, None))) for v in members}
        want_tree |= plain_tree(file, {v: (e, texts.get(v) or "") for v, e in own.items()}, 0.25)
    assert {r.node_id: (r.file_id, r.cluster) for r in QUERIES["raptor_cluster"](spark, SF).collect()} == want_clusters
    got = tree(QUERIES["summary_tree"](spark, SF))
    assert got == want_tree and sum(p is None for p, _ in got.values()) == len({f for f, _, _ in got})


@pytest.mark.parametrize("same", [0.0, 0.4])
def test_large_files_are_clustered_alike(spark, monkeypatch, same):
    """In rounds over all tasks what one task does, also where two nodes in five have one vector."""
    rows = files(1, [150, 9, 40, 1], same)
    df = spark.createDataFrame(rows, NODES).repartition(4)
    want = {(f, k): n for f, nodes in by_file(rows).items() for n, members in enumerate(plain_clusters({k: v for k, (v, _) in nodes.items()}, size_of(len(nodes), 0.25, None))) for k in members}
    for name, value in (("PART_NODES", 16), ("SEEDS", 20), ("NEIGHBOURS", 24)):
        monkeypatch.setattr(S, name, value)
    assert {(r.file_id, r.node_id): r.cluster for r in S.cluster_nodes(df, 0.25).collect()} == want


def test_ten_thousand_nodes_have_one_top(spark):
    rows = files(2, [10_000, 3])
    got = tree(S.summary_tree(spark.createDataFrame(rows, NODES).repartition(4), 0.125))
    tops = [(f, t) for (f, _, _), (p, t) in got.items() if p is None]
    assert sorted(f for f, _ in tops) == [0, 1] and {k for _, level, k in got if level == 0} == {k for _, k, _, _ in rows}
    parents = {p for p, _ in got.values() if p}
    assert parents == {k for _, level, k in got if level > 0 and k >= S.LEVEL_IDS} and len(parents) > 1400


def test_levels_root_and_limit(spark):
    rows = files(3, [40, 17, 2, 1])
    df = spark.createDataFrame(rows, NODES).repartition(3)
    for levels, most in ((1, None), (2, 5), (4, 3), (4, 1)):
        want = {}
        for f, nodes in by_file(rows).items():
            want |= plain_tree(f, nodes, 0.5, levels, most)
        got = tree(S.summary_tree(df, 0.5, levels, most))
        assert {k: p for k, (p, _) in got.items()} == {k: p for k, (p, _) in want.items()}
        assert got == want
        if most:
            assert all(len({p for (g, _, _), (p, _) in got.items() if g == f and p}) <= most for f in range(4))


def test_a_stopped_build_goes_on(spark, tmp_path, monkeypatch):
    rows = files(4, [60, 5])
    df = spark.createDataFrame(rows, NODES)
    whole = tree(S.summary_tree(df, 0.5))
    level, seen = S._level, []

    def stops(front, n, *more):
        seen.append(n)
        if n == 3 and seen.count(3) == 1:
            raise RuntimeError("stopped")
        return level(front, n, *more)

    monkeypatch.setattr(S, "_level", stops)
    with pytest.raises(RuntimeError):
        S.summary_tree(df, 0.5, folder=str(tmp_path))
    assert tree(S.summary_tree(df, 0.5, folder=str(tmp_path))) == whole
    assert seen[:4] == [1, 2, 3, 3]  # levels 1 and 2 were not built again
    other = spark.createDataFrame([(f, k, v, t + "!") for f, k, v, t in rows], NODES)
    assert {k: p for k, (p, _) in tree(S.summary_tree(other, 0.5, folder=str(tmp_path))).items()} == {k: p for k, (p, _) in whole.items()}
    assert seen.count(1) == 2  # other texts: a build of its own


def test_empty(spark):
    none = spark.createDataFrame([], NODES)
    assert S.summary_tree(none).count() == 0 and S.cluster_nodes(none).count() == 0
