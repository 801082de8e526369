"""Weights, limits and draws of mixtures."""

import math
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import mixing
import duckdb
import pandas as pd

from sparkloom.llm import columns, mixing
from sparkloom.llm.mixing import Target, mix, mixed_documents, mixture, _rows

SCHEMA = "doc_id long, text string, source string, epoch int, weight string"


def corpus(spark, sizes, words=10):
    rows = [(f"{s}{i}", "w " * words, s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, t, s, 1, "x") for k, (_, t, s) in enumerate(rows)], SCHEMA)


def plan_of(spark, sizes, target):
    return {r.source: r for r in mixture(_rows(corpus(spark, sizes)), target).collect()}


@pytest.mark.parametrize("entropy, repeats", [(0.9, 100.0), (1.0, 2.0), (0.2, 3.0), (1.0, 1.0)])
def test_exponent_meets_entropy_or_limit(spark, entropy, repeats):
    got = plan_of(spark, {"a": 300, "b": 60, "c": 20, "d": 5}, Target(entropy, repeats))
    w = [r.weight for r in got.values()]
    assert sum(w) == pytest.approx(1, abs=1e-7)
    h, times = -sum(x * math.log(x) for x in w) / math.log(4), max(r.goal / r.tokens for r in got.values())
    natural = [300 / 385, 60 / 385, 20 / 385, 5 / 385]
    assert times <= repeats * 1.001 + 1e-6
    if times < repeats * 0.999:  # the limit doesn't bind
        assert h == pytest.approx(max(entropy, -sum(x * math.log(x) for x in natural) / math.log(4)), abs=1e-4)


def test_draws_follow_the_plan_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    sizes = {"a": 400, "b": 100, "c": 50}
    docs, target = corpus(spark, sizes), Target(1.0, 3.0, block_tokens=1000)
    got, plan = mix(docs, target).collect(), plan_of(spark, sizes, target)
    times, tokens, blocks = Counter(r.doc_id for r in got), Counter(), defaultdict(Counter)
    for r in got:
        tokens[r.source] += r.n_tokens
        blocks[r.block][r.source] += r.n_tokens
    assert set(times) == set(range(550)) and max(times.values()) - min(times.values()) <= 3
    for s, p in plan.items():
        assert p.goal - 10 < tokens[s] <= p.goal
    for b in sorted(blocks)[:-2]:
        for s, p in plan.items():
            assert abs(blocks[b][s] - 1000 * p.weight) <= 10
    assert Counter(r.doc_id for r in mixed_documents(docs, target).collect()) == times


def test_budget_below_the_corpus(spark):
    docs = corpus(spark, {"a": 400, "b": 100})
    got = mix(docs, Target(0.5, 5.0, budget=1000)).collect()
    assert 970 <= sum(r.n_tokens for r in got) <= 1000 and all(r.epoch == 0 for r in got)


def test_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == 0 and mixed_documents(empty).columns == empty.columns
    rows = [(1, "a b", "s", 1, "")] * 3 + [(2, None, None, 1, ""), (None, "x " * 50_000, "", 1, ""), (3, " ", "blank", 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 3} and sum(r.doc_id == 3 for r in got) == 1
    assert Counter(r.doc_id for r in mixed_documents(df).collect()) == Counter(r.doc_id for r in got)


def test_a_third_of_all_rows_without_an_id_or_alike(spark, monkeypatch):
    """Hot rows are one row with a number in the sums; the result is that of the SQL over single rows."""
    rows = [(None, f"t{i} " * (1 + i % 5), "s1", "en") for i in range(200)] + [(7, "the same words", "s2", "en")] * 300 + [(i, f"w{i} " * (1 + i % 7), f"s{i % 3}", "en") for i in range(300)]
    monkeypatch.setattr(columns, "COPIES", 64)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang"]).astype({"doc_id": "Int64"})
    c = duckdb.connect()
    c.register("documents", frame)
    want = sorted(map(repr, c.execute(f"SELECT doc_id, source, n_tokens, weight, epoch, block, place FROM ({mixing.ORACLE})").fetchall()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    got = mix(docs, mixing.QUERY).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    drawn = mixed_documents(docs, mixing.QUERY)
    assert drawn.count() == len(want) and drawn.where("doc_id = 7 AND source = 's2'").count() == sum("'s2'" in w and w.startswith("(7,") for w in want)
