"""Literal excerpts, matrices of co-occurrence and the clearing of intermediate tables."""

import random
from collections import Counter
from pathlib import Path

from sparkloom import storage
from sparkloom.operators.excerpts import literal_excerpts
from sparkloom.operators.graph import co_occurrence, matrix


def test_excerpts_equal_a_plain_search_in_one_block_and_in_many(spark):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    items = [(i, say(rng.randrange(0, 5))) for i in range(30)] + [(99, None), (98, "aa"), (97, "aa")]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(40)] + [(900, None), (901, ""), (902, "aaa"), (902, "aaa")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, excerpt string")
    want = Counter((i, k, x) for i, t in docs for k, x in items if t and x and x in t)
    for size in (1 << 20, 300):
        assert Counter(map(tuple, literal_excerpts(d, b, size).collect())) == want
    assert literal_excerpts(d, b.limit(0)).count() == 0 and literal_excerpts(d.limit(0), b).count() == 0


def test_matrix_agrees_with_pairs(spark):
    rng = random.Random(3)
    rows = {(rng.randrange(30), rng.randrange(6)) for _ in range(90)}
    m = spark.createDataFrame(list(rows), "file long, tag long")
    pairs = {(r.a, r.b): r.n for r in co_occurrence(m, "tag", "file").collect()}
    whole = pairs | {(b, a): n for (a, b), n in pairs.items()} | {(t, t): sum(x == t for _, x in rows) for _, t in rows}
    assert {(r.a, r.b): r.n for r in matrix(m, "tag", "file").collect()} == whole


def test_intermediate_tables_lie_in_one_folder_that_is_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}")
    df = storage.staged(spark.range(5), "five")
    assert df.count() == 5 and list(Path(tmp_path, "staged", spark.sparkContext.applicationId).glob("five-*"))
    storage.clear(spark)
    assert not list(Path(tmp_path, "staged").iterdir())
