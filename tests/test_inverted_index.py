"""The inverted index against scans of all texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.inverted_index import TextIndex, _packed_texts, _texts, packed, unpacked
from sparkloom.operators.retrieval import text_candidates

DOCS = "id bigint, terms array<string>"


def texts(rng, ids, words=300):
    word = lambda: f"w{int(rng.paretovariate(0.6)) % words}"
    return [(i, [word() for _ in range(rng.randrange(0, 40))]) for i in ids]


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def queries(spark, rng, n=40):
    made = [(q, list(dict.fromkeys(f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.randrange(1, 5))))) for q in range(n)]
    return spark.createDataFrame([*made, (100, []), (101, ["nowhere"]), (102, ["w1", "nowhere"])], "query_id bigint, terms array<string>")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [*texts(rng, range(1200)), (5000, ["w1"] * 900 + ["w2"] * 300), (5001, []), (5002, None)]


def test_equals_a_scan_and_reads_little(spark, corpus, tmp_path):
    docs, asked = spark.createDataFrame(corpus, DOCS).repartition(5), queries(spark, random.Random(6))
    index = TextIndex.build(docs, str(tmp_path / "index"), range_docs=16)
    for every in (False, True):
        for k in (3, 20):
            assert rows(index.search(asked, k, every)) == rows(text_candidates(docs, asked, k, every))
    total = index.postings().where("term <> ''").agg(F.sum("n")).first()[0]
    assert total == sum(len(set(t or [])) for _, t in corpus)
    one = index.blocks([(1, ["w7", "w30"])], 3, False).agg(F.sum("n")).first()[0]
    own = sum(len({"w7", "w30"} & set(t or [])) for _, t in corpus)
    assert one < own < total / 4  # pruned below the postings of its terms, and those are few
    hot = index.blocks([(1, ["w1"])], 1, False).agg(F.sum("n")).first()[0]
    assert hot <= 16  # only the range of the text that says it most


def test_blocks_of_a_hot_term_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["hot", f"t{i}"] if i % 3 == 0 else [f"t{i}"]) for i in range(3000)], DOCS)
    index = TextIndex.build(docs, str(tmp_path / "index"), range_docs=20)
    blocks = index.postings(["hot"])
    assert blocks.agg(F.sum("n")).first()[0] == 1000 and blocks.agg(F.max("n")).first()[0] <= 20


def test_refresh_by_file(spark, corpus, tmp_path):
    rng = random.Random(7)
    docs, asked = spark.createDataFrame(corpus, DOCS), queries(spark, rng)
    index = TextIndex.build(docs, str(tmp_path / "index"), range_docs=16)
    now = {i: t for i, t in corpus}
    for step in range(3):
        changed = texts(rng, [*rng.sample(range(1200), 40), *range(9000 + 10 * step, 9010 + 10 * step)], 60)
        if step == 1:
            changed.append((5000, ["w5"]))  # the text with most of w1 loses it
        removed = rng.sample([i for i in now if i not in dict(changed)], 15)
        index = index.refresh(spark.createDataFrame(changed, DOCS), spark.createDataFrame([(i,) for i in removed], "id bigint"))
        now = {i: t for i, t in {**now, **dict(changed)}.items() if i not in removed}
        whole = spark.createDataFrame(list(now.items()), DOCS)
        for every in (False, True):
            assert rows(index.search(asked, 5, every)) == rows(text_candidates(whole, asked, 5, every))
    merged = index.compact(str(tmp_path / "merged"))
    assert merged.segments == [0] and merged.postings().where("term <> ''").agg(F.sum("n")).first()[0] == sum(len(set(t or [])) for t in now.values())
    assert rows(merged.search(asked, 5)) == rows(index.search(asked, 5))


def test_a_segment_without_its_entry_is_not_seen(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus[:50], DOCS)
    index = TextIndex.build(docs, str(tmp_path / "index"))
    before = rows(index.search(queries(spark, random.Random(8)), 5))
    index.postings().drop("segment").write.partitionBy("folder").parquet(str(tmp_path / "index" / "postings" / "segment=1"))  # a writer that died
    assert rows(TextIndex(spark, index.path).search(queries(spark, random.Random(8)), 5)) == before


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    index = TextIndex.build(none, str(tmp_path / "index"))
    asked = queries(spark, random.Random(9))
    assert index.search(asked, 5).count() == 0 and index.search(asked.limit(0), 5).count() == 0
    index = index.refresh(spark.createDataFrame([(1, ["w1"])], DOCS))
    assert [r.id for r in index.search(spark.createDataFrame([(1, ["w1"])], "query_id bigint, terms array<string>"), 5).collect()] == [1]


def test_numbers_take_few_bytes_and_come_back():
    ids, tfs, sizes = np.array([5, 3, -7, 2**63 - 1, -(2**63), 0, 1, 2]), np.arange(8), np.array([2, 0, 3, 3])
    cells = _packed_texts(ids, tfs, sizes)
    got = _texts(cells, sizes)
    assert (got[0] == ids).all() and (got[1] == tfs).all() and len(cells[3].as_py()) == 6
    values, sizes = np.array([0, 127, 128, 2**62, 2**63 - 1, 300]), np.array([0, 3, 3, 0])
    assert (unpacked(packed(values, sizes)) == values).all() and unpacked(packed(values[:0], sizes[:1])).size == 0


@pytest.mark.parametrize("every", [False, True])
def test_a_block_is_dealt_once_for_all_queries(spark, corpus, tmp_path, monkeypatch, every):
    index = TextIndex.build(spark.createDataFrame(corpus, DOCS), str(tmp_path / "index"), range_docs=64)
    dealt, own = [], TextIndex._best
    monkeypatch.setattr(TextIndex, "_best", lambda self, rows, *more: dealt.append(rows) or own(self, rows, *more))
    asked = spark.createDataFrame([(q, ["w1", "w2"]) for q in range(30)], "query_id bigint, terms array<string>")
    assert index.search(asked, 4, every).count() == 120
    assert dealt[0].count() == dealt[0].select("segment", "range", "term").distinct().count() > 0
