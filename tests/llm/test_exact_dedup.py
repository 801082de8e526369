"""Exact duplicates against brute force, with collisions forced by a short hash."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup
from sparkloom.llm.exact_dedup import equal_texts, exact_duplicates, folded, without_duplicates

UP = {i: i + 32 for i in range(65, 91)}
LONG = "Long Text " * 30_000
TEXTS = [(5, "a B"), (3, "A b"), (9, "a b"), (4, "a  b"), (2, None), (7, ""), (1, "É"), (8, "é"), (6, LONG), (12, LONG.upper()), (10, LONG + "x"), (11, "İ"), (13, "i̇")] + [(100 + i, "Hot") for i in range(60)]


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UP)].append(i)
    pick = max if largest else min
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = pick(named) if named else None
        sha = hashlib.sha256(t.encode()).hexdigest()
        stay = ids.index(keep)
        out += [(i, keep, len(ids), k == stay, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("largest", [False, True])
def test_equals_brute_force(spark, largest):
    rows = TEXTS + [(None, "a b"), (None, "none"), (None, "none"), (9, "a b"), (9, "A B"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(exact_duplicates(df, largest=largest)) == brute(rows, largest)


@pytest.mark.parametrize("keys", [0, 1 << 20])
def test_bytes_tell_collisions_apart(spark, monkeypatch, keys):
    """With a hash of three values nearly all texts collide; whether texts are picked by a broadcast changes nothing."""
    monkeypatch.setattr(exact_dedup, "SEMI_KEYS", keys)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    short = lambda t: F.pmod(F.xxhash64(t), F.lit(3))
    assert found(exact_duplicates(df, largest=True, content_hash=short)) == brute(TEXTS, True)


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(15_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(exact_duplicates(df)) == brute(rows, False)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, id long, hash string, row string, body string, size int, kept int, digest string, carried int, _id int"
    assert exact_duplicates(spark.createDataFrame([], schema)).count() == 0
    row = (1, "x", 2, "h", "r", "b", 3, 4, "d", 5, 6)
    df = spark.createDataFrame([row, row, (2, "X", *row[2:]), (3, "y", *row[2:])], schema)
    assert found(exact_duplicates(df)) == brute([(1, "x"), (1, "x"), (2, "X"), (3, "y")], False)
    assert sorted(map(tuple, without_duplicates(df).collect())) == [row, (3, "y", *row[2:])]
    assert without_duplicates(df).schema == df.schema


def test_without_duplicates_keeps_one_row_of_each_text(spark):
    rows = TEXTS + [(None, "a b"), (None, "none"), (None, "none"), (9, "A B"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for largest in (False, True):
        kept = without_duplicates(df, largest=largest).collect()
        texts = [(r.text or "").translate(UP) for r in kept]
        assert sorted(texts) == sorted({(t or "").translate(UP) for _, t in rows})
        want = {(i, s) for i, _, _, stays, s in brute(rows, largest) if stays}
        assert {(r.doc_id, hashlib.sha256((r.text or "").translate(UP).encode()).hexdigest()) for r in kept} == want


def test_only_ascii_capitals_are_folded(spark):
    df = spark.createDataFrame([("ÀB", "Àb"), ("ABC", "abc"), (None, ""), ("ẞX", "ẞx")], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", folded(F.col("t")).alias("got")).collect())


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = equal_texts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
