"""Archives: opened by another program, round trips, limits, dry runs and upserts."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.archive import export_archive, import_archive, relative
from sparkloom.sources.files import read_zipped_bundle

SCHEMA = "concept string, meta map<string,string>, body string"


def concepts(spark):
    rows = [(f"area{i % 3}/topic-{i}", {"title": f"T {i}", "lang": "en"}, f"Body {i} é.\n" * (i + 1)) for i in range(40)]
    rows += [("index", {"title": "Start"}, "See [[area1/topic-1]], [[area2/topic-2|two]] and [[gone|lost one]]."), ("area1/deep/note", {"k": "v"}, "Up: [[area1/topic-1|one]], [[/index]]"), ("empty", {"k": "v"}, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def test_an_archive_opens_and_comes_back(spark, tmp_path):
    df, rows = concepts(spark)
    (tmp_path / "out").mkdir()
    path = str(tmp_path / "out" / "all.zip")
    assert export_archive(df.unionByName(df.limit(3)), path) == len(rows)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == sorted(f"{c}.md" for c, _, _ in rows)
        text = lambda c: z.read(f"{c}.md").decode()
        assert "See [area1/topic-1](area1/topic-1.md), [two](area2/topic-2.md) and lost one." in text("index")
        assert "Up: [one](../topic-1.md), [/index](../../index.md)" in text("area1/deep/note")
    back = {r.concept: (r.meta, r.body) for r in read_zipped_bundle(spark, str(tmp_path / "out")).collect()}
    assert all(back[c] == (m, b) for c, m, b in rows[:40]) and len(back) == len(rows)


def test_the_size_is_checked_before_anything_is_written(spark, tmp_path):
    df, _ = concepts(spark)
    with pytest.raises(ValueError):
        export_archive(df, str(tmp_path / "big.zip"), most_bytes=100)
    assert not (tmp_path / "big.zip").exists()


def test_imports_are_planned_and_upserted_by_file(spark, tmp_path):
    df, rows = concepts(spark)
    (tmp_path / "in").mkdir()
    table, archives = str(tmp_path / "table"), str(tmp_path / "in")
    export_archive(df, f"{archives}/a.zip")
    count = lambda plan: {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
    assert count(import_archive(spark, archives, table)) == {"create": len(rows)} and not (tmp_path / "table").exists()
    assert count(import_archive(spark, archives, table, dry_run=False)) == {"create": len(rows)}
    assert count(import_archive(spark, archives, table)) == {"unchanged": len(rows)}
    changed = df.withColumn("body", F.when(F.col("concept") == "index", "Changed.").otherwise(F.col("body"))).where("concept <> 'empty'")
    export_archive(changed.unionByName(spark.createDataFrame([("new", {"a": "b"}, "New.")], SCHEMA)), f"{archives}/b.zip")
    assert count(import_archive(spark, archives, table, dry_run=False)) == {"unchanged": len(rows) - 1, "update": 1, "create": 1}
    got = {r.concept: r.body for r in spark.read.parquet(table).collect()}
    assert got["index"] == "Changed." and got["new"] == "New." and len(got) == len(rows) + 1


def test_relative_paths_and_no_concepts(spark, tmp_path):
    assert [relative("a", "b"), relative("x/a", "x/b"), relative("x/y/a", "b/c"), relative("x/a", "x/y/b")] == ["b.md", "b.md", "../../b/c.md", "y/b.md"]
    path = str(tmp_path / "none.zip")
    assert export_archive(spark.createDataFrame([], SCHEMA), path) == 0 and zipfile.ZipFile(path).namelist() == []
