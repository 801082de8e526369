"""The paged source over folders: batch, stream, restart."""

import json

from sparkloom.sources.paged import PagedSource, markdown_of_blocks


def put(place, database, number, ids):
    folder = place / database
    folder.mkdir(parents=True, exist_ok=True)
    page = lambda i: {"id": i, "title": f"Page {i}", "edited": "2024-01-01", "blocks": [{"type": "heading_1", "text": f"T{i}"}, {"type": "paragraph", "text": "é"}]}
    (folder / f"{number:04d}.json").write_text(json.dumps({"pages": [page(i) for i in ids]}), encoding="utf-8")


def test_a_batch_follows_the_cursors(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    for n in range(3):
        put(tmp_path, "a", n, [f"a{n}{k}" for k in range(4)])
    put(tmp_path, "b", 0, ["b00"])
    put(tmp_path, "empty", 0, [])
    rows = spark.read.format("paged").option("path", str(tmp_path)).load().collect()
    assert sorted(r.page_id for r in rows) == sorted([f"a{n}{k}" for n in range(3) for k in range(4)] + ["b00"])
    assert {(r.database, r.title, r.markdown) for r in rows if r.page_id == "b00"} == {("b", "Page b00", "# Tb00\n\né")}
    assert spark.read.format("paged").option("path", str(tmp_path)).load().rdd.getNumPartitions() == 3


def test_a_restarted_stream_goes_on_after_its_cursors(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    source, seen = tmp_path / "pages", []
    put(source, "a", 0, ["1", "2"])

    def run():
        stream = spark.readStream.format("paged").option("path", str(source)).load()
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: seen.extend(r.page_id for r in b.collect())).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert sorted(seen) == ["1", "2"]
    put(source, "a", 1, ["3"])
    put(source, "b", 0, ["4", "5"])
    run()
    run()
    assert sorted(seen) == ["1", "2", "3", "4", "5"]


def test_blocks():
    blocks = [{"type": "bulleted_list_item", "text": "x"}, {"type": "bulleted_list_item", "text": "y"}, {"type": "to_do", "text": "z", "checked": True}, {"type": "divider"}, {"type": "code", "text": "a = 1", "language": "python"}, {"type": "odd", "text": "p"}, {"type": "paragraph", "text": None}]
    assert markdown_of_blocks(blocks) == "- x\n- y\n\n- [x] z\n\n---\n\n```python\na = 1\n```\n\np"
    assert markdown_of_blocks([]) == "" and markdown_of_blocks(None) == ""
