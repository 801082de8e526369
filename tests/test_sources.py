"""Extraction of files made on the spot, bundles, and sinks."""

import zipfile
from email.message import EmailMessage

from pyspark.sql import functions as F

from sparkloom.sources.files import kind_of, needs_extract, read_bundle, read_files, read_zipped_bundle, resolve_link, xlsx_text
from sparkloom.sources.sinks import export_bundle, export_tsv, replace_by_key


def zipped(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_files(spark, tmp_path):
    w, a = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"'
    zipped(tmp_path / "a.docx", {"word/document.xml": f"<w:d {w}><w:p><w:t>Hello </w:t><w:t>there</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>x</w:t></w:p></w:tc><w:tc><w:p><w:t>y</w:t></w:p></w:tc></w:tr></w:tbl></w:d>"})
    zipped(tmp_path / "b.pptx", {f"ppt/slides/slide{n}.xml": f"<a:s {a}><a:p><a:t>S{n}</a:t></a:p></a:s>" for n in (1, 2, 10)})
    zipped(tmp_path / "c.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>5</v></c></row></s>'})
    mail = EmailMessage()
    mail["Subject"], mail["From"] = "Hi", "a@b.c"
    mail.set_content("<h1>T</h1><p>body</p>", subtype="html")
    mail.add_attachment(b"x", maintype="text", subtype="plain", filename="n.txt")
    (tmp_path / "d.eml").write_bytes(bytes(mail))
    (tmp_path / "e.html").write_text("<h1>W</h1>")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.txt").write_text("a\x00b")
    got = {r.path.rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Hello there\n\nx | y"
    assert got["b.pptx"].text == "<!-- slide 1 -->\n\nS1\n\n<!-- slide 2 -->\n\nS2\n\n<!-- slide 3 -->\n\nS10"
    assert got["c.xlsx"].text == "<!-- sheet 1 -->\nname | 5"
    assert got["d.eml"].text == "Subject: Hi\nFrom: a@b.c\n\n# T\n\nbody\n\nAttachments:\n- n.txt"
    assert got["e.html"].text == "# W" and got["h.txt"].text == "ab"
    assert (got["f.pdf"].text, got["f.pdf"].note) == (None, "unsupported") and got["g.docx"].note == "BadZipFile"
    names = spark.createDataFrame([("x.MD", True), ("x.eml", None), ("x.zip", False)], "p string, t boolean")
    assert [tuple(r) for r in names.select(kind_of(F.col("p")), needs_extract(F.col("p"), F.col("t"))).collect()] == [("plain", False), ("eml", True), (None, False)]


def test_bundles(spark, tmp_path):
    (tmp_path / "in" / "t").mkdir(parents=True)
    (tmp_path / "in" / "t" / "o.md").write_text("---\ntitle: O\ntype: table\n---\nSee [c](../c.md)\n")
    (tmp_path / "in" / "c.md").write_text("plain")
    b = read_bundle(spark, str(tmp_path / "in"))
    assert {r.concept: (r.meta, r.body) for r in b.collect()} == {"t/o": ({"title": "O", "type": "table"}, "See [c](../c.md)\n"), "c": ({}, "plain")}
    export_bundle(b, str(tmp_path / "out"))
    out = {r.name: r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["t/o.md"] == "---\ntitle: O\ntype: table\n---\nSee [c](../c.md)\n"
    assert [resolve_link("t/o", x) for x in ("../c.md", "./p.md", "/a/b.md", "q.md")] == ["c", "t/p", "a/b", "t/q"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    replace_by_key(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "file_id long, text string"), path, "file_id", 4)
    replace_by_key(spark.createDataFrame([(1, "z"), (3, "d")], "file_id long, text string"), path, "file_id", 4)
    assert sorted((r.file_id, r.text) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c"), (3, "d")]
    export_tsv(spark.createDataFrame([(1, "a\tb"), (2, None), (3, "c\\\n")], "i int, t string"), str(tmp_path / "tsv"), [F.desc("i")], 2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()) == ["2\t", "3\tc\\\\\\n"]


def test_sparse_and_wide_sheets():
    import io

    cell = lambda r, v: f'<c r="{r}"><v>{v}</v></c>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<s><row>{cell('A1', 1)}{cell('C1', 3)}</row><row>{cell('B2', 2)}{cell('AA2', 27)}</row></s>")
    assert xlsx_text(data.getvalue()) == "<!-- sheet 1 -->\n1 |  | 3\n | 2" + " | " * 24 + " | 27"
    assert xlsx_text(data.getvalue(), columns=3) == "<!-- sheet 1 -->\n1 |  | 3\n | 2\n...(columns truncated)"
    assert xlsx_text(data.getvalue(), rows=1, columns=30) == "<!-- sheet 1 -->\n1 |  | 3\n...(truncated)"


def test_zipped_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("t/o.md", "---\ntitle: O\n---\nBody")
        z.writestr("../evil.md", "x")
        z.writestr("/abs.md", "x")
        z.writestr("n.txt", "x")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = read_zipped_bundle(spark, str(tmp_path)).collect()
    assert [(r.concept, r.meta, r.body) for r in got] == [("t/o", {"title": "O"}, "Body")]
