"""Files as documents: routing by kind, and extraction of office, mail and web formats.

Files are read by ``binaryFile``, so any store that Spark reads will do; extraction runs in
Arrow batches with the standard library only. Kinds that need libraries or services which
are not part of this package (pdf, legacy office, images) give a null text and a note.
"""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import extension
from sparkloom.operators.structure import front_matter, html_to_markdown

# Extensions by extractor, and limits of tables.
PLAIN = ["md", "txt", "csv", "json"]
KINDS = {"docx": ["docx"], "pptx": ["pptx"], "xlsx": ["xlsx"], "eml": ["eml"], "html": ["html", "htm"], "plain": PLAIN, "unsupported": ["pdf", "doc", "ppt", "xls", "png", "jpg", "jpeg"]}
MOST_ROWS, MOST_COLUMNS = 2000, 50


def kind_of(path: Column) -> Column:
    """The extractor of a file, or null where there is none."""
    ext, kind = extension(path), F.lit(None).cast("string")
    for name, ends in KINDS.items():
        kind = F.when(ext.isin(ends), name).otherwise(kind)
    return kind


def needs_extract(path: Column, has_text: Column) -> Column:
    """Known kinds without a text of their own."""
    return kind_of(path).isNotNull() & ~F.coalesce(has_text, F.lit(False))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(content: bytes, prefix: str) -> Iterator[tuple[str, ElementTree.Element]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if n.startswith(prefix) and n.endswith(".xml")]
        for n in sorted(names, key=lambda n: (len(n), n)):
            yield n, ElementTree.fromstring(z.read(n))


def _text(node: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == tag)


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by bars."""
    lines, rows = [], []
    for _, root in _parts(content, "word/document"):
        tables = [t for t in root.iter() if _local(t.tag) == "tbl"]
        inside = {id(p) for t in tables for p in t.iter()}
        lines += [_text(p) for p in root.iter() if _local(p.tag) == "p" and id(p) not in inside]
        rows += [" | ".join(_text(c) for c in r if _local(c.tag) == "tc") for t in tables for r in t.iter() if _local(r.tag) == "tr"]
    return "\n\n".join(x for x in lines + rows if x.strip())


def pptx_text(content: bytes) -> str:
    """A mark for each slide, and the text of its shapes."""
    out = []
    for k, (_, root) in enumerate(_parts(content, "ppt/slides/slide"), 1):
        out.append(f"<!-- slide {k} -->")
        out += [t for p in root.iter() if _local(p.tag) == "p" and (t := _text(p)).strip()]
    return "\n\n".join(out)


def _column(reference: str, default: int) -> int:
    """The column of a cell like ``AB12``, counted from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1 if n else default


def xlsx_text(content: bytes, rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> str:
    """A mark for each sheet, and its rows with cells, at their columns, joined by bars; a note where rows or columns were cut."""
    shared = [_text(si) for _, root in _parts(content, "xl/sharedStrings") for si in root if _local(si.tag) == "si"]
    out = []
    for k, (_, root) in enumerate(_parts(content, "xl/worksheets/sheet"), 1):
        out.append(f"<!-- sheet {k} -->")
        found = [r for r in root.iter() if _local(r.tag) == "row"]
        wide = 0
        for r in found[:rows]:
            line: list[str] = []
            for c in (c for c in r if _local(c.tag) == "c"):
                v = _text(c, "v") or _text(c)
                at = _column(c.get("r") or "", len(line))
                wide = max(wide, at + 1)
                if at < columns:
                    line += [""] * (at - len(line)) + [shared[int(v)] if c.get("t") == "s" and v.isdigit() else v]
            out.append(" | ".join(line))
        if len(found) > rows:
            out.append("...(truncated)")
        if wide > columns:
            out.append("...(columns truncated)")
    return "\n".join(out)


def eml_text(content: bytes) -> str:
    """Headers, the body (web parts as Markdown), and the names of attachments."""
    mail = email.message_from_bytes(content, policy=email.policy.default)
    head = [f"{h}: {mail[h]}" for h in ("Subject", "From", "To", "Date") if mail[h]]
    body = mail.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    names = [a.get_filename() or "unnamed" for a in mail.iter_attachments()]
    text = html_to_markdown(text) if body and body.get_content_type() == "text/html" else text.strip()
    return "\n".join(head) + "\n\n" + text + ("\n\nAttachments:\n" + "\n".join(f"- {n}" for n in names) if names else "")


EXTRACT = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "eml": eml_text, "html": lambda b: html_to_markdown(b.decode("utf-8", "replace")), "plain": lambda b: b.decode("utf-8", "replace")}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, kind, length, text, note) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, notes = [], []
            for kind, content in zip(pdf["kind"], pdf["content"]):
                text, note = None, None
                try:
                    text = EXTRACT[kind](bytes(content)).replace("\x00", "") if kind in EXTRACT else None
                    note = None if kind in EXTRACT else "unsupported"
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, LookupError) as e:
                    note = type(e).__name__
                texts.append(text)
                notes.append(note)
            yield pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], "length": pdf["length"], "text": texts, "note": notes})

    return files.select("path", kind_of(F.col("path")).alias("kind"), "length", "content").mapInPandas(run, "path string, kind string, length bigint, text string, note string")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(concept, meta, body) of a folder of Markdown files with front matter; a concept is a path without its ending."""
    files = read_files(spark, path, "*.md")
    meta, body = front_matter(F.col("text"))
    root = path.rstrip("/").rpartition("/")[2]
    concept = F.regexp_replace(F.substring_index("path", f"/{root}/", -1), r"\.md$", "")
    return files.select(concept.alias("concept"), meta.alias("meta"), body.alias("body"))


def read_zipped_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, concept, meta, body) of the Markdown files in zip archives; members that lead out of an archive are left out, and broken archives have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for bundle, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for name in z.namelist():
                            if name.endswith(".md") and not name.startswith("/") and ".." not in name.split("/") and "\\" not in name:
                                rows.append((bundle, name.removesuffix(".md"), z.read(name).decode("utf-8", "replace").replace("\x00", "")))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["bundle", "concept", "text"])

    found = files.select("path", "content").mapInPandas(run, "bundle string, concept string, text string")
    meta, body = front_matter(F.col("text"))
    return found.select("bundle", "concept", meta.alias("meta"), body.alias("body"))


def resolve_link(base: str, target: str) -> str:
    """The concept that a relative or absolute link of a bundle means, seen from ``base``."""
    parts = [] if target.startswith("/") else base.split("/")[:-1]
    for p in target.strip("/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts).removesuffix(".md")
