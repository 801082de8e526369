"""Bundles as zip archives: members made in tasks, one central directory; import with a dry run and an upsert by file.

An export rewrites links between concepts to relative Markdown links, checks the size that its
manifest adds up to, and only then makes the archive: tasks compress the members, the driver
passes their bytes on to the file, a bounded piece at a time, and writes the directory of names, sizes and
places behind them. The bound on the archive's size is a parameter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.files import read_zipped_bundle
from sparkloom.sources.sinks import bundle_text, replace_by_key
from sparkloom.storage import exists, small_batches, staged

#: Bytes of text in an archive at most, and bytes that are passed on at once.
MOST_BYTES, PIECE = 512 << 20, 1 << 20
LINK = re.compile(r"\[\[([^\]|\n]+)(?:\|([^\]\n]*))?\]\]")
# Fixed values of the zip format: signatures, version, names in UTF-8, deflate, the first day of its calendar.
LOCAL, ENTRY, END, VERSION, UTF8, DEFLATE, DAY = 0x04034B50, 0x02014B50, 0x06054B50, 20, 0x800, 8, 33
ROWS = "name string, crc bigint, packed bigint, size bigint, member binary"


def relative(base: str, target: str) -> str:
    """The path from the folder of concept ``base`` to the file of ``target``."""
    here, there = base.split("/")[:-1], target.split("/")
    same = 0
    while same < min(len(here), len(there) - 1) and here[same] == there[same]:
        same += 1
    return "/".join([".."] * (len(here) - same) + there[same:]) + ".md"


def rewritten(concept: str, text: str, known: set[str]) -> str:
    """``[[target|shown]]`` as a relative link where the target is part of the export, as plain text elsewhere."""

    def link(m: re.Match) -> str:
        target, shown = m[1].strip().strip("/"), (m[2] or m[1]).strip()
        return f"[{shown}]({relative(concept, target)})" if target in known else shown

    return LINK.sub(link, text)


def manifest(concepts: DataFrame) -> DataFrame:
    """(concept, text, known) of ``concepts(concept, meta, body)``: the file's text, and which of its targets are exported too."""
    text = bundle_text(F.col("meta"), F.coalesce("body", F.lit("")))
    rows = concepts.where("concept IS NOT NULL").select("concept", text.alias("text")).dropDuplicates(["concept"])
    targets = rows.select(F.col("concept").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|\n]+)"), F.lit(1)))).alias("raw"))
    targets = targets.select("source", F.regexp_replace(F.trim("raw"), "^/+|/+$", "").alias("target"))
    known = targets.join(rows.select(F.col("concept").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("concept")).agg(F.collect_set("target").alias("known"))  # the links of one text
    return rows.join(known, "concept", "left")


def members(rows: DataFrame) -> DataFrame:
    """(name, crc, packed, size, member): each file compressed, with its local header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for concept, text, known in zip(*(b.column(x).to_pylist() for x in range(3))):
                data, name = rewritten(concept, text, set(known or ())).encode(), f"{concept}.md".encode()
                pack = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed, crc = pack.compress(data) + pack.flush(), zlib.crc32(data)
                head = struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, 0, DAY, crc, len(packed), len(data), len(name), 0)
                out.append((f"{concept}.md", crc, len(packed), len(data), head + name + packed))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["name", "crc", "packed", "size", "member"])

    return rows.select("concept", "text", "known").mapInArrow(run, ROWS)


def export_archive(concepts: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> int:
    """Write ``concepts(concept, meta, body)`` as one zip file; returns the number of its members."""
    spark = concepts.sparkSession
    rows = staged(manifest(concepts), "archive-manifest")
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if total > most_bytes or n > 0xFFFF:
        raise ValueError(f"{total} bytes in {n} files are more than an archive may hold")
    made = staged(members(rows).repartitionByRange("name").sortWithinPartitions("name"), "archive-members")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    directory, at, held = bytearray(), 0, bytearray()
    try:
        for r in made.orderBy("name").toLocalIterator():  # within the bound above
            name = r.name.encode()
            directory += struct.pack("<IHHHHHHIIIHHHHHII", ENTRY, VERSION, VERSION, UTF8, DEFLATE, 0, DAY, r.crc, r.packed, r.size, len(name), 0, 0, 0, 0, 0, at) + name
            held += r.member
            at += len(r.member)
            if len(held) >= PIECE:
                out.write(held)
                held = bytearray()
        out.write(held + directory + struct.pack("<IHHHHIIH", END, 0, 0, n, n, len(directory), at, 0))
    finally:
        out.close()
    return n


def import_archive(spark: SparkSession, archives: str, table: str, dry_run: bool = True) -> DataFrame:
    """(concept, action) for the files of the archives in a folder: create, update or unchanged, against the table of (concept, meta, body) in ``table``.

    Without ``dry_run`` new and changed files replace those of their concept. Of several
    archives with one concept the last by name counts. Nothing is removed.
    """
    best = F.max_by(F.struct("meta", "body"), "bundle")
    found = read_zipped_bundle(spark, archives).groupBy("concept").agg(best.alias("f")).select("concept", "f.meta", "f.body")
    new = staged(found.withColumn("hash", F.sha2(bundle_text(F.coalesce("meta", F.create_map().cast("map<string,string>")), F.col("body")), 256)), "imported")
    if exists(spark, table):
        old = spark.read.parquet(table).select("concept", F.col("hash").alias("old_hash"))
    else:
        old = spark.createDataFrame([], "concept string, old_hash string")
    action = F.when(F.col("old_hash").isNull(), "create").when(F.col("old_hash") != F.col("hash"), "update").otherwise("unchanged")
    plan = staged(new.join(old, "concept", "left").select("concept", action.alias("action")), "import-plan")
    if not dry_run:
        changed = plan.where("action <> 'unchanged'")
        if not changed.isEmpty():
            replace_by_key(new.join(changed.select("concept"), "concept", "left_semi"), table, "concept")
    return plan
