"""Exact duplicates by a 128-bit content hash, with bytes compared inside groups; DataFrame functions only.

1. One scan writes a slim row for each document: id, row number, hash. Texts stay behind.
2. Rows are counted by hash, combined on the map side, so a text that a third of all rows
   repeat is a row a task in the shuffle. Only hashes of two rows and more are written.
3. The texts of these hashes are read again and grouped by hash *and* text, which compares
   bytes; a hash with two texts is a collision. While there are few such hashes
   (``SEMI_KEYS``) they are broadcast and only their texts move; beyond it all texts move
   once, combined on the map side, with the same result.
4. Slim rows meet the groups. Groups of more than 1/``HOT`` of all rows are at most ``HOT``
   and are broadcast; the others spread over the shuffle.
5. Rows of a collided hash, if there are any, are grouped again by hash and text.

The hash is the first half of SHA-256: collisions can't be made on purpose, as with MD5.

Cases: a null text counts as empty. Of rows that are equal in id and text one stays; which
is fixed when the slim rows are written. A row without an id is a member of its group and
stays only if no row of the group has one (``keep_id`` is null then). An empty table gives
an empty one. Extra columns are ignored, whatever their names, and kept by
``without_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.columns import free_name
from sparkloom.storage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of 16 bytes that are broadcast to pick the texts to compare: 64 MB or so.
SEMI_KEYS = 1 << 20
#: Groups above this share of all rows are broadcast; there can't be more than ``HOT`` of them.
HOT = 4096


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null becomes empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def whole(text: Column) -> Column:
    """The text as it is; null becomes empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def half_digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _groups(rows: DataFrame, on: list[str], largest: bool) -> DataFrame:
    """Groups of two rows and more: their size, the id that stays and its row."""
    best, best_by = (F.max, F.max_by) if largest else (F.min, F.min_by)
    agg = rows.groupBy(*on).agg(F.count("*").alias("size"), best("id").alias("keep_id"), F.coalesce(best_by("row", "id"), F.min("row")).alias("keep_row"))
    return agg.where("size > 1")


def _met(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """Each row with its group: the largest groups by a bounded broadcast, the rest by whatever join is fit."""
    hot = F.col("size") > F.lit(max(1, total // HOT))
    large = F.broadcast(groups.where(hot))
    some = rows.join(large, on)
    rest = rows.join(large.select(*on), on, "left_anti").join(groups.where(~hot), on, "left")
    return some.unionByName(rest).select(
        "id",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "carried",
    )


def _collisions(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The hashes in ``groups`` under which ``texts(hash, body)`` has different bodies."""
    if groups.count() <= SEMI_KEYS:
        texts = texts.join(F.broadcast(groups.select("hash")), "hash", "left_semi")
    forms = texts.groupBy("hash", "body").agg(F.count("*").alias("n"))
    return forms.groupBy("hash").agg(F.count("*").alias("forms")).where("forms > 1").select("hash")


def equal_texts(
    docs: DataFrame,
    text: Callable[[Column], Column] = whole,
    largest: bool = False,
    carry: Callable[[Column], list[Column]] | None = None,
    content_hash: Callable[[Column], Column] = half_digest,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) of every row, and the columns ``carry`` makes of the normalised text.

    The row that stays has the smallest id, or the largest. What is carried is computed in
    the first scan and written with the slim rows.
    """
    id_, body = docs["doc_id"].alias("id"), text(docs["text"]).alias("body")
    base = docs.select(id_, body, (F.struct(*carry(docs["text"])) if carry else F.lit(0)).alias("carried"))
    slim = base.select("id", content_hash(F.col("body")).alias("hash"), "carried")
    rows = staged(slim.withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = staged(_groups(rows, ["hash"], largest), "equal-hashes")
    total = rows.count()
    collided = staged(_collisions(docs.select(body).select(content_hash(F.col("body")).alias("hash"), "body"), groups), "collisions")
    if collided.isEmpty():
        marks = _met(rows, groups, ["hash"], total)
    else:
        apart = base.select("*", content_hash(F.col("body")).alias("hash")).join(collided, "hash", "left_semi")
        apart = staged(apart.withColumn("row", F.monotonically_increasing_id()), "collided-rows")
        marks = _met(rows.join(collided, "hash", "left_anti"), groups, ["hash"], total)
        marks = marks.unionByName(_met(apart, staged(_groups(apart, ["hash", "body"], largest), "collided-groups"), ["hash", "body"], total))
    kept = [F.col("id").alias("doc_id"), "keep_id", "group_size", "kept"]
    return marks.select(*kept, "carried.*") if carry else marks.select(*kept)


def exact_duplicates(docs: DataFrame, text: Callable[[Column], Column] = folded, largest: bool = False, content_hash: Callable[[Column], Column] = half_digest) -> DataFrame:
    """``equal_texts`` with ``text_sha256``, the digest of the normalised text."""
    found = equal_texts(docs, text, largest, lambda raw: [F.unhex(F.sha2(text(raw), 256)).alias("sha")], content_hash)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, text: Callable[[Column], Column] = folded, largest: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows equal in id and text become one."""
    marks = exact_duplicates(docs, text, largest).where("NOT kept")
    twin = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = staged(marks.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), twin.alias("_twin")).distinct(), "duplicates")
    sha = F.unhex(F.sha2(text(docs["text"]), 256))
    met = docs["doc_id"].eqNullSafe(lost["_id"]) & (sha == lost["_sha"])
    stay, digest = docs.join(lost, met, "left_anti"), free_name(docs, "digest")
    once = docs.withColumn(digest, sha).join(lost.where("_twin"), met, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
    return stay.unionByName(once)


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, count(*) AS n, max(doc_id) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
