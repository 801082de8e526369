"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups are sorted by size; each enters the bin with the tightest remaining capacity that
holds it, found in a balanced tree. The capacity is the least, by bisection, at which the
groups fit the wanted number of bins. A group larger than an even share has a bin alone and
the rest is packed into the bins that are left.

Groups of equal size are interchangeable, so the packing works on runs (size, count): the
tightest bin takes as many of a run as it holds, which is what best fit does one by one.
All groups are packed by size, and only the histogram of sizes is in one place: n different
sizes add up to n * n / 2 bytes at least, so that a corpus of T bytes has at most sqrt(2 T)
of them (a million for 500 GB if every size occurred), whatever its number of groups.

The result is a table of segments (size, first key, end key, shard): a run that went to
several bins is cut at keys, found by counts over buckets of keys and a window over the few
buckets that hold a cut. Rows find their segment by a join; group sizes are summed with
map-side combination, so a text that a third of all rows share is one row per task before
any shuffle. Slots are numbered within parts of a shard that hold about ``PART_ROWS`` rows,
dealt by a hash of the row, and so are as even for one large group as for many small ones.

Cases: a null text has no bytes and groups with the empty text. Repeated rows each get a
slot of their own. An empty table gives an empty one. Equal doc_ids do not matter: groups
go by text. Extra columns are ignored by ``shard_slots`` and kept by ``with_shards``.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.columns import free_name
from sparkloom.storage import staged

OVERHEAD = 8
#: Rows in a part of a shard, within which slots are numbered, about.
PART_ROWS = 50_000
Runs = list[tuple[int, int]]
Segments = list[tuple[int, int, int]]


class Tree:
    """A treap of (remaining capacity, bin) pairs."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.random = random.Random(7)

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(low, [(remaining, number), None, None, self.random.random()]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the pair with the least remaining capacity that holds ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[1] is not None:
            node = node[1]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, rest)
        return node[0]


def best_fit(runs: Runs, capacity: int, most: int | None = None) -> tuple[Segments, int]:
    """(size, bin, count) for ``runs(size, count)`` in falling order of size, and the number of bins opened.

    Gives up when more than ``most`` bins are needed.
    """
    tree, placed, opened = Tree(), [], 0
    for size, left in runs:
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if opened == most:
                    return placed, opened + 1
                found, opened = (capacity, opened), opened + 1
            n = min(left, found[0] // size)
            placed.append((size, found[1], n))
            tree.add(found[0] - n * size, found[1])
            left -= n
    return placed, opened


def pack(runs: Runs, n: int) -> Segments:
    """(size, bin, count) with bins 0 to n - 1, at the least capacity that best fit manages.

    ``runs`` has each size once, in falling order. The search gallops up from the even share.
    """
    alone: Segments = []
    total, rest = sum(s * c for s, c in runs), list(runs)
    while rest and len(alone) < n - 1 and rest[0][0] * (n - len(alone)) > total:
        size, count = rest[0]
        alone.append((size, len(alone), 1))
        total -= size
        rest[0:1] = [(size, count - 1)] if count > 1 else []
    if not rest:
        return alone
    bins = n - len(alone)
    low = high = max(-(-total // bins), rest[0][0])
    step, (best, opened) = 1, best_fit(rest, low, bins)
    while opened > bins:
        low, high, step = high + 1, high + step, 2 * step
        best, opened = best_fit(rest, high, bins)
    while low < high:
        middle = (low + high) // 2
        found, opened = best_fit(rest, middle, bins)
        if opened <= bins:
            high, best = middle, found
        else:
            low = middle + 1
    return alone + [(s, len(alone) + b, c) for s, b, c in best]


def group_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def _cut_keys(groups: DataFrame, cuts: list[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
    """The key of the group of each (size, rank) among the groups of that size, in the order of keys."""
    spark = groups.sparkSession
    wanted = F.broadcast(spark.createDataFrame(cuts, "bytes bigint, rank bigint"))  # bins x the bits of a capacity, at most
    bucket = F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int")
    cut = groups.join(wanted.select("bytes").distinct(), "bytes", "left_semi").select("bytes", "key", bucket.alias("bucket"))
    counts = cut.groupBy("bytes", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = F.col("rank") - F.col("start")
    hit = staged(starts.join(wanted, "bytes").where((inside >= 0) & (inside < F.col("n"))).select("bytes", "bucket", "rank", inside.alias("place")), "cuts")
    few = cut.join(F.broadcast(hit.select("bytes", "bucket").distinct()), ["bytes", "bucket"], "left_semi")
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("bytes", "bucket").orderBy("key")) - 1)
    return {(r.bytes, r["rank"]): bytes(r.key) for r in ranked.join(F.broadcast(hit), ["bytes", "bucket", "place"]).toLocalIterator()}


class Plan:
    """Where each group goes: the sizes of groups of several rows, and segments of groups by size and key."""

    def __init__(self, rows: DataFrame, shards: int):
        """``rows`` has (key, size); each key has one size."""
        groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
        sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"))
        runs = sorted(((r.bytes, r.n) for r in sizes.toLocalIterator()), reverse=True)
        segments, cuts, before = [], [], {}
        for size, shard, n in pack(runs, shards):
            at = before.get(size, 0)
            segments.append((size, at, shard))
            before[size] = at + n
            if at:
                cuts.append((size, at))
        keys = _cut_keys(groups, cuts) if cuts else {}
        first = [bytearray(keys[s[:2]]) if s[1] else bytearray() for s in segments]
        after: dict[int, bytearray | None] = {}
        table = []
        for (size, _, shard), key in reversed(list(zip(segments, first))):
            table.append((size, key, after.get(size), shard))
            after[size] = key
        self.segments = staged(rows.sparkSession.createDataFrame(table, "bytes bigint, first binary, end binary, shard int"), "segments")
        self.several = staged(groups.where("rows > 1").select("key", "bytes"), "several")

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows(key, size)`` with shard; both tables have their true size, so Spark broadcasts them only while small."""
        sized = rows.join(self.several, "key", "left").withColumn("bytes", F.coalesce("bytes", "size"))
        mine = (F.col("key") >= F.col("first")) & (F.col("end").isNull() | (F.col("key") < F.col("end")))
        return sized.join(self.segments.withColumnRenamed("bytes", "of"), (F.col("bytes") == F.col("of")) & mine).drop("bytes", "of", "first", "end")


def with_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with a column ``shard`` (underscores are added while the name is taken)."""
    keyed = (group_key(docs["text"]).alias("key"), text_size(docs["text"]).alias("size"))
    plan = Plan(docs.select(*keyed), shards)
    return plan.place(docs.select(F.struct("*").alias("row"), *keyed)).select("row.*", F.col("shard").alias(free_name(docs, "shard")))


def shard_slots(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; slots are gapless in each shard."""
    text = docs["text"]
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), group_key(text).alias("key"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = max(1, rows.count() // (shards * PART_ROWS))
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")
    placed = staged(Plan(rows, shards).place(rows).select("doc_id", "size", "text_crc32", "row", "shard", part), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    slot = F.col("start") + F.row_number().over(order) - 1
    return placed.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
