"""Benchmark decontamination with suffix arrays over shards of the training texts.

The documents of a task are taken in shards of about a million words. Over each shard a
suffix array is built: the positions at which a benchmark window could begin, sorted by all
words that follow, up to where no benchmark text could go on (ranks of ten words are doubled
until no two suffixes tie). Every suffix of every benchmark item is then looked up by binary
search, which gives all places of its window; from the first window of a common passage on,
the words of both sides are compared to where they part, which is the longest verbatim
match. A position can only matter if each pair of neighbouring words in the window occurs
somewhere in the benchmark, so all other positions stay out of the array (a pair table has
no false negatives; the sorted words decide).

Documents are never shuffled and meet no other document, so a passage that a third of all
documents share costs each shard its own copies only. The benchmark is measured first and
read in blocks of about ``BLOCK_BYTES``; a block is what one broadcast holds, as arrays of
word numbers, and a larger benchmark takes more passes over the documents, not a larger
broadcast.

Cases: null, empty and wordless texts have no words, no hits and the digest of an empty
list; items without words have no window. Equal windows of several items count for each
of these items. Items that repeat an item_id count once; an item with a null item_id makes
hits but cannot be listed. Repeated documents get equal results. An empty benchmark marks
nothing. Extra columns are ignored, and kept by ``remove_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.columns import each_copy
from sparkloom.storage import TEXT_BATCH_ROWS, small_batches, staged

WINDOW = 10
#: Text bytes of the benchmark in one broadcast.
BLOCK_BYTES = 8 << 20
#: Words in a shard, about.
SHARD_WORDS = 1 << 20
#: Slots of the table of word pairs.
PAIR_SLOTS = 1 << 22
#: Suffixes looked up, and pairs of places compared, at once.
AT_ONCE, PAIRS_AT_ONCE, STRIDE = 1 << 16, 1 << 20, 16

KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TABLE = bytes(b if b in KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def word_list(text: str | None) -> list[bytes]:
    """The words of a whole text: runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode().translate(TABLE).split()


def window_ranks(words: np.ndarray, width: int) -> np.ndarray:
    """A number for the ``width`` words from each position on: equal numbers, equal words, zeros past the end."""
    shifted = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])
    joined = lambda x, y: np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1]
    power, span, whole, done = words.astype(np.int64), 1, None, 0
    while width:
        if width & 1:
            whole, done = power if whole is None else joined(whole, shifted(power, done)), done + span
        width >>= 1
        if width:
            power, span = joined(power, shifted(power, span)), 2 * span
    return whole


class Searcher:
    """The suffixes of a block of the benchmark, and their search in shards of texts."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        words: dict[bytes, int] = {}
        lists = [(i, np.array([words.setdefault(w, len(words) + 1) for w in word_list(t)], np.int32)) for i, t in items]
        lists = [(i, ids) for i, ids in lists if len(ids)]
        self.words, self.base = words, len(words) + 1
        self.least = min((min(len(ids), window) for _, ids in lists), default=0)
        names = sorted({i for i, _ in lists}, key=lambda i: (i is None, str(i)))
        number = {i: k for k, i in enumerate(names)}
        self.names, self.owner = names, np.array([number[i] for i, _ in lists], np.int32)
        gap = np.zeros(max(window, STRIDE), np.int32)  # after each item
        sizes = np.array([len(ids) for _, ids in lists], np.int64)
        self.starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
        self.bench = np.concatenate([x for _, ids in lists for x in (ids, gap)]) if lists else gap
        self.pairs = np.zeros(PAIR_SLOTS, bool)
        both = np.flatnonzero((self.bench[:-1] > 0) & (self.bench[1:] > 0))
        self.pairs[self._slot(self.bench[both].astype(np.int64), self.bench[both + 1].astype(np.int64))] = True
        counts = np.maximum(1, sizes - window + 1)
        at = np.repeat(self.starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        rank = window_ranks(self.bench, window)[at]
        order = np.argsort(rank, kind="stable")
        self.members = at[order].astype(np.int32)  # places of windows, equal windows side by side
        self.groups = np.append(np.flatnonzero(np.diff(rank[order], prepend=-1)), len(order))
        self.lengths = np.minimum(window, np.repeat(sizes, counts))[order][self.groups[:-1]]

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * self.base + b) * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def ids(self, text: str | None) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in word_list(text)], np.int32)

    def suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a window could begin, sorted by all words from there on, and the first words of each."""
        n, known, wide = len(text), text > 0, text.astype(np.int64)
        good = np.append(known[:-1] & known[1:] & self.pairs[self._slot(wide[:-1], wide[1:])], False)
        stops = np.flatnonzero(~good)
        run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) + 1  # words in a row of pairs from here on
        run[~known] = 0
        begins = np.flatnonzero(run >= max(1, self.least))
        if not len(begins):
            return begins, np.empty(0, f"S{4 * self.window}")
        # a suffix goes on a window further in another of these, or in the end of its row
        at = np.union1d(begins, (begins + self.window)[run[begins] > self.window])
        left = run[at]
        padded = np.concatenate([text, np.zeros(self.window, text.dtype)])
        rows = np.where(np.arange(self.window) < left[:, None], np.lib.stride_tricks.sliding_window_view(padded, self.window)[at], 0)
        keys = self._keys(rows)
        rank, step = np.unique(keys, return_inverse=True)[1], self.window
        while (more := left > step).any() and rank.max() < len(at) - 1:
            after = np.zeros(len(at), np.int64)
            after[more] = rank[np.searchsorted(at, at[more] + step)] + 1
            rank, step = np.unique(rank * (len(at) + 1) + after, return_inverse=True)[1], 2 * step
        mine = np.searchsorted(at, begins)
        order = mine[np.argsort(rank[mine], kind="stable")]
        return at[order], keys[order]

    def places(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of windows, as places, and the range of them that belongs to each window."""
        places, keys = self.suffix_array(text)
        found, hits = [], np.zeros(len(self.lengths), np.int64)
        suffix = np.lib.stride_tricks.sliding_window_view(self.bench, self.window) if len(self.lengths) else None
        for k in range(0, len(self.lengths) if len(places) else 0, AT_ONCE):
            part = slice(k, k + AT_ONCE)
            low = suffix[self.members[self.groups[:-1][part]]]
            first = np.searchsorted(keys, self._keys(low), "left")
            inside = np.arange(self.window) < self.lengths[part, None]
            last = np.searchsorted(keys, self._keys(np.where(inside, low, -1)), "right")
            hits[part] = n = last - first
            found.append(places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
        ends = np.cumsum(hits)
        return np.concatenate(found) if found else np.empty(0, np.int64), ends - hits, hits

    def search(self, lists: list[np.ndarray], longest: bool = True) -> list[dict]:
        """For each text of a shard: words hit, their spans, and the longest match with each item."""
        found = [{"n_words": len(x), "n_hit": 0, "spans": [], "matches": []} for x in lists]
        if not len(self.lengths) or not lists:
            return found
        ends = np.cumsum([len(x) + 1 for x in lists])
        starts = ends - np.array([len(x) + 1 for x in lists])
        text = np.concatenate([np.append(x, np.int32(0)) for x in lists])
        place, first, hits = self.places(text)
        if not len(place):
            return found
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + np.repeat(self.lengths, hits), -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
        for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
            d = int(np.searchsorted(ends, a, "right"))
            found[d]["n_hit"] += b - a
            found[d]["spans"].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
        if longest:
            for d, item, n, at in self._longest(text, ends, place, first, hits):
                found[d]["matches"].append({"item": self.names[item], "at": at - int(starts[d]), "words": n})
        return found

    def _longest(self, text: np.ndarray, ends: np.ndarray, place: np.ndarray, first: np.ndarray, hits: np.ndarray) -> list[tuple[int, ...]]:
        """(text, item, words, place) of the longest match of each text with each item, the first of equals."""
        padded = np.concatenate([text, np.zeros(STRIDE, text.dtype)])
        before_text, before_item = np.append(np.int32(0), text), np.append(np.int32(0), self.bench)
        members = np.diff(self.groups)
        best = np.empty((0, 4), np.int64)
        window = np.repeat(np.flatnonzero(hits), hits[hits > 0])  # a row an occurrence
        own = place[np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(first, hits)]
        weight = np.cumsum(members[window])
        at = 0
        while at < len(window):
            to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            w, n = window[at:to], members[window[at:to]]
            p = np.repeat(own[at:to], n)
            q = self.members[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.groups[w], n)].astype(np.int64)
            size = np.repeat(self.lengths[w], n)
            opens = (before_text[p] != before_item[q]) | (before_text[p] == 0)  # else the match began a word earlier
            p, q, size = p[opens], q[opens], size[opens].copy()
            going = np.arange(len(p))
            while len(going):
                a = np.lib.stride_tricks.sliding_window_view(padded, STRIDE)[p[going] + size[going]]
                b = np.lib.stride_tricks.sliding_window_view(self.bench, STRIDE)[np.minimum(q[going] + size[going], len(self.bench) - STRIDE)]
                differ = (a != b) | (a == 0)
                far = np.where(differ.any(axis=1), differ.argmax(axis=1), STRIDE)
                size[going] += far
                going = going[far == STRIDE]
            item = self.owner[np.searchsorted(self.starts, q, "right") - 1]
            rows = np.stack([np.searchsorted(ends, p, "right"), item, size, p], axis=1)
            best = np.concatenate([best, rows])
            best = best[np.lexsort((best[:, 3], -best[:, 2], best[:, 1], best[:, 0]))]
            best = best[np.concatenate(([True], (np.diff(best[:, :2], axis=0) != 0).any(axis=1)))] if len(best) else best
            at = to
        return [tuple(r) for r in best.tolist()]


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash of the item."""
    slim = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        block = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [(r.item_id, r.text) for r in block.toLocalIterator()]


def _shards(batches: Iterator[pa.RecordBatch], text: int, searcher: Searcher, longest: bool = True) -> Iterator[tuple[list[pa.RecordBatch], list[dict]]]:
    held: list[pa.RecordBatch] = []
    lists: list[np.ndarray] = []
    words = 0
    for b in small_batches(batches):
        held.append(b)
        for t in b.column(text).to_pylist():
            lists.append(searcher.ids(t))
            words += len(lists[-1])
        if words >= SHARD_WORDS:
            yield held, searcher.search(lists, longest)
            held, lists, words = [], [], 0
    if held:
        yield held, searcher.search(lists, longest)


MATCHES = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, matches array<struct<item:string,at:bigint,words:bigint>>"
MATCH_TYPES = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("matches", pa.list_(pa.struct([("item", pa.string()), ("at", pa.int64()), ("words", pa.int64())])))]


def _scan(docs: DataFrame, items: list, window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, matches) of each row against one block of the benchmark."""
    held = docs.sparkSession.sparkContext.broadcast(Searcher(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, found in _shards(batches, 2, held.value):
            ids = pa.Table.from_batches(shard).select([0, 1]).combine_chunks()
            rows = pa.Table.from_pylist(found, schema=pa.schema(MATCH_TYPES))
            for n, column in enumerate(("doc_id", "text_hash")):
                rows = rows.add_column(n, column, ids.column(n))
            yield from rows.to_batches()

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id bigint, text_hash bigint, {MATCHES}")


def covered(spans: Column) -> Column:
    """Positions inside at least one of the spans."""
    step = lambda acc, s: F.struct(F.greatest(acc.end, s.end).alias("end"), (acc.n + F.greatest(F.lit(0).cast("bigint"), s.end - F.greatest(s.start, acc.end))).alias("n"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("end"), zero.alias("n")), step, lambda acc: acc.n)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words, the longest match with each item that has an occurring window."""
    scans = [_scan(docs, items, window) for items in benchmark_blocks(benchmark, block_bytes)] or [_scan(docs, [], window)]
    if len(scans) == 1:
        return scans[0].drop("text_hash")
    # equal rows are told apart by their number only, so they meet as one and part again
    parts = [s.withColumn("block", F.lit(k)) for k, s in enumerate(scans)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    one = all_.groupBy("doc_id", "text_hash", "block").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("matches").alias("matches"))
    met = one.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),  # a list per block
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return each_copy(met.select("doc_id", "n_words", "spans", "matches", "copies"), "copies").drop("copy")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The digest of ``benchmark_matches`` per document."""
    found = benchmark_matches(docs, benchmark, window, block_bytes)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m.item), lambda i: i.isNotNull())))
    return found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), items.alias("items"), "matches").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.words)), F.lit(0)).cast("bigint").alias("longest_match"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any word inside a window of the benchmark.

    With one block rows are dropped as they pass. With several each block marks rows by id
    and text hash in a scan of its own, so that a worker holds one block; the marks are met
    by a join at the end.
    """
    at = docs.columns.index("text")
    blocks = benchmark_blocks(benchmark, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is not None:
        scans = [_scan(docs, items, window).where(F.size("spans") > 0).select("doc_id", "text_hash") for items in chain([first, second], blocks)]
        marked = staged(reduce(DataFrame.unionByName, scans).distinct(), "contaminated", TEXT_BATCH_ROWS).toDF("_id", "_hash")
        return docs.join(marked, docs["doc_id"].cast("bigint").eqNullSafe(marked["_id"]) & (F.xxhash64(docs["text"]) == marked["_hash"]), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(Searcher(first, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, found in _shards(batches, at, held.value, longest=False):
            clean = np.array([not f["n_hit"] for f in found], bool)
            for b in shard:
                mine, clean = clean[: b.num_rows], clean[b.num_rows :]
                yield b.filter(pa.array(mine))

    return docs.mapInArrow(run, docs.schema)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
t AS (
  SELECT item, pos, m, array_to_string(w[pos : pos + m - 1], ' ') AS k
  FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS pos FROM (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0))
),
s AS (
  SELECT rid, pos, m, array_to_string(w[pos : pos + m - 1], ' ') AS k
  FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS pos FROM d, (SELECT DISTINCT m FROM t) WHERE len(w) >= m)
),
h AS (SELECT rid, s.pos, m, item, t.pos AS i_pos FROM s JOIN t USING (k, m)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(pos, pos + m - 1)) AS p FROM (SELECT DISTINCT rid, pos, m FROM h)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid),
runs AS (SELECT rid, max(len) AS longest FROM (
  SELECT rid, item, m, pos - i_pos AS diag, g, count(*) + m - 1 AS len
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, item, m, pos - i_pos ORDER BY pos) AS g FROM h) GROUP BY rid, item, m, diag, g) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN runs USING (rid)
"""
