"""SimHash near-duplicates: whole-text fingerprints and a self-join of their binary trie.

The join walks pairs of trie nodes down together, adds up the bits in which the two paths
differ, and drops a pair as soon as the sum exceeds the budget. Two fingerprints within
``budget`` bits agree fully in at least one of ``budget + 1`` blocks of bits, so the trie is
walked once per block with that block's bits leading: only equal leading bits share a
starting node, and each starting node is work that Spark can place anywhere. A starting node
with more than ``NODE_ROWS`` fingerprints, because there are many or because its bits are
common, is cut again in the same way by the bits that are left, and so on; where all of a
node agrees in one of the new blocks that block alone finds all of its pairs.

A trie over sorted fingerprints needs no pointers: a node is a range of the sorted array.
Within a task, ranges whose members are already linked are skipped, so a dense group of
n copies costs links in the order of n, not of n squared, and emits at most n of them.

Equal fingerprints are one node from the start, so exact copies never meet in a join.

Cases: a null, empty or blank text has fingerprint zero and links like any other. A row
with a null doc_id gets its group's component but names none; a group in which no row has
a doc_id has a null component. Repeated rows get equal results. Columns beyond doc_id and
text are ignored by ``simhash_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.storage import TEXT_BATCH_ROWS, small_batches, staged

SEED = 42
BITS = 64
#: Fingerprints that share a starting node, above which it is cut again.
NODE_ROWS = 1 << 14
#: Bits that are left in a node that isn't cut any more: it has 2^20 distinct fingerprints at most.
FREE_BITS = 20
#: A fingerprint of more than one row in so many is joined by broadcast.
HOT_PARTS = 1000
#: Node pairs that are walked at once in a task.
FRONTIER = 1 << 20
#: Ranges whose product of sizes is at most this are compared member by member.
LEAF = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is one if it is set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            prints = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _field(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(fp, at), BITS - width)


def leading(fp: Column, lead: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The key that the ``lead`` blocks form, and the fingerprint with these blocks moved to its front."""
    taken = sorted(lead)
    gaps, at = [], 0
    for a, w in [*taken, (BITS, 0)]:
        if a > at:
            gaps.append((at, a - at))
        at = a + w

    def packed(parts: list[tuple[int, int]]) -> tuple[Column, int]:
        out, used = F.lit(0).cast("bigint"), 0
        for a, w in parts:
            out, used = F.shiftleft(out, w).bitwiseOR(_field(fp, a, w)), used + w
        return out, used

    return packed(lead)[0], packed([*lead, *gaps])[0]


class Forest:
    """Components of positions 0 to n - 1, and which ranges lie within one component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mixed()

    def _mixed(self) -> None:
        change = np.empty(len(self.label), np.int64)
        change[:1] = 0
        np.cumsum(self.label[1:] != self.label[:-1], out=change[1:])
        self.change = change

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        if not len(u):
            return
        label = self.label
        while True:
            a, b = label[u], label[v]
            open_ = a != b
            if not open_.any():
                break
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
        self.label = label
        self._mixed()

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        c = self.change
        return (c[a1 - 1] == c[a0]) & (c[b1 - 1] == c[b0]) & (self.label[a0] == self.label[b0])


def trie_links(sorted_fps: np.ndarray, groups: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """The component label of every position after linking fingerprints within ``budget`` bits.

    ``sorted_fps``: uint64, sorted within each group; ``groups``: where each group begins,
    and the length at the end. All members of a group agree in their first ``depth`` bits.
    """
    n, forest = len(sorted_fps), Forest(len(sorted_fps))
    lo, hi = groups[:-1].astype(np.int64), groups[1:].astype(np.int64)
    stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    ones: dict[int, np.ndarray] = {}

    def split(bit: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate((np.zeros(1, np.int32), np.cumsum((sorted_fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int32)))
        return b - (ones[bit][b] - ones[bit][a])

    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        a0, a1, b0, b1, diff = pairs
        own = a0 == b0
        keep = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~(own & (a1 - a0 < 2))
        pairs = pairs[:, keep]
        pairs = pairs[:, ~forest.joined(*pairs[:4])]
        if not pairs.shape[1]:
            continue
        a0, a1, b0, b1, diff = pairs
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (bit == BITS)
        forest.link(*_compare(sorted_fps, pairs[:, small], budget))
        a0, a1, b0, b1, diff = pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        am, bm, own = split(bit, a0, a1), split(bit, b0, b1), a0 == b0
        cross = np.concatenate([np.stack([a0, am, bm, b1, diff + 1]), np.stack([am, a1, b0, bm, diff + 1])[:, ~own]], axis=1)
        same = np.concatenate([np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff])], axis=1)
        stack += [(bit + 1, cross), (bit + 1, same)]
    return forest.label


def _compare(fps: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked positions among the members of small node pairs."""
    a0, a1, b0, b1, _ = pairs
    sizes = (a1 - a0) * (b1 - b0)
    found_u, found_v = [], []
    for at in _slices(sizes):
        s, wide = sizes[at], (b1 - b0)[at]
        which = np.repeat(np.arange(len(s)), s)
        k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        u, v = a0[at][which] + k // wide[which], b0[at][which] + k % wide[which]
        near = (u != v) & (np.bitwise_count(fps[u] ^ fps[v]) <= budget)
        found_u.append(u[near])
        found_v.append(v[near])
    return (np.concatenate(found_u), np.concatenate(found_v)) if found_u else (np.empty(0, np.int64),) * 2


def _slices(sizes: np.ndarray, most: int = 1 << 22) -> Iterator[slice]:
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _blocks(depth: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` blocks (offset, width) of the bits after the first ``depth``, with the bits of each that a key takes."""
    parts = budget + 1
    width, more = divmod(BITS - depth, parts)
    return [(depth + k * width + min(k, more), width) for k in range(parts)]


def _cut(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """``rows(walk, moved, fp, only)`` in the walks of the next cut: (walk, key, moved, fp); ``only`` names a single one."""
    front = [(0, depth)] if depth else []
    walks = [F.struct(F.lit(k + 1).alias("k"), key.alias("key"), moved.alias("moved")) for k, (key, moved) in enumerate(leading(F.col("moved"), [*front, b]) for b in _blocks(depth, budget))]
    taken = F.filter(F.array(*walks), lambda w: F.col("only").isNull() | (w.k == F.col("only")))
    return rows.select("walk", "fp", F.explode(taken).alias("w")).select((F.col("walk") * (budget + 2) + F.col("w.k")).alias("walk"), "w.key", "w.moved", "fp")


def starting_nodes(prints: DataFrame, budget: int) -> tuple[DataFrame, int]:
    """(walk, key, moved, fp) of every starting node of ``prints(fp)``, and the leading bits that all of a node share."""
    front = prints.select(F.lit(0).cast("bigint").alias("walk"), F.col("fp").alias("moved"), "fp", F.lit(None).cast("int").alias("only"))
    depth, done = 0, []
    while True:
        rows = _cut(front, depth, budget)
        depth += _blocks(depth, budget)[0][1]
        if BITS - depth <= FREE_BITS:
            done.append(rows)
            break
        blocks = _blocks(depth, budget)
        same = [F.when(F.min(f) == F.max(f), k + 1) for k, f in enumerate(_field(F.col("moved"), a, w) for a, w in blocks)]
        hot = rows.groupBy("walk", "key").agg(F.count("*").alias("n"), F.coalesce(*same).alias("only")).where(F.col("n") > NODE_ROWS)
        hot = staged(hot.drop("n"), "hot-nodes")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, ["walk", "key"], "left_anti"))
        front = staged(rows.join(hot, ["walk", "key"]).select("walk", "moved", "fp", "only"), "hot-rows")
    return reduce(DataFrame.unionByName, done), _blocks(0, budget)[0][1]


def near_links(prints: DataFrame, budget: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)`` that connect all pairs within ``budget`` bits."""
    rows, depth = starting_nodes(prints, budget)
    ordered = rows.repartition("walk", "key").sortWithinPartitions("walk", "key", "moved")

    def linked(batch: pa.Table) -> pa.RecordBatch:
        walk, key, moved, fp = (batch.column(k).to_numpy() for k in range(4))
        begins = np.flatnonzero(np.concatenate(([True], (walk[1:] != walk[:-1]) | (key[1:] != key[:-1]))))
        root = trie_links(moved.view(np.uint64), np.append(begins, len(key)), depth, budget)
        far = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[root[far]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for b in batches:
            held, rows_held = [*held, b], rows_held + b.num_rows
            if rows_held >= max(1 << 18, 2 * (held[0].num_rows if len(held) > 1 else 0)):
                rows = pa.Table.from_batches(held).combine_chunks()
                walk, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                cut = int(np.flatnonzero((walk != walk[-1]) | (key != key[-1]))[-1]) + 1 if (walk[0], key[0]) != (walk[-1], key[-1]) else 0
                if cut:
                    yield linked(rows.slice(0, cut))
                held, rows_held = rows.slice(cut).to_batches(), 0
        if rows := pa.Table.from_batches(held) if held else None:
            if rows.num_rows:
                yield linked(rows.combine_chunks())

    # moved keeps its bits; signed order within a key equals unsigned order, for the key's bits lead
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _grouped(docs: DataFrame, width: int, budget: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; root names the group."""
    prints = staged(fingerprints(docs, width), "fingerprints", TEXT_BATCH_ROWS)
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(near_links(nodes.select("fp"), budget), "simhash-links").withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = staged(rooted.join(named, "root").select("fp", "root", "component_id", "n"), "components")
    # fingerprints that more than one row in HOT_PARTS has are fewer than that; their rows stay where they are
    total = prints.count()
    hot = F.broadcast(staged(by_print.where(F.col("n") * HOT_PARTS > total), "hot-components"))
    few = prints.join(hot.select("fp"), "fp", "left_anti").join(by_print, "fp")
    return prints.join(hot, "fp").unionByName(few).select("doc_id", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable over links."""
    return _grouped(docs, width, budget).drop("root")


def near_dedup(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """The rows of ``docs``, one for each near-duplicate group: the one with the least doc_id.

    Of a group's rows that repeat that doc_id one stays, with the least text, and of equal
    texts the one whose JSON is least; a doc_id on texts of several groups may stay for each
    that it leads. Rows with a null doc_id cannot be told apart by id and stay.
    """
    found = _grouped(docs, width, budget).where("doc_id IS NOT NULL")
    rows = found.groupBy("doc_id", "fp", "root", "component_id").agg(F.count("*").alias("n"))
    leads = F.col("component_id") == F.col("doc_id")
    own = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(leads).alias("leads"), F.collect_set(F.when(leads, F.struct("fp", "root"))).alias("groups"))
    state = staged(own.where("n > 1 OR NOT leads").select("doc_id", "leads", "groups"), "dropped")
    once = docs.join(state, docs["doc_id"].eqNullSafe(state["doc_id"]), "left_anti")
    signed = F.udf(lambda t: (f := fingerprint(t, width)) - (f >> 63 << 64), "bigint")
    led = state.where("leads").select(F.col("doc_id").alias("_id"), F.explode("groups").alias("_g")).select("_id", "_g.fp", "_g.root")
    again = docs.join(led.select("_id").distinct(), docs["doc_id"] == F.col("_id"), "left_semi")
    keyed = again.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"), signed("text").alias("_fp"))
    best = keyed.join(led, (F.col("_doc") == F.col("_id")) & (F.col("_fp") == F.col("fp"))).groupBy("_doc", "root").agg(F.min_by("_row", F.struct("_text", F.to_json("_row"))).alias("row"))
    return once.unionByName(best.select("row.*"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
