"""Packing, and the placement of whole tables."""

import random
import zlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm import bin_packing
from sparkloom.llm.bin_packing import best_fit, pack, shard_slots, with_shards


def plain_best_fit(sizes, capacity):
    left, bins = [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(left) if r >= s]
        if not fits:
            left.append(capacity)
            fits = [(capacity, len(left) - 1)]
        _, k = min(fits)
        left[k] -= s
        bins.append(k)
    return bins, len(left)


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def one_by_one(segments):
    return [(s, b) for s, b, n in segments for _ in range(n)]


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 120))
def test_runs_go_where_plain_search_puts_each(sizes, capacity):
    sizes.sort(reverse=True)
    segments, opened = best_fit(runs_of(sizes), capacity)
    bins, n = plain_best_fit(sizes, capacity)
    assert one_by_one(segments) == list(zip(sizes, bins)) and opened == n


@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 9))
def test_pack_fills_no_more_than_the_bins(sizes, n):
    placed = one_by_one(pack(runs_of(sizes), n))
    assert sorted(s for s, _ in placed) == sorted(sizes) and {b for _, b in placed} <= set(range(n))


def check(rows, out, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_table(spark, monkeypatch):
    monkeypatch.setattr(bin_packing, "PART_ROWS", 20)
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 300) + str(rng.randrange(2000))) for i in range(3000)] + [(7, "same text")] * 700 + [(None, None), (1, ""), (1, None)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, shard int, key string").repartition(4)
    out = shard_slots(df, 6).collect()
    check(rows, out, 6)
    total = {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) < 1.02 * min(total.values())
    groups = {}
    for r in with_shards(df, 6).collect():
        groups.setdefault(r.text or "", set()).add(r.shard_)
    assert all(len(s) == 1 for s in groups.values())


def test_a_huge_group_stays_whole_and_alone(spark):
    rows = [(i, "same " * 50) for i in range(300)] + [(1000 + i, f"other text {i}") for i in range(400)]
    out = shard_slots(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, out, 4)
    home = {r.shard for r in out if r.doc_id < 1000}
    assert len(home) == 1 and not any(r.shard in home for r in out if r.doc_id >= 1000)
    assert len({r.shard for r in out}) == 4


def test_the_table_is_packed_as_plain_search_packs_it(spark):
    """A size that a third of all groups share is cut at keys; each bin gets the groups that best fit gives it."""
    rows = [(i, f"{i:04d}" + "x" * 100) for i in range(400)] + [(1000 + i, "y" * (i % 150) + str(i)) for i in range(800)] + [(3000 + i, "same") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = shard_slots(df, 5).collect()
    check(rows, out, 5)
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t) + 8
    want = Counter()
    for s, b, n in pack(runs_of(groups.values()), 5):
        want[b, s] += n
    text = dict(rows)
    home = {text[r.doc_id]: r.shard for r in out}
    assert Counter((home[t], s) for t, s in groups.items()) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_slots(df).count() == 0 and with_shards(df).columns == ["doc_id", "text", "shard"]
