"""Suffix-array matches against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np

from sparkloom.llm import columns, decontaminate
from sparkloom.llm.decontaminate import contamination, remove_contaminated

UP = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(10, len(v))
        for k in range(len(v) - m + 1) if v else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(item)
    ids = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def sample():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["Aa", "b", "c1", "dé", "e"]) + rng.choice([" ", ",", "-"]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([25, 12, 10, 9, 3, 14])] + [(6, "Only"), (7, ""), (8, None), (2, "twice the same id with other words in it as well"), (None, "nameless item of seven words or so")]
    rare = [(i, t.replace("a", f"x{i} a")) for i, t in items[:6] if t]
    items = rare + items[6:]
    docs = [None, "", "...", say(300), "only", "nameless item of seven words or so"]
    docs += [say(30) + t[: rng.randrange(1, len(t) + 1)] + " " + say(30) for _, t in items if t] + [items[0][1] * 3, items[1][1] + "zz " + items[1][1]]
    return list(enumerate(docs)), items


def test_equals_brute_force_in_one_block_and_in_many(spark, monkeypatch):
    docs, items = sample()
    d = spark.createDataFrame(docs + [docs[6], docs[6]], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, items) for i, t in docs}
    for size, shard in ((1 << 20, 1 << 20), (200, 50)):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        rows = contamination(d, b, block_bytes=size).collect()
        assert len(rows) == len(docs) + 2
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
        kept = remove_contaminated(d, b, block_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in [*want, 6, 6] if not want[i][4])


def test_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, n_hit int, item_id string")
    none = spark.createDataFrame([], "item_id long, text string, doc_id long")
    assert [r.contaminated for r in contamination(docs, none).collect()] == [False]
    assert remove_contaminated(docs, none).columns == docs.columns
    items = spark.createDataFrame([(1, "a b c", 9)], "item_id long, text string, doc_id long")
    assert contamination(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in contamination(docs, items).collect()] == [3]
    assert remove_contaminated(docs, items).count() == 0


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x " + " ".join(f"w{i}" for i in range(4, 21)) + " y " + " ".join(f"w{i}" for i in range(11))
    docs, items = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    row = decontaminate.benchmark_matches(docs, items).first()
    assert [(m.item, m.at, m.words) for m in row.matches] == [("1", 1, 17)] and [(s.start, s.end) for s in row.spans] == [(1, 18), (19, 30)]


def longest_by_hand(text, items):
    """{item id: (words, first place)} of the longest runs of equal words that hold a window."""
    w, best = words(text), {}
    for item, t in items:
        v = words(t)
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= min(10, len(v)) and n > best.get(item, (0, 0))[0]:
                    best[item] = (n, p)
                elif n and n == best.get(item, (0, 0))[0] and p < best[item][1]:
                    best[item] = (n, p)
    return best


def test_longest_matches_and_places_equal_brute_force():
    docs, items = sample()
    rng = random.Random(9)
    long = [f"w{rng.randrange(9)}" for _ in range(150)]
    items = items + [(100, " ".join(long)), (101, " ".join(long[20:90])), (102, " ".join(long[:40] * 2))]
    texts = [t for _, t in docs] + [" ".join(long[5:140] + ["zz"] + long[30:60]), " ".join(long * 2), " ".join(long[80:91]), " ".join(long[:45] + long[100:])]
    for at_once in (1 << 20, 7):
        decontaminate.PAIRS_AT_ONCE, decontaminate.AT_ONCE = at_once, at_once
        s = decontaminate.Searcher(items)
        got = s.search([s.ids(t) for t in texts])
        for t, f in zip(texts, got):
            assert {m["item"]: (m["words"], m["at"]) for m in f["matches"]} == longest_by_hand(t, items)
    decontaminate.PAIRS_AT_ONCE, decontaminate.AT_ONCE = 1 << 20, 1 << 16


def test_the_array_is_sorted_by_whole_suffixes():
    rng = random.Random(3)
    item = [f"v{rng.randrange(3)}" for _ in range(400)]
    s = decontaminate.Searcher([(1, " ".join(item))])
    text = np.append(s.ids(" ".join(item + ["?"] + item[100:] + item[:200])), 0)
    places, _ = s.suffix_array(text)
    ends = np.flatnonzero(text == 0)
    suffix = lambda p: text[p : ends[np.searchsorted(ends, p)]].tolist()
    pairs = set(zip(item, item[1:]))
    assert len(pairs) == 9 and len(places) > 800 and [suffix(p) for p in places] == sorted(suffix(p) for p in places)


def test_a_full_block_takes_bounded_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 3000) % 200_000) for _ in range(800)]
    size = sum(map(len, texts))
    assert size > decontaminate.BLOCK_BYTES * 0.75
    tracemalloc.start()
    s = decontaminate.Searcher(list(enumerate(texts)))
    s.search([s.ids(t) for t in texts[:30]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_many_copies_over_several_blocks(spark, monkeypatch):
    docs, items = sample()
    monkeypatch.setattr(columns, "COPIES", 4)
    rows = docs[:9] + [docs[8]] * 22 + [(None, docs[7][1])] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = contamination(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=200).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(((i, *brute(t, items)) for i, t in rows), key=key)
