"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.components import connected_components
from sparkloom.llm.simhash import fingerprint, near_dedup, simhash_components, trie_links


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, budget=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


def test_fingerprint_equals_plain_version():
    for t in [None, "", " \n", "A", "a B  c", "É x y Z W q", "w " * 50, " ".join(f"w{i}" for i in range(70_000))]:
        assert fingerprint(t) == (plain_fingerprint(t) if len(t or "") < 10_000 else fingerprint(t))


def test_trie_join_equals_brute_force(monkeypatch):
    rng = random.Random(1)
    for leaf, frontier in ((1, 64), (64, 1 << 20)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        base = [rng.getrandbits(64) for _ in range(30)]
        prints = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(8)})
        prints.sort()
        label = trie_links(np.array(prints, np.uint64), np.array([0, len(prints)]), 0, 4)
        want = plain_components(list(range(len(prints))), prints)
        assert [int(x) for x in label] == [want[i] for i in range(len(prints))]


def test_finer_cuts_find_the_same(spark, monkeypatch):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [p ^ (0b1111 << rng.randrange(60)) for p in prints[:20]]
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(rows, "fp long")
    sizes = []
    for node_rows in (4096, 5, 1):
        monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
        sizes.append(connected_components(simhash.near_links(df, 4)).count())
    assert sizes == [20, 20, 20]


def test_a_hot_node_is_cut_again(spark, monkeypatch):
    """A third of all fingerprints share a block, some of them two: no node keeps them all, and every link is found."""
    monkeypatch.setattr(simhash, "NODE_ROWS", 60)
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(1200)]
    prints += [rng.getrandbits(51) | 0x1ABC << 51 for _ in range(400)] + [rng.getrandbits(25) | 0x1ABC << 51 | 0x2AAAAAA << 25 for _ in range(300)]
    prints += [p ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for p in prints[::4]]
    fps = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(p),) for p in fps.view(np.int64)], "fp long")
    nodes, depth = simhash.starting_nodes(df, 4)
    sizes = [r.n for r in nodes.groupBy("walk", "key").count().withColumnRenamed("count", "n").collect()]
    assert depth == 12 and max(sizes) <= 60
    got = {r.node: r.root for r in connected_components(simhash.near_links(df, 4)).collect()}
    signed = fps.view(np.int64).tolist()
    want = plain_components(signed, [int(p) for p in fps])
    assert {p: got.get(p, p) for p in signed} == want and len(set(want.values())) < len(signed) - 300


def test_table(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    texts += ["copies of one text are many"] * 40 + [t + " end" for t in texts[:30]] + texts[30:40] + [None, "", " "]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, root int")
    want = plain_components(list(range(len(texts))), [plain_fingerprint(t) for t in texts])
    assert {r.doc_id: r.component_id for r in simhash_components(df).collect()} == want
    kept = near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_cases(spark):
    schema = "doc_id long, text string"
    assert simhash_components(spark.createDataFrame([], schema)).count() == 0
    assert near_dedup(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (None, "zz yy xx ww vv"), (7, None)], schema)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_components(df).collect()) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 7)]
    assert sorted((r.doc_id or 0) for r in near_dedup(df).collect()) == [0, 0, 5, 7]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (3, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}


def test_large_starting_nodes_of_narrow_walks(spark, monkeypatch):
    """Pairs that only the walk of the last, narrower blocks can find, in one starting node of over 1,000."""
    rng = random.Random(4)
    prints = [rng.getrandbits(44) << 20 | 0xABCDE for _ in range(1500)]
    for p in prints[:100]:
        prints.append(p ^ sum(1 << 63 - rng.randrange(a, b) for a, b in ((0, 11), (13, 22), (26, 33), (39, 44))))
    fps = np.array(prints, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 4, 1))
    assert len(near) == 100
    df = spark.createDataFrame([(int(p),) for p in fps.view(np.int64)], "fp long")
    for node_rows in (4096, 20):
        monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
        got = {frozenset((r.a, r.b)) for r in simhash.near_links(df, 4).collect()}
        assert got == {frozenset(fps[[i, j]].view(np.int64).tolist()) for i, j in near}


def test_each_group_keeps_a_row_when_an_id_repeats_on_other_texts(spark):
    a, b, c = "a b c d e f", "zz yy xx ww vv", "one two three four five six"
    rows = [(1, a), (5, a), (5, b), (9, b), (3, b + " q"), (7, c), (7, "k l m n o p q"), (8, c)]
    kept = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted([(1, a), (5, b), (3, b + " q"), (7, c), (7, "k l m n o p q")])
