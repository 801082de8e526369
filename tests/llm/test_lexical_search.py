"""Ranked search against a plain score of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from sparkloom.llm import lexical_search
from sparkloom.llm.lexical_search import Block, Corpus, Plan, frequencies, term_statistics, terms

UP = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(docs, items, k):
    cut = [(i, Counter(words(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in cut:
            m = 75 + 25 * c.total() * n_docs // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t]), doc))
        best = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(best, 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    """Documents over words of very unlike frequencies, with copies, empty and long ones."""
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(60)]
    docs += [(n + 100, None), (n + 101, ""), (n + 102, " .,! "), (n + 103, "Überall w1 w1,w1;w1 日本 é"), (n + 104, "w1 w2 w3 " * 5000), (None, docs[3][1]), (None, docs[3][1]), (5, docs[3][1])]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, "w1"), (31, "w1 w2 w1"), (32, None), (33, ""), (34, "nowhere"), (35, "日本 w399 É é über"), (30, "w7 w9"), (None, "w3 w11 w50"), (36, docs[3][1]), (37, " ".join(t for _, t in docs[:40]))]
    return docs, items


def search(spark, docs, items, parts=4, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return lexical_search.lexical_search(d, spark.createDataFrame(items, "item_id long, text string"), **more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus(random.Random(1), 400)
    for k, block, pairs in ((20, 1 << 22, 1 << 19), (3, 1500, 40)):
        monkeypatch.setattr(lexical_search, "PAIRS", pairs)
        assert rows(search(spark, docs, items, k=k, block_bytes=block)) == brute(docs, items, k)


def test_a_third_of_all_rows_alike(spark):
    rng = random.Random(2)
    docs = [(i, "hot words again" if i % 3 == 0 else f"hot w{rng.randrange(50)} words w{rng.randrange(9)}") for i in range(900)]
    items = [(1, "hot words"), (2, "hot w3"), (3, "again w7 w7"), (4, "words w4 w5 w6 hot")]
    assert rows(search(spark, docs, items, parts=7)) == brute(docs, items, 20)


def test_weak_terms_are_pruned_and_results_stay(spark):
    """A term that nearly all documents have makes no candidates beside rare ones that k documents have."""
    rng = random.Random(3)
    docs = [(i, " ".join(["the" if i % 6 else "this", f"x{i % 9}", *(f"y{rng.randrange(30)}" for _ in range(9))])) for i in range(600)]
    items = [(0, "the x3 y1"), (1, "the")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    block = Block([t for _, t in items])
    postings = frequencies(d, block.vocabulary)
    n_docs, n_terms = len(docs), sum(len(words(t)) for _, t in docs)
    found = Corpus(n_docs, n_terms)
    df, largest, kth = term_statistics(postings, found, len(block.vocabulary), 20)
    plan = Plan(block, found, df, largest, kth)
    the = block.vocabulary[b"the"]
    assert df[the] == 500 and plan.pruned >= 1 and plan.candidates[plan.at[the] : plan.at[the] + plan.n_items[the]].tolist() == [1]
    assert rows(search(spark, docs, items)) == brute(docs, items, 20)
    for t, k in block.vocabulary.items():
        each = sorted((int(found.impacts(np.array([c[t.decode()]]), np.array([c.total()]))[0]) for c in (Counter(words(x)) for _, x in docs) if c[t.decode()]), reverse=True)
        assert (df[k], largest[k], kth[k]) == (len(each), each[0], each[19] if len(each) >= 20 else 0)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x300), 0x65E5, 0x1F600])) for _ in range(rng.randrange(40)))
        assert [w.decode() for w in terms(t)] == words(t)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, n int, term string, tf int, item int, score int, rank int"
    one = [(1, "a b", 1, "x", 1, 1, 1, 1)]
    items = spark.createDataFrame([(1, "b", 1, 1, 1)], "item_id long, text string, item int, rank int, score int")
    assert lexical_search.lexical_search(spark.createDataFrame([], schema), items).count() == 0
    assert lexical_search.lexical_search(spark.createDataFrame(one, schema), items.limit(0)).count() == 0
    more = spark.createDataFrame(one * 2 + [(2, "c", *one[0][2:])], schema)
    assert rows(lexical_search.lexical_search(more, items)) == brute([(1, "a b")] * 2 + [(2, "c")], [(1, "b")], 20)
