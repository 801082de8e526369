"""The search plan against plain Python, list by list."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkloom.operators import topk
from sparkloom.operators.retrieval import fetch_limit, text_candidates, text_candidates_with_fallback
from sparkloom.plans.search import SearchOptions, candidates, search


def plain_covers(terms, wanted):
    """Minimal spans that hold every wanted term, found by trying all."""
    at = [(k, t) for k, t in enumerate(terms) if t in wanted]
    spans = [(a, b) for a, (_, _) in enumerate(at) for b in range(a, len(at)) if {t for _, t in at[a : b + 1]} == wanted]
    best = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in best)


@given(st.lists(st.sampled_from("abcde"), max_size=25), st.sets(st.sampled_from("abc"), min_size=1))
def test_cover_rank_equals_brute_force(terms, wanted):
    at = [(k, t) for k, t in enumerate(terms) if t in wanted]
    got = topk.cover_rank([ord(t) for _, t in at], [k for k, _ in at], len(wanted))
    assert got == pytest.approx(plain_covers(terms, wanted))


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=6), max_size=12), st.integers(1, 4))
def test_running_top_k_equals_a_sort(batches, k):
    running, n, want = topk.Running(2, k), 0, [[], []]
    for scores in batches:
        ids = np.arange(n, n + len(scores))
        both = np.array([scores, [s - 3 if s > 2 else -np.inf for s in scores]], float)
        running.add(both, ids)
        if len(scores) == 3:
            running.best()
        n += len(scores)
        for q in range(2):
            want[q] += [(-s, i) for s, i in zip(both[q].tolist(), ids.tolist()) if s > -math.inf]
    q, score, ids = running.best()
    for k_ in range(2):
        assert list(zip((-score[q == k_]).tolist(), ids[q == k_].tolist())) == sorted(want[k_])[:k]


def corpus(rng):
    docs = {i: [rng.choice("abcdefgh") + rng.choice(["", "", "x"]) for _ in range(rng.randrange(0, 14))] for i in range(80)}
    vecs = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(70)}
    queries = {100: (["a", "b"], [1.0, 0.2, 0.0]), 101: (["cx"], None), 102: (["a", "b", "c", "d"], [0.0, -1.0, 0.5]), 103: ([], [0.3, 0.3, 0.3])}
    return docs, vecs, queries


def tables(spark, docs, vecs, queries):
    d = spark.createDataFrame(list(docs.items()), "id long, terms array<string>").repartition(3)
    v = spark.createDataFrame(list(vecs.items()), "id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(i, t, e, "show the table ab") for i, (t, e) in queries.items()], "query_id long, terms array<string>, embedding array<double>, text string")
    return d, v, q


def plain_text(docs, terms, k):
    wanted = set(terms)
    full = sorted((-round(plain_covers(t, wanted) + 1e-9, 6), i) for i, t in docs.items() if wanted and wanted <= set(t))[:k]
    some = sorted((-round(0.1 * sum(Counter(t)[w] for w in wanted), 6), i) for i, t in docs.items() if wanted & set(t))[:k]
    more = [] if len(full) >= max(3, k // 8) else [x for x in some if x[1] not in {i for _, i in full}]
    return [i for _, i in full + more], [i for _, i in full], [i for _, i in some]


@pytest.mark.parametrize("occurrences", [4, 1 << 16])
def test_text_lists(spark, monkeypatch, occurrences):
    monkeypatch.setattr(topk, "OCCURRENCES", occurrences)
    docs, vecs, queries = corpus(random.Random(5))
    d, _, q = tables(spark, docs, vecs, queries)
    asked = q.select("query_id", "terms")
    for n, found in enumerate((text_candidates_with_fallback(d, asked, 12), text_candidates(d, asked, 12, every=True), text_candidates(d, asked, 12))):
        got = {i: [] for i in queries}
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.id)
        assert got == {i: plain_text(docs, t, 12)[n] for i, (t, _) in queries.items()}


def plain_candidates(docs, vecs, query, options):
    terms, e = query
    cos = lambda a, b: round(max(0.0, sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))), 6)
    near = sorted((-cos(e, v), i) for i, v in vecs.items())[: options.fetch] if e else []
    text = plain_text(docs, terms, options.fetch)[0]
    rrf = Counter()
    for ranked in ([i for _, i in near], text):
        for n, i in enumerate(ranked):
            rrf[i] += 1 / (61 + n)
    sim = {i: -s for s, i in near}
    first = sorted((-round(s, 6), i) for i, s in rrf.items())[: options.fetch]
    return {i: (-s, sim.get(i)) for s, i in first if i in set(text) or i not in sim or sim[i] >= options.min_score}


def test_candidates_boosts_groups_and_context(spark):
    docs, vecs, queries = corpus(random.Random(6))
    d, v, q = tables(spark, docs, vecs, queries)
    options = SearchOptions(top_k=4)
    assert options.fetch == fetch_limit(4) == 48
    want = {i: plain_candidates(docs, vecs, x, options) for i, x in queries.items()}
    got = {i: {} for i in queries}
    for r in candidates(d, v, q, options).collect():
        got[r.query_id][r.id] = (r.rrf, r.sim)
    assert got == want
    chunk = lambda i: (i, i % 7, i // 7, f"text {i}", "table.md" if i % 3 else "x.md", "show, none" if i % 4 else None, "table" if i % 5 == 0 else "text")
    chunks = spark.createDataFrame([chunk(i) for i in docs], "id long, file_id long, chunk_index int, text string, name string, keywords string, kind string")
    score = lambda x, i: round(x + (0.12 if i % 4 else 0) + (0.15 if i % 5 == 0 else 0), 6)
    options = SearchOptions(top_k=4, keyword_boost=True, filename_boost=True, modality_boost=True, context_chunks=1)
    found = search(d, v, q, options, chunks=chunks).collect()
    best = {i: sorted((-score(s, k), k) for k, (s, _) in c.items())[:4] for i, c in want.items()}
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in found) == sorted((i, n + 1, k, -s) for i, b in best.items() for n, (s, k) in enumerate(b))
    assert all(r.context == "\n\n".join(f"text {k}" for k in (r.id - 7, r.id, r.id + 7) if k in docs) for r in found)
    grouped = search(d, v, q, SearchOptions(top_k=4, group_by_file=True), chunks=chunks).collect()
    files = {i: {} for i in queries}
    for i, c in want.items():
        for k, (s, _) in c.items():
            files[i].setdefault(k % 7, []).append((-s, k))
    assert {(r.query_id, r.file_id): (r.matched, r.snippets) for r in grouped} == {
        (i, f): (len(files[i][f]), [f"text {k}" for _, k in sorted(files[i][f])[:3]]) for i in queries for f in sorted(files[i], key=lambda f: (min(files[i][f])[0], f))[:4]
    }
    diverse = search(d, v, q, SearchOptions(top_k=4, diversify=True), chunks=chunks).collect()
    assert Counter(r.query_id for r in diverse) == Counter({i: min(4, len(c)) for i, c in want.items() for _ in range(min(4, len(c)))})
    with pytest.raises(ValueError):
        search(d, v, q, SearchOptions(diversify=True))
