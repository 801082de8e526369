"""Search that goes on from its hits, step by step against plain Python."""

import json
import math
import random
from collections import Counter, defaultdict

from test_search import corpus, plain_text, tables

from sparkloom.operators.graph import expand_by_entities
from sparkloom.operators.retrieval import text_candidates_with_fallback, vector_candidates
from sparkloom.plans.recall import Related, cached_search, related_search
from sparkloom.plans.search import SearchOptions, candidates, funnel, search
from sparkloom.sources.versioned import QueryCache

K = 5


def cosine(a, b):
    return round(max(0.0, sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))), 6)


def plain_hybrid(docs, vecs, query, k, files=None, hybrid=True, least=0.35):
    """(id, score) of the best k, in the given files."""
    terms, e = query
    inside = lambda i: files is None or i % 7 in files
    sims = {i: cosine(e, v) for i, v in vecs.items() if inside(i)} if e else {}
    near = sorted(sims, key=lambda i: (-sims[i], i))[:60]
    text = plain_text({i: t for i, t in docs.items() if inside(i)}, terms, 60)[0] if hybrid else []
    rrf = Counter()
    for ranked in (near, text):
        for n, i in enumerate(ranked):
            rrf[i] += 1 / (61 + n)
    first = sorted(rrf, key=lambda i: (-round(rrf[i], 6), i))[:60]
    kept = [i for i in first if i in text or i not in sims or sims[i] >= least]
    score = {i: round(rrf[i], 6) if hybrid else sims[i] for i in kept}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def merge(items, fresh, step):
    best = {}
    for i, f, s, o, n in items + [(i, f, s, step, n) for i, f, s, n in fresh]:
        if (i, f) not in best or (-s, n) < (-best[i, f][2], best[i, f][4]):
            best[i, f] = (i, f, s, o, n)
    return sorted(best.values(), key=lambda x: (-x[2], x[4], -1 if x[0] is None else x[0], x[1]))[:K]


def plain_related(docs, vecs, query, t):
    items = [(i, i % 7, s, "search", 0) for i, s in plain_hybrid(docs, vecs, query, K)]
    seeds = list(dict.fromkeys(f for _, f, *_ in items))[:3]
    mine = {f for _, f, *_ in items}
    place = {}
    for f in seeds:
        for d in sorted({d for s, d in t["links"] if s == f} - mine):
            place.setdefault(d, len(place))
    near = list(place)[:8]
    found = plain_hybrid(docs, vecs, query, K, set(near), hybrid=False) if near else []
    fresh = [(i, i % 7, round(s * 0.92 + 1e-9, 4), 1) for i, s in found] or [(f, f, 0.414, 1) for f in near if f < 7]
    items = merge(items, fresh, "links")
    seeds = list(dict.fromkeys(f for _, f, *_ in items))[:3]
    by_file = defaultdict(set)
    for f, tag in t["tags"]:
        by_file[f].add(tag)
    own = set().union(*(by_file[f] for f in seeds))
    pairs = Counter((a, b) for tags in by_file.values() for a in tags & own for b in tags if a != b)
    best = {}
    for (_, b), n in pairs.items():
        if n >= 2:
            best[b] = max(best.get(b, 0), n)
    tags = sorted(best, key=lambda x: (-best[x], x))[:5]
    near = {f for f in by_file if by_file[f] & set(tags)} - {f for _, f, *_ in items}
    items = merge(items, [(i, i % 7, round(s * 0.9 + 1e-9, 4), 2) for i, s in plain_hybrid(docs, vecs, query, K, near)] if near else [], "tags")
    top = items[:3]
    named = {e for f, c, e in t["entities"] if (c, f) in {(i, f) for i, f, *_ in top}}
    known = {i for i, *_ in items}
    near = sorted({c for f, c, e in t["entities"] if f in {f for _, f, *_ in top} and e in named} - {i for i, *_ in top})[:8]
    items = merge(items, [(c, c % 7, 0.405, 3) for c in near if c not in known], "entities")
    at = defaultdict(set)
    for e, c, x in t["events"]:
        at[e].add(x)
    chunk = {e: c for e, c, _ in t["events"]}
    seen = {e: 0 for e in at if chunk[e] in {i for i, *_ in items[:3]}}
    for h in (1, 2):
        reach = set().union(*(at[e] for e in seen if seen[e] == h - 1), set())
        seen |= {e: h for e in at if e not in seen and at[e] & reach}
    first = sorted(seen, key=lambda e: (seen[e], e))[:50]
    known = {i for i, *_ in items}
    items = merge(items, [(chunk[e], chunk[e] % 7, 0.396, 4) for e in first if seen[e] and chunk[e] not in known], "events")
    children = defaultdict(float)
    for i, _, s, *_ in items:
        for a, b in t["children"]:
            if a == i:
                children[b] = max(children[b], round(s * 0.95 + 1e-9, 4))
    items = merge(items, [(c, c % 7, s, 5) for c, s in sorted(children.items(), key=lambda x: (-x[1], x[0]))[:K]], "children")
    terms, e = query
    hits = sorted(((-cosine(e, v), r, f, c) for r, f, c, v in t["representations"]))[:K] if e else []
    known, files = {i for i, *_ in items}, {f for _, f, *_ in items}
    fresh = [(c, f, -s, 6) for s, _, f, c in hits if c is not None and c not in known and c in docs]
    fresh += [(None, f, max(-s for s, _, g, c in hits if c is None and g == f), 6) for f in sorted({f for _, _, f, c in hits if c is None} - files)]
    return [x[:4] for x in merge(items, fresh, "representations")]


def case(spark, rng):
    docs, vecs, queries = corpus(rng)
    d, v, q = tables(spark, docs, vecs, queries)
    t = {
        "links": [(rng.randrange(7), rng.randrange(9)) for _ in range(12)],
        "tags": [(rng.randrange(7), rng.choice("pqrstu")) for _ in range(16)],
        "entities": [(i % 7, i, rng.randrange(12)) for i in docs for _ in range(2)],
        "events": [(1000 + i, i, rng.randrange(60)) for i in docs for _ in range(2)],
        "children": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "representations": [(500 + n, n % 7, rng.choice([None, n % 7 + 7 * rng.randrange(11)]), [rng.gauss(0, 1) for _ in range(3)]) for n in range(20)],
    }
    types = {"links": "src long, dst long", "tags": "file_id long, tag string", "entities": "file_id long, chunk_id long, entity long", "events": "event long, chunk_id long, entity long", "children": "chunk_id long, child_id long", "representations": "id long, file_id long, chunk_id long, embedding array<double>"}
    frames = {name: spark.createDataFrame(t[name], types[name]).repartition(2) for name in t}
    chunks = spark.createDataFrame([(i, i % 7, i // 7, f"text {i}", "n", "k", "text") for i in docs], "id long, file_id long, chunk_index int, text string, name string, keywords string, kind string")
    own = lambda df: df.withColumn("file_id", (df["id"] % 7).cast("long"))
    return docs, vecs, queries, own(d), own(v), q, chunks, t, frames


def test_every_step_equals_plain_python(spark):
    for seed in (1, 2):
        docs, vecs, queries, d, v, q, chunks, t, frames = case(spark, random.Random(seed))
        got = defaultdict(list)
        for r in related_search(d, v, q, chunks, Related(**frames), SearchOptions(top_k=K)).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.file_id, r.score, r.origin))
        want = {i: plain_related(docs, vecs, x, t) for i, x in queries.items()}
        assert dict(got) == {i: w for i, w in want.items() if w}
    assert {o for w in want.values() for *_, o in w} >= {"links", "representations"}


def test_scoped_lists_and_tagged_files(spark):
    docs, vecs, queries, d, v, q, chunks, _, _ = case(spark, random.Random(3))
    files = {100: [1, 2], 101: [3], 102: [0, 5, 6]}
    within = spark.createDataFrame([(i, f) for i, fs in files.items() for f in fs] + [(102, None)], "query_id long, file_id long")
    options = SearchOptions(top_k=K)
    got = defaultdict(dict)
    for r in candidates(d, v, q, options, within=within).collect():
        got[r.query_id][r.id] = r.rrf
    assert dict(got) == {i: dict(plain_hybrid(docs, vecs, queries[i], 1000, set(fs))) for i, fs in files.items() if plain_hybrid(docs, vecs, queries[i], 1000, set(fs))}
    nothing = within.where("file_id > 99")
    assert vector_candidates(v, q.where("embedding IS NOT NULL").select("query_id", "embedding"), 5, nothing).count() == 0
    assert text_candidates_with_fallback(d, q.select("query_id", "terms"), 5, nothing).count() == 0
    tagged = spark.createDataFrame([(101, f) for f in range(9)], "query_id long, file_id long")
    found = {r.id: r.score for r in search(d, v, q, SearchOptions(top_k=50), chunks=chunks, tagged=tagged).where("query_id = 101").collect()}
    plain = dict(plain_hybrid(docs, vecs, queries[101], 1000))
    assert found == plain | {f: 0.45 for f in range(7) if f not in {i % 7 for i in plain}}


def test_what_may_not_be_read_is_neither_found_nor_followed(spark):
    docs, _, _, d, v, q, chunks, _, frames = case(spark, random.Random(4))
    readable = spark.createDataFrame([(i,) for i in docs if i % 7 != 2 and i % 3], "id long")
    found = related_search(d, v, q, chunks, Related(**frames), SearchOptions(top_k=K), readable).collect()
    assert found and all(r.file_id % 7 != 2 and (r.id is None or r.id % 3) for r in found)


def test_hops_over_hub_entities_are_cut_without_changing_the_first(spark):
    rng = random.Random(5)
    at = {e: {rng.choice([0, 0, 0, rng.randrange(1, 40)]), rng.randrange(40)} for e in range(120)}
    seeds = {q: {rng.randrange(120) for _ in range(3)} for q in range(6)}
    mentions = spark.createDataFrame([(e, x) for e, xs in at.items() for x in xs], "event long, entity long")
    asked = spark.createDataFrame([(q, e) for q, es in seeds.items() for e in es], "query_id long, event long")
    for most in (4, 10, 500):
        want = set()
        for q, es in seeds.items():
            seen = {e: 0 for e in es}
            for h in (1, 2):
                reach = set().union(*(at[e] for e in seen if seen[e] == h - 1))
                seen |= {e: h for e in at if e not in seen and at[e] & reach}
            want |= {(q, e, seen[e]) for e in sorted(seen, key=lambda e: (seen[e], e))[:most]}
        assert {tuple(r) for r in expand_by_entities(asked, mentions, 2, most).collect()} == want


def test_funnel_counts_names_groups_and_access(spark):
    docs, vecs, queries, d, v, q, chunks, _, _ = case(spark, random.Random(6))
    readable = spark.createDataFrame([(i,) for i in docs if i % 3], "id long")
    some, near = {i: t for i, t in docs.items() if i % 3}, {i: e for i, e in vecs.items() if i % 3}
    named = chunks.drop("name").selectExpr("*", "CASE WHEN id % 2 = 0 THEN 'show the table ab.md' ELSE 'x' END AS name")
    for r in funnel(d, v, q, SearchOptions(top_k=K, filename_boost=True, group_by_file=True), readable, named).collect():
        kept = [i for i, _ in plain_hybrid(some, near, queries[r.query_id], 1000)]
        assert (r.after_access, r.after_min_score, r.filename_boosted) == (min(60, r.merged_unique), len(kept), sum(i % 2 == 0 for i in kept))
        assert r.after_mmr == r.after_rerank == r.final == min(K, len({i % 7 for i in kept}))


def test_the_cache_answers_before_the_search(spark, tmp_path):
    asked = spark.createDataFrame([(1, 1, "s", "one", [1.0, 0.0]), (2, 1, "s", "two", [0.0, 1.0]), (3, 2, "s", "one", [1.0, 0.0])], "query_id long, user_id long, scope string, query string, embedding array<double>")
    calls = []

    def answer(rest):
        calls.append(sorted(r.query_id for r in rest.collect()))
        return rest.where("query_id <> 2").selectExpr("query_id", "explode(array(2, 1)) AS rank", "query_id * 10 AS id")

    cache = QueryCache(spark, f"{tmp_path}/cache")
    first = {r.query_id: (r.cached, json.loads(r.payload)) for r in cached_search(cache, asked.where("query_id < 3"), "2024-01-01 00:00:00", answer).collect()}
    assert first == {1: (False, [{"rank": 1, "id": 10}, {"rank": 2, "id": 10}]), 2: (False, [])}
    again = {r.query_id: (r.cached, json.loads(r.payload)) for r in cached_search(cache, asked, "2024-01-01 01:00:00", answer).collect()}
    assert again == {1: (True, first[1][1]), 2: (True, []), 3: (False, [{"rank": 1, "id": 30}, {"rank": 2, "id": 30}])}
    assert calls == [[1, 2], [3]]
