"""Claim search from both ends against a plain search from one, with and without budgets."""

import random
from collections import defaultdict

import pytest

from sparkloom.operators.claim_search import claim_search, followed, identities, neighbourhood


def brute(claims, mentions, questions, fan_out, nodes, most_claims, paths):
    """Depth-first search over the whole graph, with the claims of the nodes that the budgets leave."""
    name = {m: f"e{e}" if e is not None else f"m{m}" for m, e, _ in mentions}
    members = defaultdict(set)
    for m, n in name.items():
        members[n].add(m)
    lists = defaultdict(set)
    for c, s, o in claims:
        if o is not None and s in name and o in name:
            lists[name[s]].add((c, name[o]))
            lists[name[o]].add((c, name[s]))
    lists = {n: sorted(x)[:fan_out] for n, x in lists.items()}
    out = []
    for q in {q for q, _ in questions}:
        starts = {}
        for a in {a for p, a in questions if p == q and a is not None}:
            of = sorted(m for m, _, s in mentions if s is not None and s.lower() == a.lower())[:fan_out]
            if of:
                starts[a] = {name[m] for m in of}
        cut = set()

        def first(have, wanted, most, reason):
            fresh = sorted(wanted - have)
            if len(have) + len(fresh) > most:
                cut.add(reason)
            return have | set(fresh[: max(0, most - len(have))])

        open_ = first(set(), set().union(*starts.values()) if starts else set(), nodes, "node_limit")
        ahead = {(n, c, b) for n in open_ for c, b in lists.get(n, [])}
        behind = {(a, c, n) for a, x in lists.items() for c, n in x if n in open_}
        loaded = first(set(), {c for _, c, _ in ahead | behind}, most_claims, "claim_limit")
        back = {(a, c, n) for a, c, n in behind if c in loaded}
        one = {(n, c, b) for n, c, b in ahead if c in loaded and n != b}
        open2 = first(open_, {b for _, _, b in one}, nodes, "node_limit")
        second = {(n, c, b) for _, _, n in one if n in open2 for c, b in lists.get(n, [])}
        second_paths = {(s, x, b, c1, c2) for s, c1, x in one for n, c2, b in second if n == x and b not in (s, x)}
        loaded2 = first(loaded, {p[4] for p in second_paths}, most_claims, "claim_limit")
        found = {}
        for a in starts:
            for b in starts:
                if a >= b:
                    continue

                def add(path, along):
                    several = any(len(members[n]) > 1 for n in along[:-1])
                    found[a, b, tuple(path)] = found.get((a, b, tuple(path)), False) or several

                for s, c1, x in one:
                    if s not in starts[a]:
                        continue
                    if x in starts[b]:
                        add([c1], [s, x])
                        continue
                    for y, c2, end in back:
                        if y == x and end in starts[b] and end not in (s, x):
                            add([c1, c2], [s, x, end])
                    for s2, x2, y, d1, c2 in second_paths:
                        if (s2, x2, d1) == (s, x, c1) and c2 in loaded2 and y not in starts[b]:
                            for z, c3, end in back:
                                if z == y and end in starts[b] and end not in (s, x, y):
                                    add([c1, c2, c3], [s, x, y, end])
        ranked = sorted((len(p), a, b, list(p), several) for (a, b, p), several in found.items())
        if len(ranked) > paths:
            cut.add("path_limit")
        out += [(q, a, b, n, p, several, k, sorted(cut)) for k, (n, a, b, p, several) in enumerate(ranked[:paths], 1)]
    return sorted(out)


def graph(seed, n_mentions, n_claims):
    rng = random.Random(seed)
    mentions = [(m, rng.randrange(n_mentions // 3) if rng.random() < 0.4 else None, f"Name {m % (n_mentions * 2 // 3)}") for m in range(n_mentions)]
    hub = lambda: 0 if rng.random() < 0.15 else rng.randrange(n_mentions + 2)
    claims = [(c, hub(), None if rng.random() < 0.05 else hub()) for c in range(n_claims)]
    questions = [(q, f"name {rng.randrange(n_mentions * 2 // 3)}") for q in range(12) for _ in range(3)] + [(50, "Nobody"), (50, "name 1"), (51, None)]
    return claims, mentions, questions


@pytest.mark.parametrize("budget", [(24, 300, 480, 50), (5, 1000, 10_000, 1000), (24, 6, 480, 50), (24, 300, 30, 50), (24, 300, 480, 3), (3, 12, 20, 4)])
def test_equals_brute_force(spark, budget):
    claims, mentions, questions = graph(budget[0] + budget[1], 60, 150)
    c = spark.createDataFrame(claims, "claim_id long, subject long, object long").repartition(3)
    m = spark.createDataFrame(mentions, "mention long, entity long, surface string")
    got = claim_search(c, m, spark.createDataFrame(questions, "question_id long, anchor string"), *budget).collect()
    assert sorted(tuple(r) for r in got) == brute(claims, mentions, questions, *budget)
    assert {x for r in got for x in r.truncated} >= ({"path_limit"} if budget[3] == 3 else set())


def test_a_bridge_joins_mentions_of_one_entity(spark):
    mentions = [(1, None, "Ann"), (2, 7, "IBM"), (3, 7, "I.B.M."), (4, None, "Bob")]
    claims = spark.createDataFrame([(10, 1, 2), (11, 3, 4)], "claim_id long, subject long, object long")
    asked = spark.createDataFrame([(1, "ann"), (1, "BOB")], "question_id long, anchor string")
    frame = lambda rows: spark.createDataFrame(rows, "mention long, entity long, surface string")
    assert [tuple(r) for r in claim_search(claims, frame(mentions), asked).collect()] == [(1, "BOB", "ann", 2, [11, 10], True, 1, [])]
    apart = [(m, None, s) for m, _, s in mentions]
    assert claim_search(claims, frame(apart), asked).count() == 0 and claim_search(claims.limit(0), frame(mentions), asked).count() == 0


def test_lists_are_made_for_anchors_and_their_neighbours_only(spark):
    mentions = spark.createDataFrame([(m, m // 2 if m < 4 else None, f"n{m}") for m in range(40)], "mention long, entity long, surface string")
    chain = [(100 + m, m, m + 1) for m in range(39)]
    claims = spark.createDataFrame([*chain, *chain, (99, 5, 5)], "claim_id long, subject long, object long")
    known = identities(mentions)
    near = neighbourhood(claims, known, spark.createDataFrame([("m5",)], "node string"))
    assert {r.node for r in near.collect()} == {"m4", "m5", "m6"}
    lists = {(r.a, r.claim_id, r.b) for r in followed(claims, known, near, 2).collect()}
    assert lists == {("m4", 103, "e1"), ("m4", 104, "m5"), ("m5", 99, "m5"), ("m5", 104, "m4"), ("m6", 105, "m5"), ("m6", 106, "m7")}
