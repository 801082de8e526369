"""The replay of filters against a plain loop over orders and documents."""

import re
from collections import Counter
from itertools import permutations

from sparkloom.llm.filter_audit import document_flags, filter_audit, replay

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(rows):
    """(part, letters) of each row (doc_id, text, lang)."""
    out = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        bad += "E" * any(doc_id is not None and i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)
        out.append((lang or "", set(bad)))
    return out


def brute(rows, labels):
    out = Counter()
    parts = set()
    removed = Counter()
    for (doc_id, _, _), (part, bad) in zip(rows, failing(rows)):
        parts.add(part)
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, order, step)
                if f in bad and not gone:
                    gone = True
                    out[key, "removed"] += 1
                    out[key, "good_lost"] += good
                    out[key, "toxic_lost"] += toxic
                    removed[part, f] += 1
                elif f in bad:
                    out[key, "redundant"] += 1
                out[key, "kept"] += not gone
                out[key, "unique_fails"] += bad == {f}
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, o, s): (*(out[(p, o, s), c] for c in columns), removed[p, o[s - 1]]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def text(n, spread=1000, extra=""):
    return " ".join(f"w{i % spread}" for i in range(n)) + extra


ROWS = [
    (1, text(250), "en"), (2, text(250), "en"), (3, text(250, 20), "en"), (4, text(10, 3, " #"), "de"), (5, None, None), (6, "", ""), (7, "", "en"), (8, " \t\n", "en"),
    (9, text(199), "en"), (10, text(200), "en"), (11, "ABC " * 300, "de"), (12, text(250, 125), "en"), (13, text(250, 124), "en"), (14, text(300, 1000, " A|B"), "de"),
    (1, text(250), "en"), (None, text(250), "en"), (None, "only", None), (15, text(30_000, 29_000, " %"), "fr"), (16, "ÀÉ " * 210, "fr"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, 0), (11, None, 1), (14, 1, None), (None, 1, 1), (99, 1, 1)]
COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit(docs, labels)
    assert found.count() == 600 * len({r[2] or "" for r in ROWS})
    assert got(found) == brute(ROWS, LABELS)


def test_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, part string, failed int, quality int, label_id long, keep_id long, bits int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], schema), labels).count() == 0
    rows = [(i, t, lang, "x", 1, 1, 1, 1, 1) for i, t, lang in ROWS[:8]]
    assert got(filter_audit(spark.createDataFrame(rows, schema), labels)) == brute([r[:3] for r in rows], [])


def test_a_hot_text_and_part(spark):
    rows = [(i, "same text" if i % 3 else text(i % 7 + 197), "en" if i % 3 else "xx") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert got(filter_audit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int"))) == brute(rows, [(i, i % 2, 0) for i in range(300)])


def test_flags_and_other_numbers_of_filters(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = Counter((part, sum(1 << "ABCDE".index(x) for x in bad)) for part, bad in failing(ROWS))
    assert Counter((r.part, r.failed) for r in document_flags(docs, labels).collect()) == want
    flags = spark.createDataFrame([("p", 3, True, False), ("p", 2, False, False), ("p", 0, False, False)], "part string, failed int, good boolean, toxic boolean")
    assert got(replay(flags, "XY")) == {("p", "XY", 1): (2, 1, 0, 0, 1, 0, 1), ("p", "XY", 2): (1, 1, 1, 1, 0, 0, 3), ("p", "YX", 1): (1, 2, 0, 1, 1, 0, 3), ("p", "YX", 2): (1, 0, 1, 0, 0, 0, 1)}
