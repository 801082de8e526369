"""Held-out accuracy, calibration and edge cases of the quality scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import quality_classifier
from sparkloom.llm.quality_classifier import NAMES, fit, isotonic, quality_scores, statistics, text_statistics


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85, auc


def test_isotonic_is_the_least_squares_rise():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0, 0.5, 1, 0.9]), np.ones(6))
    assert np.allclose(y, [0, 0.5, 0.95]) and np.allclose(x, [0, 2, 4.5])


def test_cases(spark):
    schema = "doc_id long, text string, score string, x int"
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    docs = spark.createDataFrame([(1, None, "s", 1), (1, "", "s", 1), (None, "a " * 200_000, None, None)], schema)
    assert [r.score for r in quality_scores(docs, none).collect()] == [0.5] * 3
    assert quality_scores(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, ""), (1, 0, ""), (None, 1, ""), (2, None, "")], "doc_id long, quality int, text string")
    assert quality_scores(docs, one).count() == 3
    assert all(np.isfinite(statistics(t)).all() for t in (None, "", " ", "\n\n", "é", "#" * 99))


def plain_statistics(text):
    """The numbers again, character by character."""
    t = text or ""
    data, words = t.encode(), [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", t.encode()) if w]
    lines = [x for x in (x.strip() for x in t.encode().split(b"\n")) if x]
    n, nw, nl = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    letter = [c for c in data if chr(c).isascii() and chr(c).isalpha() or c >= 128]
    tally = Counter(words)
    shares = [k / n for k in Counter(data).values()]
    mark = lambda s: sum(chr(c) in s for c in data)
    bare = [w for w in words if all(chr(c) in "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in w)]
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / nw, sum(65 <= c <= 90 for c in data) / max(1, len(letter)), mark("0123456789") / n,
        mark("#*$%&|<>~^_=+@\\{}[]") / n, mark("!") / nw, mark("|") / nw, mark(".?") / nw, mark(",") / nw, len(tally) / nw, 1 - len(set(lines)) / nl if lines else 0.0,
        math.log1p(len(data) / nl), sum(len(x) < 20 for x in lines) / nl, sum(x[-1:] in (b".", b"!", b"?") for x in lines) / nl, sum(c >= 128 for c in data) / n,
        max(tally.values(), default=0) / nw, math.log1p(max(map(len, words), default=0)), len(bare) / nw, -sum(p * math.log(p) for p in shares) if data else 0.0,
    ]


def test_statistics_equal_a_plain_count(spark):
    texts = [None, "", "A b, c. D!\n\n12 | #$\né É x?\na b", "w " * 50 + "\nEnd.", "=== ---\r\n\tq"]
    for t in texts:
        assert np.allclose(statistics(t), plain_statistics(t)), t
    got = {r.doc_id: r.x for r in text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(np.allclose(got[i], plain_statistics(t)) for i, t in enumerate(texts))


def test_summed_equations_fit_what_one_solve_over_all_rows_fits(spark):
    """Ridge over random features, and the calibration, from the rows in one place."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + k % 3) for k in range(len(NAMES))]) for i in range(600)]
    rows = [(i, x, float(x[0] + 0.5 * x[1] * x[1] > 0.3)) for i, x in rows]
    df = spark.createDataFrame(rows, "doc_id long, x array<double>, y double").repartition(5)
    model = fit(df, features=32, ridge=1e-3, seed=3)
    split = {r.doc_id: r.s for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(5)).alias("s")).collect()}
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    learns = np.array([split[r[0]] != 0 for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.features(x[learns])
    n = learns.sum()
    rest = np.sqrt(1e-3 * n / 32) * np.eye(33)[1:]
    want = np.linalg.lstsq(np.concatenate([z, rest]), np.concatenate([y[learns], np.zeros(32)]), rcond=None)[0]
    assert np.allclose(model.raw(x), model.features(x) @ want, atol=1e-6)
    r = model.raw(x[~learns])
    bins = np.round(np.clip(r, -1, 2) * 1000)
    points = sorted((r[bins == b].mean(), y[~learns][bins == b].mean(), (bins == b).sum()) for b in set(bins))
    v, w = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    rise = [max(min(mean(a, b) for b in range(k, len(v))) for a in range(k + 1)) for k in range(len(v))]  # max-min form of isotonic regression
    pools = [p for k, p in enumerate(rise) if k == 0 or p > rise[k - 1] + 1e-12]
    assert np.allclose(model.values, pools, atol=1e-6)


def test_a_third_of_all_rows_with_one_id(spark, monkeypatch):
    """They teach once for each text, and the sample stays within its bound."""
    monkeypatch.setattr(quality_classifier, "TRAIN_ROWS", 60)
    good, bad = "A calm sentence about the river and its banks. " * 4, "BUY $$$ now!!! *** click | click | click "
    rows = [(5, good)] * 300 + [(5, f"{good} {i}") for i in range(200)] + [(None, bad)] * 200 + [(i, good if i % 2 else bad) for i in range(10, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(5, 1), *((i, i % 2) for i in range(10, 310))], "doc_id long, quality int")
    sizes = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda known: (sizes.append((known.count(), known.where("doc_id = 5").count())), fit(known))[1])
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and sizes[0][1] in (0, 201) and sizes[0][0] <= 501
    assert len({r.score for r in got if r.doc_id is None}) == 1 and all(0 <= r.score <= 1 for r in got)
