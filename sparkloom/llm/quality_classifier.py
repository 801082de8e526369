"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of each whole text are computed once and staged (some 20 numbers a document).
The model is fitted on a bounded sample of labelled rows: at most about ``TRAIN_ROWS``,
picked by a hash of the doc_id and the statistics, after rows that are equal in both became
one; every document is scored. Random Fourier features of the
standardised statistics approximate a Gaussian kernel. Each of a fixed number of tasks
sums its part of the normal equations and sends one matrix of fixed size; the ridge system
is solved once. One labelled row in five is kept from the fit: on these rows the scores
are calibrated by isotonic regression over bins of raw score, so what reaches the driver
is bounded by the number of bins. Neither labels, lang, source nor doc_id enter a score.

Cases: a null text counts as empty and is scored like any other. Rows held out, or without
a doc_id or a label, teach nothing; several labels of one doc_id are averaged. With no
labels of use every score is 0.5. Repeated rows get equal results; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import TEXT_BATCH_ROWS, small_batches, staged

TRAIN_ROWS = 200_000
TASKS = 16
BINS = 1000
SYMBOLS = np.array([chr(b) in "#*$%&|<>~^_=+@\\{}[]" for b in range(256)])
UPPER = np.array([65 <= b <= 90 for b in range(256)])
DIGIT = np.array([48 <= b <= 57 for b in range(256)])
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "exclaims", "pipes", "stops", "commas", "distinct_words",
    "repeated_lines", "log_line", "short_lines", "ended_lines", "non_ascii", "top_word", "log_longest", "letterless", "entropy",
)


def statistics(text: str | None) -> list[float]:
    """The numbers ``NAMES`` of a whole text."""
    data = (text or "").encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words = max(1, len(data)), data.split()
    lines = [x for x in (x.strip() for x in data.split(b"\n")) if x]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    n_words, n_lines, letters = max(1, len(words)), max(1, len(lines)), max(1, int(count[LETTER].sum()))
    share = count[count > 0] / n
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        (len(data) - int(count[SPACE].sum())) / n_words,
        count[UPPER].sum() / letters,
        count[DIGIT].sum() / n,
        count[SYMBOLS].sum() / n,
        count[33] / n_words,
        count[124] / n_words,
        (count[46] + count[63]) / n_words,
        count[44] / n_words,
        len(tally) / n_words,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        np.log1p(len(data) / n_lines),
        sum(len(x) < 20 for x in lines) / n_lines,
        sum(x[-1:] in b".!?" for x in lines) / n_lines,
        count[128:].sum() / n,
        max(tally.values(), default=0) / n_words,
        np.log1p(max(map(len, tally), default=0)),
        sum(k for w, k in tally.items() if not w.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) / n_words,
        float(-(share * np.log(share)).sum()) if len(data) else 0.0,
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [[float(v) for v in statistics(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, x array<double>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's decimal digits, modulo 3; a remainder of 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


@dataclass
class Model:
    """Everything that a score needs; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.concatenate([np.ones((len(x), 1)), waves], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0) if len(self.knots) else np.full(len(x), 0.5)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points sorted by x: the centres and the rising values of the pools."""
    pools: list[list[float]] = []
    for a, v, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        pools.append([a * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, len(NAMES)))


def fit(known: DataFrame, features: int = 256, ridge: float = 1e-3, seed: int = 11) -> Model:
    """The model from ``known(doc_id, x, y)``, labelled rows that may be learned from."""
    n = known.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    picked = staged(known.where(F.pmod(F.xxhash64("doc_id", "x", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)), "training")
    d, random = len(NAMES), np.random.default_rng(seed)
    empty = Model(np.zeros(d), np.ones(d), random.normal(size=(d, features)) / np.sqrt(d), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.empty(0), np.empty(0))
    moments = picked.agg(*(f(F.get("x", F.lit(k))) for k in range(d) for f in (F.avg, F.stddev_pop))).first()
    if moments[0] is None:
        return empty
    empty.mean, empty.scale = np.array(moments[0::2]), np.maximum(np.array(moments[1::2]), 1e-6)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((features + 1, features + 2))
        for b in batches:
            z, y = empty.features(_matrix(b, "x")), b.column("y").to_numpy()
            a += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["sums"])

    parts = picked.where(~calibrates).repartition(TASKS, F.xxhash64("doc_id", "x")).mapInArrow(equations, "sums binary")
    total = sum(np.frombuffer(r.sums).reshape(features + 1, -1) for r in parts.toLocalIterator())
    a, b = total[:, :-1], total[:, -1]
    penalty = ridge * max(1.0, a[0, 0]) / features * np.eye(features + 1)
    penalty[0, 0] = 0
    empty.beta = np.linalg.lstsq(a + penalty, b, rcond=None)[0]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(empty.raw(_matrix(b, "x"))), b.column("y")], names=["r", "y"])

    scored = picked.where(calibrates).select("x", "y").mapInArrow(raw, "r double, y double")
    bins = scored.groupBy(F.round(F.least(F.lit(2.0), F.greatest(F.lit(-1.0), "r")) * BINS).cast("int").alias("bin")).agg(F.avg("r"), F.avg("y"), F.count("*"))
    points = np.array(sorted(tuple(map(float, r[1:])) for r in bins.toLocalIterator())).reshape(-1, 3)
    empty.knots, empty.values = isotonic(*points.T)
    return empty


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    stats = staged(text_statistics(docs), "statistics", TEXT_BATCH_ROWS)
    marks = labels.where(labels["quality"].isNotNull()).groupBy(labels["doc_id"].cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("y"))
    once = stats.where((remainder(F.col("doc_id")) != 1) & F.col("doc_id").isNotNull()).groupBy("doc_id", "x").agg(F.count("*").alias("copies")).drop("copies")
    known = once.join(marks, "doc_id")
    model = spark.sparkContext.broadcast(fit(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(_matrix(b, "x")))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double").withColumn("score", F.round("score", 6))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
