"""An index of vectors: trained coarse lists, residual codes, exact re-ranking.

Vectors are normalised, so that the inner product is the cosine. Coarse centroids and the code
book of the residuals are trained on a hash-picked sample (``TRAIN_ROWS`` rows at most, a documented
bound); every vector is then indexed, in place: it belongs to the list of its nearest
centroid, and its residual is coded by one byte for each of a few subspaces. The index is a
table in folders by list, sorted by list, with codes and vectors in columns of their own.

A search takes queries in blocks. Each query probes its nearest lists; how many is measured when
the index is trained: as many as have ``MET`` of the neighbours of sample rows in the sample, so
vectors in groups need few and vectors without any order nearly all. Only the folders of
probed lists are opened, and only codes are read; a task keeps a running top-k of estimated
cosines, and no more than that many rows a query leave it. The best are scored exactly, by
reading the vectors of the lists they are in, and re-ranked. A list that a third of all
vectors share is many files and tasks.

Vectors that are null, of another length or without direction have similarity 0 to
everything; they stand in a list of their own, which is not probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.topk import Running, query_blocks, rows_at_once
from sparkloom.storage import small_batches, staged

#: Rows that centroids and code book are trained on, at most, and rounds of the training.
TRAIN_ROWS, ROUNDS = 20_000, 12
#: Lists at most, and vectors in a list, about.
MOST_LISTS, LIST_ROWS = 4096, 64
#: Sample rows that serve as queries when the number of probed lists is chosen, their neighbours, and the share of these to be met.
TRIALS, NEIGHBOURS, MET = 256, 10, 0.97
#: Numbers in a subspace, and words of its code book.
SUBSPACE, WORDS = 4, 256
#: Candidates that are scored exactly, for each wanted hit.
REFINED = 10
#: Vectors coded at once.
ROWS = 4096


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def batch_vectors(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of lists, and which rows have a direction."""
    v = np.zeros((len(column), d))
    whole = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == d
    v[whole] = column.filter(pa.array(whole)).flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, d)
    return unit(v), np.linalg.norm(v, axis=1) > 0


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of at most ``k`` groups of the rows; an empty group takes the row that is farthest from its own."""
    random = np.random.default_rng(seed)
    c = x[random.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T * 2 - (c * c).sum(1)).argmax(1) for part in np.array_split(x, max(1, len(x) // ROWS))])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-((x - c[near]) ** 2).sum(1))[: len(empty)]]
    return c


@dataclass
class Codes:
    """The trained part: of fixed size."""

    centroids: np.ndarray
    books: np.ndarray  # subspaces x words x numbers

    @classmethod
    def train(cls, x: np.ndarray, lists: int, seed: int) -> Codes:
        """From unit vectors ``x``."""
        centroids = k_means(x, lists, seed)
        rest = x - centroids[cls(centroids, np.empty(0)).nearest(x, 1)[:, 0]]
        parts = [rest[:, a : a + SUBSPACE] for a in range(0, x.shape[1], SUBSPACE)]
        books = np.zeros((len(parts), WORDS, SUBSPACE))
        for s, p in enumerate(parts):
            c = k_means(p, WORDS, seed + 1 + s)
            books[s, : len(c), : p.shape[1]] = c
            books[s, len(c) :] = books[s, 0]
        return cls(centroids, books)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, the nearest first."""
        score = 2 * x @ self.centroids.T - (self.centroids**2).sum(1)
        return np.argsort(-score, axis=1, kind="stable")[:, :n]

    def probes(self, x: np.ndarray, seed: int) -> int:
        """Lists to probe so that ``MET`` of the neighbours of rows of ``x`` in ``x`` are in them."""
        k = min(NEIGHBOURS, len(x) - 1)
        if k < 1:
            return len(self.centroids)
        tried = np.random.default_rng(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
        score = x[tried] @ x.T
        score[np.arange(len(tried)), tried] = -2
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(self.nearest(x[tried], len(self.centroids)), axis=1)  # of each list in a row's order
        own = self.nearest(x, 1)[:, 0]
        return int(np.quantile(np.take_along_axis(place, own[near], axis=1), MET, method="higher")) + 1

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest, out = x - self.centroids[lists], np.zeros((len(x), len(self.books)), np.uint8)
        for s, book in enumerate(self.books):
            p = np.zeros((len(x), SUBSPACE))
            part = rest[:, s * SUBSPACE : (s + 1) * SUBSPACE]
            p[:, : part.shape[1]] = part
            out[:, s] = (2 * p @ book.T - (book**2).sum(1)).argmax(1)
        return out

    def decode(self, codes: np.ndarray, n: int) -> np.ndarray:
        """What the codes of rows of list ``n`` stand for: one product with them is the sum of those of all subspaces."""
        words = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        return (self.centroids[n] + words[:, : self.centroids.shape[1]]).astype(np.float32)


class VectorIndex:
    """The index in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        kept = spark.read.parquet(f"{path}/codes").first()
        self.dimensions, self.lists, self.probes = kept.dimensions, kept.lists, kept.probes
        self.codes = Codes(np.frombuffer(kept.centroids).reshape(kept.lists, kept.dimensions), np.frombuffer(kept.books).reshape(-1, WORDS, SUBSPACE))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dimensions: int, seed: int = 7) -> VectorIndex:
        """Train on a sample of ``vectors(id, embedding)`` and index all of them."""
        spark, n = vectors.sparkSession, vectors.count()
        share = min(1.0, TRAIN_ROWS / max(1, n))
        picked = vectors.where(F.size("embedding") == dimensions).where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(TRAIN_ROWS)
        x = np.array([r.embedding for r in picked.select("embedding").toLocalIterator()], np.float64).reshape(-1, dimensions)
        x = unit(x[np.linalg.norm(x, axis=1) > 0])
        lists = max(1, min(MOST_LISTS, n // LIST_ROWS, len(x)))
        codes = Codes.train(x, lists, seed) if len(x) else Codes(np.zeros((1, dimensions)), np.zeros((-(-dimensions // SUBSPACE), WORDS, SUBSPACE)))
        row = (dimensions, len(codes.centroids), codes.probes(x, seed), codes.centroids.tobytes(), codes.books.tobytes())
        spark.createDataFrame([row], "dimensions int, lists int, probes int, centroids binary, books binary").coalesce(1).write.parquet(f"{path}/codes")
        cls(spark, path).add(vectors)
        return cls(spark, path)

    def add(self, vectors: DataFrame) -> None:
        """Index further ``vectors(id, embedding)`` under the trained lists and codes."""
        held, d = self.spark.sparkContext.broadcast(self.codes), self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, ROWS):
                x, directed = batch_vectors(b.column(1), d)
                near = held.value.nearest(x, 1)[:, 0]
                coded = held.value.encode(x, near)
                lists = np.where(directed, near, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists), pa.array([c.tobytes() for c in coded], pa.binary()), b.column(1)], names=["id", "list", "code", "embedding"])

        slim = vectors.select(vectors["id"].cast("bigint").alias("id"), vectors["embedding"].cast("array<double>").alias("embedding"))
        rows = slim.mapInArrow(run, "id bigint, list int, code binary, embedding array<double>")
        rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, code binary, embedding array<double>, list int").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refined: int = REFINED) -> DataFrame:
        """(query_id, id, score, rank): about the k nearest of each of ``queries(query_id, embedding)``, their cosines clamped at 0 and exact."""
        found = None
        for block in query_blocks(queries.select("query_id", "embedding")):
            part = self._block([r for r in block if r.embedding is not None and len(r.embedding) == self.dimensions], k, probes or self.probes, refined)
            found = part if found is None or part is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")

    def _block(self, block: list, k: int, probes: int, refined: int) -> DataFrame | None:
        if not block:
            return None
        names = np.array([r.query_id for r in block], np.int64)
        q = unit(np.array([r.embedding for r in block], np.float64))
        near = self.codes.nearest(q, probes)
        asks = [np.flatnonzero((near == n).any(axis=1)) for n in range(self.lists)]
        opened = [n for n, a in enumerate(asks) if len(a)]
        held = self.spark.sparkContext.broadcast((q, names, self.codes.centroids, self.codes.books, asks))

        def estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qs, ids_of, centroids, books, asked = held.value
            trained, slim, running, step = Codes(centroids, books), qs.astype(np.float32), Running(len(qs), refined * k), rows_at_once(len(qs))
            for b in small_batches(batches, ROWS):
                ids, lists = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                for n in np.unique(lists):
                    mine, who = np.flatnonzero(lists == n), asked[n]
                    for part in np.array_split(mine, -(-len(mine) // step)):
                        running.add_some(who, slim[who] @ trained.decode(codes[part], n).T, ids[part])
            at, score, ids = running.best()
            yield pa.RecordBatch.from_arrays([pa.array(ids_of[at]), pa.array(ids), pa.array(score.astype(np.float64))], names=["query_id", "id", "guess"])

        # a task passes on its best of each query, so the many small files of lists are a few tasks for each core
        codes = self.rows().where(F.col("list").isin(opened)).select("id", "list", "code").coalesce(2 * self.spark.sparkContext.defaultParallelism)
        guessed = codes.mapInArrow(estimates, "query_id bigint, id bigint, guess double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), "id"))
        first = staged(guessed.withColumn("n", place).where(F.col("n") <= refined * k).select("query_id", "id").distinct(), "nearest-guesses")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qs, ids_of, *_ = held.value
            row = {int(n): i for i, n in enumerate(ids_of)}
            for b in batches:
                v, _ = batch_vectors(b.column(2), qs.shape[1])
                mine = qs[[row[n] for n in b.column(0).to_pylist()]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(np.maximum(0.0, (mine * v).sum(1)), 6))], names=["query_id", "id", "score"])

        whole = first.join(self.rows().where(F.col("list").isin(opened)).select("id", "embedding"), "id").select("query_id", "id", "embedding")
        scored = whole.mapInArrow(exact, "query_id bigint, id bigint, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
