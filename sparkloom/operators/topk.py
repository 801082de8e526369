"""Top-k of a stated query set against all rows: queries in blocks, rows in place.

A block of queries of bounded size is broadcast; each task keeps a running top-k per query
over its rows and passes on k rows a query at most. Rows are never shuffled or paired; only
the tasks' candidates meet, in a window per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import small_batches

#: Queries in a broadcast.
BLOCK = 2048
#: Candidates held before a running top-k is cut back, and numbers in a matrix of scores.
HELD, CELLS = 1 << 18, 1 << 18
#: Rows of vectors scored at once, and occurrences of terms.
VECTORS, OCCURRENCES = 1024, 1 << 16
#: A fixed value: what a cover without other words in it adds to a text's rank.
COVER = 0.1


class Running:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.held = k, np.full(n, -np.inf), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries x rows) of rows; -inf is no candidate."""
        q, c = np.nonzero((scores >= self.floor[:, None]) & (scores > -np.inf))
        self.parts.append((q, scores[q, c], ids[c]))
        self.held += len(q)
        if self.held > HELD:
            self.best()

    def add_some(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (some queries x rows) of rows."""
        q, c = np.nonzero(scores >= self.floor[queries][:, None])
        self.parts.append((queries[q], scores[q, c], ids[c]))
        self.held += len(q)
        if self.held > HELD:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the best so far, by query and rank."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        q, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, np.arange(len(self.floor)))
        kept = np.arange(len(q)) - first[q] < self.k
        q, score, ids = q[kept], score[kept], ids[kept]
        last = np.searchsorted(q, np.arange(len(self.floor)), "right")
        full = last - np.searchsorted(q, np.arange(len(self.floor))) == self.k
        self.floor[full] = score[last[full] - 1]
        self.parts, self.held = [(q, score, ids)], 0
        return q, score, ids


def rows_at_once(queries: int, most: int = VECTORS) -> int:
    """Rows whose scores for so many queries are one matrix of ``CELLS`` numbers at most."""
    return max(1, min(most, CELLS // max(1, queries)))


def query_blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list]:
    """The rows of ``queries`` in order of their first column, ``size`` at a time."""
    block: list = []
    for row in queries.orderBy(queries.columns[0]).toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _united(parts: Iterator[DataFrame]) -> DataFrame | None:
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)
    return found


def scan_topk(rows: DataFrame, blocks: Iterator[list], scorer: Callable[[list], Callable[[pa.RecordBatch], np.ndarray]], k: int) -> DataFrame | None:
    """(query_id, id, score, rank) for ``rows(id, ...)``; scores of -inf are no candidates.

    ``scorer(block)`` makes, inside a task, a function from a batch to scores (queries x rows).
    """

    def part(block: list) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, running = scorer(held.value), Running(len(held.value), k)
            for b in small_batches(batches, rows_at_once(len(held.value))):
                running.add(np.round(score(b), 6), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            q, best, ids = running.best()
            names = np.array([r[0] for r in held.value], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(ids), pa.array(best)], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, "query_id bigint, id bigint, score double")

    found = _united(part(block) for block in blocks)
    if found is None:
        return None
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Scope:
    """Which files the queries of a block may find; each row has its ``files``."""

    def __init__(self, block: list):
        self.n, queries = len(block), {}
        for q, row in enumerate(block):
            for f in row["files"]:
                queries.setdefault(f, []).append(q)
        self.queries = {f: np.array(qs, np.int64) for f, qs in queries.items()}

    def mask(self, files: list) -> np.ndarray:
        """(queries x rows): whether a query may find a row of that file."""
        found = np.zeros((self.n, len(files)), bool)
        for at, f in enumerate(files):
            mine = self.queries.get(f)
            if mine is not None:
                found[mine, at] = True
        return found


def scoped_cosine_scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
    """``cosine_scorer`` for batches (id, vector, file), where each query finds rows of its own ``files`` only."""
    score, scope = cosine_scorer(block), Scope(block)
    return lambda b: np.where(scope.mask(b.column(2).to_pylist()), score(b), -np.inf)


def cosine_scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
    """For query rows (id, vector) and batches (id, vector): cosine similarity clamped at 0; other lengths count as no direction."""
    q = np.array([r[1] for r in block], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def score(b: pa.RecordBatch) -> np.ndarray:
        lists, v = b.column(1), np.zeros((b.num_rows, q.shape[1]))
        whole = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == q.shape[1]
        v[whole] = lists.filter(pa.array(whole)).flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        return np.maximum(0.0, q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T)

    return score


def cover_rank(codes: list[int], places: list[int], m: int) -> float:
    """Cover density of ``m`` terms whose occurrences stand at ``places``, in order: short covers count most."""
    last: dict[int, int] = {}
    rank, before = 0.0, -1
    for end, (code, place) in enumerate(zip(codes, places)):
        last[code] = end
        if len(last) == m and (begin := min(last.values())) > before:
            rank += COVER / (1 + place - places[begin] - (end - begin))  # words between that are no query terms
            before = begin
    return rank


class TermBlock:
    """The queries (id, terms) of a block by term; each term has a number."""

    def __init__(self, block: list):
        self.codes = {t: n for n, t in enumerate(sorted({t for r in block for t in r[1]}))}
        self.names = np.array([r[0] for r in block], np.int64)
        wants = sorted({(self.codes[t], n) for n, r in enumerate(block) for t in r[1]})
        self.queries = np.array([n for _, n in wants], np.int64)
        self.starts = np.searchsorted(np.array([c for c, _ in wants], np.int64), np.arange(len(self.codes) + 1))
        self.need = np.bincount(self.queries, minlength=len(block))
        self.terms = [np.array(sorted({self.codes[t] for t in r[1]}), np.int64) for r in block]

    def scores(self, doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of any term (queries x n texts), and of how many terms there are some."""
        cell, times = np.unique(doc * len(self.codes) + code, return_counts=True)
        d, c = np.divmod(cell, len(self.codes))
        many = self.starts[c + 1] - self.starts[c]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[c], many)
        flat, shape = self.queries[at] * n + np.repeat(d, many), (len(self.names), n)
        size = len(self.names) * n
        return np.bincount(flat, np.repeat(times, many), size).reshape(shape), np.bincount(flat, minlength=size).reshape(shape)


def scan_terms(docs: DataFrame, blocks: Iterator[list], k: int, some: bool = True, every: bool = True, scoped: bool = False) -> DataFrame | None:
    """(query_id, id, score, whole): the k best ``docs(id, terms)`` with any term, and the k best with every term (``whole``).

    The JVM keeps the occurrences of a block's terms, as numbers; a text's occurrences stay
    together and in order, for a broadcast join moves no row. Any term: ``COVER`` for each
    occurrence; every term: the density of their covers. ``scoped``: documents have a
    ``file_id``, and each query finds those of its own ``files`` only.
    """

    def part(block: list) -> DataFrame:
        spark, held = docs.sparkSession, TermBlock(block)
        known = spark.sparkContext.broadcast((held, Scope(block) if scoped else None))
        codes = F.broadcast(spark.createDataFrame(list(held.codes.items()), "w string, code int"))  # six terms a query, at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, scope = known.value
            ranked = [(flag, Running(len(b.names), k)) for flag, wanted in ((False, some), (True, every)) if wanted]

            def texts(ids: np.ndarray, code: np.ndarray, pos: np.ndarray, *files: np.ndarray) -> None:
                first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                ends = np.append(first[1:], len(ids))
                step = rows_at_once(len(b.names), CELLS)
                for at in range(0, len(first), step):
                    lo, hi, n = first[at], ends[min(at + step, len(first)) - 1], len(first[at : at + step])
                    doc = np.repeat(np.arange(n), ends[at : at + n] - first[at : at + n])
                    times, terms = b.scores(doc, code[lo:hi], n)
                    if scope is not None:
                        terms = np.where(scope.mask(files[0][first[at : at + n]].tolist()), terms, 0)
                    for flag, running in ranked:
                        score = np.where(terms > 0, COVER * times, -np.inf)
                        if flag:
                            score = np.full(score.shape, -np.inf)
                            for q, d in zip(*np.nonzero((terms == b.need[:, None]) & (terms > 0))):
                                mine = slice(first[at + d], ends[at + d])
                                own = np.isin(code[mine], b.terms[q])
                                score[q, d] = cover_rank(code[mine][own].tolist(), pos[mine][own].tolist(), int(b.need[q])) + 1e-9  # halves go up
                        running.add(np.round(score, 6), ids[first[at : at + n]])

            held_rows: list[tuple[np.ndarray, ...]] = []
            n_held = 0
            for batch in batches:
                held_rows.append(tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in range(batch.num_columns)))
                n_held += batch.num_rows
                if n_held >= OCCURRENCES:
                    columns = [np.concatenate(x) for x in zip(*held_rows)]
                    ids = columns[0]
                    others = np.flatnonzero(ids != ids[-1])
                    cut = int(others[-1]) + 1 if len(others) else 0  # the last text may go on in the next batch
                    if cut:
                        texts(*(c[:cut] for c in columns))
                    held_rows, n_held = [tuple(c[cut:] for c in columns)], len(ids) - cut
            if n_held:
                texts(*(np.concatenate(x) for x in zip(*held_rows)))
            for flag, running in ranked:
                q, score, ids = running.best()
                yield pa.RecordBatch.from_arrays([pa.array(b.names[q]), pa.array(ids), pa.array(score), pa.array(np.full(len(q), flag))], names=["query_id", "id", "score", "whole"])

        own, rows = (["file_id"], docs) if scoped else ([], docs)
        if scoped:  # texts of other files aren't read word by word; the names are those of one block
            names = [(f,) for f in known.value[1].queries]
            rows = docs.join(F.broadcast(spark.createDataFrame(names, docs.select("file_id").schema)), "file_id", "left_semi")
        found = rows.select(F.col("id").cast("bigint").alias("id"), *own, F.posexplode("terms").alias("pos", "w")).join(codes, "w").select("id", "code", "pos", *own)
        return found.mapInArrow(run, "query_id bigint, id bigint, score double, whole boolean")

    found = _united(part(block) for block in blocks)
    if found is None:
        return None
    order = Window.partitionBy("query_id", "whole").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
