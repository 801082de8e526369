"""Ranked lexical search of a table of items against all documents, with thresholds seeded from each term's k best impacts.

1. Documents are cut into terms once for each block of items. A row keeps its length and its
   frequencies of the block's terms: the table that the rest reads; texts are not read again.
2. Each term's impacts over all documents are reduced to its number of documents, its largest
   and its k-th largest impact, first in each task, then over all tasks.
3. An item's k-th score can't be less than the k-th impact of any one of its terms: k documents
   have that much from this term alone. The largest of these seeds is the item's threshold.
   Its terms are ordered by their largest impact; the weakest, whose largest impacts
   together stay below the threshold, can't lift a document to it and make no candidates.
4. The rows are joined with the block's remaining terms by a broadcast, which gives candidate pairs. A
   candidate is scored exactly, over all terms of the item that its row has. A task keeps the
   k best of each item and raises its own threshold with them, so at most k rows an item
   and task are shuffled, however frequent a term is.

Items are read in blocks of about ``BLOCK_BYTES``; a block is what a broadcast holds, and more
items take more passes over the documents. Documents are never shuffled.

An impact is w * ((10^9 tf) div (1000 tf + 12 m)), with w = floor(1000 ln((2N+2) / (2df+1)))
and m = 100-25+((25 n N) div L).

Cases: null texts and texts without terms score nothing and aren't counted in N. A term twice
in an item counts twice. Items without terms, or whose terms no document has, return no rows;
items that repeat an item_id are ranked each. Equal scores go by doc_id, rows without
one last; repeated rows take a rank each. Empty tables give an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.storage import small_batches, staged

#: Text of the items that one broadcast holds.
BLOCK_BYTES = 4 << 20
#: Candidate pairs that a task scores at once, about.
PAIRS = 1 << 19
#: Term characters: ASCII letters in lower case, digits, and all bytes of characters beyond ASCII.
TERM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(TERM).split()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all slices: ``sizes[i]`` consecutive numbers from ``starts[i]``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def best(group: np.ndarray, value: np.ndarray, k: int, then: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k largest values of each group, ordered by group and place; ties by ``then``, ascending."""
    order = np.lexsort((-value, group) if then is None else (then, -value, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)])) < k]


@dataclass
class Corpus:
    """Number of documents with a term, and of all their terms."""

    docs: int
    terms: int

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a frequency in a document of ``n`` terms is worth, before the term's weight."""
        m = 75 + 25 * n * self.docs // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


class Block:
    """Items and the terms they have, numbered from zero."""

    def __init__(self, texts: list[str | None]):
        found = [Counter(terms(t)) for t in texts]
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for c in found for t in c))}
        self.items = len(found)
        self.sizes = np.array([len(c) for c in found], np.int64)
        self.item = np.repeat(np.arange(self.items), self.sizes)
        self.term = np.array([self.vocabulary[t] for c in found for t in c], np.int64)
        self.times = np.array([n for c in found for n in c.values()], np.int64)


class Plan:
    """What the scoring of a block needs: weights, thresholds, the items of each candidate-making term."""

    def __init__(self, block: Block, corpus: Corpus, df: np.ndarray, largest: np.ndarray, kth: np.ndarray):
        self.corpus, self.items, self.terms = corpus, block.items, len(block.vocabulary)
        self.weights = np.array([corpus.weight(n) for n in df.tolist()], np.int64)
        self.sizes, self.starts, self.term, self.times = block.sizes, np.cumsum(block.sizes) - block.sizes, block.term, block.times
        worth = block.times * self.weights[block.term]
        self.threshold = np.zeros(block.items, np.int64)
        np.maximum.at(self.threshold, block.item, worth * kth[block.term])
        top = worth * largest[block.term]
        order = np.lexsort((top, block.item))
        sums = np.cumsum(top[order])
        sums -= np.repeat((sums[self.starts[self.sizes > 0]] - top[order][self.starts[self.sizes > 0]]), self.sizes[self.sizes > 0])
        makes = (sums >= self.threshold[block.item[order]]) & (top[order] > 0)
        pairs = order[makes]
        pairs = pairs[np.argsort(block.term[pairs], kind="stable")]
        self.pruned = len(order) - len(pairs)
        self.candidates = block.item[pairs]
        self.n_items = np.bincount(block.term[pairs], minlength=self.terms)
        self.at = np.cumsum(self.n_items) - self.n_items

    def score(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, score) of all candidate pairs; postings are ordered by row and term."""
        impact = self.weights[term] * self.corpus.impacts(tf, n)
        sizes = self.n_items[term]
        pairs = np.unique(np.repeat(row, sizes) * self.items + self.candidates[spread(self.at[term], sizes)])
        of_row, of_item = pairs // self.items, pairs % self.items
        where = spread(self.starts[of_item], self.sizes[of_item])
        pair = np.repeat(np.arange(len(pairs)), self.sizes[of_item])
        keys, wanted = row * self.terms + term, of_row[pair] * self.terms + self.term[where]
        place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        hit = keys[place] == wanted if len(keys) else np.zeros(0, bool)
        score = np.zeros(len(pairs), np.int64)
        np.add.at(score, pair[hit], self.times[where[hit]] * impact[place[hit]])
        return of_row, of_item, score


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf) of every document: its number of terms, and its frequencies of the vocabulary as two arrays."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for b in small_batches(batches):
            sizes, ids, tfs, lengths = [], [], [], []
            for text in b.column(1).to_pylist():
                words = terms(text)
                mine = sorted((k, tf) for w, tf in Counter(words).items() if (k := number(w)) is not None)
                lengths.append(len(words))
                sizes.append(len(mine))
                ids += (k for k, _ in mine)
                tfs += (tf for _, tf in mine)
            offsets = pa.array([0, *accumulate(sizes)], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *arrays], names=["doc_id", "n", "term", "tf"])

    slim = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<int>")


def _postings(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, term, frequency and the document's length of each posting of a batch (doc_id, n, term, tf)."""
    sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
    flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(b.num_rows), sizes)
    return row, flat(2), flat(3), b.column(1).to_numpy(zero_copy_only=False)[row]


def term_statistics(postings: DataFrame, corpus: Corpus, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term of the block: number of documents, largest and k-th largest impact (0 where fewer have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        term, impact = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            _, t, tf, n = _postings(b)
            df += np.bincount(t, minlength=n_terms)
            term, impact = np.r_[term, t], np.r_[impact, corpus.impacts(tf, n)]
            kept = best(term, impact, k)
            term, impact = term[kept], impact[kept]
        counts = np.where(np.r_[True, term[1:] != term[:-1]], df[term], 0) if len(term) else term
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(impact), pa.array(counts, pa.int64())], names=["term", "impact", "docs"])

    each = postings.mapInArrow(run, "term int, impact bigint, docs bigint")
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"))))
    tops = ranked.where(F.col("place") <= k).groupBy("term").agg(F.max("impact").alias("largest"), F.min(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    counts = each.groupBy("term").agg(F.sum("docs").alias("df"))
    out = np.zeros((3, n_terms), np.int64)
    for r in counts.join(tops, "term").toLocalIterator():  # a row for each term of the block
        out[:, r.term] = r.df, r.largest, r.kth or 0
    return out[0], out[1], out[2]


def best_documents(postings: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task."""
    held = postings.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        least = np.maximum(p.threshold, 1)
        item, score, doc, nameless = (np.empty(0, np.int64) for _ in range(4))
        for b in batches:
            row, term, tf, n = _postings(b)
            ids = b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))  # slices of whole rows
            made = np.cumsum(np.r_[0, p.n_items[term]])[ends]
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(made, made[at] + PAIRS, "right")) - 1)
                s = slice(ends[at], ends[to])
                r, i, v = p.score(row[s], term[s], tf[s], n[s])
                fit = v >= least[i]
                r, i, v = r[fit], i[fit], v[fit]
                item, score, doc, nameless = np.r_[item, i], np.r_[score, v], np.r_[doc, ids[r]], np.r_[nameless, null[r]]
                kept = np.lexsort((doc, nameless, -score, item))
                place = np.arange(len(kept)) - np.searchsorted(item[kept], item[kept])
                last = kept[place == k - 1]
                least[item[last]] = np.maximum(least[item[last]], score[last])
                kept = kept[place < k]
                item, score, doc, nameless = item[kept], score[kept], doc[kept], nameless[kept]
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=nameless.astype(bool)), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id bigint, score bigint")


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """(item_id, text) in blocks of about ``block_bytes`` of text, dealt by a hash of the item."""
    slim = items.select(items["item_id"], items["text"].cast("string").alias("text")).where(F.length("text") > 0)
    total = slim.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        yield [(r.item_id, r.text) for r in slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toLocalIterator()]


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, with scores above 0."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)])
    found, corpus = [], None
    for rows in item_blocks(items, block_bytes):
        block = Block([text for _, text in rows])
        postings = staged(frequencies(docs, block.vocabulary), "frequencies")
        if corpus is None:
            corpus = Corpus(*postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first())
        some = postings.where(F.size("term") > 0)
        plan = Plan(block, corpus, *term_statistics(some, corpus, len(block.vocabulary), k))
        names = spark.createDataFrame([(n, item_id) for n, (item_id, _) in enumerate(rows)], schema)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best_documents(some, plan, k).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        found.append(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: the items of a block
    if not found:
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    return reduce(DataFrame.unionByName, found)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
i AS (
  SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, item, term, count(*) AS times FROM (SELECT item_id, item, unnest(w) AS term FROM i) GROUP BY ALL),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term),
s AS (
  SELECT item_id, item, doc_id, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN f USING (term) JOIN q USING (term), c GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
