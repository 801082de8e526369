"""Operators of retrieval over batches of queries; each takes and returns hits per query_id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.operators.topk import cosine_scorer, query_blocks, scan_terms, scan_topk, scoped_cosine_scorer

# Constants that results depend on.
RRF_K = 60
FALLBACK_SCORE = 0.45
MIN_VECTOR_SCORE = 0.35
KEYWORD_STEP, KEYWORD_CAP = 0.12, 0.25
FILENAME_BOOST, MODALITY_BOOST = 0.20, 0.15
MMR_LAMBDA = 0.7
SNIPPETS = 3
FEW_HITS = 3
HITS = "query_id bigint, id bigint, score double, rank int"


def fetch_limit(k: int) -> int:
    """Candidates per list for a wanted k."""
    return min(max(12 * k, k), 200)


def _or_none(found: DataFrame | None, like: DataFrame) -> DataFrame:
    return found if found is not None else like.sparkSession.createDataFrame([], HITS)


def with_files(queries: DataFrame, within: DataFrame) -> DataFrame:
    """The queries that ``within(query_id, file_id)`` names, with the ``files`` in which they search: few a query."""
    return queries.join(within.where("file_id IS NOT NULL").groupBy("query_id").agg(F.collect_set("file_id").alias("files")), "query_id")


def vector_candidates(vectors: DataFrame, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """Nearest ``vectors(id, embedding)`` for each of ``queries(query_id, embedding)``, exactly; ``within`` its files, where vectors have a ``file_id``."""
    if within is None:
        return _or_none(scan_topk(vectors, query_blocks(queries), cosine_scorer, k), vectors)
    return _or_none(scan_topk(vectors.select("id", "embedding", "file_id"), query_blocks(with_files(queries, within)), scoped_cosine_scorer, k), vectors)


def text_candidates(docs: DataFrame, queries: DataFrame, k: int, every: bool = False) -> DataFrame:
    """Best ``docs(id, terms)`` for each of ``queries(query_id, terms)``: any term, or every term by the density of covers."""
    found = scan_terms(docs, query_blocks(queries), k, some=not every, every=every)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return _or_none(None if found is None else found.drop("whole").withColumn("rank", F.row_number().over(order)), docs)


def text_candidates_with_fallback(docs: DataFrame, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """The k best with every term; where these are few, the k best with any term stand behind them; ``within`` a query's files, where documents have a ``file_id``."""
    asked = queries if within is None else with_files(queries, within)
    found = scan_terms(docs, query_blocks(asked), k, scoped=within is not None)
    if found is None:
        return _or_none(None, docs)
    once = found.groupBy("query_id", "id").agg(F.max("whole").alias("whole"), F.max_by("score", "whole").alias("score"))
    full = F.count_if("whole").over(Window.partitionBy("query_id"))
    kept = once.withColumn("full", full).where(F.col("whole") | (F.col("full") < max(FEW_HITS, k // 8)))
    order = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, rrf) with the sum of 1 / (k + rank) over the lists."""
    union = None
    for hits in lists:
        part = hits.select("query_id", "id", (F.lit(1.0) / (k + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "id").agg(F.sum("part").alias("rrf"))


def fuse_hybrid(near: DataFrame, text: DataFrame | None, k: int = RRF_K) -> DataFrame:
    """(query_id, id, rrf, sim, is_fts) of a vector and a text list, each read once; both lie by query, so none is shuffled."""
    part = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    found = near.select("query_id", "id", F.col("score").alias("sim"), F.col("rank").alias("near"))
    if text is None:
        return found.select("query_id", "id", part("near").alias("rrf"), "sim", F.lit(False).alias("is_fts"))
    both = found.join(text.select("query_id", "id", F.col("rank").alias("far")), ["query_id", "id"], "full")
    return both.select("query_id", "id", (part("near") + part("far")).alias("rrf"), "sim", F.col("far").isNotNull().alias("is_fts"))


def top_per_query(hits: DataFrame, score: str, k: int, first: Column | None = None) -> DataFrame:
    """The k best hits of each query, ties by id; rows for which ``first`` is largest come before."""
    order = [F.desc(score), F.col("id")] if first is None else [first.desc(), F.desc(score), F.col("id")]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def min_score(hits: DataFrame, vector_score: str = "vector_score", full_text: str = "is_fts", least: float = MIN_VECTOR_SCORE) -> DataFrame:
    """Full-text hits and hits without a vector score pass; others need ``least``."""
    return hits.where(F.col(full_text) | F.col(vector_score).isNull() | (F.col(vector_score) >= least))


def keyword_boost(query: Column, keywords: Column) -> Column:
    """A step for each comma-separated keyword that the query contains or that contains it, capped."""
    q = F.lower(F.trim(query))
    words = F.filter(F.transform(F.split(F.lower(keywords), ","), lambda w: F.trim(w)), lambda w: w != "")
    hit = F.filter(words, lambda w: F.contains(q, w) | F.contains(w, q))
    return F.when(hit.isNull(), 0.0).otherwise(F.least(F.lit(KEYWORD_CAP), F.size(hit) * F.lit(KEYWORD_STEP)))


def filename_boost(query: Column, name: Column, boost: float = FILENAME_BOOST) -> Column:
    return F.when(F.contains(F.lower(name), F.lower(F.trim(query))), boost).otherwise(0.0)


def modality_boost(query: Column, content_kind: Column, boost: float = MODALITY_BOOST) -> Column:
    return F.when(F.coalesce(T.modality(query) == content_kind, F.lit(False)), boost).otherwise(0.0)


def first_hit(hits: DataFrame, key: str = "id", ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The best row of each query and key, by ``ties`` among equals; rows without a key all stay."""
    best = F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), *ties))
    kept = hits.where(F.col(key).isNotNull()).withColumn("_n", best).where("_n = 1").drop("_n")
    return kept.unionByName(hits.where(F.col(key).isNull()))


def group_by_file(hits: DataFrame, snippets: int = SNIPPETS) -> DataFrame:
    """Per query and file: the best score, the number of chunks, and the first snippets by score."""
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "chunk_id")))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= snippets, F.struct("n", "text")))), lambda s: s.text)
    return ranked.groupBy("query_id", "file_id").agg(F.max("score").alias("score"), F.count("*").alias("matched"), texts.alias("snippets"))


def context_window(hits: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Each hit with the text of its neighbours within n places, joined by blank lines."""
    wanted = hits.select("query_id", "file_id", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - n, F.col("chunk_index") + n)).alias("at"))
    near = wanted.join(chunks.select("file_id", F.col("chunk_index").alias("at"), "text"), ["file_id", "at"])
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return near.groupBy("query_id", "file_id", "chunk_index").agg(F.array_join(F.transform(parts, lambda p: p.text), "\n\n").alias("context"))


def recall_at(hits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean share of expected ids among the first k hits, for each k: ``hits(query_id, id, rank)``, ``expected(query_id, id)``."""
    want = expected.groupBy("query_id").agg(F.count("*").alias("n"))
    got = expected.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"g{k}") for k in ks))
    return want.join(got, "query_id").agg(*(F.round(F.avg(F.col(f"g{k}") / F.col("n")), 6).alias(f"recall_{k}") for k in ks))


def citation(loc_type: Column, start: Column, end: Column, chunk_index: Column) -> Column:
    """A label for where a chunk stands."""
    names = {"pdf_page": "p.", "slide": "slide", "sheet": "sheet"}
    span = F.when(end > start, F.format_string("%d-%d", start, end)).otherwise(start.cast("string"))
    label = F.format_string("#%d", chunk_index + 1)
    for kind, name in names.items():
        label = F.when((loc_type == kind) & start.isNotNull(), F.concat(F.lit(name + " "), span)).otherwise(label)
    return label


def diversify(hits: DataFrame, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance: (query_id, id, pick) of k hits a query.

    ``hits(query_id, id, file_id, chunk_index, text, score)`` has a bounded number of rows a
    query (the candidates of a search), so each query is one small group. Chunks of one
    file are alike by their distance and words, chunks of different files by words alone.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        words = [{w for w in str(t).lower().split() if len(w) > 1} for t in rows["text"]]

        def alike(a: int, b: int) -> float:
            union = len(words[a] | words[b])
            j = len(words[a] & words[b]) / union if union else 0.0
            if rows.file_id[a] != rows.file_id[b]:
                return 0.65 * j
            gap = abs(rows.chunk_index[a] - rows.chunk_index[b])
            return 1.0 if gap == 0 else 0.85 if gap == 1 else min(1.0, 0.45 + 0.45 * j)

        left, taken = list(range(len(rows))), []
        worst = [0.0] * len(rows)
        while left and len(taken) < k:
            best = max(left, key=lambda i: (weight * rows.score[i] - (1 - weight) * worst[i], -i))
            left.remove(best)
            taken.append(best)
            for i in left:
                worst[i] = max(worst[i], alike(i, best))
        return pd.DataFrame({"query_id": rows.query_id[taken], "id": rows.id[taken], "pick": range(1, len(taken) + 1)})

    return hits.groupBy("query_id").applyInPandas(pick, "query_id bigint, id bigint, pick int")


def rerank(hits: DataFrame, scorer=None, first: int = 32) -> DataFrame:
    """The first hits in the order of ``scorer(pdf) -> scores``, the rest behind; without one, as they are."""
    if scorer is None:
        return hits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=pdf["score"].where(pdf["rank"] > first, 1e6 + scorer(pdf)))

    return hits.mapInPandas(run, hits.schema)
