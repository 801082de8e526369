"""The search plan: candidates, fusion, filters, boosts and selection for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import retrieval as R
from sparkloom.storage import staged


@dataclass(frozen=True)
class SearchOptions:
    """Options with the ranges that requests may use; those after ``hybrid`` need ``chunks``."""

    top_k: int = 8
    candidates: int | None = None
    min_score: float = R.MIN_VECTOR_SCORE
    hybrid: bool = True
    keyword_boost: bool = False
    filename_boost: bool = False
    modality_boost: bool = False
    group_by_file: bool = False
    diversify: bool = False
    context_chunks: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 50 or not 0 <= self.context_chunks <= 3 or not 0 <= self.min_score <= 1:
            raise ValueError("an option is out of range")
        if self.group_by_file and (self.diversify or self.context_chunks):
            raise ValueError("hits grouped by file have no order of chunks")

    @property
    def fetch(self) -> int:
        return self.candidates or R.fetch_limit(self.top_k)

    @property
    def boosted(self) -> bool:
        return self.keyword_boost or self.filename_boost or self.modality_boost


def _lists(docs: DataFrame, vectors: DataFrame, queries: DataFrame, options: SearchOptions, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    near = R.vector_candidates(vectors, queries.where("embedding IS NOT NULL").select("query_id", "embedding"), options.fetch, within)
    text = R.text_candidates_with_fallback(docs, queries.where(F.size("terms") > 0).select("query_id", "terms"), options.fetch, within) if options.hybrid else None
    return near, text


def candidates(docs: DataFrame, vectors: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), readable: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rrf, sim, is_fts): the fused candidates that pass the minimum score.

    ``readable(id)`` limits documents and vectors before any top-k, so that what a reader may
    not see takes no place among the candidates; ``within(query_id, file_id)`` limits each
    query to a few files, and leaves out queries without one. Documents and vectors are scored once.
    """
    if readable is not None:
        docs, vectors = docs.join(readable, "id", "left_semi"), vectors.join(readable, "id", "left_semi")
    near, text = _lists(docs, vectors, queries, options, within)
    first = R.top_per_query(R.fuse_hybrid(near, text).withColumn("rrf", F.round("rrf", 6)), "rrf", options.fetch).drop("rank")
    return R.min_score(first, "sim", "is_fts", options.min_score)


def funnel(docs: DataFrame, vectors: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), readable: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """What each step leaves of a query's candidates.

    query_id, vector_candidates, text_candidates and merged_unique over the two lists;
    after_access: the first candidates, which are readable ones only; after_min_score;
    filename_boosted: those whose file's name gained (needs ``chunks``, else 0); after_mmr and
    after_rerank: the chosen ones, or files where hits are grouped; final.
    """
    if readable is not None:
        docs, vectors = docs.join(readable, "id", "left_semi"), vectors.join(readable, "id", "left_semi")
    near, text = _lists(docs, vectors, queries, options)
    fused = R.fuse_hybrid(near, text).withColumn("rrf", F.round("rrf", 6))
    ranked = fused.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")))
    first = F.col("n") <= options.fetch
    enough = first & (F.col("is_fts") | F.col("sim").isNull() | (F.col("sim") >= options.min_score))
    known, chosen = F.lit(False), F.count_if(enough)
    if chunks is not None:
        asked = queries.select("query_id", F.col("text").alias("asked"))
        ranked = ranked.join(chunks.select("id", "file_id", "name"), "id", "left").join(asked, "query_id", "left")
        known = enough & F.lit(options.filename_boost) & (F.coalesce(R.filename_boost(F.col("asked"), F.col("name")), F.lit(0.0)) > 0)
        if options.group_by_file:
            chosen = F.count_distinct(F.when(enough, F.col("file_id")))
    counts = ranked.groupBy("query_id").agg(
        F.count("sim").alias("vector_candidates"), F.count_if("is_fts").alias("text_candidates"), F.count("*").alias("merged_unique"), F.count_if(first).alias("after_access"),
        F.count_if(enough).alias("after_min_score"), F.count_if(known).alias("filename_boosted"), F.least(chosen, F.lit(options.top_k)).alias("final"),
    )
    return counts.withColumns({"after_mmr": F.col("final"), "after_rerank": F.col("final")})


def boosted(hits: DataFrame, queries: DataFrame, options: SearchOptions) -> DataFrame:
    """``hits`` with ``score``: the fused score, or the likeness where only vectors are searched, and what keywords, file name and kind of content add to it."""
    base = F.col("rrf") if options.hybrid else F.coalesce("sim", "rrf")
    if not options.boosted:
        return hits.withColumn("score", base)
    asked = hits.join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
    score = base
    if options.keyword_boost:
        score = score + R.keyword_boost(F.col("asked"), F.col("keywords"))
    if options.filename_boost:
        score = score + R.filename_boost(F.col("asked"), F.col("name"))
    if options.modality_boost:
        score = score + R.modality_boost(F.col("asked"), F.col("kind"))
    return asked.withColumn("score", F.round(score, 6)).drop("asked")


def first_chunks(chunks: DataFrame, wanted: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """(file_id, id): the first chunk of each file of ``wanted(file_id)``; a file's chunks meet as one row of each task."""
    rows = chunks if readable is None else chunks.join(readable, "id", "left_semi")
    some = rows.join(wanted.select("file_id").distinct(), "file_id", "left_semi")
    return some.groupBy("file_id").agg(F.min(F.struct("chunk_index", "id"))["id"].alias("id"))


def search(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    options: SearchOptions = SearchOptions(),
    readable: DataFrame | None = None,
    chunks: DataFrame | None = None,
    scorer: Callable | None = None,
    within: DataFrame | None = None,
    tagged: DataFrame | None = None,
) -> DataFrame:
    """Hybrid search of ``queries(query_id, terms, embedding, text)``; the best hits of each query with their ``rank``.

    ``chunks(id, file_id, chunk_index, text, name, keywords, kind)`` says what a hit is; only
    the candidates meet it. Hits have query_id, id, rrf, sim and score (and file_id,
    chunk_index, text with ``chunks``; context where asked for); grouped by file they have
    query_id, file_id, score, matched and snippets. ``scorer`` puts the hits in its own order.
    ``within(query_id, file_id)`` limits queries to their files. The first chunk of each file
    of ``tagged(query_id, file_id)`` that has no hit joins the candidates, at the fallback score.
    """
    hits = candidates(docs, vectors, queries, options, readable, within).drop("is_fts")
    if chunks is None and (tagged is not None or options.boosted or options.group_by_file or options.diversify or options.context_chunks):
        raise ValueError("these options need chunks")
    if chunks is not None:
        if tagged is not None:
            hits = staged(hits, "candidates")
            more = tagged.join(hits.join(chunks.select("id", "file_id"), "id").select("query_id", "file_id"), ["query_id", "file_id"], "left_anti")
            hits = hits.unionByName(more.join(first_chunks(chunks, more, readable), "file_id").select("query_id", "id", F.lit(R.FALLBACK_SCORE).alias("rrf"), F.lit(None).cast("double").alias("sim")))
        hits = hits.join(chunks, "id")
    hits = boosted(hits, queries, options)
    if options.group_by_file:
        files = R.group_by_file(hits.withColumn("chunk_id", F.col("id")))
        return R.top_per_query(files.withColumn("id", F.col("file_id")), "score", options.top_k).drop("id")
    if options.diversify:
        pool = R.top_per_query(hits, "score", max(4 * options.top_k, options.fetch // 2))
        picked = R.diversify(pool.select("query_id", "id", "file_id", "chunk_index", "text", "score"), options.top_k)
        hits = pool.drop("rank").join(picked, ["query_id", "id"]).withColumnRenamed("pick", "rank")
    else:
        hits = R.top_per_query(hits, "score", options.top_k)
    if scorer is not None:
        hits = R.top_per_query(R.rerank(hits, scorer).drop("rank"), "score", options.top_k)
    hits = hits.drop("name", "keywords", "kind")
    if options.context_chunks:
        around = R.context_window(hits, chunks, options.context_chunks)
        hits = hits.join(around, ["query_id", "file_id", "chunk_index"], "left")
    return hits
