"""Queries of search that goes on from its hits; four documents are a file, a document is a chunk of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.recall import Related, cached_search, related_search
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval_queries import HYBRID, doc_terms, hybrid_queries, vectors
from sparkloom.plans.search import SearchOptions, funnel
from sparkloom.sources.versioned import QueryCache
from sparkloom.storage import new_folder, table

NOW = "2024-01-01 00:00:00"


def file_of(id_: str) -> Column:
    return F.floor(F.col(id_) / 4).cast("bigint").alias("file_id")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Terms, vectors, questions and chunks."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(
        F.col("doc_id").alias("id"), file_of("doc_id"), (F.col("doc_id") % 4).cast("int").alias("chunk_index"), "text", F.concat(F.col("source"), F.lit(".md")).alias("name"),
        F.col("lang").alias("keywords"), F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("kind"),
    )
    own = lambda df: df.withColumn("file_id", file_of("id"))
    return own(doc_terms(spark, sf_dir)), own(vectors(spark, sf_dir)), hybrid_queries(spark, sf_dir), chunks


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document links to the file of the document whose number is its length, if there is one."""
    return table(spark, sf_dir, "documents").select(file_of("doc_id").alias("src"), file_of("n_chars").alias("dst")).distinct()


def related_tables(spark: SparkSession, sf_dir: str) -> Related:
    """Links, languages and sources as tags, lengths as entities, every tenth document as a summary, vectors as other representations."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    tags = d.select(file_of("doc_id"), F.explode(F.array("lang", "source", F.concat(F.lit("length "), (F.col("n_chars") % 101).cast("string")))).alias("tag")).where("tag IS NOT NULL")
    return Related(
        links=doc_links(spark, sf_dir),
        tags=tags,
        entities=d.select(file_of("doc_id"), F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 5).alias("entity")),
        events=d.select(F.col("doc_id").alias("event"), F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 997).alias("entity")),
        children=d.select((F.col("doc_id") - F.col("doc_id") % 10).alias("chunk_id"), F.col("doc_id").alias("child_id")).where("chunk_id <> child_id"),
        representations=e.select(F.col("vec_id").alias("id"), file_of("vec_id"), F.when(F.col("label") % 2 == 1, F.col("vec_id")).alias("chunk_id"), "embedding"),
    )


@query(f"""WITH {HYBRID}, first AS (SELECT query_id, id, id // 4 AS file_id, rrf AS score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM c JOIN documents ON doc_id = id QUALIFY rank <= 8),
seeds AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM first GROUP BY query_id, file_id QUALIFY place <= 3),
lk AS (SELECT DISTINCT doc_id // 4 AS src, n_chars // 4 AS dst FROM documents),
near AS (SELECT query_id, dst AS file_id, min(place) AS place FROM seeds JOIN lk ON src = file_id WHERE (query_id, dst) NOT IN (SELECT (query_id, file_id) FROM first) GROUP BY query_id, dst
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(place), dst) <= 8),
found AS (SELECT s.query_id, s.id, near.file_id, round(sim * 0.92::DOUBLE + 1e-9, 4) AS score FROM s JOIN near ON near.query_id = s.query_id AND near.file_id = s.id // 4 JOIN documents ON doc_id = s.id WHERE sim >= 0.35
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY sim DESC, s.id) <= 8),
rest AS (SELECT query_id, min(doc_id) AS id, file_id, 0.414::DOUBLE AS score FROM near JOIN documents ON doc_id // 4 = file_id WHERE query_id NOT IN (SELECT query_id FROM found) GROUP BY query_id, file_id),
items AS (SELECT query_id, id, file_id, score, 'search' AS origin, 0 AS step FROM first UNION ALL SELECT *, 'links', 1 FROM found UNION ALL SELECT *, 'links', 1 FROM rest)
SELECT query_id, id, file_id::BIGINT AS file_id, score, origin, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, step, id)::INT AS rank FROM items QUALIFY rank <= 8""")
def search_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search that goes on to the files its first files link to."""
    docs, vecs, asked, chunks = parts(spark, sf_dir)
    return related_search(docs, vecs, asked, chunks, Related(links=doc_links(spark, sf_dir)))


@query()
def search_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with boosts and all that its hits lead to: links, tags, entities, events, summaries, representations."""
    docs, vecs, asked, chunks = parts(spark, sf_dir)
    return related_search(docs, vecs, asked, chunks, related_tables(spark, sf_dir), SearchOptions(keyword_boost=True, modality_boost=True))


@query()
def search_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the evening after those of the morning: what was asked in nearly the same words is served from the cache.

    Every third question is asked in the morning, all are in the evening.
    """
    docs, vecs, asked, chunks = parts(spark, sf_dir)
    cache = QueryCache(spark, new_folder(spark, "query-cache"))
    asked = asked.where("embedding IS NOT NULL").withColumns({"user_id": (F.col("query_id") % 7).cast("bigint"), "scope": F.lit("all"), "query": F.col("text")})
    links = Related(links=doc_links(spark, sf_dir))
    answer = lambda rest: related_search(docs, vecs, rest.select("query_id", "terms", "text", "embedding"), chunks, links)
    cached_search(cache, asked.where("query_id % 3 = 0"), NOW, answer)
    found = cached_search(cache, asked, "2024-01-01 12:00:00", answer)
    return found.select("query_id", "cached", F.md5("payload").alias("payload_md5"))


@query(f"""WITH {HYBRID}, m AS (SELECT query_id, id FROM f UNION SELECT query_id, id FROM n),
k AS (SELECT c.query_id, count(*) AS after_min_score, count(DISTINCT source) AS files, count(*) FILTER (contains(lower(source || '.md'), lower(trim(q.text)))) AS boosted FROM c JOIN benchmark q ON q.item_id = c.query_id LEFT JOIN documents ON doc_id = id GROUP BY 1)
SELECT query_id, (SELECT count(*) FROM n WHERE n.query_id = g.query_id) AS vector_candidates, (SELECT count(*) FROM f WHERE f.query_id = g.query_id) AS text_candidates, merged_unique, least(96, merged_unique) AS after_access,
  coalesce(after_min_score, 0) AS after_min_score, coalesce(boosted, 0) AS filename_boosted, least(8, coalesce(files, 0)) AS after_mmr, least(8, coalesce(files, 0)) AS after_rerank, least(8, coalesce(files, 0)) AS final
FROM (SELECT query_id, count(*) AS merged_unique FROM m GROUP BY query_id) g LEFT JOIN k USING (query_id)""")
def search_funnel_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each step leaves where hits are grouped by file; a document's source is its file."""
    docs, vecs, asked, chunks = parts(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"))
    return funnel(docs, vecs, asked, SearchOptions(filename_boost=True, group_by_file=True), chunks=chunks.drop("file_id").join(sources, "id"))
