"""Retrieval queries over documents, embeddings and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import retrieval as R
from sparkloom.operators import structure as S
from sparkloom.operators.inverted_index import TextIndex
from sparkloom.operators.vector_index import VectorIndex
from sparkloom.plans.registry import query
from sparkloom.plans.search import SearchOptions, search
from sparkloom.storage import new_folder, table, texts

QT = r"""qt AS (SELECT query_id, w FROM (SELECT item_id AS query_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT item_id, regexp_extract_all(lower(text), '[一-鿿]{2,}|[a-z0-9_]{2,}') AS ws FROM benchmark)) GROUP BY item_id, w)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 6)"""
DT = r"""dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda w: w <> '') AS ws FROM documents),
dp AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM dw), dt AS (SELECT doc_id, w, count(*) AS tf FROM dp GROUP BY doc_id, w)"""
FTS = f"{QT}, {DT}, fts AS (SELECT query_id, doc_id AS id, round(0.1::DOUBLE * sum(tf), 6) AS score, count(*) AS hit FROM qt JOIN dt USING (w) GROUP BY query_id, doc_id)"
#: The density of covers of all terms: at each occurrence the latest of every term, each beginning once.
COVERS = """need AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id), every AS (SELECT query_id, id FROM fts JOIN need USING (query_id) WHERE hit = n),
o AS (SELECT every.query_id, every.id, dp.w, dp.pos, row_number() OVER (PARTITION BY every.query_id, every.id ORDER BY dp.pos) AS k FROM every JOIN qt USING (query_id) JOIN dp ON dp.doc_id = every.id AND dp.w = qt.w),
latest AS (SELECT e.query_id, e.id, e.pos, e.k, p.w, max(p.k) AS seen FROM o e JOIN o p ON p.query_id = e.query_id AND p.id = e.id AND p.k <= e.k GROUP BY ALL),
ends AS (SELECT query_id, id, pos, k, min(seen) AS first_k FROM latest JOIN need USING (query_id) GROUP BY query_id, id, pos, k, n HAVING count(*) = n),
shortest AS (SELECT query_id, id, first_k, min(k) AS k, min(pos) AS pos FROM ends GROUP BY query_id, id, first_k),
cd AS (SELECT s.query_id, s.id, round(sum(0.1::DOUBLE / (1 + s.pos - o.pos - (s.k - s.first_k))) + 1e-9, 6) AS score FROM shortest s JOIN o ON o.query_id = s.query_id AND o.id = s.id AND o.k = s.first_k GROUP BY s.query_id, s.id)"""


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.col("doc_id").alias("id"), T.terms(F.col("text")).alias("terms"))


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.query_terms(F.col("text")).alias("terms"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(
    """SELECT q.vec_id AS query_id, v.vec_id AS id, round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) DESC, v.vec_id)::INT AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10"""
)
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return R.vector_candidates(v, v.where("id % 20 = 0"), 10)


@query()
def knn_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About what ``knn_cosine_topk`` finds, from an index of all vectors; a test holds the recall."""
    v = vectors(spark, sf_dir)
    return VectorIndex.build(v, new_folder(spark, "vector-index"), 64).search(v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)


@query(f"WITH {FTS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fts QUALIFY rank <= 20")
def fts_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_candidates(doc_terms(spark, sf_dir), item_terms(spark, sf_dir), 20)


@query(f"WITH {FTS}, {COVERS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM cd QUALIFY rank <= 20")
def fts_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_candidates(doc_terms(spark, sf_dir), item_terms(spark, sf_dir), 20, every=True)


@query(f"WITH {FTS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fts QUALIFY rank <= 20")
def fts_index_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``fts_or_topk`` finds, from an inverted index of all documents."""
    return TextIndex.build(doc_terms(spark, sf_dir), new_folder(spark, "text-index")).search(item_terms(spark, sf_dir), 20)


@query(f"WITH {FTS}, {COVERS} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM cd QUALIFY rank <= 20")
def fts_index_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``fts_and_topk`` finds, from an inverted index of all documents."""
    return TextIndex.build(doc_terms(spark, sf_dir), new_folder(spark, "text-index")).search(item_terms(spark, sf_dir), 20, every=True)


#: All French documents say everything twice, and the Spanish ones are gone.
CHANGED = FTS.replace("FROM documents", "FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' ' || text ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'es')")


@query(f"WITH {CHANGED} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fts QUALIFY rank <= 20")
def fts_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents after some were changed and some removed in the index."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex.build(doc_terms(spark, sf_dir), new_folder(spark, "text-index"))
    changed = docs.where("lang = 'fr'").select(F.col("doc_id").alias("id"), T.terms(F.concat_ws(" ", "text", "text")).alias("terms"))
    return index.refresh(changed, docs.where("lang = 'es'").select(F.col("doc_id").alias("id"))).search(item_terms(spark, sf_dir), 20)


#: Candidates of hybrid search for a wanted 8: 96 of each list, text hits with any term only where fewer than 12 have all.
HYBRID = f"""{FTS}, {COVERS},
whole AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM cd QUALIFY rn <= 96), few AS (SELECT query_id, count(*) AS n FROM whole GROUP BY query_id),
any_term AS (SELECT query_id, id, score FROM fts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 96),
t AS (SELECT query_id, id, 1 AS whole, score FROM whole UNION ALL SELECT query_id, id, 0, score FROM any_term LEFT JOIN few USING (query_id) WHERE coalesce(few.n, 0) < 12 AND (query_id, id) NOT IN (SELECT (query_id, id) FROM whole)),
f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, score DESC, id) AS rn FROM t),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS sim
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id, embeddings v),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM s QUALIFY rn <= 96),
u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS rrf FROM (SELECT query_id, id, rn FROM f UNION ALL SELECT query_id, id, rn FROM n) GROUP BY query_id, id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) <= 96),
c AS (SELECT u.query_id, u.id, rrf, n.sim FROM u LEFT JOIN n USING (query_id, id) LEFT JOIN f USING (query_id, id) WHERE f.rn IS NOT NULL OR n.sim IS NULL OR n.sim >= 0.35)"""


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same number."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return item_terms(spark, sf_dir).join(asked, "query_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def hit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: their source is the file, one in five holds a table."""
    kind = F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("file_id"), F.floor(F.col("doc_id") / 20).cast("int").alias("chunk_index"),
        "text", F.concat("source", F.lit(".md")).alias("name"), F.concat_ws(",", "lang", F.lit("the; ing")).alias("keywords"), kind.alias("kind"),
    )


@query(f"WITH {HYBRID} SELECT query_id, id, rrf, sim, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id)::INT AS rank FROM c QUALIFY rank <= 8")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(doc_terms(spark, sf_dir), vectors(spark, sf_dir), hybrid_queries(spark, sf_dir), SearchOptions())
    return found.select("query_id", "id", "rrf", "sim", "rank")


@query(f"""WITH {HYBRID},
b AS (SELECT c.query_id, c.id, d.source, round(rrf + least(0.25, 0.12 * ((contains(lower(trim(q.text)), lang) OR contains(lang, lower(trim(q.text))))::INT + contains(lower(trim(q.text)), 'the; ing')::INT))
  + CASE WHEN contains(d.source || '.md', lower(trim(q.text))) THEN 0.2 ELSE 0 END, 6) AS score FROM c JOIN documents d ON d.doc_id = c.id JOIN benchmark q ON q.item_id = c.query_id)
SELECT query_id, source AS file_id, max(score) AS score, count(*) AS matched, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, source)::INT AS rank FROM b GROUP BY query_id, source QUALIFY rank <= 8""")
def search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with boosts, hits grouped by file."""
    options = SearchOptions(keyword_boost=True, filename_boost=True, group_by_file=True)
    found = search(doc_terms(spark, sf_dir), vectors(spark, sf_dir), hybrid_queries(spark, sf_dir), options, chunks=hit_chunks(spark, sf_dir))
    return found.select("query_id", "file_id", "score", "matched", "rank")


@query()
def search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with boosts by content, diverse hits and the chunks around them."""
    options = SearchOptions(keyword_boost=True, modality_boost=True, diversify=True, context_chunks=1)
    found = search(doc_terms(spark, sf_dir), vectors(spark, sf_dir), hybrid_queries(spark, sf_dir), options, chunks=hit_chunks(spark, sf_dir))
    return found.select("query_id", "id", "score", "rank", F.md5("context").alias("context_md5"))


@query(f"""WITH {FTS},
ok AS (SELECT d.doc_id AS id FROM documents d WHERE lang IN ('de', 'fr')),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fts JOIN ok USING (id) QUALIFY rank <= 8)
SELECT * FROM r""")
def acl_before_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    readable = table(spark, sf_dir, "documents").where("lang IN ('de', 'fr')").select(F.col("doc_id").alias("id"))
    return R.text_candidates(doc_terms(spark, sf_dir).join(readable, "id", "left_semi"), item_terms(spark, sf_dir), 8)


@query("""SELECT v.vec_id, m.vec_id AS cached_id, round(list_cosine_similarity(v.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS score
FROM embeddings v, embeddings m WHERE v.vec_id % 20 = 0 AND m.vec_id % 20 <> 0 AND round(list_cosine_similarity(v.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) >= 0.3
QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) DESC, m.vec_id) = 1""")
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cached query of each query, if it is near enough."""
    v = vectors(spark, sf_dir)
    found = R.vector_candidates(v.where("id % 20 <> 0"), v.where("id % 20 = 0"), 1)
    return found.where("score >= 0.3").select(F.col("query_id").alias("vec_id"), F.col("id").alias("cached_id"), "score")


@query("""SELECT l_suppkey AS query_id, l_partkey AS file_id, round(max(l_extendedprice), 2) AS score, count(*) AS matched,
  array_to_string(list_transform(list_sort(list({'a': -l_extendedprice, 'b': l_orderkey * 10 + l_linenumber, 't': l_shipmode_like}))[1:3], lambda x: x.t), '|') AS snippets
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY l_suppkey, l_partkey""")
def group_by_file_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = li.select(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_extendedprice").alias("score"), F.concat("l_returnflag", "l_linestatus").alias("text"),
    )
    return R.group_by_file(hits).select("query_id", "file_id", F.round("score", 2).alias("score"), "matched", F.array_join("snippets", "|").alias("snippets"))


@query("""SELECT l_suppkey AS query_id, l_partkey AS id, l_orderkey, round(l_extendedprice, 2) AS score FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""")
def dedupe_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score"), "l_orderkey", "l_linenumber")
    return R.first_hit(hits, "id", ("l_orderkey", "l_linenumber")).select("query_id", "id", "l_orderkey", F.round("score", 2).alias("score"))


@query("""SELECT vec_id, score, is_fts FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score, label % 3 = 0 AS is_fts, CASE WHEN label = 1 THEN NULL ELSE round(embedding[1]::DOUBLE, 6) END AS vs FROM embeddings)
WHERE is_fts OR vs IS NULL OR vs >= 0.35""")
def min_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"), (F.col("label") % 3 == 0).alias("is_fts"), "label")
    return R.min_score(e.withColumn("vs", F.when(F.col("label") != 1, F.col("score"))), "vs", "is_fts").select("vec_id", "score", "is_fts")


@query("""SELECT doc_id, coalesce(least(0.25, 0.12 * len(list_filter(['the', 'der', 'les', lang, source], lambda w: w <> '' AND (contains(lower(trim(q)), w) OR contains(w, lower(trim(q))))))), 0.0)::DOUBLE AS boost
FROM (SELECT *, text AS q FROM documents)""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words = F.concat_ws(",", F.lit("the, der ,les"), "lang", "source")
    return d.select("doc_id", R.keyword_boost(F.col("text"), words).alias("boost"))


@query("""SELECT page_id, CASE WHEN page_id % 3 < 2 AND contains(lower(url), CASE page_id % 3 WHEN 0 THEN '.html' ELSE '/de/' END) THEN 0.2 ELSE 0.0 END::DOUBLE AS boost, CASE WHEN url LIKE '%\\_source%' ESCAPE '\\' THEN 1 ELSE 0 END AS tagged FROM pages""")
def filename_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 3
    asked = F.when(k == 0, " .HTML ").when(k == 1, "/De/").otherwise("no such name")
    return p.select("page_id", R.filename_boost(asked, F.col("url")).alias("boost"), F.col("url").like(T.unmatched_like("_source")).cast("int").alias("tagged"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_size % 3 = 0 THEN 0.15 WHEN p_partkey % 4 = 1 AND p_size % 3 = 1 THEN 0.15 WHEN p_partkey % 4 = 2 AND p_size % 3 = 2 THEN 0.15 ELSE 0.0 END::DOUBLE AS boost FROM part""")
def modality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hits of the kind that a question asks for gain."""
    k, kind = F.col("p_partkey") % 4, F.col("p_size") % 3
    asked = F.concat(F.lit("the "), F.when(k == 0, "Chart").when(k == 1, "spreadsheet").when(k == 2, "FORMULA").otherwise("charts"), F.lit(" of "), F.col("p_name"))
    held = F.when(kind == 0, "figure").when(kind == 1, "table").otherwise("equation")
    return table(spark, sf_dir, "part").select("p_partkey", R.modality_boost(asked, held).alias("boost"))


@query(f"""WITH {FTS},
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 20),
want AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM fts WHERE hit >= 5) WHERE n <= 3),
r AS (SELECT want.query_id, count(*) AS n, count(*) FILTER (rank <= 5) AS g5, count(*) FILTER (rank <= 10) AS g10, count(*) FILTER (rank <= 20) AS g20
  FROM want LEFT JOIN hits USING (query_id, id) GROUP BY want.query_id)
SELECT round(avg(g5 / n), 6) AS recall_5, round(avg(g10 / n), 6) AS recall_10, round(avg(g20 / n), 6) AS recall_20 FROM r""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the first three documents with five query terms that the ranked list finds."""
    docs, items = doc_terms(spark, sf_dir), item_terms(spark, sf_dir)
    hits = R.text_candidates(docs, items, 20)
    pairs = docs.select("id", F.explode(F.array_distinct("terms")).alias("w")).join(items.select("query_id", F.explode("terms").alias("w")), "w")
    many = pairs.groupBy("query_id", "id").agg(F.count("*").alias("hit")).where("hit >= 5")
    first = many.withColumn("n", F.row_number().over(R.Window.partitionBy("query_id").orderBy("id"))).where("n <= 3").select("query_id", "id")
    return R.recall_at(hits, first)


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 1)) AS w FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS j
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.jaccard_tokens(F.col("text")).alias("w"))
    a, b = d.select(F.col("doc_id").alias("a"), F.col("w").alias("x")), d.select(F.col("doc_id").alias("b"), F.col("w").alias("y"))
    return a.join(b, a["a"] + 1 == b["b"]).select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("""SELECT vec_id, CASE WHEN label % 4 = 0 THEN 'p. ' || (label + 1) WHEN label % 4 = 1 THEN 'slide ' || (label + 1) || '-' || (label + 3) WHEN label % 4 = 2 THEN 'sheet ' || (label + 1) ELSE '#' || (vec_id + 1) END AS label_text FROM embeddings""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "embeddings"), F.col("label") % 4
    loc = F.when(kind == 0, "pdf_page").when(kind == 1, "slide").when(kind == 2, "sheet")
    start = F.col("label") + 1
    return e.select("vec_id", R.citation(loc, start, F.when(kind == 1, start + 2).otherwise(start), F.col("vec_id")).alias("label_text"))


@query(r"""SELECT item_id, CASE WHEN regexp_matches(lower(text), '^\s*(what|who|define)\b') THEN 'definition' WHEN regexp_matches(lower(text), '\b(compare|versus|vs|difference)\b') THEN 'comparison'
  WHEN regexp_matches(lower(text), '\b(how|steps|guide)\b') THEN 'procedure' WHEN regexp_matches(lower(text), '\b(list|all|every)\b') THEN 'listing'
  WHEN regexp_matches(text, '\b(19|20)[0-9]{2}\b') THEN 'temporal' WHEN length(text) < 120 THEN 'keyword' ELSE 'general' END AS query_type FROM benchmark""")
def query_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    kind = (
        F.when(t.rlike(r"^\s*(what|who|define)\b"), "definition")
        .when(t.rlike(r"\b(compare|versus|vs|difference)\b"), "comparison")
        .when(t.rlike(r"\b(how|steps|guide)\b"), "procedure")
        .when(t.rlike(r"\b(list|all|every)\b"), "listing")
        .when(F.col("text").rlike(r"\b(19|20)[0-9]{2}\b"), "temporal")
        .when(F.length("text") < 120, "keyword")
        .otherwise("general")
    )
    return table(spark, sf_dir, "benchmark").select("item_id", kind.alias("query_type"))


@query(f"""WITH {FTS},
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 5),
tagged AS (SELECT source, min(doc_id) AS id FROM documents GROUP BY source),
more AS (SELECT DISTINCT h.query_id, t.id, 0.45 AS score FROM hits h JOIN documents d ON d.doc_id = h.id JOIN tagged t ON t.source = d.source WHERE (h.query_id, t.id) NOT IN (SELECT (query_id, id) FROM hits))
SELECT query_id, id, score::DOUBLE AS score FROM hits UNION ALL SELECT query_id, id, score::DOUBLE FROM more""")
def tag_union_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, and the first document of each tag (source) among them at the fallback score."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    hits = R.text_candidates(doc_terms(spark, sf_dir), item_terms(spark, sf_dir), 5).select("query_id", "id", "score")
    first = d.groupBy("source").agg(F.min("id").alias("id"))
    tags = hits.join(d, "id").select("query_id", "source").distinct()
    more = tags.join(first, "source").select("query_id", "id", F.lit(R.FALLBACK_SCORE).alias("score")).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return hits.unionByName(more)


@query("""SELECT c_custkey, sha256('{"segment":"' || coalesce(c_mktsegment, '') || '","top_k":8,"workspace":' || c_nationkey || '}') AS scope FROM customer""")
def scope_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of search options as JSON with sorted keys."""
    options = F.struct(F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.lit(8).alias("top_k"), F.col("c_nationkey").alias("workspace"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.to_json(options), 256).alias("scope"))


@query()
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diverse hits of each item's first twenty."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id"), (F.col("doc_id") % 7).alias("chunk_index"), "text")
    hits = R.text_candidates(doc_terms(spark, sf_dir), item_terms(spark, sf_dir), 20)
    return R.diversify(hits.select("query_id", "id", "score").join(docs, "id"), 8)


@query("""WITH ch AS (SELECT doc_id, unnest(generate_series(0, greatest(0, ceil((length(text) - 800) / 700)::INT))) AS chunk_index, text FROM documents WHERE text <> ''),
c AS (SELECT doc_id, chunk_index, trim(substr(text, chunk_index * 700 + 1, 800), ' ') AS text FROM ch)
SELECT h.doc_id AS file_id, h.chunk_index::INT AS chunk_index, md5(string_agg(n.text, chr(10) || chr(10) ORDER BY n.chunk_index)) AS context_md5
FROM c h JOIN c n ON n.doc_id = h.doc_id AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 WHERE h.chunk_index % 3 = 0 GROUP BY h.doc_id, h.chunk_index""")
def context_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.sliding_chunks(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "file_id")
    hits = c.where("chunk_index % 3 = 0").withColumn("query_id", F.lit(0))
    return R.context_window(hits, c, 1).select("file_id", "chunk_index", F.md5("context").alias("context_md5"))
