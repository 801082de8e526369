"""Queries about access, the state of a wiki, entities by rule and bounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import governance as V
from sparkloom.operators import retrieval as R
from sparkloom.plans.registry import query
from sparkloom.storage import table

ACL = """u AS (SELECT s_suppkey AS user_id, s_nationkey AS ws, s_suppkey % 25 = 0 AS admin, s_nationkey % 5 = 0 AS personal, s_suppkey % 4 > 0 AS member FROM supplier),
f AS (SELECT c_custkey AS file_id, c_nationkey AS ws, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey * 10 + c_custkey % 7 END AS folder, c_custkey % 50 AS owner FROM customer),
g AS (SELECT user_id, ws * 10 + k AS folder, (user_id + k) % 4 AS level FROM u, generate_series(0, 6) t(k))"""


@query(f"""WITH {ACL}, r AS (SELECT user_id, file_id FROM u JOIN f USING (ws) WHERE admin OR ((personal OR member) AND owner = user_id AND (personal OR folder IS NULL))
  UNION SELECT u.user_id, file_id FROM u JOIN f USING (ws) JOIN g ON g.user_id = u.user_id AND g.folder = f.folder WHERE NOT admin AND NOT personal AND member AND level >= 2) SELECT * FROM r""")
def readable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier, as a user, may read of its nation's customers, as files."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    user, ws = F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("workspace_id")
    k = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")
    grants = s.select("s_suppkey", "s_nationkey", k).select(user, (F.col("s_nationkey") * 10 + F.col("k")).alias("folder_id"), ((F.col("s_suppkey") + F.col("k")) % 4).alias("level"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace_id"), (F.col("n_nationkey") % 5 == 0).alias("personal"))
    folder = F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey") * 10 + F.col("c_custkey") % 7)
    files = c.select(F.col("c_custkey").alias("file_id"), F.col("c_nationkey").alias("workspace_id"), folder.alias("folder_id"), (F.col("c_custkey") % 50).alias("user_id"))
    return V.readable_files(s.select(user, ws), s.select(user, (F.col("s_suppkey") % 25 == 0).alias("is_admin")), places, s.where("s_suppkey % 4 > 0").select(user, ws), grants, files)


WIKI = """p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'source' ELSE 'topic' END AS kind, CASE WHEN p_partkey % 11 > 0 THEN lower(replace(p_name, ' ', '-')) || '-' || p_partkey % 40 ELSE '' END AS slug FROM part),
l AS (SELECT p_partkey AS source, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 7 % 150 END AS target, lower(replace(p_name, ' ', '-')) || '-' || p_partkey % 30 AS slug, CASE p_partkey % 13 WHEN 0 THEN 'deleted' WHEN 1 THEN 'acl' END AS reason FROM part WHERE p_partkey % 5 > 0)"""


def wiki(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as pages of three kinds, and links between them by number or by slug."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = lambda n: F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), (k % n).cast("string"))
    pages = p.select(k.alias("file_id"), F.when(k % 3 == 0, "concept").when(k % 3 == 1, "source").otherwise("topic").alias("page_kind"), F.when(k % 11 > 0, name(40)).otherwise("").alias("slug"))
    links = p.where("p_partkey % 5 > 0").select(k.alias("source"), F.when(k % 2 == 0, k * 7 % 150).alias("target"), name(30).alias("slug"), F.when(k % 13 == 0, "deleted").when(k % 13 == 1, "acl").alias("reason"))
    return links, pages


@query(f"""WITH {WIKI}, s AS (SELECT slug, min(id) AS id FROM p WHERE slug <> '' GROUP BY slug), e AS (SELECT l.source, l.target IS NOT NULL AS direct, coalesce(l.target, s.id) AS target, reason, l.target IS NULL AND s.id IS NOT NULL AS mended FROM l LEFT JOIN s ON l.target IS NULL AND s.slug = l.slug)
SELECT DISTINCT source, e.target, CASE WHEN direct THEN 'file_direct' ELSE 'wiki_topic' END AS edge_type FROM e JOIN p ON p.id = e.target WHERE (reason IS NULL OR mended) AND (direct OR kind IN ('concept', 'topic'))""")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, pages = wiki(spark, sf_dir)
    return V.typed_edges(links.select("source", F.when(F.col("target").isNull(), "wiki_slug").otherwise("file_id").alias("kind"), "target", "slug", F.col("reason").isNotNull().alias("broken")), pages)


@query(f"""WITH {WIKI} SELECT 'broken' AS finding, source AS file_id, slug AS target FROM l WHERE reason = 'deleted' UNION ALL SELECT 'acl_broken', source, target::VARCHAR FROM l WHERE reason = 'acl'
UNION ALL SELECT 'missing_slug', id, kind FROM p WHERE kind <> 'source' AND slug = '' UNION ALL SELECT 'orphan', id, slug FROM p WHERE kind <> 'source' AND slug <> '' AND id NOT IN (SELECT source FROM l) AND id NOT IN (SELECT target FROM l WHERE reason IS NULL AND target IS NOT NULL)""")
def wiki_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lint(*wiki(spark, sf_dir))


@query("""WITH c AS (SELECT l_suppkey AS q, l_orderkey AS file, l_orderkey * 10 + l_linenumber AS chunk, l_partkey % 5 AS entity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
s AS (SELECT * FROM c WHERE n <= 3), e AS (SELECT DISTINCT s.q, c.entity FROM s JOIN c ON c.file = s.file AND c.chunk = s.chunk), x AS (SELECT DISTINCT s.q, c.chunk FROM s JOIN c ON c.file = s.file JOIN e ON e.q = s.q AND e.entity = c.entity WHERE (s.q, c.chunk) NOT IN (SELECT (q, chunk) FROM s))
SELECT q AS query_id, chunk AS chunk_id, 0.405::DOUBLE AS score FROM x QUALIFY row_number() OVER (PARTITION BY q ORDER BY chunk) <= 8""")
def entity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the hits' files that name what the hits name."""
    li = table(spark, sf_dir, "lineitem")
    chunks = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), (F.col("l_partkey") % 5).alias("entity"), F.col("l_extendedprice").alias("score"))
    hits = R.top_per_query(chunks.withColumn("id", F.col("chunk_id")), "score", 3).select("query_id", "file_id", "chunk_id", "rank")
    return V.entity_neighbours(hits, chunks.select("file_id", "chunk_id", "entity"))


@query("""WITH x AS (SELECT p_partkey AS chunk_id, [p_brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE 'Year 2020' END] AS cells FROM part WHERE p_partkey % 3 = 0),
h AS (SELECT chunk_id, unnest(cells) AS entity FROM x)
SELECT DISTINCT chunk_id, entity, 'column_header' AS relation, CASE WHEN regexp_matches(entity, '[0-9]') THEN 'metric' ELSE 'concept' END AS entity_type FROM h
UNION ALL SELECT p_partkey, p_name, 'caption', CASE WHEN p_partkey % 3 = 0 THEN 'metric' ELSE 'concept' END FROM part WHERE p_partkey % 2 = 0""")
def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of tables and captions name."""
    k = F.col("p_partkey")
    last = F.when(k % 4 == 0, F.col("p_type")).otherwise("Year  2020")
    grid = F.concat(F.lit("\n| "), "p_brand", F.lit(" | "), "p_type", F.lit(" | "), last, F.lit(" |\n|---|:--|---|\n| 1 | 2 | 3 |"))
    chunks = table(spark, sf_dir, "part").select(k.alias("chunk_id"), F.when(k % 3 == 0, "Table").otherwise("paragraph").alias("kind"), grid.alias("text"), F.when(k % 2 == 0, F.concat(F.lit(" "), "p_name")).alias("caption"))
    return V.rule_entities(chunks)


@query("SELECT s_suppkey AS entity FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 400 = 7)")
def entity_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that nothing mentions once most files are deleted."""
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("file_id"))
    deleted = table(spark, sf_dir, "orders").where("o_orderkey % 400 <> 7").select(F.col("o_orderkey").alias("file_id"))
    return V.unreferenced(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity")), mentions, deleted)


@query(r"""WITH n AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), o AS (SELECT page_id AS source, '/old' || page_id % 5 AS target FROM pages UNION ALL SELECT page_id, '/same' FROM pages)
SELECT source, target FROM o WHERE source % 3 > 0 UNION SELECT source, target FROM n WHERE source % 3 = 0""")
def link_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, those of every third scanned again."""
    p = table(spark, sf_dir, "pages")
    found = p.select(F.col("page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    old = p.select(F.col("page_id").alias("source"), F.explode(F.array(F.concat(F.lit("/old"), (F.col("page_id") % 5).cast("string")), F.lit("/same"))).alias("target"))
    return V.rebuilt_links(old, p.where("page_id % 3 = 0").select(F.col("page_id").alias("source")), found)


@query("""WITH b AS (SELECT o_custkey AS key, o_orderkey AS value, o_orderkey AS pos FROM orders WHERE o_orderkey % 4 = 0)
SELECT c_custkey AS key, -c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM b) UNION ALL SELECT key, max_by(value, pos) FROM b GROUP BY key""")
def cache_put_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after a batch in which keys repeat."""
    batch = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("position"))
    return V.put_many(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (-F.col("c_custkey")).alias("value")), batch)


@query(f"""WITH s AS (SELECT doc_id, octet_length(encode(text)) AS r, octet_length(encode(substr(text, 1, 900))) AS e, octet_length(encode(source)) * 40 AS a, octet_length(encode(lang)) * 300 AS x FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, r, e, a, x, r + e + a + x AS t0 FROM s), t1 AS (SELECT *, t0 > 1200 AS c0, CASE WHEN t0 > 1200 THEN t0 - r + {len(V.CUT)} ELSE t0 END AS n1 FROM t),
t2 AS (SELECT *, n1 > 1200 AS c1, CASE WHEN n1 > 1200 THEN n1 - e + {len(V.CUT)} ELSE n1 END AS n2 FROM t1), t3 AS (SELECT *, n2 > 1200 AS c2, CASE WHEN n2 > 1200 THEN n2 - a + {len(V.CUT)} ELSE n2 END AS n3 FROM t2),
t4 AS (SELECT *, n3 > 1200 AS c3, CASE WHEN n3 > 1200 THEN n3 - x + {len(V.CUT)} ELSE n3 END AS n4 FROM t3)
SELECT doc_id AS key, n4::INT AS n_bytes, concat_ws(',', CASE WHEN c0 THEN 'retrieval' END, CASE WHEN c1 THEN 'evidence' END, CASE WHEN c2 THEN 'answer' END, CASE WHEN c3 THEN 'extraction' END) AS cut, NOT (c0 OR c1 OR c2 OR c3) AS whole FROM t4""")
def bounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four sections within 1 200 bytes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return V.bounded_answer(d.select(F.col("doc_id").alias("key"), F.col("text").alias("retrieval"), F.substring("text", 1, 900).alias("evidence"), F.repeat("source", F.lit(40)).alias("answer"), F.repeat("lang", F.lit(300)).alias("extraction")), 1200)


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS call, o_orderkey % 500 AS chars, o_orderkey % 5 > 0 AS readable, coalesce(max(CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) = 1 AS halted FROM orders),
w AS (SELECT run_id, 0::BIGINT AS call, 0 AS n, 0::BIGINT AS used, '' AS reason FROM (SELECT DISTINCT run_id FROM c)
  UNION ALL SELECT run_id, call, n + (reason = '')::INT, used + CASE WHEN reason = '' THEN chars ELSE 0 END, reason FROM (
    SELECT c.run_id, c.call, w.n, w.used, c.chars, CASE WHEN halted THEN 'stopped' WHEN NOT readable THEN 'not_readable' WHEN n >= 4 THEN 'calls' WHEN used + chars > 900 THEN 'chars' ELSE '' END AS reason FROM w JOIN c ON c.run_id = w.run_id AND c.call = w.call + 1))
SELECT run_id, call, reason = '' AS accepted, reason FROM w WHERE call > 0""")
def budgeted_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which secondary searches of a run stay within its budgets."""
    o = table(spark, sf_dir, "orders")
    call = F.row_number().over(R.Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    calls = o.select(F.col("o_custkey").alias("run_id"), call.alias("call"), (F.col("o_orderkey") % 500).alias("chars"), (F.col("o_orderkey") % 5 > 0).alias("readable"), (F.col("o_orderkey") % 17 == 0).alias("stopped"))
    return V.within_budget(calls, 4, 900)


ASKED = ["图里是什么", "它们什么关系", "标签的关联", "相关文档", "合计多少", "合同条款", "归档在哪", "如何操作", "列出要点", "知识库", "plain question", " 一个很长的没有任何关键词的中文问句啊 "]
TYPES = ["figure_vlm", "struct_relation", "tag_topic", "topic_wiki", "structured_field", "cjk_doc", "tag_archive", "procedure", "full_summary", "exact_term", "fact", "fact"]


@query(f"SELECT p_partkey, {TYPES}[p_partkey % {len(TYPES)} + 1] AS query_type FROM part")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of answer questions ask for."""
    asked = F.get(F.array(*map(F.lit, ASKED)), (F.col("p_partkey") % len(ASKED)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", V.question_type(asked).alias("query_type"))
