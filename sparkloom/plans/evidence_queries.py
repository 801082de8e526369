"""Queries about evidence: windows, citations, traces, states of files, and associations of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import association as A
from sparkloom.operators import evidence as E
from sparkloom.operators import graph as G
from sparkloom.operators import retrieval as R
from sparkloom.plans.graph_queries import TREE, tree
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval_queries import FTS, HYBRID, doc_terms, hybrid_queries, item_terms, vectors
from sparkloom.plans.search import SearchOptions, funnel
from sparkloom.storage import table, texts

ASKED = ["合同", " 报告 ", "发票", "AFRICA", "简历"]
SQL_LISTS = ", ".join(f"({k}, {q!r}, {terms!r})" for k, (q, terms) in enumerate(E.EXPANSIONS.items()))


@query(f"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(split_part(text, ' ', 1)) ELSE [{", ".join(repr(q.strip()) for q in ASKED)}][1 + doc_id % {len(ASKED)}] END AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, coalesce(l, [t]) AS l FROM q LEFT JOIN (VALUES {SQL_LISTS}) v(k, w, l) ON w = t)
SELECT doc_id AS query_id, (unnest(generate_series(1, len(l))) - 1)::INT AS n, unnest(l) AS term FROM x""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What short terms are searched as: the first words of half the documents, and terms among which some are known."""
    some = F.get(F.array(*map(F.lit, ASKED)), (F.col("doc_id") % len(ASKED)).cast("int"))
    asked = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, F.substring_index("text", " ", 1)).otherwise(some).alias("text"))
    return E.expanded(asked)


HALF = "qt AS (SELECT query_id, w, i FROM (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY w) AS i FROM qt0))"


@query(f"""WITH {FTS.replace("qt AS (", "qt0 AS (", 1).replace(", dw AS", f", {HALF}, dw AS", 1)},
l AS (SELECT query_id, i % 2 AS part, doc_id AS id, round(0.1::DOUBLE * sum(tf), 6) AS score FROM qt JOIN dt USING (w) GROUP BY query_id, i % 2, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) AS rn FROM l QUALIFY rn <= 20)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS rrf FROM r GROUP BY query_id, id""")
def rrf_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of terms of each query, searched on their own and fused."""
    docs, sets = doc_terms(spark, sf_dir), item_terms(spark, sf_dir).select("query_id", F.array_sort("terms").alias("t"))
    half = lambda odd: sets.select("query_id", F.filter("t", lambda _, i: i % 2 == odd).alias("terms"))
    return R.fuse([R.text_candidates(docs, half(k).where(F.size("terms") > 0), 20) for k in (0, 1)]).select("query_id", "id", F.round("rrf", 6).alias("rrf"))


@query(f"""WITH {HYBRID}, m AS (SELECT query_id, count(*) AS merged FROM (SELECT query_id, id FROM f UNION SELECT query_id, id FROM n) GROUP BY query_id)
SELECT query_id, (SELECT count(*) FROM n WHERE n.query_id = m.query_id) AS vector_candidates, (SELECT count(*) FROM f WHERE f.query_id = m.query_id) AS text_candidates, merged AS merged_unique,
  (SELECT count(*) FROM c WHERE c.query_id = m.query_id) AS after_min_score, least(8, (SELECT count(*) FROM c WHERE c.query_id = m.query_id)) AS final, least(96, merged) AS after_access,
  0::BIGINT AS filename_boosted, least(8, (SELECT count(*) FROM c WHERE c.query_id = m.query_id)) AS after_mmr, least(8, (SELECT count(*) FROM c WHERE c.query_id = m.query_id)) AS after_rerank FROM m""")
def search_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each step of hybrid search leaves."""
    return funnel(doc_terms(spark, sf_dir), vectors(spark, sf_dir), hybrid_queries(spark, sf_dir), SearchOptions())


ORIGINS = ["search_hit", *E.PROVENANCE, "unknown"]
SQL_ORIGINS = " ".join(f"WHEN '{k}' THEN '{p}|{c}|{s}'" for k, (p, c, s) in E.PROVENANCE.items())


@query(f"""WITH o AS (SELECT o_orderkey, [{', '.join(repr(x) for x in ORIGINS)}][o_orderkey % {len(ORIGINS)} + 1] AS origin, o_totalprice / 200000 AS score FROM orders),
p AS (SELECT o_orderkey, string_split(CASE origin WHEN 'search_hit' THEN 'inferred|' || CASE WHEN score >= 0.5 THEN '0.85' ELSE '0.65' END || '|search_hit' {SQL_ORIGINS} ELSE 'ambiguous|0.2|wiki_link' END, '|') AS x FROM o)
SELECT o_orderkey, x[1] AS provenance, x[2]::DOUBLE AS confidence, x[3] AS source_kind FROM p""")
def provenance_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where hits come from, and how far they are to be trusted."""
    origin = F.get(F.array(*map(F.lit, ORIGINS)), (F.col("o_orderkey") % len(ORIGINS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.provenance(origin, F.col("o_totalprice") / 200000).alias("p")).select("o_orderkey", "p.*")


@query(r"""SELECT page_id, '/api/files/' || page_id || '/preview' AS preview_url, CASE WHEN regexp_matches(b, '^[A-Za-z0-9_-][A-Za-z0-9._-]*$') THEN b END AS asset_key, CASE WHEN page_id % 7 >= 1 THEN page_id % 7 END AS page, nullif(CASE WHEN page_id % 2 = 0 THEN 'Figure' ELSE '' END, '') AS caption
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS b FROM pages WHERE page_id % 3 = 0)""")
def figure_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets and previews of the pages that hold a figure."""
    i = F.col("page_id")
    refs = E.figure_refs(i, F.when(i % 3 == 0, "figure").otherwise("text"), F.col("url"), i % 7, F.when(i % 2 == 0, "Figure").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", refs.alias("r")).where("r IS NOT NULL").select("page_id", "r.*")


FILES = """f AS (SELECT o_orderkey AS file_id, 'Order ' || o_orderkey || ' of ' || o_custkey AS name, o_orderdate AS updated_at,
  CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN ' running' WHEN 2 THEN NULL ELSE 'done' END AS extract, CASE o_orderkey % 5 WHEN 0 THEN 'indexing' WHEN 1 THEN NULL WHEN 2 THEN 'failed' ELSE 'ready' END AS index, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'done' END AS post FROM orders),
s AS (SELECT file_id, name, updated_at, CASE WHEN coalesce(index, '') <> 'ready' THEN CASE WHEN trim(extract) IN ('pending', 'processing', 'queued', 'running') THEN 'extract_' || trim(extract) ELSE 'index_' || coalesce(index, 'pending') END
    WHEN post = 'queued' THEN 'post_queued' WHEN post = 'failed' THEN 'post_failed' END AS stage,
  CASE WHEN coalesce(index, '') <> 'ready' THEN 'processing_placeholder' WHEN post = 'queued' THEN 'final_md_post_pending' WHEN post = 'failed' THEN 'final_md_post_failed' END AS source_kind,
  coalesce(index, '') = 'ready' AS is_final, CASE WHEN coalesce(index, '') <> 'ready' THEN 'none' WHEN post IN ('queued', 'failed') THEN 'partial' ELSE 'final' END AS confidence FROM f)"""


def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files in all states of extraction, indexing and what comes after."""
    k = F.col("o_orderkey")
    extract = F.when(k % 6 == 0, "pending").when(k % 6 == 1, " running").when(k % 6 > 2, "done")
    index = F.when(k % 5 == 0, "indexing").when(k % 5 == 2, "failed").when(k % 5 > 2, "ready")
    after = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "failed").otherwise("done")
    name = F.concat(F.lit("Order "), k.cast("string"), F.lit(" of "), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(k.alias("file_id"), name.alias("name"), F.col("o_orderdate").alias("updated_at"), E.processing_stage(extract, index, after).alias("p")).select("file_id", "name", "updated_at", "p.*")


@query(f"WITH {FILES} SELECT file_id, stage, source_kind, is_final, confidence FROM s")
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_files(spark, sf_dir).drop("name", "updated_at")


@query(f"""WITH {FILES}, q AS (SELECT n_nationkey AS query_id, 'of ' || n_nationkey AS text FROM nation),
m AS (SELECT query_id, file_id, stage, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, file_id DESC) AS n FROM s JOIN q ON contains(lower(name), text) WHERE NOT is_final)
SELECT query_id, file_id, 0.05::DOUBLE AS score, stage FROM m WHERE n <= 8 AND file_id % 9 <> 0""")
def processing_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are named like a query and not ready yet."""
    files = staged_files(spark, sf_dir)
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Of "), F.col("n_nationkey").cast("string")).alias("text"))
    hits = files.where("file_id % 9 = 0").select("file_id").join(F.broadcast(asked.select("query_id")))  # a few hits of each of the 25 queries
    return E.placeholders(hits, files, asked, 8)


SAMPLE = ["the", "und", "les"]


@query(rf"""WITH d AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n FROM documents WHERE length(text) >= 400),
p AS (SELECT doc_id, t, k, string_split(low, t) AS parts FROM d, (VALUES ('the', 1), ('und', 2), ('les', 3)) v(t, k)),
h AS (SELECT doc_id, k, t, i, greatest(0, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(t) - ('0x' || substr(md5(doc_id || ':' || t || ':' || i), 1, 8))::BIGINT % 121) AS s
  FROM (SELECT *, unnest(generate_series(1, least(20, len(parts) - 1))) AS i FROM p WHERE len(parts) > 1)),
hk AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS o FROM h QUALIFY o <= 20),
w AS (SELECT doc_id, ('0x' || substr(md5(doc_id || ':any:' || i), 1, 8))::BIGINT % (n - 399) AS s, 100 + i AS o FROM d, generate_series(1, 6) g(i)
  UNION ALL SELECT doc_id, least(n - 1, greatest(0, ('0x' || substr(md5(doc_id || ':near:' || i), 1, 8))::BIGINT % 401 - 200)), 200 + i FROM d, generate_series(1, 20) g(i)),
a AS (SELECT doc_id, s, min(o) AS o FROM (SELECT * FROM hk UNION ALL SELECT * FROM w) GROUP BY doc_id, s),
f AS (SELECT doc_id, s FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) <= 20),
e AS (SELECT doc_id, f.s, least(n, f.s + ('0x' || substr(md5(doc_id || ':size:' || f.s), 1, 8))::BIGINT % 401 + 400) AS e, text, n FROM f JOIN d USING (doc_id)),
c AS (SELECT doc_id, s, e, round(0.6 * ((contains(x, 'the')::INT + contains(x, 'und')::INT + contains(x, 'les')::INT) / 3) + 0.4 * greatest(0, 1 - abs(s + (e - s) / 2) / n), 6) AS score
  FROM (SELECT *, lower(substr(text, s + 1, e - s)) AS x FROM e WHERE e - s >= 80))
SELECT doc_id, s AS start, e AS "end", score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s)::INT AS rank FROM c QUALIFY rank <= 3""")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sampled windows of each long text."""
    return E.sampled_windows(texts(spark, sf_dir).select("doc_id", "text"), SAMPLE, 3)


@query(r"""WITH d AS (SELECT doc_id, text, trim(substr(text, 11, 60)) AS x FROM documents WHERE length(text) >= 100),
e AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN x || ' zzz' ELSE x END AS x FROM d),
p AS (SELECT doc_id, text, '(?s)^(.*?)(' || array_to_string(list_transform(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\s+') || ')' AS p FROM e),
f AS (SELECT doc_id, text, regexp_matches(text, p) AS verified, length(regexp_extract(text, p, 1)) AS a, length(regexp_extract(text, p, 2)) AS n FROM p)
SELECT doc_id, sha256(text) AS source_sha256, verified, CASE WHEN verified THEN a END AS start, CASE WHEN verified THEN a + n END AS "end",
  CASE WHEN verified THEN sha256(substr(text, greatest(0, a - 240) + 1, a + n + 240 - greatest(0, a - 240))) END AS context_sha256 FROM f""")
def citation_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts with other white space checked against their sources, with their places and what stands around; one in five is not in its source."""
    d = texts(spark, sf_dir).where(F.length("text") >= 100).select("doc_id", "text", F.trim(F.substring("text", 11, 60)).alias("x"))
    said = F.regexp_replace(F.when(F.col("doc_id") % 5 == 0, F.concat("x", F.lit(" zzz"))).otherwise(F.col("x")), " ", " 　\n")
    found = E.verified_citations(d.select("doc_id", said.alias("excerpt"), "text"))
    return found.select("doc_id", "source_sha256", "verified", "start", "end", F.sha2("context", 256).alias("context_sha256"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders), l AS (SELECT o_custkey, list(o_orderkey ORDER BY n) AS ids, count(*) AS c FROM o WHERE n <= 100 GROUP BY o_custkey),
h AS (SELECT o_custkey, ids, unnest(generate_series(0, 7)) AS k FROM l), z AS (SELECT o_custkey, k, list_reduce(list_prepend(len(ids)::BIGINT, list_transform(generate_series(1, k), lambda x: 0::BIGINT)), lambda a, x: greatest(1, a // 2)) AS m, ids FROM h),
j AS (SELECT o_custkey, k, ids[1:m] AS ids FROM z) SELECT o_custkey, array_to_string(ids, ',') AS ids FROM j WHERE length('[' || array_to_string(ids, ',') || ']') <= 40 OR len(ids) = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k) = 1""")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each customer's best hits, halved until a trace is within its bytes."""
    first = R.top_per_query(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "score", 100)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id)
    kept = first.groupBy(F.col("query_id").alias("o_custkey")).agg(E.bounded_ids(ids, 100, 40).alias("ids"))
    return kept.select("o_custkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH j AS (SELECT o_custkey AS file_id, o_orderkey AS job_id, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
s AS (SELECT l_orderkey AS job_id, l_returnflag AS stage, min(l_shipdate) AS first, max({'at': l_shipdate, 's': l_linestatus}).s AS s FROM lineitem GROUP BY l_orderkey, l_returnflag)
SELECT file_id, job_id, status, count(stage) AS n_stages, coalesce(string_agg(stage || '=' || s, ' > ' ORDER BY first, stage, s), '') AS timeline FROM j LEFT JOIN s USING (job_id) GROUP BY file_id, job_id, status""")
def pipeline_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that the latest job of each file went through."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    logs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("at"))
    return E.stage_timeline(jobs, logs)


@query("""WITH t AS (SELECT o_custkey AS file_id, year(o_orderdate)::INT AS job_id, o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS finished_at, o_orderdate AS created_at FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT file_id, job_id, id FROM t QUALIFY row_number() OVER (PARTITION BY file_id, job_id ORDER BY finished_at IS NOT NULL DESC, finished_at DESC NULLS LAST, created_at DESC, id DESC) = 1""")
def trace_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    done = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    traces = o.select(F.col("o_custkey").alias("file_id"), F.year("o_orderdate").alias("job_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), done.alias("finished_at"), F.col("o_orderdate").alias("created_at"))
    return E.newest_trace(traces, ("f", "o")).select("file_id", "job_id", "id")


@query("""WITH s AS (SELECT n_nationkey AS workspace, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 500 ELSE 100000000 END AS cur, (n_nationkey % 3)::INT AS rnd, n_nationkey % 4 = 2 AS complete FROM nation WHERE n_nationkey % 5 > 0),
b AS (SELECT DISTINCT c_nationkey AS workspace, CASE WHEN coalesce(complete, false) THEN 0 ELSE coalesce(cur, 0) END AS cur, coalesce(rnd, 0) + coalesce(complete, false)::INT AS rnd FROM customer LEFT JOIN s ON workspace = c_nationkey),
k AS (SELECT b.workspace, cur, rnd, c_custkey AS id, row_number() OVER (PARTITION BY b.workspace ORDER BY c_custkey) AS n FROM b LEFT JOIN customer ON c_nationkey = b.workspace AND c_custkey > cur)
SELECT workspace, coalesce(max(id) FILTER (n <= 3), cur)::BIGINT AS "cursor", rnd AS round, count(id) <= 3 AS complete FROM k GROUP BY workspace, cur, rnd""")
def reconcile_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workspace's checkpoint after a page of three."""
    k = F.col("n_nationkey")
    state = table(spark, sf_dir, "nation").where(k % 5 > 0).select(k.alias("workspace"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 500).otherwise(100_000_000).alias("cursor"), (k % 3).cast("int").alias("round"), (k % 4 == 2).alias("complete"))
    return E.reconcile_page(state, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("workspace"), F.col("c_custkey").alias("id")), 3)[1]


@query(r"""WITH p AS (SELECT doc_id, item_id, trim(b.text, ' ') AS t FROM (SELECT doc_id, doc_id % 20 AS k FROM documents WHERE doc_id % 10 = 0) JOIN (SELECT item_id, text FROM benchmark) b ON item_id = k)
SELECT doc_id, 0 AS chunk_index, md5(coalesce(t, text)) AS text_md5, len(list_filter(regexp_split_to_array(lower(coalesce(t, text)), '\W+'), lambda w: w <> ''))::INT AS n_terms, t IS NOT NULL AS manual_override FROM documents LEFT JOIN p USING (doc_id) WHERE text IS NOT NULL""")
def chunk_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts edited by hand, and what follows from them."""
    d = texts(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    patch = d.where("doc_id % 10 = 0").select("doc_id", "chunk_index", (F.col("doc_id") % 20).alias("item_id")).join(table(spark, sf_dir, "benchmark"), "item_id")
    return E.edited(d, patch).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.size("terms").alias("n_terms"), "manual_override")


@query("""SELECT p_partkey AS block_id, CASE p_partkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'table' WHEN 2 THEN 'equation' ELSE 'text' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '.png' ELSE p_name END AS body, p_size AS page,
  CASE WHEN p_partkey % 5 <= 1 THEN p_type END AS caption FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 > 0""")
def layout_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign layout blocks in one form; those without content are left out."""
    k = F.col("p_partkey")
    label = F.when(k % 5 == 0, " Picture").when(k % 5 == 1, "TABLE").when(k % 5 == 2, "formula").otherwise("paragraph")
    blocks = table(spark, sf_dir, "part").select(k.alias("block_id"), label.alias("label"), F.when(k % 7 > 0, F.col("p_name")).otherwise("  ").alias("text"), F.concat("p_brand", F.lit(".png")).alias("path"), F.col("p_type").alias("caption"), F.col("p_size").alias("page"))
    return E.adapted_blocks(blocks)


@query(f"""WITH RECURSIVE {TREE}
SELECT root, node, (row_number() OVER (PARTITION BY root ORDER BY label, node))::INT AS pos, repeat('  ', level) || '- ' || split_part(label, '/', level + 1) AS line FROM w""")
def layout_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workspace as a nested list of its folders and files."""
    return G.layout_lines(tree(spark, sf_dir))


@query("""SELECT p_partkey, 'See [[wiki:' || CASE WHEN p_type = 'ECONOMY' THEN 'budget' ELSE p_type END || ']], [[' || p_name || '|' || CASE WHEN p_type = 'ECONOMY' THEN 'wiki:budget' ELSE 'wiki: ' || p_type END || ']] and `[[wiki:ECONOMY]]`.' AS text FROM part""")
def slug_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after the page "economy" was renamed."""
    note = F.concat(F.lit("See [[wiki:"), F.col("p_type"), F.lit("]], [["), F.col("p_name"), F.lit("|wiki: "), F.col("p_type"), F.lit("]] and `[[wiki:ECONOMY]]`."))
    return table(spark, sf_dir, "part").select("p_partkey", T.renamed_slug(note, "economy", "budget").alias("text"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '') || ' 检索' || coalesce(lang, '') || '知识库x_1发'), '[一-鿿]+|[a-z0-9_]+') AS r FROM documents),
f AS (SELECT doc_id, flatten(list_transform(r, lambda x: CASE WHEN regexp_full_match(x, '[一-鿿]{2,}') THEN list_transform(generate_series(1, length(x) - 1), lambda k: substr(x, k, 2)) ELSE [x] END)) AS t FROM t)
SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM f""")
def analyzer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents that end in mixed scripts."""
    mixed = F.concat(F.coalesce("text", F.lit("")), F.lit(" 检索"), F.coalesce("lang", F.lit("")), F.lit("知识库x_1发"))
    tokens = texts(spark, sf_dir).select("doc_id", T.analysed(mixed, "cjk").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name || '|' || p_type || '|' || p_brand ELSE '' END AS anchors FROM part""")
def question_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that questions are about."""
    k = F.col("p_partkey") % 3
    asked = F.when(k == 0, F.concat(F.lit("what lies  between "), "p_name", F.lit(" and "), "p_brand", F.lit(" were they?")))
    asked = asked.when(k == 1, F.concat("p_name", F.lit(", "), "p_type", F.lit(" and "), "p_brand", F.lit(" coworkers?"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.anchors(asked), "|").alias("anchors"))


@query(r"""WITH q AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' in ' || (1890 + doc_id % 150) || ' or 2001' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' they worked  on' ELSE '' END, '\s+', ' ', 'g'))) AS q FROM documents),
y AS (SELECT doc_id, q, list_transform(list_filter(regexp_extract_all(q, '[0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9]{2}')), lambda x: x::INT) AS y FROM q)
SELECT doc_id, list_min(y) AS first_year, list_max(y) AS last_year, len(y) = 0 AND regexp_matches(q, 'when|year|date|period|duration') AS wants_time, regexp_matches(q, 'worked\s+on|which\s+project') AS wants_project FROM y""")
def question_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text, read as a question, demands of claims."""
    i = F.col("doc_id")
    years = F.when(i % 3 == 0, F.concat(F.lit(" in "), (1890 + i % 150).cast("string"), F.lit(" or 2001"))).otherwise("")
    asked = F.concat(F.coalesce("text", F.lit("")), years, F.when(i % 4 == 0, " they worked  on").otherwise(""))
    return texts(spark, sf_dir).select("doc_id", A.constraints(asked).alias("c")).select("doc_id", "c.*")


CLAIMS = """k AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_partkey AS source, l_suppkey AS target, CASE l_linenumber % 4 WHEN 0 THEN 'located_in' WHEN 1 THEN 'owns' WHEN 2 THEN 'not_owns' ELSE 'related_to' END AS predicate,
  CASE WHEN l_linenumber % 5 > 0 THEN year(l_shipdate) END AS first, CASE WHEN l_linenumber % 5 > 0 THEN year(l_shipdate) + 1 END AS last, l_linestatus AS status FROM lineitem)"""


@query(f"""WITH {CLAIMS}, o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY claim_id) <= 24),
c AS (SELECT a.claim_id, o.claim_id AS other, coalesce(a.first <= o.last AND o.first <= a.last, true) AS meet, a.target = o.target AS same, a.predicate = o.predicate AS eq, a.status <> o.status AS differ, a.predicate = 'located_in' AS functional
  FROM k a JOIN o ON a.source = o.source AND replace(a.predicate, 'not_', '') = replace(o.predicate, 'not_', '') AND a.claim_id <> o.claim_id),
x AS (SELECT DISTINCT claim_id, least(claim_id, other) AS a, greatest(claim_id, other) AS b FROM c WHERE meet AND ((same AND NOT eq) OR (same AND eq AND differ) OR (eq AND functional AND NOT same))),
p AS (SELECT claim_id // 10 AS path_id, claim_id FROM k WHERE claim_id % 10 <= CASE WHEN (claim_id // 10) % 2 = 0 THEN 1 ELSE 2 END),
n AS (SELECT path_id, count(DISTINCT (a, b)) AS n FROM p JOIN x USING (claim_id) GROUP BY path_id),
e AS (SELECT path_id, count(*) AS n_claims, bool_or(first IS NOT NULL AND first <= 1996 AND last >= 1995) AS timely, bool_or(source % 10 = 0 OR target % 10 = 0) AS lost, min(predicate) AS predicate FROM p JOIN k USING (claim_id) GROUP BY path_id)
SELECT path_id, n_claims, coalesce(n, 0) AS n_conflicts, CASE WHEN coalesce(n, 0) > 0 THEN 'conflicted' WHEN NOT timely THEN 'insufficient' WHEN lost OR (n_claims = 1 AND predicate = 'related_to') THEN 'adjacent_only' WHEN n_claims = 1 THEN 'direct' ELSE 'composed' END AS level
FROM e LEFT JOIN n USING (path_id)""")
def path_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well paths of one or two claims answer a question about 1995 and 1996."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    known = lambda more: F.when(n % 5 > 0, F.year("l_shipdate") + more)
    predicate = F.when(n % 4 == 0, "located_in").when(n % 4 == 1, "owns").when(n % 4 == 2, "not_owns").otherwise("related_to")
    claims = li.select((F.col("l_orderkey") * 10 + n).alias("claim_id"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), predicate.alias("predicate"), known(0).alias("first"), known(1).alias("last"), F.col("l_linestatus").alias("status"))
    path = F.floor(F.col("claim_id") / 10)
    paths = claims.select(path.alias("path_id"), "claim_id").where(F.col("claim_id") % 10 <= F.when(F.col("path_id") % 2 == 0, 1).otherwise(2))
    nodes = li.select(F.col("l_partkey").alias("node")).unionByName(li.select(F.col("l_suppkey").alias("node"))).where("node % 10 = 0")
    return A.path_levels(paths, claims, nodes, 1995, 1996)
