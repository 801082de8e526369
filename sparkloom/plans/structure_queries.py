"""Queries about the structure of texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import structure as S
from sparkloom.operators.summary_tree import cluster_nodes
from sparkloom.operators.summary_tree import summary_tree as summary_tree_of
from sparkloom.plans.registry import query
from sparkloom.storage import table, texts

CHUNKS = """ch AS (SELECT doc_id, unnest(generate_series(0, greatest(0, ceil((length(text) - 800) / 700)::INT))) AS chunk_index, text FROM documents WHERE text <> ''),
c AS (SELECT doc_id, chunk_index::INT AS chunk_index, chunk_index::INT * 700 AS char_start, trim(substr(text, chunk_index * 700 + 1, 800), ' ') AS text FROM ch)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir)


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, char_start, md5(text) AS text_md5, length(text)::INT AS chars FROM c")
def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_chunks(docs(spark, sf_dir)).select("doc_id", "chunk_index", "char_start", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, sha256(doc_id || chr(31) || chunk_index || chr(31) || char_start || chr(31) || text) AS chunk_sha FROM c")
def chunk_identity_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.sliding_chunks(docs(spark, sf_dir))
    return c.select("doc_id", "chunk_index", T.identity(*(F.col(x) for x in ("doc_id", "chunk_index", "char_start", "text"))).alias("chunk_sha"))


@query(f"WITH {CHUNKS} SELECT sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS embed_hash, count(*) AS uses, min(doc_id) AS first_doc FROM c GROUP BY 1")
def embed_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunk texts: what an embedding cache would hold."""
    c = S.sliding_chunks(docs(spark, sf_dir))
    return c.groupBy(F.sha2(T.strip_space(F.col("text")), 256).alias("embed_hash")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc"))


@query(r"""WITH m AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines, greatest(1, length(text)) AS n, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN list_sum(list_transform(lines, lambda x: length(x))) / len(lines) ELSE 0 END AS mean_line,
  length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?''"()-]', '', 'g')) / n AS odd, (length(text) - length(regexp_replace(text, '\p{L}', '', 'g'))) / n AS letters FROM m)
SELECT doc_id, round(mean_line, 6) AS mean_line, round(odd, 6) AS odd, round(letters, 6) AS letters, mean_line >= 4 AND odd <= 0.2 AND letters >= 0.4 AS good FROM f""")
def text_quality_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.text_quality(F.col("text")).alias("q"))
    return d.select("doc_id", *(F.round(f"q.{c}", 6).alias(c) for c in ("mean_line", "odd", "letters")), "q.good")


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[\s_]+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g'), 1, 128) AS slug FROM documents""")
def slug_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(r"""SELECT page_id, pos::INT AS pos, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""")
def href_link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1), '') AS lang FROM pages""")
def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", one("<title>([^<]*)</title>").alias("title"), one('<html[^>]*lang="([a-z]+)"').alias("lang"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown_pages(texts(spark, sf_dir, "pages"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_table(texts(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), S.html_to_markdown)


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_chunks(docs(spark, sf_dir), 800, 100)


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.text_chunks(docs(spark, sf_dir), 800, recursive=True)


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, every other one with marks of its slides, cut by location, block and size."""

    def read(page_id: int, html: str | None) -> str:
        text = S.html_to_markdown(html)
        if page_id is None or page_id % 2:
            return text
        return "<!-- loc type=slide slide=1 -->\n" + text.replace("\n\n", "\n\n<!-- loc type=slide slide=2 -->\n\n")

    return S.markdown_chunks(texts(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), read=read)


@query()
def raptor_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors within bounded files of fifty."""
    e = table(spark, sf_dir, "embeddings")
    return cluster_nodes(e.select(F.floor(F.col("vec_id") / 50).alias("file_id"), F.col("vec_id").alias("node_id"), "embedding"), 0.25)


@query()
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of summaries over bounded files of fifty vectors, whose texts are the documents of the same number."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    nodes = e.join(d, "vec_id", "left").select(F.floor(F.col("vec_id") / 50).alias("file_id"), F.col("vec_id").alias("node_id"), "embedding", F.coalesce("text", F.lit("")).alias("text"))
    return summary_tree_of(nodes, 0.25)


@query("""WITH s AS (SELECT l_suppkey AS k, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT AS b, l_orderkey, l_linenumber FROM lineitem),
n AS (SELECT *, a > coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM s),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY k ORDER BY a, b, l_orderkey, l_linenumber) AS island FROM n)
SELECT k AS doc_id, min(a)::INT AS "start", max(b)::INT AS "end" FROM g GROUP BY k, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping spans of each supplier joined where they meet."""
    li = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    return S.merge_intervals(li.select(F.col("l_suppkey").alias("doc_id"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end")))


@query(f"""WITH {CHUNKS}, p AS (SELECT doc_id, unnest(generate_series(0, length(text) // 1000)) AS page, text FROM documents WHERE text <> ''),
m AS (SELECT doc_id, page * 1000 AS at, 'p' || page AS mark FROM p WHERE page % 2 = 1 OR doc_id % 2 = 0)
SELECT c.doc_id, c.chunk_index, max_by(m.mark, m.at) AS mark FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.at <= c.char_start GROUP BY c.doc_id, c.chunk_index""".replace(" AS at", " AS pos").replace("m.at", "m.pos"))
def asof_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page mark at or before the start of each chunk."""
    d = docs(spark, sf_dir).where("text <> ''")
    pages = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast(length(text) div 1000 as int)"))).alias("page")).where("page % 2 = 1 OR doc_id % 2 = 0")
    marks = pages.select("doc_id", (F.col("page") * 1000).alias("at"), F.concat(F.lit("p"), "page").alias("mark"))
    points = S.sliding_chunks(d).select("doc_id", F.col("char_start").alias("at"), "chunk_index")
    return S.asof_last(points, marks, "doc_id", "mark").select("doc_id", "chunk_index", "mark")


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, chunk_index, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM c)
SELECT doc_id, chunk_index, used::BIGINT AS used FROM r WHERE used <= 10000 AND n <= 8""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, in order, within 10 000 characters and eight chunks."""
    c = S.sliding_chunks(docs(spark, sf_dir))
    return S.running_budget(c, "doc_id", ["chunk_index"], F.length("text"), 10_000, 8).select("doc_id", "chunk_index", "used")


@query("""SELECT page_id, CASE WHEN length(html) > 400000 THEN 'large' WHEN e IN ('pdf', 'doc', 'docx') THEN 'long_doc' WHEN e IN ('xls', 'xlsx', 'csv') THEN 'table_heavy' WHEN e IN ('eml', 'json') THEN 'qa_pairs' ELSE 'default' END AS profile,
  CASE WHEN e IN ('md', 'txt', 'html', 'htm', 'json') THEN 'text' WHEN e IN ('pdf', 'doc', 'docx', 'odt', 'rtf') THEN 'document' WHEN e IN ('xls', 'xlsx', 'csv') THEN 'sheet' WHEN e = 'eml' THEN 'mail' ELSE 'other' END AS bucket
FROM (SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'eml' WHEN 3 THEN 'html' ELSE '' END AS e FROM pages)""")
def profile_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    name = F.concat(F.lit("File"), F.when(k == 0, ".PDF").when(k == 1, ".csv").when(k == 2, ".eml").when(k == 3, ".html").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", S.profile(name, F.length("html")).alias("profile"), T.file_bucket(name).alias("bucket"))


@query(f"""WITH {CHUNKS} SELECT d.doc_id, chunk_index, sha256('workspace: ' || d.source || chr(10) || 'tags: ' || d.lang || ', q' || coalesce(l.quality::VARCHAR, '?') || chr(10) || 'file: ' || d.doc_id || chr(10) || '---' || chr(10) || c.text) AS input_sha
FROM c JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)""")
def embed_input_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the embedding input of each chunk: a header of metadata over its text."""
    d, l = docs(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality")
    c = S.sliding_chunks(d.select(F.struct("doc_id", "source", "lang").alias("doc_id"), "text")).select("doc_id.*", "chunk_index", "text")
    tags = F.array_join(F.array_sort(F.array(F.col("lang"), F.concat(F.lit("q"), F.coalesce(F.col("quality").cast("string"), F.lit("?"))))), ", ")
    whole = F.concat_ws("\n", F.concat(F.lit("workspace: "), "source"), F.concat(F.lit("tags: "), tags), F.concat(F.lit("file: "), "doc_id"), F.lit("---"), "text")
    return c.join(l, "doc_id", "left").select("doc_id", "chunk_index", F.sha2(whole, 256).alias("input_sha"))


@query(f"""WITH {CHUNKS}, k AS (SELECT doc_id, chunk_index, text, chunk_index // 4 AS parent FROM c)
SELECT doc_id, parent::INT AS parent, count(*) AS children, md5(substr(string_agg(text, chr(10) ORDER BY chunk_index), 1, 32000)) AS parent_md5 FROM k GROUP BY doc_id, parent""")
def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of four chunks each, capped at 32 000 characters."""
    c = S.sliding_chunks(docs(spark, sf_dir)).withColumn("parent", F.floor(F.col("chunk_index") / 4).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x.text)
    return c.groupBy("doc_id", "parent").agg(F.count("*").alias("children"), F.md5(F.substring(F.array_join(texts, "\n"), 1, 32_000)).alias("parent_md5"))


@query(r"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '\b(1[0-9]{3}|20[0-9]{2})\b', 1) AS y FROM documents)
SELECT doc_id, coalesce(list_min(list_transform(y, lambda x: x::INT)), -1) AS first_year, coalesce(list_max(list_transform(y, lambda x: x::INT)), -1) AS last_year FROM e""")
def year_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", T.year_interval(F.col("text")).alias("y"))
    return d.select("doc_id", F.coalesce("y.first", F.lit(-1)).alias("first_year"), F.coalesce("y.last", F.lit(-1)).alias("last_year"))


@query(r"""SELECT doc_id, CASE WHEN length(x) > 48 THEN substr(x, 1, 47) || '…' ELSE x END AS label, CASE WHEN length(e) BETWEEN 1 AND 256 THEN e END AS entity, substr(lower(trim(x, ' ')), 1, 64) AS tag
FROM (SELECT doc_id, string_split(text, chr(10))[1] AS x, regexp_replace(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS e FROM documents)""")
def first_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.get(F.split("text", "\n"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", T.label(line).alias("label"), T.entity_name(line).alias("entity"), T.tag(line).alias("tag"))


@query(r"""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, CAST(coalesce(len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZÀ-Þ]'))), 0) AS INT) AS capitalised, md5(regexp_extract(text, '^[^.!?]*[.!?]')) AS first_sentence FROM t JOIN documents USING (doc_id)""")
def rule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as an event: its first sentence, and how many names it may hold."""
    caps = F.size(F.filter(F.split("text", " "), lambda x: x.rlike("^[A-ZÀ-Þ]")))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(caps, F.lit(0)).alias("capitalised"), F.md5(F.regexp_extract("text", "^[^.!?]*[.!?]", 0)).alias("first_sentence"))


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, chunk_index, length(text) AS chars FROM c),
v AS (SELECT *, (80000 - coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY chars, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // (count(*) OVER (PARTITION BY doc_id) - row_number() OVER (PARTITION BY doc_id ORDER BY chars, chunk_index) + 1) AS fair FROM n),
l AS (SELECT *, max(CASE WHEN chars > fair THEN fair END) OVER (PARTITION BY doc_id) AS level FROM v),
r AS (SELECT *, least(chars, coalesce(level, chars)) AS own, row_number() OVER (PARTITION BY doc_id, chars > coalesce(level, chars) ORDER BY chunk_index) AS place FROM l)
SELECT doc_id, chunk_index, (own + CASE WHEN chars > level AND place <= 80000 - sum(own) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END)::BIGINT AS share FROM r""")
def equal_share_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 000 characters shared evenly among the chunks of a document; what short chunks leave goes to the others."""
    c = S.sliding_chunks(docs(spark, sf_dir)).select("doc_id", "chunk_index", F.length("text").cast("bigint").alias("chars"))
    return S.budget_shares(c, 80_000)
