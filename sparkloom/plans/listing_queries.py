"""Listings, queues, drill-down and governance queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import listing as L
from sparkloom.operators import relational as R
from sparkloom.operators import structure as S
from sparkloom.plans.graph_queries import LINKS, TAGS, file_tags, links
from sparkloom.plans.registry import query
from sparkloom.plans.structure_queries import CHUNKS, docs
from sparkloom.storage import table

# Queries of the keyword guard, and the needle of the occurrence scan.
KEYWORDS, NEEDLE = ["example", "Nicht", "zzz"], "the"


def joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(F.array_sort(F.collect_set(column)), by)


@query(f"""WITH {LINKS}, o AS (SELECT src AS id, count(*) AS n_out FROM e GROUP BY src), i AS (SELECT dst AS id, count(*) AS n_in FROM e GROUP BY dst)
SELECT id::BIGINT AS id, '| ' || id || ' | ' || n_name || ' | ' || coalesce(n_out, 0) || ' | ' || coalesce(n_in, 0) || ' |' AS line FROM o FULL JOIN i USING (id) JOIN nation ON n_nationkey = id""")
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lines of a link directory: files with at least one link, and their counts both ways."""
    e = links(spark, sf_dir)
    out, back = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), "n_name")
    cells = F.concat_ws(" | ", "id", "n_name", F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0)))
    return out.join(back, "id", "full").join(names, "id").select("id", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


@query("""WITH n AS (SELECT p_brand AS slug, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, slug LIMIT 10),
p AS (SELECT p_brand AS slug, max(p_partkey) AS file_id FROM part WHERE p_size = 1 GROUP BY 1)
SELECT slug, n AS inbound_topic_edges, file_id, CASE WHEN file_id IS NULL THEN 'concept' ELSE 'entity' END AS page_kind FROM n LEFT JOIN p USING (slug)""")
def hub_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten slugs with most inbound topic edges, and their pages where there are any."""
    p = table(spark, sf_dir, "part")
    edges = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == p["p_partkey"])
    top = edges.groupBy(F.col("p_brand").alias("slug")).agg(F.count("*").alias("inbound_topic_edges")).orderBy(F.desc("inbound_topic_edges"), "slug").limit(10)
    pages = p.where("p_size = 1").groupBy(F.col("p_brand").alias("slug")).agg(F.max("p_partkey").alias("file_id"))
    return top.join(pages, "slug", "left").withColumn("page_kind", F.when(F.col("file_id").isNull(), "concept").otherwise("entity"))


@query("""WITH l AS (SELECT l_partkey AS id, l_suppkey AS src FROM lineitem WHERE l_quantity >= 49), x AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT id FROM l)) AS orphans, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS broken, (SELECT count(*) FROM x WHERE n >= 2) AS pending""")
def governance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without links, broken links, and missing concepts that two sources or more name."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    linked = li.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    orphans = p.join(linked, "p_partkey", "left_anti").agg(F.count("*").alias("orphans"))
    returned = li.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("sources"))
    rest = returned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken"), F.count_if(F.col("sources") >= 2).alias("pending"))
    return orphans.withColumn("one", F.lit(1)).join(rest.withColumn("one", F.lit(1)), "one").drop("one")


@query("""WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error' DESC, value DESC, event_id) AS n FROM events)
SELECT user_id, event_id, event_type FROM r WHERE n <= 20""")
def reserved_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return L.reserved_first(e, "user_id", F.col("event_type") == "error", [F.desc("value"), F.asc("event_id")], 20).select("user_id", "event_id", "event_type")


@query("""WITH k AS (SELECT p_partkey AS id FROM part ORDER BY id DESC LIMIT 200), e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def graph_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest nodes of a link graph, and the links whose both ends are among them."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    newest = table(spark, sf_dir, "part").orderBy(F.desc("p_partkey")).limit(L.GRAPH_NODES)
    edges = a.join(li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"])
    return L.induced(newest, edges, "p_partkey").distinct()


@query("""WITH h AS (SELECT doc_id, contains(lower(text), 'que') AND contains(lower(text), 'les') AS both_, contains(lower(text), 'que') OR contains(lower(text), 'les') AS any_ FROM documents)
SELECT doc_id, CASE WHEN both_ THEN 0 ELSE 1 END AS pass FROM h WHERE any_ ORDER BY pass, doc_id LIMIT 50""")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a strict and a loose pass, the strict ones first, each document once."""
    low = F.lower("text")
    has = [F.contains(low, F.lit(w)) for w in ("que", "les")]
    d = docs(spark, sf_dir)
    return d.where(has[0] | has[1]).select("doc_id", F.when(has[0] & has[1], 0).otherwise(1).alias("pass")).orderBy("pass", "doc_id").limit(50)


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS c, o_totalprice / 1000000 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
f AS (SELECT q, l_partkey AS child_id, max(round(score * 0.95 + 1e-9, 4)) AS score FROM h JOIN lineitem ON l_orderkey = c WHERE n <= 8 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, child_id) AS n FROM f) SELECT q AS query_id, child_id, score FROM r WHERE n <= 8""")
def summary_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the best summaries of each query."""
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_totalprice") / 1000000).alias("score"))
    return L.drill_down(hits, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("child_id")), 8)


@query(f"""WITH {LINKS}, s AS (SELECT n_nationkey::BIGINT AS seed FROM nation WHERE n_nationkey <= 3), a AS (SELECT seed, dst::BIGINT AS node FROM s JOIN e ON src = seed), b AS (SELECT seed, dst::BIGINT AS node FROM a JOIN e ON src = node),
n AS (SELECT seed, node, min(depth)::INT AS depth FROM (SELECT seed, seed AS node, 0 AS depth FROM s UNION ALL SELECT seed, node, 1 FROM a UNION ALL SELECT seed, node, 2 FROM b) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS i FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seed) AS j FROM k WHERE i <= 8)
SELECT seed, depth, node FROM o WHERE j = 1 ORDER BY seed, depth, node LIMIT 8""")
def context_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").where("n_nationkey <= 3").select(F.col("n_nationkey").cast("bigint").alias("seed"))
    return L.context_batch(seeds, links(spark, sf_dir)).select("seed", "depth", "node")


@query(f"""WITH {LINKS}, x AS (SELECT DISTINCT src FROM e WHERE src <= 5)
SELECT count(*) > 0 AS required, count(*) AS expandable, least(count(*), 3) AS recommended_parallel, coalesce(string_agg(src, ',' ORDER BY src), '') AS seeds FROM x""")
def context_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the first hits have links worth following, and how many to follow side by side."""
    n = F.countDistinct("src")
    seeds = F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda x: x.cast("string")), ",")
    return links(spark, sf_dir).where("src <= 5").agg((n > 0).alias("required"), n.alias("expandable"), F.least(n, F.lit(L.PARALLEL)).alias("recommended_parallel"), seeds.alias("seeds"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS id, p_brand AS slug FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 48)
SELECT id AS file_id, string_agg(slug, ',' ORDER BY slug) AS shared FROM s WHERE id <> 1 AND slug IN (SELECT slug FROM s WHERE id = 1) GROUP BY id""")
def coref_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share slugs with one file, and the slugs."""
    li, p = table(spark, sf_dir, "lineitem").where("l_quantity >= 48"), table(spark, sf_dir, "part")
    s = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("file_id"), F.col("p_brand").alias("slug"))
    return s.where("file_id <> 1").join(s.where("file_id = 1").select("slug"), "slug", "left_semi").groupBy("file_id").agg(joined("slug").alias("shared"))


@query(f"""WITH {LINKS}, d AS (SELECT src AS node, count(*) AS n_links FROM e GROUP BY 1), x AS (SELECT 'out' AS direction, dst AS node FROM e WHERE src = 1 UNION ALL SELECT 'in', src FROM e WHERE dst = 1)
SELECT direction, x.node::BIGINT AS node, coalesce(n_links, 0) AS n_links FROM x LEFT JOIN d USING (node)""")
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links out of and into one node; each neighbour with its own number of links."""
    e = links(spark, sf_dir)
    out, into = (e.where(f"{a} = 1").select(F.lit(d).alias("direction"), F.col(b).alias("node")) for a, b, d in (("src", "dst", "out"), ("dst", "src", "in")))
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_links"))
    return out.unionByName(into).join(degree, "node", "left").select("direction", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""WITH m AS (SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 3 = 0 THEN ' User' || (c_custkey % 50) || '@Example.COM' ELSE c_name END AS surface FROM customer),
k AS (SELECT mention_id, CASE WHEN regexp_full_match(trim(lower(surface)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN trim(lower(surface)) END AS mail FROM m)
SELECT mention_id, CASE WHEN mail IS NULL THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN mail IS NOT NULL THEN min(mention_id) OVER (PARTITION BY mail) END AS entity_id FROM k""")
def email_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions resolved by an e-mail address alone; equal names are never an identity."""
    surface = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" User"), F.col("c_custkey") % 50, F.lit("@Example.COM"))).otherwise(F.col("c_name"))
    mail = F.trim(F.lower(surface))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), F.when(mail.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), mail).alias("mail"))
    found = m.where("mail IS NOT NULL").groupBy("mail").agg(F.min("mention_id").alias("entity_id"))
    return m.join(found, "mail", "left").select("mention_id", F.when(F.col("mail").isNull(), "ambiguous").otherwise("resolved").alias("status"), "entity_id")


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS body_md5 FROM c WHERE chunk_index < 6 GROUP BY doc_id")
def section_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six chunks of each document as one text."""
    first = S.sliding_chunks(docs(spark, sf_dir)).where("chunk_index < 6")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c.text)
    return first.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(parts, "\n")).alias("body_md5"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type IN ('purchase', 'error') AS finished, floor(value)::BIGINT AS a, event_id % 7 AS b, CASE WHEN event_id % 4 > 0 THEN event_id % 11 END AS c FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY finished DESC, ts DESC, event_id DESC) AS n FROM e) SELECT user_id, event_id, finished, a + b + c AS duration FROM r WHERE n = 1""")
def extraction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished trace of each file, and its duration: null where a stage is missing."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").isin("purchase", "error").alias("finished"),
                                              (F.floor("value") + k % 7 + F.when(k % 4 > 0, k % 11)).alias("duration"))
    return R.latest(e, ["user_id"], [F.desc("finished"), F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH e AS (SELECT event_id, user_id, props, event_id % 2 AS fresh FROM events), f AS (SELECT user_id, props, min((fresh, event_id)) AS k FROM e GROUP BY 1, 2),
n AS (SELECT user_id, props, row_number() OVER (PARTITION BY user_id ORDER BY k) AS seq FROM f) SELECT event_id, user_id, seq FROM e JOIN n USING (user_id, props) WHERE fresh = 1""")
def event_append_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended run events with their numbers; a client id seen before keeps its number."""
    e = table(spark, sf_dir, "events")
    return L.append_sequence(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "props", "event_id").select("event_id", "user_id", "seq")


@query(f"""WITH {TAGS}, o AS (SELECT o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 20)
SELECT o_orderkey, count(tag) AS n, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS entities FROM o LEFT JOIN ft ON file_id = o_orderkey GROUP BY 1""")
def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one file's events with their entities."""
    o = R.page(table(spark, sf_dir, "orders").where("o_custkey = 7").select("o_orderkey"), [F.asc("o_orderkey")], 1, 20)
    ft = file_tags(spark, sf_dir)
    return o.join(ft, o["o_orderkey"] == ft["file_id"], "left").groupBy("o_orderkey").agg(F.count("tag").alias("n"), joined("tag").alias("entities"))


@query("""WITH c AS (SELECT p_brand AS slug, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_linenumber = 7 GROUP BY 1), p AS (SELECT DISTINCT p_brand AS slug FROM part)
SELECT slug, coalesce(n, 0) AS linked_sources FROM p LEFT JOIN c USING (slug) ORDER BY slug LIMIT 20""")
def theme_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of theme pages with the number of distinct sources that link to each."""
    li, p = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_linenumber = 7"), table(spark, sf_dir, "part")
    n = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_brand").alias("slug")).agg(F.countDistinct("l_suppkey").alias("n"))
    pages = p.select(F.col("p_brand").alias("slug")).distinct()
    return R.page(pages.join(n, "slug", "left").select("slug", F.coalesce("n", F.lit(0)).alias("linked_sources")), [F.asc("slug")], 1, 20)


@query("""WITH p AS (SELECT doc_id, string_split(lower(text), 'the') AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i, len(x) AS m FROM p),
s AS (SELECT doc_id, i, m, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * (i - 1) AS pos FROM u) SELECT doc_id, pos::BIGINT AS char_start FROM s WHERE i < m""")
def tag_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.occurrences(docs(spark, sf_dir), "doc_id", "text", NEEDLE)


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100""")
def queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred queued jobs with their owners."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    owned = o.where("o_orderstatus = 'P'").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return owned.select("o_orderkey", "c_name", "n_name").orderBy("o_orderkey").limit(100)


@query("""WITH m AS (SELECT event_id, user_id || props AS job, row_number() OVER (PARTITION BY user_id || props ORDER BY event_id) AS n FROM events WHERE (user_id, event_type) NOT IN (SELECT c_custkey, 'error' FROM customer WHERE c_nationkey < 5))
SELECT job, event_id FROM m WHERE n = 1""")
def queue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message of each job, after the targeted ones are taken out."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"), F.lit("error").alias("event_type"))
    kept = table(spark, sf_dir, "events").join(gone, ["user_id", "event_type"], "left_anti")
    return kept.groupBy(F.concat(F.col("user_id").cast("string"), "props").alias("job")).agg(F.min("event_id").alias("event_id"))


@query("SELECT c_mktsegment AS owner_group, event_type AS queue, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
def dead_letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead messages counted by queue within the owner's reach."""
    per_owner = table(spark, sf_dir, "events").where("event_type IN ('error', 'signup')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer")
    return per_owner.join(c, per_owner["user_id"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("owner_group"), F.col("event_type").alias("queue")).agg(F.sum("n").alias("n"))


@query("""WITH j AS (SELECT user_id, max(ts) FILTER (event_type IN ('view', 'click')) AS beat, count(*) FILTER (event_type = 'error') % 5 AS attempts FROM events GROUP BY 1)
SELECT user_id, attempts, CASE WHEN beat >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR THEN 'keep' WHEN attempts < 3 THEN 'requeue' ELSE 'close' END AS action FROM j""")
def stale_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with running jobs, by their last sign of life and their attempts."""
    beat = F.max(F.when(F.col("event_type").isin("view", "click"), F.col("ts"))).alias("beat")
    jobs = table(spark, sf_dir, "events").groupBy("user_id").agg(beat, (F.count_if(F.col("event_type") == "error") % 5).alias("attempts"))
    return L.recovery(jobs, F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'"), "beat", "attempts", 3).drop("beat")


@query("""WITH q AS (SELECT unnest(['example', 'Nicht', 'zzz']) AS query) SELECT query, page_id FROM q JOIN pages ON contains(lower(html), lower(query)) OR contains(lower(url), lower(query))""")
def short_keyword_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For short one-word queries, the pages whose text or name has the query."""
    guarded = [q for q in KEYWORDS if len(q) <= L.GUARD_CHARS and " " not in q]
    low = F.lower(F.concat_ws("\n", "url", "html"))
    hits = F.filter(F.array(*map(F.lit, guarded)), lambda q: F.contains(low, F.lower(q)))
    return table(spark, sf_dir, "pages").select(F.explode(hits).alias("query"), "page_id")


@query("""WITH r AS (SELECT l_orderkey AS file_id, 'kind' || (l_linenumber % 3) AS kind, l_discount AS score FROM lineitem), b AS (SELECT file_id, kind, max(score) AS score FROM r GROUP BY 1, 2)
SELECT file_id, max(score) AS score, string_agg(kind, ',' ORDER BY score DESC, kind) AS kinds FROM b GROUP BY 1""")
def representation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several representations merged by file: the best score, and the kinds from the best down."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("kind"), F.col("l_linenumber") % 3).alias("kind")).agg(F.max("l_discount").alias("score"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "kind"))), lambda k: k.kind)
    return r.groupBy("file_id").agg(F.max("score").alias("score"), F.array_join(order, ",").alias("kinds"))


@query("""SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 10 DAY END, o_orderdate) >= TIMESTAMP '1997-06-01 00:00:00' - INTERVAL 365 DAY""")
def cache_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries within their time to live, counted from the last hit, else the update, else the creation."""
    made = F.col("o_orderdate")
    hit, updated = F.when(F.col("o_orderstatus") == "F", made + F.expr("INTERVAL 30 DAY")), F.when(F.col("o_orderpriority") == "1-URGENT", made + F.expr("INTERVAL 10 DAY"))
    return table(spark, sf_dir, "orders").where(F.coalesce(hit, updated, made) >= F.expr("TIMESTAMP_NTZ '1997-06-01 00:00:00' - INTERVAL 365 DAY")).select("o_orderkey")


@query("SELECT event_id, 'kind=' || event_type || ' user=' || user_id || ' zone=' || (event_id % 4) AS detail FROM events")
def detail_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log details read into pairs and written back with sorted keys."""
    raw = F.format_string("zone=%d user=%d kind=%s", F.col("event_id") % 4, "user_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", T.format_key_values(T.key_values(raw)).alias("detail"))
