"""Relational queries: access, tags, listings, retention, merges and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import relational as R
from sparkloom.plans.registry import query
from sparkloom.storage import table


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) AND o_orderstatus = 'F'")
def acl_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_regionkey = 1"), table(spark, sf_dir, "orders")
    readable = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left_semi")
    return o.where("o_orderstatus = 'F'").join(readable, o["o_custkey"] == readable["c_custkey"], "left_semi").select("o_orderkey", "o_custkey")


GRANTS = "g AS (SELECT o_custkey AS folder, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS tier, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS level FROM orders)"


@query(f"WITH {GRANTS}, m AS (SELECT folder, min(tier) AS tier FROM g GROUP BY folder) SELECT folder, tier, max(level) AS level FROM g JOIN m USING (folder, tier) GROUP BY folder, tier")
def tier_grant_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User before role before group before department: the first tier that grants, and its highest level."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    g = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("folder"), F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3).otherwise(4).alias("tier"), F.when(s == "F", 3).when(s == "O", 2).otherwise(1).alias("level")
    )
    return R.tiered_grant(g, ["folder"], "tier", "level")


TAGS = "ft AS (SELECT DISTINCT l_orderkey AS file_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey), two AS (SELECT min(p_brand) AS a, max(p_brand) AS b FROM part)"


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("file_id"), F.col("p_brand").alias("tag")).distinct()


@query(f"WITH {TAGS} SELECT file_id FROM ft WHERE tag = (SELECT a FROM two) INTERSECT SELECT file_id FROM ft WHERE tag = (SELECT b FROM two)")
def two_tag_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft, two = file_tags(spark, sf_dir), table(spark, sf_dir, "part").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b"))
    first, second = ft.join(F.broadcast(two), F.col("tag") == F.col("a"), "left_semi"), ft.join(F.broadcast(two), F.col("tag") == F.col("b"), "left_semi")
    return first.select("file_id").join(second, "file_id", "left_semi")


@query("WITH ft AS (SELECT DISTINCT l_orderkey AS file_id, l_returnflag || l_linestatus AS tag FROM lineitem) SELECT file_id FROM ft WHERE tag IN ('AF', 'NO', 'RF') GROUP BY file_id HAVING count(DISTINCT tag) = 3")
def tag_set_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat("l_returnflag", "l_linestatus").alias("tag"))
    return R.with_all_tags(ft, ["RF", "AF", "NO"])


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS workspace FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def union_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("workspace"))
    return c.unionByName(s)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT p_partkey, (SELECT count(*) FROM part) > 25 AS truncated FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def listing_cap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 25).select("p_partkey", "truncated")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def retention_keep5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id FROM (SELECT *, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN NULL ELSE ts END AS last_hit FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_hit DESC NULLS LAST, event_id DESC) <= 20")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of twenty entries a user keeps; entries never hit go first."""
    e = table(spark, sf_dir, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("first")))  # one row
    hit = e.join(first).withColumn("last_hit", F.when(F.col("event_type") != F.col("first"), F.col("ts")))
    return R.latest(hit, ["user_id"], [F.desc_nulls_last("last_hit"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("SELECT n_nationkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) - 1)::INT AS sort_order FROM nation")
def sibling_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_name", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.row_number().over(w) - 1).alias("sort_order"))


@query("""WITH y AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) END AS first_year, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) + 1 END AS last_year FROM orders)
SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND coalesce(a.first_year <= b.last_year AND b.first_year <= a.last_year, true)""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer whose years may overlap; unknown years overlap everything."""
    from sparkloom.functions.text import overlaps

    o = table(spark, sf_dir, "orders")
    year = F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate"))
    y = o.select("o_custkey", "o_orderkey", year.alias("f"), (year + 1).alias("l"))
    a, b = y.toDF("o_custkey", "a", "af", "al"), y.toDF("o_custkey", "b", "bf", "bl")
    return a.join(b, "o_custkey").where((F.col("a") < F.col("b")) & overlaps(F.col("af"), F.col("al"), F.col("bf"), F.col("bl"))).select("a", "b")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (CASE WHEN l.quality = 1 THEN d.n_chars END) IS DISTINCT FROM (CASE WHEN d.doc_id % 3 = 0 THEN d.n_chars END)")
def distinct_from_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored fingerprint is distinct from the current one; two nulls are equal."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    stored, now = F.when(F.col("quality") == 1, F.col("n_chars")), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    return d.join(l, "doc_id", "left").where(~stored.eqNullSafe(now)).select("doc_id")


@query("""WITH r(pos, pattern, provider) AS (VALUES (1, 'http', 'basic'), (2, 'https', 'secure'), (3, 'https://m.', 'mobile'), (4, 'http://blog', 'blog'))
SELECT page_id, max_by(provider, pos) AS provider FROM pages LEFT JOIN r ON starts_with(url, pattern) GROUP BY page_id""")
def route_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider of the last route that matches; the routes are a small configuration."""
    routes = [("http", "basic"), ("https", "secure"), ("https://m.", "mobile"), ("http://blog", "blog")]
    provider = F.lit(None).cast("string")
    for prefix, name in routes:
        provider = F.when(F.startswith("url", F.lit(prefix)), name).otherwise(provider)
    return table(spark, sf_dir, "pages").select("page_id", provider.alias("provider"))


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS h FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 6 <> 0)
SELECT k AS c_custkey, CASE WHEN a.h IS NULL THEN 'inserted' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'updated' ELSE 'same' END AS state FROM a FULL JOIN b USING (k)""")
def external_sync_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_mktsegment").alias("h"))
    new = c.where("c_custkey % 6 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("h"))
    return R.sync(old, new, "c_custkey", "h")


@query("SELECT d.doc_id, sha256(coalesce(d.text, '')) AS fingerprint FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(l.quality = 1 AND d.doc_id % 2 = 0, false)")
def fingerprint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to index again: all but those that are ready with an equal fingerprint."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))
    ready = table(spark, sf_dir, "labels").where("quality = 1 AND doc_id % 2 = 0").join(d, "doc_id").select("doc_id", "fingerprint")
    return d.join(ready, ["doc_id", "fingerprint"], "left_anti")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'DRAFT' ELSE 'REVOKED' END AS state, o_orderpriority AS v FROM orders),
l AS (SELECT o_custkey, v FROM o WHERE state = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, coalesce(l.v, c_mktsegment) AS shown FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def overlay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source value, or the newest active correction over it."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    last = R.latest(o, ["o_custkey"], [F.desc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderpriority", "c_mktsegment").alias("shown"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def or_endpoint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a frontier at either end: two semi-joins and a union, no nested loop."""
    li, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size = 1"), table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    a = li.join(p, li["l_partkey"] == p["p_partkey"], "left_semi").select("l_orderkey", "l_linenumber")
    b = li.join(s, li["l_suppkey"] == s["s_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")
    return a.unionByName(b).dropDuplicates()


@query("SELECT vec_id, label, array_to_string(list_transform(embedding[1:12], lambda x: round(x::DOUBLE, 4)::VARCHAR), ',') IS NOT NULL AS has_preview, len(embedding[1:12])::INT AS preview FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 10 OFFSET 10")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label = 3")
    return R.page(e, [F.asc("vec_id")], 2, 10).select("vec_id", "label", F.col("embedding").isNotNull().alias("has_preview"), F.size(F.slice("embedding", 1, 12)).alias("preview"))


@query("""WITH n AS (SELECT c_custkey, c_acctbal, 1 AS v FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 2 FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, v FROM n QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC) = 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of each key after a batch of updates."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("v"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("v"))
    return R.upsert(c, new, ["c_custkey"], "v").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "v")


@query("SELECT doc_id, lang FROM documents WHERE (CASE WHEN source IN ('src1', 'src2') THEN 'summary' WHEN source = 'src3' THEN NULL ELSE 'text' END) IS DISTINCT FROM 'summary'")
def null_aware_inequality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source").isin("src1", "src2"), "summary").when(F.col("source") != "src3", "text")
    return table(spark, sf_dir, "documents").where(~kind.eqNullSafe(F.lit("summary"))).select("doc_id", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42 OR c_name ILIKE '%42%'")
def file_search_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id:N`` finds an id, digits an id or a part of the name, anything else a part of the name."""
    return search_box(table(spark, sf_dir, "customer"), "42", "c_custkey", "c_name").select("c_custkey", "c_name")


def search_box(rows: DataFrame, text: str, id_column: str, name_column: str) -> DataFrame:
    from sparkloom.functions.text import unmatched_like

    text = text.strip()
    by_name = F.col(name_column).ilike(unmatched_like(text))
    if text.lower().startswith("id:") and text[3:].strip().isdigit():
        return rows.where(F.col(id_column) == int(text[3:]))
    return rows.where((F.col(id_column) == int(text)) | by_name) if text.isdigit() else rows.where(by_name) if text else rows


@query("""SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY d.doc_id DESC LIMIT 50""")
def awaiting_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(50)


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'user' END, CASE WHEN c_nationkey % 2 = 0 THEN 'system' END, 'default') AS setting FROM customer""")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, system = F.when(F.col("c_custkey") % 4 == 0, "user"), F.when(F.col("c_nationkey") % 2 == 0, "system")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(user, system, F.lit("default")).alias("setting"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 30")
def keyset_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rows to process after a cursor, in key order."""
    return table(spark, sf_dir, "orders").where("o_orderkey > 100 AND o_orderstatus <> 'F'").select("o_orderkey").orderBy("o_orderkey").limit(30)


@query("SELECT l_orderkey AS job, min(l_linenumber) AS first_pos, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def queue_peek_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.min("l_linenumber").alias("first_pos"), F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT kind, id FROM (SELECT 'job' AS kind, o_custkey AS id, 1 AS p FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'job', c_custkey, 2 FROM customer WHERE c_acctbal < 0) QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY p) = 1""")
def active_task_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("job").alias("kind"), F.col("o_custkey").alias("id"))
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("job").alias("kind"), F.col("c_custkey").alias("id"))
    return o.unionByName(c).dropDuplicates()


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_md5, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS occurrences FROM documents")
def content_hash_and_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that lets extraction skip a body, and how often a tag stands in it."""
    from sparkloom.functions.text import strip_space

    n = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("the"), F.lit("")))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_space(F.col("text"))).alias("content_md5"), F.floor(n / 3).alias("occurrences"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('before ' || text) WHEN doc_id % 11 = 0 THEN NULL ELSE sha256(text) END AS link_hash FROM documents)
SELECT d.doc_id, link_hash IS NULL AS unknown FROM documents d JOIN l USING (doc_id) WHERE link_hash IS DISTINCT FROM sha256(d.text)""")
def stale_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose stored hash is not that of the text they lead to."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("now"), F.sha2(F.concat(F.lit("before "), "text"), 256).alias("old"))
    stored = F.when(F.col("doc_id") % 7 == 0, F.col("old")).when(F.col("doc_id") % 11 != 0, F.col("now"))
    return d.select("doc_id", "now", stored.alias("link_hash")).where(~F.col("link_hash").eqNullSafe(F.col("now"))).select("doc_id", F.col("link_hash").isNull().alias("unknown"))


@query("""SELECT event_id, count(*) OVER () AS total FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20""")
def activity_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the newest activities, with how many there are in all."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    total = F.broadcast(e.agg(F.count("*").alias("total")))  # one row
    return R.page(e.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 2, 20).select("event_id").join(total)
