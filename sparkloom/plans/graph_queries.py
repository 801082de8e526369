"""Graph queries: tags, links, trees, paths, ranks and claims over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import graph as G
from sparkloom.operators.excerpts import literal_excerpts
from sparkloom.operators.claim_search import claim_search
from sparkloom.plans.registry import query
from sparkloom.storage import staged, table

TAGS = "ft AS (SELECT DISTINCT l_orderkey AS file_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"
#: Links between nations: customers of one order from suppliers of the other.
LINKS = """e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey)"""


def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("file_id"), F.col("p_brand").alias("tag")).distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    whole = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return whole.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).distinct()


@query(f"WITH {TAGS} SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM ft x JOIN ft y ON x.file_id = y.file_id AND x.tag < y.tag GROUP BY x.tag, y.tag")
def tag_cooc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.co_occurrence(file_tags(spark, sf_dir), "tag", "file_id")


@query(f"""WITH {TAGS}, top AS (SELECT tag FROM ft GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 80), k AS (SELECT * FROM ft WHERE tag IN (SELECT tag FROM top))
SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM k x JOIN k y ON x.file_id = y.file_id GROUP BY x.tag, y.tag""")
def tag_heatmap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-occurrence matrix of the 80 most used tags, in long form; files by tag on the diagonal."""
    ft = staged(file_tags(spark, sf_dir), "file-tags")
    top = staged(ft.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(80), "top-tags")
    kept = ft.join(F.broadcast(top.select("tag")), "tag", "left_semi").select("file_id", "tag")  # 80 rows
    return G.matrix(kept, "tag", "file_id")


@query(f"""WITH new AS (SELECT o_orderkey AS file_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40), {TAGS}, k AS (SELECT ft.* FROM ft JOIN new USING (file_id))
SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM k x JOIN k y ON x.file_id = y.file_id AND x.tag < y.tag GROUP BY x.tag, y.tag""")
def tag_graph_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that stand together in the forty newest files."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(40).select(F.col("o_orderkey").alias("file_id"))
    return G.co_occurrence(file_tags(spark, sf_dir).join(F.broadcast(newest), "file_id", "left_semi"), "tag", "file_id")  # 40 rows


@query(f"""WITH {TAGS}, seeds AS (SELECT DISTINCT p_brand AS tag FROM part WHERE p_partkey <= 3),
n AS (SELECT s.tag AS seed, o.tag AS tag, count(*) AS n FROM ft s JOIN ft o USING (file_id) WHERE s.tag IN (SELECT tag FROM seeds) AND s.tag <> o.tag GROUP BY s.tag, o.tag),
m AS (SELECT tag, max(n) AS n FROM n GROUP BY tag HAVING max(n) >= 2)
SELECT tag, n FROM m ORDER BY n DESC, tag LIMIT 5""")
def seeded_cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tags that most often stand beside a seed tag."""
    ft = file_tags(spark, sf_dir)
    seeds = table(spark, sf_dir, "part").where("p_partkey <= 3").select(F.col("p_brand").alias("tag")).distinct()
    mine = ft.join(seeds, "tag", "left_semi").select("file_id", F.col("tag").alias("seed"))
    n = mine.join(ft, "file_id").where("seed <> tag").groupBy("seed", "tag").agg(F.count("*").alias("n"))
    return n.groupBy("tag").agg(F.max("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "tag").limit(5)


@query(f"""WITH {LINKS}, o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY dst)
SELECT node::BIGINT AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, (coalesce(n_out, 0) + coalesce(n_in, 0))::DOUBLE AS score FROM o FULL JOIN i USING (node) ORDER BY score DESC, node DESC LIMIT 10""")
def hub_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(links(spark, sf_dir)).orderBy(F.desc("score"), F.desc("node")).limit(10)


@query("""WITH n AS (SELECT p_brand AS slug, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part)
SELECT a.id AS a, b.id AS b, count(*) AS n FROM n a JOIN n b ON a.slug = b.slug AND a.id < b.id WHERE a.rn <= 10 AND b.rn <= 10 GROUP BY a.id, b.id""")
def coref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources that share a slug, among the ten newest of each slug."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("id"))
    newest = p.withColumn("rn", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("id")))).where("rn <= 10")
    return G.co_occurrence(newest, "id", "slug")


TREE = """t AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
w AS (SELECT node, node AS root, 0 AS level, name AS label FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.root, w.level + 1, w.label || '/' || t.name FROM w JOIN t ON t.parent = w.node)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    return (
        r.select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(n.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(c.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    )


@query(f"WITH RECURSIVE {TREE} SELECT node, root FROM w")
def tree_root_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tree_paths(tree(spark, sf_dir)).select("node", "root")


@query(f"WITH RECURSIVE {TREE} SELECT node, level, label FROM w")
def tree_path_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tree_paths(tree(spark, sf_dir)).select("node", "level", "label")


@query(f"""WITH RECURSIVE {TREE}, d AS (SELECT parent, count(*) AS children FROM t WHERE parent IS NOT NULL GROUP BY parent), h AS (SELECT root, max(level) AS height, count(*) - 1 AS descendants FROM w GROUP BY root)
SELECT root, height, descendants::BIGINT AS descendants, coalesce(children, 0)::BIGINT AS children FROM h LEFT JOIN d ON d.parent = h.root""")
def tree_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tree(spark, sf_dir)
    h = G.tree_paths(t).groupBy("root").agg(F.max("level").alias("height"), (F.count("*") - 1).alias("descendants"))
    d = t.where("parent IS NOT NULL").groupBy(F.col("parent").alias("root")).agg(F.count("*").alias("children"))
    return h.join(d, "root", "left").na.fill(0, ["children"])


MOVES = """m AS (SELECT 'n' || n_nationkey AS node, 'r' || (n_regionkey + 1) % 5 AS parent FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'r0', 'r0' UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey + 1) FROM customer)"""


@query(f"""WITH RECURSIVE {TREE}, {MOVES}, d AS (SELECT DISTINCT node, parent FROM m),
u AS (SELECT node, parent, parent AS up FROM d UNION ALL SELECT u.node, u.parent, t.parent FROM u JOIN t ON t.node = u.up WHERE t.parent IS NOT NULL AND u.up <> u.node)
SELECT node, parent, NOT bool_or(up = node) AS allowed FROM u GROUP BY node, parent""")
def tree_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a folder may go below another, which must not lie within it."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    key = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    moves = (
        n.select(key("n", F.col("n_nationkey")).alias("node"), key("r", (F.col("n_regionkey") + 1) % 5).alias("parent"))
        .unionByName(c.where("c_custkey % 3 = 0").select(key("n", F.col("c_nationkey")).alias("node"), key("c", F.col("c_custkey")).alias("parent")))
        .unionByName(n.select(key("r", F.col("n_regionkey")).alias("node"), key("n", F.col("n_nationkey")).alias("parent")))
        .unionByName(spark.range(1).select(F.lit("r0").alias("node"), F.lit("r0").alias("parent")))
        .unionByName(c.select(key("c", F.col("c_custkey")).alias("node"), key("c", F.col("c_custkey") + 1).alias("parent")))
    )
    return G.allowed_moves(moves, tree(spark, sf_dir).select("node", "parent"))


@query(f"""WITH RECURSIVE {LINKS}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 0::BIGINT AS node, 0 AS hops, [0::BIGINT] AS path UNION ALL SELECT u.dst, w.hops + 1, list_append(w.path, u.dst::BIGINT) FROM w JOIN u ON u.src = w.node WHERE w.hops < 4 AND NOT list_contains(w.path, u.dst::BIGINT)),
b AS (SELECT node, hops, path FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY hops, path) = 1)
SELECT node, hops, array_to_string(path, '>') AS path FROM b""")
def shortest_path_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.range(1).select(F.col("id").alias("node"))
    return G.shortest_paths(links(spark, sf_dir), starts).select("node", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {LINKS}, d AS (SELECT src, count(*) AS n FROM e GROUP BY src), nodes AS (SELECT DISTINCT n_nationkey::BIGINT AS node FROM nation),
b AS (SELECT node, CASE WHEN node = 0 THEN 1.0::DOUBLE / 1.5 WHEN node = 1 THEN 0.5::DOUBLE / 1.5 ELSE 0 END AS base FROM nodes),
m AS (SELECT src::BIGINT AS src, dst::BIGINT AS dst, n FROM e JOIN d USING (src)),
r AS (SELECT 0 AS k, node, base AS rank FROM b
  UNION ALL SELECT k + 1, node, 0.15 * base + 0.85 * flow FROM (SELECT r.k, b.node, any_value(b.base) AS base, coalesce(sum(CASE WHEN m.dst = b.node THEN r.rank / m.n END), 0) AS flow
    FROM r LEFT JOIN m ON m.src = r.node CROSS JOIN b WHERE r.k < 10 GROUP BY r.k, b.node))
SELECT node, round(rank, 6) AS rank FROM r WHERE k = 10 AND rank > 0""")
def ppr_10_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten steps of personalised rank from one anchor and one weaker seed."""
    seeds = spark.range(2).select(F.col("id").alias("node"), F.when(F.col("id") == 0, 1.0).otherwise(0.5).alias("weight"))
    return G.personalised_rank(links(spark, sf_dir), seeds).where("rank > 0").select("node", F.round("rank", 6).alias("rank"))


@query(f"""WITH {LINKS} SELECT src::BIGINT AS src, dst::BIGINT AS dst, a.n_regionkey AS src_root, b.n_regionkey AS dst_root FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst
WHERE a.n_regionkey <> b.n_regionkey ORDER BY abs(a.n_regionkey - b.n_regionkey) DESC, src, dst LIMIT 20""")
def surprising_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between different top folders, the farthest first."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b = n.toDF("src", "src_root"), n.toDF("dst", "dst_root")
    far = links(spark, sf_dir).join(a, "src").join(b, "dst").where("src_root <> dst_root")
    return far.orderBy(F.abs(F.col("src_root") - F.col("dst_root")).desc(), "src", "dst").limit(20).select("src", "dst", "src_root", "dst_root")


@query("""SELECT slug, count(DISTINCT src) AS n_sources, array_to_string(list_sort(list(DISTINCT src))[1:5], ',') AS sample
FROM (SELECT p_partkey AS src, lower(replace(p_name, ' ', '-')) AS slug FROM part) WHERE slug NOT IN (SELECT lower(replace(p_name, ' ', '-')) FROM part WHERE p_retailprice <= 902) GROUP BY slug HAVING count(DISTINCT src) >= 2""")
def pending_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that several sources name and no page has."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"), "p_retailprice")
    missing = p.join(p.where("p_retailprice <= 902").select("slug").distinct(), "slug", "left_anti")  # the cheapest have pages
    g = missing.groupBy("slug").agg(F.countDistinct("src").alias("n_sources"), F.slice(F.array_sort(F.collect_set("src")), 1, 5).alias("s")).where("n_sources >= 2")
    return g.select("slug", "n_sources", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sample"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no urgent order names."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query(f"""WITH {LINKS}, h AS (SELECT n_regionkey AS q, n_nationkey AS id, n_nationkey / 100.0::DOUBLE AS score FROM nation),
s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 3),
x AS (SELECT s.q, e.dst AS id, max(s.score) * 0.92 AS score FROM s JOIN e ON e.src = s.id GROUP BY s.q, e.dst),
f AS (SELECT * FROM x WHERE (q, id) NOT IN (SELECT (q, id) FROM h))
SELECT q::BIGINT AS query_id, id::BIGINT AS id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 8""")
def link_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    hits = n.select(F.col("n_regionkey").cast("bigint").alias("query_id"), F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_nationkey") / 100.0).alias("score"))
    return G.expand_by_links(hits, links(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"))


MENTIONS = "m AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS entity FROM lineitem)"


@query(f"""WITH {MENTIONS}, s0 AS (SELECT l_orderkey AS q, l_orderkey AS event FROM lineitem WHERE l_orderkey <= 3 GROUP BY 1, 2),
h1 AS (SELECT DISTINCT s.q, b.event FROM s0 s JOIN m a USING (event) JOIN m b USING (entity) WHERE (s.q, b.event) NOT IN (SELECT (q, event) FROM s0)),
h2 AS (SELECT DISTINCT s.q, b.event FROM h1 s JOIN m a USING (event) JOIN m b USING (entity) WHERE (s.q, b.event) NOT IN (SELECT (q, event) FROM s0 UNION ALL SELECT (q, event) FROM h1)),
u AS (SELECT q, event, 0 AS hop FROM s0 UNION ALL SELECT q, event, 1 FROM h1 UNION ALL SELECT q, event, 2 FROM h2)
SELECT q AS query_id, event, hop FROM u QUALIFY row_number() OVER (PARTITION BY q ORDER BY hop, event) <= 200""".replace("b.event FROM s0 s JOIN m a USING (event) JOIN m b USING (entity)", "b.event FROM s0 s JOIN m a ON a.event = s.event JOIN m b ON b.entity = a.entity").replace("b.event FROM h1 s JOIN m a USING (event) JOIN m b USING (entity)", "b.event FROM h1 s JOIN m a ON a.event = s.event JOIN m b ON b.entity = a.entity"))
def entity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within two hops over shared entities."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("entity")).distinct()
    seeds = m.where("event <= 3").select(F.col("event").alias("query_id"), "event").distinct()
    return G.expand_by_entities(seeds, m)


@query(f"""WITH {LINKS}, c AS (SELECT src * 100 + dst AS claim_id, src AS a, dst AS b FROM e), u AS (SELECT claim_id, a, b FROM c UNION ALL SELECT claim_id, b, a FROM c),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY a ORDER BY claim_id, b) <= 24),
p1 AS (SELECT 0 AS start, b AS node, [0, b] AS nodes, [claim_id] AS claims FROM k WHERE a = 0 AND b <> 0),
p2 AS (SELECT start, k.b AS node, list_append(nodes, k.b) AS nodes, list_append(claims, k.claim_id) AS claims FROM p1 JOIN k ON k.a = p1.node WHERE NOT list_contains(nodes, k.b)),
p3 AS (SELECT start, k.b AS node, list_append(claims, k.claim_id) AS claims FROM p2 JOIN k ON k.a = p2.node WHERE NOT list_contains(nodes, k.b))
SELECT node::BIGINT AS node, 1 AS hops, array_to_string(claims, '>') AS claims FROM p1 UNION ALL SELECT node::BIGINT, 2, array_to_string(claims, '>') FROM p2 UNION ALL SELECT node::BIGINT, 3, array_to_string(claims, '>') FROM p3""")
def claim_path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir)
    claims = e.select((F.col("src") * 100 + F.col("dst")).alias("claim_id"), F.col("src").alias("subject"), F.col("dst").alias("object"))
    found = G.claim_paths(claims, spark.range(1).select(F.col("id").alias("node")))
    return found.select("node", "hops", F.array_join(F.transform("claims", lambda x: x.cast("string")), ">").alias("claims"))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_partkey AS subject, l_returnflag AS predicate, l_suppkey AS object FROM lineitem)
SELECT subject, predicate, count(DISTINCT object) AS objects, CASE WHEN predicate = 'N' AND count(DISTINCT object) > 1 THEN 'conflicted' WHEN count(*) = 1 THEN 'insufficient' ELSE 'direct' END AS level FROM c GROUP BY subject, predicate""")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates that allow one object and have several."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate")).agg(F.countDistinct("l_suppkey").alias("objects"), F.count("*").alias("n"))
    level = F.when((F.col("predicate") == "N") & (F.col("objects") > 1), "conflicted").when(F.col("n") == 1, "insufficient").otherwise("direct")
    return c.select("subject", "predicate", "objects", level.alias("level"))


@query("""WITH c AS (SELECT d.doc_id, b.item_id, sha256(d.doc_id || chr(31) || b.x) AS claim_hash FROM documents d JOIN (SELECT item_id, string_split(text, '.')[1] AS x FROM benchmark) b ON b.x <> '' AND contains(d.text, b.x)) SELECT * FROM c""")
def literal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose excerpt (an item's first sentence) stands in the text."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.get(F.split("text", r"\."), F.lit(0)).alias("excerpt"))
    found = literal_excerpts(table(spark, sf_dir, "documents").select("doc_id", "text"), b)
    return found.select("doc_id", "item_id", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "excerpt"), 256).alias("claim_hash"))


@query(f"""WITH {TAGS}, t AS (SELECT tag, count(*) AS n FROM ft GROUP BY tag) SELECT tag, n FROM t ORDER BY n DESC, tag LIMIT 10""")
def hub_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_tags(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@query(f"""WITH {LINKS} SELECT n_nationkey::BIGINT AS node, (SELECT count(*) FROM e WHERE src = n_nationkey) AS n_out, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS n_in,
  CASE WHEN n_nationkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e) THEN 'orphan' WHEN n_nationkey NOT IN (SELECT dst FROM e) THEN 'unlinked' ELSE 'ok' END AS finding FROM nation""")
def link_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.degrees(links(spark, sf_dir))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    j = n.join(d, "node", "left").na.fill(0, ["n_out", "n_in"])
    return j.select("node", "n_out", "n_in", F.when((F.col("n_out") == 0) & (F.col("n_in") == 0), "orphan").when(F.col("n_in") == 0, "unlinked").otherwise("ok").alias("finding"))


@query("""WITH m AS (
  SELECT p_partkey AS mention, CASE WHEN p_partkey % 2 = 0 THEN p_partkey // 7 END AS entity, p_name AS surface FROM part
  UNION ALL SELECT 1000000 + s_suppkey, NULL, s_name FROM supplier),
q AS (SELECT s_nationkey AS question_id, s_name AS anchor FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2
  UNION ALL SELECT n_nationkey, p_name FROM nation JOIN part ON p_partkey = n_nationkey + 1),
names AS (SELECT mention, node, count(*) OVER (PARTITION BY node) > 1 AS several FROM (SELECT mention, CASE WHEN entity IS NULL THEN 'm' || mention ELSE 'e' || entity END AS node FROM m)),
k AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, x.node AS s, y.node AS o, x.several AS s_several, y.several AS o_several FROM lineitem JOIN names x ON x.mention = l_partkey JOIN names y ON y.mention = 1000000 + l_suppkey),
f AS (SELECT * FROM (SELECT s AS a, o AS b, claim_id, s_several AS several FROM k UNION SELECT o, s, claim_id, o_several FROM k) QUALIFY row_number() OVER (PARTITION BY a ORDER BY claim_id, b) <= 24),
s AS (SELECT DISTINCT question_id, anchor, node FROM (SELECT DISTINCT question_id, anchor FROM q)
  JOIN (SELECT *, row_number() OVER (PARTITION BY lower(surface) ORDER BY mention) AS n FROM m) r ON lower(surface) = lower(anchor) AND n <= 24 JOIN names USING (mention)),
n1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY node) AS n FROM (SELECT DISTINCT question_id, node FROM s)),
ah AS (SELECT s.question_id, anchor, a, b, claim_id, several FROM s JOIN n1 USING (question_id, node) JOIN f ON a = node WHERE n <= 300),
bh AS (SELECT s.question_id, anchor, a, b, claim_id, several FROM s JOIN n1 USING (question_id, node) JOIN f ON b = node WHERE n <= 300),
c1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY claim_id) AS n FROM (SELECT question_id, claim_id FROM ah UNION SELECT question_id, claim_id FROM bh)),
one AS (SELECT question_id, anchor, [a, b] AS nodes, [claim_id] AS claims, several AS bridged, b AS here FROM ah JOIN c1 USING (question_id, claim_id) WHERE n <= 480 AND a <> b),
back AS (SELECT question_id, anchor AS target, a, b AS finish, claim_id AS last, several AS last_several FROM bh JOIN c1 USING (question_id, claim_id) WHERE n <= 480 AND a <> b),
n2 AS (SELECT question_id, node, row_number() OVER (PARTITION BY question_id ORDER BY node) + (SELECT count(*) FROM n1 p WHERE p.question_id = x.question_id AND p.n <= 300) AS n
  FROM (SELECT DISTINCT question_id, here AS node FROM one WHERE (question_id, here) NOT IN (SELECT (question_id, node) FROM n1 WHERE n <= 300)) x),
open2 AS (SELECT question_id, node FROM n1 WHERE n <= 300 UNION ALL SELECT question_id, node FROM n2 WHERE n <= 300),
step AS (SELECT one.question_id, anchor, nodes, claims, bridged, b, claim_id, several FROM one JOIN open2 ON open2.question_id = one.question_id AND open2.node = one.here JOIN f ON f.a = one.here WHERE NOT list_contains(nodes, b)),
c2 AS (SELECT question_id, claim_id, row_number() OVER (PARTITION BY question_id ORDER BY claim_id) + (SELECT count(*) FROM c1 p WHERE p.question_id = x.question_id AND p.n <= 480) AS n
  FROM (SELECT DISTINCT question_id, claim_id FROM step WHERE (question_id, claim_id) NOT IN (SELECT (question_id, claim_id) FROM c1 WHERE n <= 480)) x),
loaded AS (SELECT question_id, claim_id FROM c1 WHERE n <= 480 UNION ALL SELECT question_id, claim_id FROM c2 WHERE n <= 480),
two AS (SELECT question_id, anchor, list_append(nodes, b) AS nodes, list_append(claims, claim_id) AS claims, bridged OR several AS bridged, b AS here FROM step JOIN loaded USING (question_id, claim_id)),
ends AS (SELECT question_id, anchor AS target, list(node) AS ends FROM s GROUP BY ALL),
found AS (
  SELECT question_id, anchor AS source, target, claims, bridged FROM one JOIN ends USING (question_id) WHERE anchor < target AND list_contains(ends, here)
  UNION ALL
  SELECT x.question_id, anchor, back.target, list_append(claims, last), bridged OR last_several
  FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x JOIN back ON back.question_id = x.question_id AND back.a = x.here AND anchor < back.target AND NOT list_contains(nodes, finish) JOIN ends ON ends.question_id = x.question_id AND ends.target = back.target
  WHERE NOT list_has_any(nodes[2:], ends)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY len(claims), source, target, claims) AS rank FROM (SELECT question_id, source, target, claims, bool_or(bridged) AS bridged FROM found GROUP BY ALL)),
cuts AS (SELECT question_id, 'node_limit' AS reason FROM n1 WHERE n > 300 UNION SELECT question_id, 'node_limit' FROM n2 WHERE n > 300 UNION SELECT question_id, 'claim_limit' FROM c1 WHERE n > 480
  UNION SELECT question_id, 'claim_limit' FROM c2 WHERE n > 480 UNION SELECT question_id, 'path_limit' FROM r WHERE rank > 50)
SELECT question_id, source, target, len(claims)::INT AS hops, array_to_string(claims, '>') AS claims, bridged, rank::INT AS rank,
  coalesce((SELECT string_agg(reason, ',' ORDER BY reason) FROM cuts WHERE cuts.question_id = r.question_id), '') AS truncated FROM r WHERE rank <= 50""")
def association_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two suppliers of each nation and a part hang together by what was shipped; one part in two is a mention of a wider entity."""
    part, supplier, li = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    key = lambda c: F.lit(1_000_000) + F.col(c)
    mentions = part.select(F.col("p_partkey").alias("mention"), F.when(F.col("p_partkey") % 2 == 0, F.floor(F.col("p_partkey") / 7)).alias("entity"), F.col("p_name").alias("surface"))
    mentions = mentions.unionByName(supplier.select(key("s_suppkey").alias("mention"), F.lit(None).cast("bigint").alias("entity"), F.col("s_name").alias("surface")))
    claims = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_partkey").alias("subject"), key("l_suppkey").alias("object"))
    first = supplier.withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))).where("n <= 2")
    asked = first.select(F.col("s_nationkey").alias("question_id"), F.col("s_name").alias("anchor"))
    asked = asked.unionByName(table(spark, sf_dir, "nation").join(part, F.col("p_partkey") == F.col("n_nationkey") + 1).select(F.col("n_nationkey").alias("question_id"), F.col("p_name").alias("anchor")))
    found = claim_search(claims, mentions, asked)
    return found.withColumn("claims", F.array_join(F.transform("claims", lambda c: c.cast("string")), ">")).withColumn("truncated", F.array_join("truncated", ","))
