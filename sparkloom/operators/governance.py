"""Who may read what, the state of a wiki, entities by rule, and bounded answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T

# The level from which a folder can be read, bounds and factors, and the order in which an answer is cut.
READ = 2
#: Users in a block, all of whom may read the same files, and groups in which such files meet them.
USERS, PARTS = 1024, 16
NEIGHBOURS, SEEDS, NEIGHBOUR_SCORE = 8, 20, 0.405
SECTIONS = ("retrieval", "evidence", "answer", "extraction")
CUT = '{"state":"partial","data":{"truncated":true}}'
#: Patterns of question types, in the order in which they are tried.
QUESTIONS = (
    ("figure_vlm", "图里|流程图|示意图|截图|结构图|曲线图"),
    ("struct_relation", "什么关系|怎么扯|引用链|涉及哪些主题|出链|入链|wiki-path"),
    ("tag_topic", "共现|相邻标签|标签.*关联|关联.*标签"),
    ("topic_wiki", "主题|关联|对比|还有哪些|相关文档|邻居"),
    ("structured_field", "金额|合计|价税|总计|多少|数字|日期|费用"),
    ("cjk_doc", "发票|合同|报销单|报告"),
    ("tag_archive", "标签下|归档在"),
    ("procedure", "步骤|流程|如何"),
    ("full_summary", "全文|要点|清单"),
)


def readable_files(asked: DataFrame, users: DataFrame, workspaces: DataFrame, members: DataFrame, grants: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, file_id) of each of ``asked(user_id, workspace_id)``: what a user may read in a workspace.

    ``users(user_id, is_admin)``, ``workspaces(workspace_id, personal)``, ``members(user_id,
    workspace_id)``, ``grants(user_id, folder_id, level)``, ``files(file_id, workspace_id,
    folder_id, user_id)``. An administrator reads all files, the owner of a personal workspace
    their own; a member those of folders with a level of ``READ`` at least, and their own
    outside of folders.

    The three ways give different pairs, and their inputs are made distinct before they meet,
    so no pair is shuffled: a workspace is personal or not, and a file is in one workspace and
    in one folder or none. Users with the same files stand in blocks of ``USERS`` at most, and
    files meet blocks; pairs are made where their files are.
    """
    admins = users.groupBy("user_id").agg(F.coalesce(F.bool_or("is_admin"), F.lit(False)).alias("is_admin"))
    member = members.select("user_id", "workspace_id", F.lit(True).alias("member")).distinct()
    who = asked.select("user_id", "workspace_id").distinct().join(admins, "user_id").join(workspaces.select("workspace_id", "personal").distinct(), "workspace_id")
    who = who.join(member, ["user_id", "workspace_id"], "left").na.fill({"member": False})
    owned = files.select("file_id", "workspace_id", "folder_id", F.col("user_id").alias("owner")).distinct()
    every = who.where("is_admin").select("user_id", "workspace_id").distinct()
    own = who.where("NOT is_admin AND (personal OR member)").join(owned, (who["workspace_id"] == owned["workspace_id"]) & (who["user_id"] == owned["owner"])).where("personal OR folder_id IS NULL")
    best = grants.groupBy("user_id", "folder_id").agg(F.max("level").alias("level")).where(F.col("level") >= READ)
    shared = who.where("NOT is_admin AND NOT personal AND member").join(best, "user_id").select("user_id", "workspace_id", "folder_id")
    pairs = [_readers(every, owned, ["workspace_id"]), own.select("user_id", "file_id"), _readers(shared, owned, ["workspace_id", "folder_id"])]
    return reduce(DataFrame.unionByName, pairs)


def _readers(users: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """(user_id, file_id) of the same ``key``: each file meets blocks of users, and the files of a key are ``PARTS`` groups, as small tables make many pairs."""
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("user_id")) - 1) / USERS)
    blocks = users.withColumn("block", block).groupBy(*key, "block").agg(F.collect_list("user_id").alias("users"))
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(spread, *key, "part")
    dealt = files.withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(PARTS)).cast("int")).repartition(spread, *key, "part")
    return dealt.join(blocks, [*key, "part"]).select(F.explode("users").alias("user_id"), "file_id")


def typed_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, target, edge_type) once each, of ``links(source, kind, target, slug, broken)`` between ``pages(file_id, page_kind, slug)``.

    A slug that leads nowhere yet is looked up among the pages; a topic edge needs a wiki page
    at its end; broken links that no slug mends are left out.
    """
    known = pages.select(F.col("file_id").alias("found"), F.col("page_kind").alias("found_kind"), F.col("slug").alias("page_slug"))
    by_slug = known.where("page_slug <> ''").groupBy("page_slug").agg(F.min("found").alias("by_slug"))
    asked = links.withColumn("page_slug", F.when(F.col("target").isNull() & (F.col("kind") == "wiki_slug"), T.slug(F.col("slug"))))
    met = asked.join(by_slug, "page_slug", "left").withColumn("to", F.coalesce("target", "by_slug"))
    met = met.where(~F.col("broken") | F.col("by_slug").isNotNull()).join(known.drop("page_slug"), F.col("to") == F.col("found"))
    kept = met.join(pages.select(F.col("file_id").alias("source")), "source", "left_semi").where((F.col("kind") != "wiki_slug") | F.col("found_kind").isin("concept", "topic"))
    return kept.select("source", F.col("to").alias("target"), F.when(F.col("kind") == "wiki_slug", "wiki_topic").otherwise("file_direct").alias("edge_type")).distinct()


def lint(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(finding, file_id, target): links to what was deleted or may not be read, wiki pages without a slug, and such that nothing links to or from.

    ``links(source, target, slug, reason)``: reason is deleted, acl or null; ``pages(file_id, page_kind, slug)``.
    """
    row = lambda df, finding, file_id, target: df.select(F.lit(finding).alias("finding"), F.col(file_id).alias("file_id"), target.cast("string").alias("target"))
    wiki = pages.where(F.col("page_kind").isin("concept", "topic"))
    named = wiki.where("trim(slug) <> ''")
    into = links.where("reason IS NULL").select(F.col("target").alias("file_id")).distinct()
    out = links.select(F.col("source").alias("file_id")).distinct()
    orphans = named.join(into, "file_id", "left_anti").join(out, "file_id", "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            row(links.where("reason = 'deleted'"), "broken", "source", F.coalesce("slug", F.col("target").cast("string"))),
            row(links.where("reason = 'acl'"), "acl_broken", "source", F.col("target")),
            row(wiki.where("slug IS NULL OR trim(slug) = ''"), "missing_slug", "file_id", F.col("page_kind")),
            row(orphans, "orphan", "file_id", F.col("slug")),
        ],
    )


def entity_neighbours(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): other chunks of the hits' files that name an entity of the hits.

    ``hits(query_id, file_id, chunk_id, rank)``: the first ``SEEDS`` of each query are followed;
    ``edges(file_id, chunk_id, entity)``. ``NEIGHBOURS`` of each query, by chunk.
    """
    seeds = hits.where(F.col("rank") <= SEEDS)
    named = seeds.join(edges, ["file_id", "chunk_id"]).select("query_id", "entity").distinct()
    files = seeds.select("query_id", "file_id").distinct().join(named, "query_id")  # what may be named where, so that a file's chunks meet only these
    near = files.join(edges, ["file_id", "entity"]).select("query_id", "chunk_id").distinct().join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return near.withColumn("n", first).where(F.col("n") <= NEIGHBOURS).select("query_id", "chunk_id", F.lit(NEIGHBOUR_SCORE).alias("score"))


def rule_entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, entity, entity_type, relation): header cells of tables and captions of ``chunks(chunk_id, kind, text, caption)``; a cell with a digit is a metric."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_table = (F.lower("kind") == "table") & F.get(lines, F.lit(0)).startswith("|") & F.get(lines, F.lit(1)).rlike(r"^\|?[\s:|-]*-[\s:|-]*$")
    cells = F.split(F.regexp_replace(F.get(lines, F.lit(0)), r"^\|+|\|+$", ""), r"\|")
    of = lambda name, kind, relation: F.struct(T.entity_name(name).alias("entity"), kind.alias("entity_type"), F.lit(relation).alias("relation"))
    header = F.when(is_table, F.transform(cells, lambda c: of(c, F.when(c.rlike("[0-9]"), "metric").otherwise("concept"), "column_header"))).otherwise(F.array().cast("array<struct<entity:string,entity_type:string,relation:string>>"))
    title = F.array(of(F.col("caption"), F.when(F.lower("kind") == "table", "metric").otherwise("concept"), "caption"))
    found = chunks.select("chunk_id", F.explode(F.array_distinct(F.concat(header, title))).alias("e")).select("chunk_id", "e.*").where("entity IS NOT NULL")
    return found.groupBy("chunk_id", "entity", "relation").agg(F.min("entity_type").alias("entity_type"))


def unreferenced(entities: DataFrame, mentions: DataFrame, deleted: DataFrame) -> DataFrame:
    """``entities(entity)`` that only files of ``deleted(file_id)`` mention, or none, given ``mentions(entity, file_id)``."""
    alive = mentions.join(deleted, "file_id", "left_anti").select("entity").distinct()
    return entities.join(alive, "entity", "left_anti")


def rebuilt_links(links: DataFrame, scanned: DataFrame, found: DataFrame) -> DataFrame:
    """``links(source, target)`` where those of the ``scanned(source)`` files are replaced by ``found``."""
    kept = links.join(scanned.distinct(), "source", "left_anti")
    return kept.select("source", "target").unionByName(found.join(scanned.distinct(), "source", "left_semi").select("source", "target")).distinct()


def put_many(cache: DataFrame, batch: DataFrame) -> DataFrame:
    """``cache(key, value)`` after ``batch(key, value, position)``: the last of a batch's entries with a key stays."""
    last = batch.groupBy("key").agg(F.max_by("value", "position").alias("value"))
    return cache.join(last.select("key"), "key", "left_anti").select("key", "value").unionByName(last)


def bounded_answer(parts: DataFrame, most_bytes: int) -> DataFrame:
    """(key, n_bytes, cut, whole): the sections of an answer, cut to a stub in the order of ``SECTIONS`` until it fits the bytes."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    sizes = [size(F.col(s)) for s in SECTIONS]
    fitted = parts.withColumn("_bytes", sum(sizes[1:], sizes[0]))
    for k, own in enumerate(sizes):
        fitted = fitted.withColumn(f"_cut{k}", F.col("_bytes") > most_bytes)
        fitted = fitted.withColumn("_bytes", F.when(F.col(f"_cut{k}"), F.col("_bytes") - own + len(CUT)).otherwise(F.col("_bytes")))
    cut = F.filter(F.array(*(F.when(F.col(f"_cut{k}"), F.lit(s)) for k, s in enumerate(SECTIONS))), lambda x: x.isNotNull())
    return fitted.select("key", F.col("_bytes").alias("n_bytes"), F.array_join(cut, ",").alias("cut"), (F.size(cut) == 0).alias("whole"))


def within_budget(calls: DataFrame, most_calls: int, most_chars: int) -> DataFrame:
    """(run_id, call, accepted, reason) of the secondary searches ``calls(run_id, call, chars, readable, stopped)`` of each run, in order.

    A call is refused for good once its run was stopped, if it may not read its evidence, or
    if it would take the run beyond its calls or characters; refused calls use nothing up.
    Runs have few calls, so that each is one small group of a window.
    """
    order = Window.partitionBy("run_id").orderBy("call").rowsBetween(Window.unboundedPreceding, 0)
    open_ = calls.withColumn("halted", F.max(F.col("stopped").cast("int")).over(order) == 1)
    list_ = F.sort_array(F.collect_list(F.struct("call", "chars", "readable", "halted")))

    def step(acc: Column, c: Column) -> Column:
        reason = F.when(c.halted, "stopped").when(~c.readable, "not_readable").when(acc.n >= most_calls, "calls").when(acc.used + c.chars > most_chars, "chars")
        ok = reason.isNull()
        seen = F.concat(acc.seen, F.array(F.struct(c.call.alias("call"), ok.alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))))
        return F.struct((acc.n + ok.cast("int")).alias("n"), (acc.used + F.when(ok, c.chars).otherwise(0)).alias("used"), seen.alias("seen"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<call:bigint,accepted:boolean,reason:string>>").alias("seen"))
    folded = open_.groupBy("run_id").agg(F.aggregate(list_, start, step, lambda acc: acc.seen).alias("seen"))
    return folded.select("run_id", F.explode("seen").alias("s")).select("run_id", "s.*")


def question_type(question: Column) -> Column:
    """The first type whose pattern a question matches; short Chinese ones are exact terms, all others ask for facts."""
    q = F.trim(F.coalesce(question, F.lit("")))
    kind = F.when(q.rlike(QUESTIONS[0][1]), QUESTIONS[0][0])
    for name, pattern in QUESTIONS[1:]:
        kind = kind.when(q.rlike(pattern), name)
    return kind.when((F.length(q) <= 12) & q.rlike("[一-鿿]"), "exact_term").otherwise("fact")
