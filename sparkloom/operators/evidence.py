"""Evidence of answers: sampled windows, verified citations, provenance, traces, and the state of files."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.functions.columns import let
from sparkloom.storage import small_frames

# Sizes and weights of sampled windows, the radius around a citation, bounds of a trace.
WINDOWS, SHORTEST, LONGEST, LEAD = 20, 400, 800, 120
OVERLAP_WEIGHT, PROXIMITY_WEIGHT = 0.6, 0.4
RADIUS = 240
TRACE_IDS, TRACE_BYTES = 100, 16 * 1024
PLACEHOLDER_SCORE = 0.05
#: What short terms are searched as.
EXPANSIONS = {
    "发票": ["发票", "报销", "收据", "单据", "对账单"],
    "合同": ["合同", "协议", "合约", "契约"],
    "报告": ["报告", "报表", "汇报", "分析报告"],
    "简历": ["简历", "履历", "CV", "个人简历"],
    "教程": ["教程", "指南", "手册", "说明", "文档"],
}
#: Provenance, confidence and kind of source by origin.
PROVENANCE = {
    "file_direct": ("extracted", 1.0, "wiki_link"),
    "derived_from": ("extracted", 1.0, "derived_from"),
    "wiki_coref": ("inferred", 0.95, "coref"),
    "wiki_topic": ("inferred", 0.95, "topic_hub"),
    "wiki_graph": ("inferred", 0.88, "wiki_graph_expand"),
    "doc_entity": ("inferred", 0.86, "doc_entity_expand"),
    "sag_event": ("inferred", 0.84, "sag_event_expand"),
    "raptor": ("inferred", 0.84, "raptor_drilldown"),
    "tag_cooc": ("inferred", 0.82, "tag_cooc_expand"),
    "tag_union": ("inferred", 0.75, "tag_cooccurrence"),
    "monte_carlo": ("inferred", 0.7, "monte_carlo_sample"),
    "broken_link": ("ambiguous", 0.2, "wiki_link"),
    "other_link": ("inferred", 0.75, "wiki_link"),
}
EXTRACTING, INDEXING, AFTER = ("pending", "processing", "queued", "running"), ("pending", "indexing", "queued", "running"), ("pending", "queued", "running")


def expanded(queries: DataFrame) -> DataFrame:
    """(query_id, n, term) of ``queries(query_id, text)``: a known short term becomes its likes, any other query stays itself."""
    asked = F.trim("text")
    known = F.create_map(*(x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    terms = F.coalesce(F.element_at(known, asked), F.array(asked))
    return queries.where("text IS NOT NULL").select("query_id", F.posexplode(terms).alias("n", "term"))


def provenance(origin: Column, score: Column | None = None) -> Column:
    """(provenance, confidence, source_kind) of a hit or link by where it comes from; plain hits by their score."""
    row = lambda p, c, k: F.struct(F.lit(p).alias("provenance"), c.alias("confidence"), F.lit(k).alias("source_kind"))
    hit = F.when(F.coalesce(score if score is not None else F.lit(0.0), F.lit(0.0)) >= 0.5, 0.85).otherwise(0.65)
    found = F.when(origin == "search_hit", row("inferred", hit, "search_hit"))
    for name, (p, c, k) in PROVENANCE.items():
        found = found.when(origin == name, row(p, F.lit(c), k))
    return found.otherwise(row("ambiguous", F.lit(0.2), "wiki_link"))


def figure_refs(file_id: Column, kind: Column, asset: Column, page: Column, caption: Column) -> Column:
    """(preview_url, asset_key, page, caption) of a figure, null for other content; an asset is named by its last part, if that is a plain name."""
    base = F.regexp_extract(F.coalesce(asset, F.lit("")), r"([^/\\]*)$", 1)
    safe = F.when(base.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]*$"), base)
    refs = F.struct(F.concat(F.lit("/api/files/"), file_id.cast("string"), F.lit("/preview")).alias("preview_url"), safe.alias("asset_key"), F.when(page >= 1, page).alias("page"), F.nullif(caption, F.lit("")).alias("caption"))
    return F.when(kind == "figure", refs)


def processing_stage(extract: Column, index: Column, after: Column) -> Column:
    """(stage, source_kind, is_final, confidence) of a file from the states of its three jobs; no stage when all is done."""
    e, i, a = (F.coalesce(F.trim(x), F.lit("")) for x in (extract, index, after))
    row = lambda stage, kind, final, confidence: F.struct(stage.alias("stage"), F.lit(kind).cast("string").alias("source_kind"), F.lit(final).alias("is_final"), F.lit(confidence).alias("confidence"))
    waiting = lambda stage: row(stage, "processing_placeholder", False, "none")
    return (
        F.when((i != "ready") & e.isin(*EXTRACTING), waiting(F.concat(F.lit("extract_"), e)))
        .when(i != "ready", waiting(F.concat(F.lit("index_"), F.when(i == "", "pending").otherwise(i))))
        .when(a.isin(*AFTER), row(F.concat(F.lit("post_"), a), "final_md_post_pending", True, "partial"))
        .when(a == "failed", row(F.lit("post_failed"), "final_md_post_failed", True, "partial"))
        .otherwise(row(F.lit(None).cast("string"), None, True, "final"))
    )


def placeholders(hits: DataFrame, files: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, file_id, score, stage) for files that aren't ready, are named like a query and aren't among its hits.

    ``files(file_id, name, stage, is_final, updated_at)``; ``queries(query_id, text)`` is a
    stated query set and meets the unready files only. The newest k of each query.
    """
    unready = files.where(~F.col("is_final"))
    named = unready.join(F.broadcast(queries.where("trim(text) <> ''")), F.contains(F.lower("name"), F.lower(F.trim("text"))))  # the query set
    newest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("file_id")))
    first = named.withColumn("n", newest).where(F.col("n") <= k)
    return first.join(hits.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti").select("query_id", "file_id", F.lit(PLACEHOLDER_SCORE).alias("score"), "stage")


def sampled_windows(docs: DataFrame, terms: list[str], k: int, seed_at: Column | None = None) -> DataFrame:
    """(doc_id, start, end, score, rank): the k best of at most ``WINDOWS`` windows of each text.

    Windows begin a little before places of the terms, in order, and at places drawn by a
    hash, half of them near the seed; their sizes are drawn too. A window is scored by the
    share of the terms that it holds and by how near the seed it lies. Draws come from the
    document's id, so that a sample can be repeated.
    """
    terms = [t.lower() for t in terms if len(t) >= 2]
    lower, n = F.lower("text"), F.col("n")
    draw = lambda what, below: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), what)), 1, 8), 16, 10).cast("bigint"), below)

    def places(term: str, body: Column) -> Column:
        lengths = F.transform(F.split(body, "\\Q" + term + "\\E", WINDOWS + 1), lambda x: F.length(x))
        before = lambda sizes, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x) + (i - 1) * len(term)
        found = lambda sizes: F.transform(F.sequence(F.lit(1), F.size(sizes) - 1), lambda i: F.greatest(F.lit(0).cast("bigint"), before(sizes, i) - draw(F.concat(F.lit(f"{term}:"), i.cast("string")), F.lit(LEAD + 1))))
        return let(lengths, lambda sizes: F.when(F.size(sizes) > 1, found(sizes)).otherwise(F.array().cast("array<bigint>")))  # each text is cut once a term, not once a place

    hits = let(lower, lambda body: F.flatten(F.array(*(places(t, body) for t in terms[:5])))) if terms else F.array().cast("array<bigint>")
    wide = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), lambda i: draw(F.concat(F.lit("any:"), i.cast("string")), n - SHORTEST + 1))
    near = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), lambda i: F.least(n.cast("bigint") - 1, F.greatest(F.lit(0).cast("bigint"), F.col("seed") + draw(F.concat(F.lit("near:"), i.cast("string")), F.lit(SHORTEST + 1)) - SHORTEST // 2)))
    drawn = F.concat(F.slice(wide, 1, WINDOWS // 3), near)
    starts = F.slice(F.array_distinct(F.concat(F.slice(hits, 1, WINDOWS), drawn)), 1, WINDOWS)
    seeded = docs.withColumn("n", F.length("text")).where(n >= SHORTEST)
    seeded = seeded.select("doc_id", "text", "n", F.coalesce(seed_at.cast("bigint") if seed_at is not None else F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("seed"))
    each = seeded.select("doc_id", "text", "n", "seed", F.explode_outer(starts).alias("start"))  # never empty; explode would make the starts twice, to see whether there are any
    size = draw(F.concat(F.lit("size:"), F.col("start").cast("string")), F.lit(LONGEST - SHORTEST + 1)) + SHORTEST
    each = each.withColumn("end", F.least(n.cast("bigint"), F.col("start") + size)).where(F.col("end") - F.col("start") >= 80)
    own = F.lower(F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    held = sum((F.contains(own, F.lit(t)).cast("int") for t in terms), F.lit(0)) / max(1, len(terms))
    distance = F.abs(F.col("start") + (F.col("end") - F.col("start")) / 2 - F.col("seed")) / n
    scored = each.select("doc_id", "start", "end", F.round(OVERLAP_WEIGHT * held + PROXIMITY_WEIGHT * F.greatest(F.lit(0.0), 1 - distance), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "start"))).where(F.col("rank") <= k)


def squeezed(text: str) -> tuple[str, list[int], list[int]] | None:
    """NFKC with white space as single blanks, and where each character begins and ends in ``text``.

    A base character and its combining marks are one unit. None where the units do not make
    up the normal form of the whole, for then no place can be proven.
    """
    begins = [k for k, c in enumerate(text) if k == 0 or not unicodedata.combining(c)]
    units = zip(begins, [*begins[1:], len(text)])
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    plain: list[str] = []
    for a, b in units:
        for c in unicodedata.normalize("NFKC", text[a:b]):
            plain.append(c)
            if c.isspace():
                if out and out[-1] == " ":
                    ends[-1] = b
                    continue
                c = " "
            out.append(c)
            starts.append(a)
            ends.append(b)
    if "".join(plain) != unicodedata.normalize("NFKC", text):
        return None
    lead, tail = int(out[:1] == [" "]), len(out) - int(len(out) > 1 and out[-1] == " ")
    return "".join(out[lead:tail]), starts[lead:tail], ends[lead:tail]


def verify(source: str | None, excerpt: str | None) -> tuple[bool, int | None, int | None, str | None]:
    """Whether an excerpt stands in a source, where, and the text around it."""
    wanted = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", excerpt or "")).strip()
    found = squeezed(source) if source and wanted else None
    if found is None or (at := found[0].find(wanted)) < 0:
        return False, None, None, None
    start, end = found[1][at], found[2][at + len(wanted) - 1]
    return True, start, end, source[max(0, start - RADIUS) : end + RADIUS]


def verified_citations(citations: DataFrame) -> DataFrame:
    """``citations(doc_id, excerpt, text)`` checked against the text: (doc_id, excerpt, verified, start, end, context, source_sha256)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in small_frames(batches):
            found = pd.DataFrame([verify(t, e) for t, e in zip(pdf["text"], pdf["excerpt"])], columns=["verified", "start", "end", "context"])
            yield pd.concat([pdf[["doc_id", "excerpt", "source_sha256"]].reset_index(drop=True), found.astype({"start": "Int64", "end": "Int64"})], axis=1)

    slim = citations.select("doc_id", "excerpt", "text", F.sha2("text", 256).alias("source_sha256"))
    return slim.mapInPandas(run, "doc_id bigint, excerpt string, source_sha256 string, verified boolean, start bigint, end bigint, context string")


def bounded_ids(ids: Column, most: int = TRACE_IDS, most_bytes: int = TRACE_BYTES) -> Column:
    """The first ids of a trace, halved until their JSON is within the bytes; one stays."""
    size = lambda x: F.octet_length(F.to_json(x))
    half = lambda x: F.slice(x, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(x) / 2).cast("int")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length())), F.slice(F.array_distinct(ids), 1, most), lambda acc, _: F.when(size(acc) > most_bytes, half(acc)).otherwise(acc))


def stage_timeline(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """(file_id, job_id, status, n_stages, timeline) of the latest job of each file.

    ``jobs(file_id, job_id, status, created_at)``, ``logs(job_id, stage, status, at)``: the
    timeline has each stage once, in the order of its first entry, with its last status.
    A job's logs are few; a file without logs has an empty timeline.
    """
    newest = Window.partitionBy("file_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    last = jobs.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    stages = logs.join(last.select("job_id"), "job_id", "left_semi").groupBy("job_id", "stage").agg(F.min("at").alias("first"), F.max(F.struct("at", F.col("status").alias("s"))).alias("newest"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("first", "stage", "newest.s"))), lambda e: F.concat(e.stage, F.lit("="), e.s))
    told = stages.groupBy("job_id").agg(F.array_join(line, " > ").alias("timeline"), F.count("*").alias("n_stages"))
    return last.join(told, "job_id", "left").select("file_id", "job_id", "status", F.coalesce("n_stages", F.lit(0)).alias("n_stages"), F.coalesce("timeline", F.lit("")).alias("timeline"))


def newest_trace(traces: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """The newest of the ended ``traces(file_id, job_id, id, status, finished_at, created_at)`` of each file and job; finished ones come first."""
    order = [F.col("finished_at").isNotNull().desc(), F.desc("finished_at"), F.desc("created_at"), F.desc("id")]
    ended = traces.where(F.lower("status").isin(*terminal))
    return ended.withColumn("n", F.row_number().over(Window.partitionBy("file_id", "job_id").orderBy(*order))).where("n = 1").drop("n")


def reconcile_page(state: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The next page of each workspace and the checkpoint after it: (workspace, id) and (workspace, cursor, round, complete).

    ``state(workspace, cursor, round, complete)`` is what the last call returned; a workspace
    without a row starts at the beginning, and one that was complete starts a new round.
    """
    known = items.select("workspace").distinct().join(state, "workspace", "left")
    again = F.coalesce("complete", F.lit(False))
    begun = known.select("workspace", F.when(again, 0).otherwise(F.coalesce("cursor", F.lit(0))).cast("bigint").alias("cursor"), (F.coalesce("round", F.lit(0)) + F.when(again, 1).otherwise(0)).alias("round"))
    left = items.join(begun, "workspace").where(F.col("id") > F.col("cursor"))
    ranked = left.withColumn("n", F.row_number().over(Window.partitionBy("workspace").orderBy("id"))).where(F.col("n") <= size + 1)
    page = ranked.where(F.col("n") <= size).select("workspace", "id")
    ends = ranked.groupBy("workspace").agg(F.max(F.when(F.col("n") <= size, F.col("id"))).alias("last"), (F.count("*") <= size).alias("end"))
    after = begun.join(ends, "workspace", "left").select("workspace", F.coalesce("last", "cursor").alias("cursor"), "round", F.coalesce("end", F.lit(True)).alias("complete"))
    return page, after


def edited(chunks: DataFrame, patch: DataFrame) -> DataFrame:
    """``chunks(doc_id, chunk_index, text)`` with the texts of ``patch``, their terms, and whether an edit was made by hand."""
    new = patch.select("doc_id", "chunk_index", T.strip_space(F.col("text")).alias("_new"))
    both = chunks.join(new, ["doc_id", "chunk_index"], "left")
    text = F.coalesce("_new", "text")
    return both.select("doc_id", "chunk_index", text.alias("text"), T.terms(text).alias("terms"), F.col("_new").isNotNull().alias("manual_override"))


def adapted_blocks(blocks: DataFrame) -> DataFrame:
    """Foreign layout blocks (block_id, label, text, path, caption, page) as (block_id, kind, body, page, caption); those without content go."""
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    kind = F.when(label.isin("image", "picture", "figure"), "image").when(label == "table", "table").when(label.isin("equation", "formula"), "equation").otherwise("text")
    body = F.trim(F.coalesce(F.when(kind == "image", F.col("path")).otherwise(F.col("text")), F.lit("")))
    kept = blocks.select("block_id", kind.alias("kind"), body.alias("body"), "page", F.when(kind.isin("image", "table"), F.nullif(F.trim("caption"), F.lit(""))).alias("caption"))
    return kept.where("body <> ''")
