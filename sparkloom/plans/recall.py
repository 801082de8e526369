"""Search that goes on from its hits: linked files, tags used together, entities, events, summaries, representations, and a cache before it all."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators import governance as V
from sparkloom.operators import graph as G
from sparkloom.operators import listing as L
from sparkloom.operators import retrieval as R
from sparkloom.operators.relational import latest
from sparkloom.plans.search import SearchOptions, first_chunks, search
from sparkloom.sources.versioned import QueryCache
from sparkloom.storage import staged

# Files and chunks that are followed, what is found from them, and what their scores are multiplied by.
SEEDS, LINKED, COOC_TAGS, COOC_FILES, LEAST_EDGE, EVENTS = 3, 8, 5, 128, 2, 50
LINK_FACTOR, TAG_FACTOR, EVENT_FACTOR = 0.92, 0.90, 0.88
ITEMS = ["query_id", "id", "file_id", "score", "origin", "step"]


@dataclass(frozen=True)
class Related:
    """What hits may lead to; each table that is given adds its step, in this order."""

    links: DataFrame | None = None  # (src, dst): files
    tags: DataFrame | None = None  # (file_id, tag)
    entities: DataFrame | None = None  # (file_id, chunk_id, entity)
    events: DataFrame | None = None  # (event, chunk_id, entity)
    children: DataFrame | None = None  # (chunk_id, child_id): what a summary stands for
    representations: DataFrame | None = None  # (id, file_id, chunk_id, embedding): other vectors of files, or of chunks


def seed_files(items: DataFrame, n: int = SEEDS) -> DataFrame:
    """(query_id, file_id, place): the first ``n`` files of each query."""
    best = items.groupBy("query_id", "file_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "file_id"))).where(F.col("place") <= n).drop("rank")


def linked_files(items: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(query_id, file_id): the first ``LINKED`` new files that the seeds link to, in the order of the seeds.

    ``k`` is the most items of a query, so that the first ``LINKED + k`` links of a file are
    enough: what follows them can't be chosen.
    """
    some = latest(links.select("src", "dst").distinct(), ["src"], [F.asc("dst")], LINKED + k)
    near = seed_files(items).join(some, F.col("file_id") == F.col("src")).groupBy("query_id", F.col("dst").alias("file_id")).agg(F.min("place").alias("place"))
    fresh = near.join(items.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti")
    return latest(fresh, ["query_id"], [F.asc("place"), F.asc("file_id")], LINKED).select("query_id", "file_id")


def neighbour_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, tag): the tags most often used beside one of the seeds' tags.

    Pairs are counted once for all queries, over all files; the map side combines them.
    """
    once = tags.select("file_id", "tag").distinct()
    asked = staged(seed_files(items).join(once, "file_id").select("query_id", F.col("tag").alias("seed")).distinct(), "seed-tags")
    mine = once.withColumnRenamed("tag", "seed").join(asked.select("seed").distinct(), "seed", "left_semi")
    pairs = mine.join(once, "file_id").where("seed <> tag").groupBy("seed", "tag").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_EDGE)
    best = asked.join(pairs, "seed").groupBy("query_id", "tag").agg(F.max("n").alias("n"))
    return latest(best, ["query_id"], [F.desc("n"), F.asc("tag")], COOC_TAGS).select("query_id", "tag")


def files_of_tags(items: DataFrame, wanted: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """(query_id, file_id): the first ``COOC_FILES`` new files with one of a query's tags; a tag's first ``COOC_FILES + k`` are enough."""
    some = latest(tags.select("tag", "file_id").distinct().join(wanted.select("tag").distinct(), "tag", "left_semi"), ["tag"], [F.asc("file_id")], COOC_FILES + k)
    fresh = wanted.join(some, "tag").select("query_id", "file_id").distinct().join(items.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti")
    return latest(fresh, ["query_id"], [F.asc("file_id")], COOC_FILES)


def event_chunks(items: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, id, score): chunks of events that share entities with those of the first items, over two hops."""
    known = events.select("event", "chunk_id").distinct()
    seeds = items.where(F.col("rank") <= SEEDS).join(known, F.col("id") == F.col("chunk_id")).select("query_id", "event").distinct()
    reached = G.expand_by_entities(seeds, events.select("event", "entity").distinct(), 2, EVENTS).where("hop > 0")
    return reached.join(known, "event").select("query_id", F.col("chunk_id").alias("id"), F.lit(round(R.FALLBACK_SCORE * EVENT_FACTOR, 4)).alias("score")).distinct()


def merged(items: DataFrame, fresh: DataFrame, origin: str, step: int, k: int) -> DataFrame:
    """``items`` and ``fresh(query_id, id, file_id, score)``, the best ``k`` of each query; each chunk once, earlier steps first among equals."""
    both = items.select(ITEMS).unionByName(fresh.select("query_id", "id", "file_id", "score", F.lit(origin).alias("origin"), F.lit(step).alias("step")))
    once = latest(both, ["query_id", "id", "file_id"], [F.desc("score"), F.asc("step")])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "step", "id", "file_id")
    return staged(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"items-{origin}")


def related_search(
    docs: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    related: Related,
    options: SearchOptions = SearchOptions(),
    readable: DataFrame | None = None,
    tagged: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, file_id, score, origin, rank): hits of ``search``, and what they lead to.

    Documents and vectors have a ``file_id``. Linked files and files of neighbouring tags are
    searched with the query again, within these files; all other steps bring their own scores.
    After each step a query keeps its best ``top_k`` items, from which the next step goes on, so
    that each step's work is bounded by the queries. A hit of a representation without a chunk
    has no ``id``. What isn't in ``readable(id)`` is neither found nor followed.
    """
    k = options.top_k
    plain = replace(options, group_by_file=False, context_chunks=0)
    ready = chunks if readable is None else chunks.join(readable, "id", "left_semi")
    places = ready.select("id", "file_id")
    first = search(docs, vectors, queries, plain, readable, chunks, tagged=tagged)
    items = staged(first.select("query_id", "id", "file_id", "score", F.lit("search").alias("origin"), F.lit(0).alias("step"), "rank"), "items-search")

    def again(within: DataFrame, factor: float, settings: SearchOptions) -> DataFrame:
        found = search(docs, vectors, queries, settings, readable, chunks, within=within)
        return found.select("query_id", "id", "file_id", F.round(F.col("score") * factor + 1e-9, 4).alias("score"))

    def placed(fresh: DataFrame, step: str) -> DataFrame:
        return staged(fresh.select("query_id", "id", "score"), step).join(places, "id")

    if related.links is not None:
        near = staged(linked_files(items, related.links, k), "linked")
        found = staged(again(near, LINK_FACTOR, replace(plain, hybrid=False)), "linked-hits")
        none = near.join(found.select("query_id").distinct(), "query_id", "left_anti")
        rest = none.join(first_chunks(chunks, none, readable), "file_id").select("query_id", "id", "file_id", F.lit(round(R.FALLBACK_SCORE * LINK_FACTOR, 4)).alias("score"))
        items = merged(items, found.unionByName(rest), "links", 1, k)
    if related.tags is not None:
        near = staged(files_of_tags(items, neighbour_tags(items, related.tags), related.tags, k), "tag-files")
        items = merged(items, again(near, TAG_FACTOR, plain), "tags", 2, k)
    if related.entities is not None:
        hits = items.select("query_id", "file_id", F.col("id").alias("chunk_id"), "rank").where(F.col("rank") <= SEEDS)
        near = V.entity_neighbours(hits, related.entities).withColumnRenamed("chunk_id", "id")
        fresh = near.join(items.select("query_id", "id"), ["query_id", "id"], "left_anti")
        items = merged(items, placed(fresh, "entity-hits"), "entities", 3, k)
    if related.events is not None:
        fresh = event_chunks(items, related.events).join(items.select("query_id", "id"), ["query_id", "id"], "left_anti")
        items = merged(items, placed(fresh, "event-hits"), "events", 4, k)
    if related.children is not None:
        hits = items.where("id IS NOT NULL").select("query_id", F.col("id").alias("chunk_id"), "score")
        items = merged(items, placed(L.drill_down(hits, related.children, k).withColumnRenamed("child_id", "id"), "children"), "children", 5, k)
    if related.representations is not None:
        rows = related.representations.join(ready.select("file_id").distinct(), "file_id", "left_semi") if readable is not None else related.representations
        best = R.vector_candidates(rows.select("id", "embedding"), queries.where("embedding IS NOT NULL").select("query_id", "embedding"), k)
        which = staged(best.select("query_id", F.col("id").alias("representation"), "score"), "representations")
        hits = which.join(rows.select(F.col("id").alias("representation"), "file_id", "chunk_id"), "representation")
        of_chunks = hits.join(places.withColumnRenamed("id", "chunk_id"), ["chunk_id", "file_id"], "left_semi").select("query_id", F.col("chunk_id").alias("id"), "file_id", "score")
        of_files = hits.where("chunk_id IS NULL").groupBy("query_id", "file_id").agg(F.max("score").alias("score")).join(items.select("query_id", "file_id"), ["query_id", "file_id"], "left_anti")
        fresh = of_chunks.join(items.select("query_id", "id"), ["query_id", "id"], "left_anti").unionByName(of_files.select("query_id", F.lit(None).cast("bigint").alias("id"), "file_id", "score"))
        items = merged(items, fresh, "representations", 6, k)
    return items.drop("step")


def cached_search(cache: QueryCache, asked: DataFrame, now: str, answer) -> DataFrame:
    """(query_id, cached, payload): what ``cache`` serves, and ``answer(rest)`` of the other questions, which it then keeps.

    ``asked(query_id, user_id, scope, query, embedding, ...)``; ``answer`` returns items with
    query_id and rank, kept as JSON in the order of their ranks. A question without an item
    gets an empty list.
    """
    names = ["query_id", "user_id", "scope", "query", "embedding"]
    served = staged(cache.turn(asked.select(*names, F.lit(None).cast("string").alias("payload")), now).select("query_id", "payload"), "served")
    rest = staged(asked.join(served.select("query_id"), "query_id", "left_anti"), "not-served")
    items = answer(rest)
    listed = F.array_sort(F.collect_list(F.struct("rank", *[c for c in items.columns if c not in ("query_id", "rank")])))
    payloads = items.groupBy("query_id").agg(F.to_json(listed).alias("payload"))  # at most top_k items a query
    made = staged(rest.join(payloads, "query_id", "left").select(*names, F.coalesce("payload", F.lit("[]")).alias("payload")), "answers")
    cache.turn(made, now)
    return served.select("query_id", F.lit(True).alias("cached"), "payload").unionByName(made.select("query_id", F.lit(False).alias("cached"), "payload"))
