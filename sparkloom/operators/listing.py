"""Operators of listings and queues: reserved places, drill-down, occurrences, appended sequences, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.relational import latest

# Factor of drilled-down children, longest guarded keyword, nodes of a link graph, files of a context, parallel readers.
DRILL_FACTOR, GUARD_CHARS, GRAPH_NODES, CONTEXT_FILES, PARALLEL = 0.95, 16, 200, 8, 3


def reserved_first(rows: DataFrame, group: str, reserved: Column, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; reserved rows stand before all others."""
    return latest(rows, [group], [F.coalesce(reserved, F.lit(False)).desc(), *order], k)


def drill_down(hits: DataFrame, children: DataFrame, k: int, factor: float = DRILL_FACTOR) -> DataFrame:
    """(query_id, child_id, score): children of the best ``k`` hits of each query, each at its best parent's reduced score.

    ``hits(query_id, chunk_id, score)``, ``children(chunk_id, child_id)``; at most ``k`` children a query, ties by child_id.
    """
    parents = latest(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
    reduced = F.round(F.col("score") * factor + 1e-9, 4)
    found = parents.join(children, "chunk_id").groupBy("query_id", "child_id").agg(F.max(reduced).alias("score"))
    return latest(found, ["query_id"], [F.desc("score"), F.asc("child_id")], k)


def occurrences(texts: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, char_start) of every occurrence of ``needle`` in any case, overlapping ones included.

    Texts are cut before each occurrence, so the running length of the pieces is the offset. Keys are unique; a null text has none.
    """
    low, lower = needle.lower(), F.lower(text)
    pieces = texts.select(key, F.startswith(lower, F.lit(low)).alias("first"), F.posexplode(F.split(lower, f"(?=\\Q{low}\\E)")).alias("i", "piece"))
    sized = pieces.select(key, "i", F.length("piece").cast("bigint").alias("n"), ((F.col("i") > 0) | F.col("first")).alias("hit"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("i")) - F.col("n")
    return sized.withColumn("char_start", before).where("hit").select(key, "char_start")


def append_sequence(old: DataFrame, new: DataFrame, group: str, client: str, order: str) -> DataFrame:
    """``new`` with ``seq``: repeated client ids take the number they have, others the next ones in their group."""
    both = old.select(group, client, order, F.lit(0).alias("_new")).unionByName(new.select(group, client, order, F.lit(1).alias("_new")))
    firsts = both.groupBy(group, client).agg(F.min(F.struct("_new", order)).alias("_first"))
    numbered = firsts.select(group, client, F.row_number().over(Window.partitionBy(group).orderBy("_first")).cast("bigint").alias("seq"))
    return new.join(numbered, [group, client])


def recovery(running: DataFrame, now: Column, beat: str, attempts: str, most: int, stale: str = "1 hour") -> DataFrame:
    """``running`` with ``action``: keep where the last beat is recent, else requeue, or close once attempts are used up."""
    late = F.col(beat).isNull() | (F.col(beat) < now - F.expr(f"INTERVAL {stale}"))
    return running.withColumn("action", F.when(~late, "keep").when(F.col(attempts) < most, "requeue").otherwise("close"))


def induced(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The edges (src, dst) with both ends among ``nodes``."""
    ends = nodes.select(node)
    return edges.join(ends.withColumnRenamed(node, "src"), "src", "left_semi").join(ends.withColumnRenamed(node, "dst"), "dst", "left_semi").select("src", "dst")


def context_batch(seeds: DataFrame, edges: DataFrame, depth: int = 2, most: int = CONTEXT_FILES) -> DataFrame:
    """(seed, depth, node): neighbourhoods of several seeds in turn, each node once, ``most`` a seed and in all."""
    reached = front = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
        front = front.join(steps, "node").select("seed", F.col("_next").alias("node"), F.lit(d).alias("depth")).distinct()
        reached = reached.unionByName(front)
    near = reached.groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    once = latest(latest(near, ["seed"], [F.asc("depth"), F.asc("node")], most), ["node"], [F.asc("seed")])
    return once.orderBy("seed", "depth", "node").limit(most)
