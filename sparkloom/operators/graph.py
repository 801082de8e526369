"""Graph analytics over edge tables: frontier joins, degrees, paths, ranks and trees.

Iterations have fixed bounds. Each round's state is written to the shared folder, so plans
stay short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import staged

# Bounds and factors that results depend on.
PATH_HOPS, MOST_HOPS = 4, 6
DAMPING, ROUNDS = 0.85, 10
TREE_DEPTH = 20


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def co_occurrence(members: DataFrame, item: str, group: str) -> DataFrame:
    """Unordered pairs of items by the number of groups that hold both.

    Groups are sets whose size the caller bounds (the newest of each, the most used items): n
    items of a group make n * n / 2 pairs, as the result has them.
    """
    m = members.select(F.col(group).alias("g"), F.col(item).alias("x")).distinct()
    a, b = m.withColumnRenamed("x", "a"), m.withColumnRenamed("x", "b")
    return a.join(b, "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def matrix(members: DataFrame, item: str, group: str) -> DataFrame:
    """(a, b, n) both ways and on the diagonal, for distinct members of few items.

    A group's items meet in a row, so nothing is joined; pairs are counted on the map side,
    and the shuffle has the square of the number of items at most for each task.
    """
    sets = members.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("x"))
    upper = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 1, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    half = sets.select(F.explode(upper).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(ways).alias("w"), "n").select("w.a", "w.b", "n")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, score) over distinct edges."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    zero = out.join(into, "node", "full").na.fill(0, ["n_out", "n_in"])
    return zero.withColumn("score", (F.col("n_out") + F.col("n_in")).cast("double"))


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int = PATH_HOPS) -> DataFrame:
    """(start, node, hops, path) of every node within ``hops`` of each start, undirected; the least path of equals."""
    around = staged(both_ways(edges), "edges")
    seen = staged(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")), "paths")
    for h in range(1, min(hops, MOST_HOPS) + 1):
        front = seen.where(F.col("hops") == h - 1)
        step = front.join(around, front["node"] == around["src"]).select("start", F.col("dst").alias("node"), F.lit(h).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        fresh = step.groupBy("start", "node").agg(F.min("hops").alias("hops"), F.min("path").alias("path")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = staged(seen.unionByName(fresh), "paths")
    return seen


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(node, rank): ``rounds`` steps from ``seeds(node, weight)`` along distinct edges; mass at dead ends is lost."""
    e = edges.select("src", "dst").distinct()
    e = staged(e.join(e.groupBy("src").agg(F.count("*").alias("n")), "src"), "rank-edges")
    total = F.broadcast(seeds.agg(F.sum("weight").alias("total")))  # one row
    base = staged(seeds.join(total).select("node", (F.col("weight") / F.col("total")).alias("base")), "rank-base")
    rank = base.select("node", F.col("base").alias("rank"))
    for k in range(rounds):
        flow = rank.join(e, rank["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("flow"))
        rank = flow.join(base, "node", "full").select("node", (damping * F.coalesce("flow", F.lit(0.0)) + (1 - damping) * F.coalesce("base", F.lit(0.0))).alias("rank"))
        if k % 3 == 2 or k == rounds - 1:
            rank = staged(rank, "rank")
    return rank


def tree_paths(nodes: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(node, root, level, label) for ``nodes(node, parent, name)``; roots have no parent, and cycles end at ``depth``."""
    reached = staged(nodes.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).alias("level"), F.col("name").alias("label")), "tree")
    children = nodes.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent", "name")
    whole, front = reached, reached
    for _ in range(depth):
        step = front.join(children, front["node"] == children["parent"]).select(F.col("child").alias("node"), "root", (F.col("level") + 1).alias("level"), F.concat_ws("/", "label", "name").alias("label"))
        front = staged(step, "tree")
        if front.isEmpty():
            break
        whole = whole.unionByName(front)
    return whole


def allowed_moves(moves: DataFrame, nodes: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(node, parent, allowed) of distinct ``moves(node, parent)`` in the tree ``nodes(node, parent)``: no folder goes into itself or below.

    All moves walk up together from the new parent, a level a round.
    """
    up = nodes.where("parent IS NOT NULL").select(F.col("node").alias("at"), F.col("parent").alias("above"))
    front = staged(moves.select("node", "parent").distinct().withColumn("at", F.col("parent")), "moves")
    ended = []
    for _ in range(depth):
        ended.append(front.where(F.col("at") == F.col("node")).select("node", "parent", F.lit(False).alias("allowed")))
        step = front.where(F.col("at") != F.col("node")).join(up, "at", "left")
        ended.append(step.where("above IS NULL").select("node", "parent", F.lit(True).alias("allowed")))
        front = staged(step.where("above IS NOT NULL").select("node", "parent", F.col("above").alias("at")), "moves")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def layout_lines(nodes: DataFrame) -> DataFrame:
    """(root, node, pos, line): each tree as a nested Markdown list, in the order of its paths; a tree is one workspace."""
    paths = tree_paths(nodes)
    name = F.element_at(F.split("label", "/"), F.col("level") + 1)
    order = Window.partitionBy("root").orderBy("label", "node")
    return paths.select("root", "node", F.row_number().over(order).alias("pos"), F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), name).alias("line"))


def expand_by_links(hits: DataFrame, edges: DataFrame, seeds: int = 3, neighbours: int = 8, factor: float = 0.92) -> DataFrame:
    """Neighbours of each query's best files, scored by the seed's score times ``factor``; known files stay out."""
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= seeds)
    near = best.join(edges, best["id"] == edges["src"]).groupBy("query_id", F.col("dst").alias("id")).agg((F.max("score") * factor).alias("score"))
    fresh = near.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours).drop("n")


def expand_by_entities(seeds: DataFrame, mentions: DataFrame, hops: int = 2, most: int = 200) -> DataFrame:
    """(query_id, event, hop) reached from ``seeds(query_id, event)`` over shared entities of ``mentions(event, entity)``.

    The first ``most`` of each query, by hop and event; each hop is cut likewise, for what comes
    later in it can't be among them. At most ``most`` events of a query are known before a hop,
    so the first ``2 * most`` events of an entity are all that a hop can use of it.
    """
    cut = lambda events: events.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "event"))).where(F.col("n") <= most).drop("n")
    seen = staged(cut(seeds.select("query_id", "event", F.lit(0).alias("hop")).distinct()), "events")
    once = mentions.select("event", "entity").distinct()
    place = F.row_number().over(Window.partitionBy("entity").orderBy("event"))
    first = staged(once.withColumn("n", place).where(F.col("n") <= 2 * most).drop("n"), "entity-events")
    for h in range(1, hops + 1):
        entities = seen.where(F.col("hop") == h - 1).join(mentions, "event").select("query_id", "entity").distinct()
        found = entities.join(first, "entity").select("query_id", "event", F.lit(h).alias("hop")).distinct().join(seen.select("query_id", "event"), ["query_id", "event"], "left_anti")
        seen = staged(cut(seen.unionByName(found)), "events")
    return seen


def claim_paths(claims: DataFrame, starts: DataFrame, hops: int = 3, fan_out: int = 24) -> DataFrame:
    """(start, node, hops, claims) over ``claims(claim_id, subject, object)`` in both directions, without repeated nodes.

    At each node the ``fan_out`` first claims by id are followed.
    """
    around = claims.select("claim_id", F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(claims.select("claim_id", F.col("object").alias("a"), F.col("subject").alias("b")))
    first = Window.partitionBy("a").orderBy("claim_id", "b")
    around = staged(around.withColumn("n", F.row_number().over(first)).where(F.col("n") <= fan_out).drop("n"), "claims")
    front = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("nodes"), F.array().cast("array<bigint>").alias("claims"))
    found = None
    for h in range(1, hops + 1):
        step = front.join(around, front["node"] == around["a"]).where(~F.array_contains("nodes", F.col("b")))
        front = staged(step.select("start", F.col("b").alias("node"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("claims", F.array("claim_id")).alias("claims")), "claim-paths")
        part = front.select("start", "node", F.lit(h).alias("hops"), "claims")
        found = part if found is None else found.unionByName(part)
    return found
