"""Paths of claims between the anchors of questions, searched from both ends, with budgets.

A claim joins two mentions. Mentions that are resolved to one entity are one node (the
identity bridge), any other mention is a node of its own. From a node the ``FAN_OUT`` first
claims by id are followed; that list is made once for all questions, so a hub costs no more
than another node, and only for the anchors' nodes and their neighbours: a path of three
claims leads through no others.

For each question every anchor's nodes are both a start and an end. Two rounds go forward,
one goes back; paths of one, two and three claims are where they meet, so that a frontier has
fan-out squared rows where a search from one side has its cube. A path repeats no node and ends at
the first node of the anchor it leads to.

Budgets are a question's: it follows claims of at most ``NODES`` nodes, round by round and by
node, loads at most ``CLAIMS`` different claims, round by round and by id, and returns at most
``PATHS`` paths, short ones first. ``truncated`` names the budgets that cut something off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import staged

# Budgets of a question.
FAN_OUT, NODES, CLAIMS, PATHS, HOPS = 24, 300, 480, 50, 3


def identities(mentions: DataFrame) -> DataFrame:
    """(mention, node, several) of ``mentions(mention, entity)``: the node is the entity where there is one; ``several`` if it has more members."""
    node = F.when(F.col("entity").isNotNull(), F.concat(F.lit("e"), F.col("entity").cast("string"))).otherwise(F.concat(F.lit("m"), F.col("mention").cast("string")))
    named = mentions.select("mention", node.alias("node"))
    sizes = named.groupBy("node").agg((F.count_distinct("mention") > 1).alias("several"))
    return named.distinct().join(sizes, "node").select("mention", "node", "several")


WAYS = (("subject", "object"), ("object", "subject"))


def neighbourhood(claims: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows of ``nodes`` of ``starts(node)`` and of all nodes that a claim joins to one: no others are ever followed."""
    own = staged(nodes.join(starts.select("node").distinct(), "node", "left_semi"), "start-mentions")
    first = own.select("mention").distinct()
    ends = reduce(DataFrame.unionByName, [claims.join(first.withColumnRenamed("mention", x), x, "left_semi").select(F.col(y).alias("mention")) for x, y in WAYS]).distinct()
    met = nodes.join(ends, "mention", "left_semi").select("node").unionByName(starts.select("node")).distinct()
    return staged(nodes.join(met, "node", "left_semi"), "near-mentions")


def followed(claims: DataFrame, nodes: DataFrame, near: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(a, b, claim_id, several): the first claims of each node ``a`` of ``near``, in both directions; ``several`` is that of ``a``.

    Equal rows have one rank, so that they are made distinct when few are left.
    """
    start = near.select(F.col("mention").alias("x"), F.col("node").alias("a"), "several")
    end = nodes.select(F.col("mention").alias("y"), F.col("node").alias("b"))
    both = reduce(DataFrame.unionByName, [claims.select("claim_id", F.col(x).alias("x"), F.col(y).alias("y")).join(start, "x") for x, y in WAYS]).join(end, "y")
    place = F.dense_rank().over(Window.partitionBy("a").orderBy("claim_id", "b"))
    return both.select("a", "b", "claim_id", "several").withColumn("n", place).where(F.col("n") <= fan_out).drop("n").distinct()


def anchor_nodes(questions: DataFrame, mentions: DataFrame, nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(question_id, anchor, node) of ``questions(question_id, anchor)`` by the ``fan_out`` first mentions of that surface, in any case."""
    asked = questions.select("question_id", "anchor", F.lower("anchor").alias("surface_key")).distinct()
    wanted = asked.select("surface_key").distinct()
    own = mentions.withColumn("surface_key", F.lower("surface")).join(wanted, "surface_key", "left_semi")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("surface_key").orderBy("mention"))).where(F.col("n") <= fan_out)
    return asked.join(first.select("surface_key", "mention"), "surface_key").join(nodes.select("mention", "node"), "mention").select("question_id", "anchor", "node").distinct()


class Budget:
    """What a question has left: each round takes its share, in order."""

    def __init__(self, most: int, name: str):
        self.most, self.name, self.used, self.cuts = most, name, None, []

    def take(self, wanted: DataFrame, key: str) -> DataFrame:
        """The new ones of ``wanted(question_id, key)`` that fit, and those that were taken before."""
        distinct = wanted.select("question_id", key).distinct()
        fresh = distinct if self.used is None else distinct.join(self.used, ["question_id", key], "left_anti")
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(key))
        ranked = fresh.withColumn("n", place)
        if self.used is not None:
            ranked = ranked.join(self.used.groupBy("question_id").agg(F.count("*").alias("before")), "question_id", "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before")
        ranked = staged(ranked, self.name)
        self.cuts.append(ranked.where(F.col("n") > self.most).select("question_id", F.lit(self.name).alias("reason")))
        taken = ranked.where(F.col("n") <= self.most).select("question_id", key)
        self.used = taken if self.used is None else self.used.unionByName(taken)
        return self.used


def claim_search(claims: DataFrame, mentions: DataFrame, questions: DataFrame, fan_out: int = FAN_OUT, nodes: int = NODES, most_claims: int = CLAIMS, paths: int = PATHS) -> DataFrame:
    """(question_id, source, target, hops, claims, bridged, rank, truncated).

    ``claims(claim_id, subject, object)`` join mentions, ``mentions(mention, entity, surface)``
    say what they are, ``questions(question_id, anchor)`` has a row for each anchor. A question without any
    path has no row.
    """
    known = staged(identities(mentions), "identities")
    starts = staged(anchor_nodes(questions, mentions, known, fan_out), "anchors")
    around = staged(followed(claims, known, neighbourhood(claims, known, starts), fan_out), "followed-claims")
    by_node, by_claim = Budget(nodes, "node_limit"), Budget(most_claims, "claim_limit")

    open_nodes = by_node.take(starts, "node")
    ahead = starts.join(open_nodes, ["question_id", "node"]).join(around, F.col("node") == F.col("a"))
    behind = starts.join(open_nodes, ["question_id", "node"]).join(around, F.col("node") == F.col("b"))
    ahead = staged(ahead.select("question_id", "anchor", "a", "b", "claim_id", "several"), "first-ahead")
    behind = staged(behind.select("question_id", "anchor", "a", "b", "claim_id", "several"), "first-behind")
    loaded = by_claim.take(ahead.select("question_id", "claim_id").unionByName(behind.select("question_id", "claim_id")), "claim_id")
    one = ahead.join(loaded, ["question_id", "claim_id"]).where("a <> b").select("question_id", "anchor", F.array("a", "b").alias("nodes"), F.array("claim_id").alias("claims"), F.col("several").alias("bridged"))
    back = staged(behind.join(loaded, ["question_id", "claim_id"]).where("a <> b").select("question_id", F.col("anchor").alias("target"), "a", F.col("b").alias("end"), F.col("claim_id").alias("last"), F.col("several").alias("last_several")), "behind")
    one = staged(one.withColumn("at", F.element_at("nodes", -1)), "ahead-1")

    open_nodes = by_node.take(one.select("question_id", F.col("at").alias("node")), "node")
    step = one.join(open_nodes.withColumnRenamed("node", "at"), ["question_id", "at"]).join(around, F.col("at") == F.col("a")).where(~F.array_contains("nodes", F.col("b")))
    step = staged(step.select("question_id", "anchor", "nodes", "claims", "bridged", "b", "claim_id", "several"), "second-ahead")
    loaded = by_claim.take(step, "claim_id")
    two = step.join(loaded, ["question_id", "claim_id"]).select("question_id", "anchor", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("claims", F.array("claim_id")).alias("claims"), (F.col("bridged") | F.col("several")).alias("bridged"), F.col("b").alias("at"))

    ends = starts.groupBy("question_id", F.col("anchor").alias("target")).agg(F.collect_set("node").alias("ends"))  # fan_out at most
    inner = lambda nodes: F.slice(nodes, F.lit(2), F.size(nodes))  # noqa: E731  (all but the start)
    direct = one.join(ends, "question_id").where((F.col("anchor") < F.col("target")) & F.array_contains("ends", F.col("at")))
    direct = direct.select("question_id", F.col("anchor").alias("source"), "target", "claims", "bridged")
    meet = (F.col("at") == F.col("a")) & (F.col("anchor") < F.col("target")) & ~F.array_contains("nodes", F.col("end"))

    def met(front: DataFrame) -> DataFrame:
        pairs = front.join(back.withColumnRenamed("question_id", "asked"), (F.col("question_id") == F.col("asked")) & meet).drop("asked").join(ends, ["question_id", "target"])
        whole = pairs.where(~F.arrays_overlap(inner(F.col("nodes")), F.col("ends")))
        return whole.select("question_id", F.col("anchor").alias("source"), "target", F.concat("claims", F.array("last")).alias("claims"), (F.col("bridged") | F.col("last_several")).alias("bridged"))

    found = reduce(DataFrame.unionByName, [direct, met(one), met(two)])
    once = found.groupBy("question_id", "source", "target", "claims").agg(F.bool_or("bridged").alias("bridged")).withColumn("hops", F.size("claims"))
    order = Window.partitionBy("question_id").orderBy("hops", "source", "target", "claims")
    ranked = staged(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths + 1), "claim-paths")
    cuts = reduce(DataFrame.unionByName, [*by_node.cuts, *by_claim.cuts, ranked.where(F.col("rank") > paths).select("question_id", F.lit("path_limit").alias("reason"))])
    reasons = cuts.groupBy("question_id").agg(F.sort_array(F.collect_set("reason")).alias("truncated"))  # three at most
    shown = ranked.where(F.col("rank") <= paths).join(reasons, "question_id", "left")
    return shown.select("question_id", "source", "target", "hops", "claims", "bridged", "rank", F.coalesce("truncated", F.array().cast("array<string>")).alias("truncated"))
