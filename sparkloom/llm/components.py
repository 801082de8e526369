"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins and two partial aggregations, so a hub with a third of all edges
is pre-aggregated before the shuffle and its join side can be split by adaptive execution.
Nothing is collected but a row count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (``a`` > ``b`` in every edge) and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots themselves.

    ``root`` is the least node of the component. Null ends and loops are ignored; an
    empty table gives an empty one.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = staged(links, label), None
    while True:
        n, check = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, check) == before or n == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, check)
        links = staged(_small_star(_large_star(links).distinct()).distinct(), label)
