"""How filters interact: every order of the filters is replayed over every document.

Each document has a set of failing filters (a number of bits), a part and two labels. These
rows are crossed with the broadcast orders (120 for five filters, a table that doesn't grow),
the first failing step of each order is found, the steps are exploded, and conditional sums
are grouped by part, order and step. Sums are combined on the map side: a task sends a row
for each part, order and step, however many documents it has, so a hot part costs no task
more than others. What a filter removes, summed over all orders, is its Shapley count.

That a text is the same as an earlier one is found by ``exact_dedup`` over the whole table;
texts are not moved but for the comparison of bytes there.

Cases: a null text counts as empty, a null part as the empty string. A null doc_id has no
smaller one and no labels. Labels that repeat a doc_id count if any of them says so.
Repeated rows count each; a row equal in id and text to another is no later copy. An empty
table gives an empty one. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.columns import let
from sparkloom.llm.exact_dedup import equal_texts

SPACES = " \t\n\x0b\x0c\r"


def replay(flags: DataFrame, filters: str) -> DataFrame:
    """Counts by part, order and step of ``flags(part, failed, good, toxic)``.

    Bit k of ``failed`` is set where the filter named by letter k of ``filters`` fails.
    """
    spark = flags.sparkSession
    steps = range(len(filters))
    orders = [("".join(filters[k] for k in p), *(1 << k for k in p)) for p in permutations(steps)]
    table = spark.createDataFrame(orders, "filter_order string, " + ", ".join(f"bit{k} int" for k in steps))
    fails = lambda k: F.col("failed").bitwiseAND(F.col(f"bit{k}")) != 0
    first = reduce(lambda later, k: F.when(fails(k), k + 1).otherwise(later), reversed(steps), F.lit(len(filters) + 1))
    crossed = flags.crossJoin(F.broadcast(table)).select("part", "filter_order", "failed", "good", "toxic", first.alias("first"), F.array(*(F.col(f"bit{k}") for k in steps)).alias("bits"))
    rows = crossed.select("part", "filter_order", "failed", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    number = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    here, before = F.col("first") == F.col("step"), F.col("first") < F.col("step")
    counts = rows.groupBy("part", "filter_order", "step").agg(
        number(F.col("first") > F.col("step")).alias("kept"),
        number(here).alias("removed"),
        number(before & (F.col("failed").bitwiseAND(F.col("bit")) != 0)).alias("redundant"),
        number(F.col("failed") == F.col("bit")).alias("unique_fails"),
        number(here & F.col("good")).alias("good_lost"),
        number(here & F.col("toxic")).alias("toxic_lost"),
    )
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # as many rows as steps and orders
    return counts.withColumn("shapley", F.sum("removed").over(same))


def text_flags(text: Column) -> Column:
    """Bits A to D of a text: few words, repetitive words, capitals, symbols."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    by_words = let(words, lambda w: bit(F.size(w) < 200, 0) + bit(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 1))
    return by_words + bit(100 * capitals.cast("long") > 3 * F.length(body), 2) + bit(body.rlike(r"[#$%&*|]"), 3)


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic) of every document; bit E is set where a smaller doc_id has the same text."""
    rows = docs.select(docs["doc_id"], docs["text"], docs["lang"])
    seen = equal_texts(rows, carry=lambda text: [text_flags(text).alias("bits"), F.coalesce(rows["lang"].cast("string"), F.lit("")).alias("part")])
    later = F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False))
    flags = seen.select("doc_id", "part", (F.col("bits") + F.when(later, 16).otherwise(0)).alias("failed"))
    said = lambda c: F.coalesce(F.max(F.coalesce(labels[c] == 1, F.lit(False))), F.lit(False)).alias(c)
    known = labels.groupBy(labels["doc_id"].alias("label_id")).agg(said("quality"), said("toxic"))
    met = flags.join(known, F.col("doc_id") == F.col("label_id"), "left")
    return met.select("part", "failed", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters ABCDE and step."""
    return replay(document_flags(docs, labels), "ABCDE")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents
),
f AS (
  SELECT d.part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS s,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
),
g AS (
  SELECT part, [a, b, c, s, e] AS fails, (a::INT + b::INT + c::INT + s::INT + e::INT) AS n_fails, good, toxic, count(*) AS n FROM f GROUP BY ALL
),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [p.i, q.i, r.i, s.i, t.i] AS p, 'ABCDE'[p.i] || 'ABCDE'[q.i] || 'ABCDE'[r.i] || 'ABCDE'[s.i] || 'ABCDE'[t.i] AS filter_order
  FROM k p, k q, k r, k s, k t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5
),
x AS (
  SELECT part, filter_order, step.i::INT AS step, p[step.i] AS filter, fails[p[step.i]] AS here, n_fails, good, toxic, n,
    len(list_filter(p[1 : step.i - 1], lambda y: fails[y])) AS earlier
  FROM g, o, k step
),
c AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT here AND earlier = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (here AND earlier = 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (here AND earlier = 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM c
"""
