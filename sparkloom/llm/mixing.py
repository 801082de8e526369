"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The share of each source in all tokens is raised to an exponent and normalised. The
exponent is found by bisection: the largest that reaches the target entropy, raised where
needed until no source is repeated more often than the limit allows (the limit prevails).
Sources stay in a table; each bisection round evaluates a batch of exponents in one
aggregation, so nothing grows with the number of sources on the driver.

A source's budget is its weight times the budget. It is spent epoch by epoch, each in a
fresh permutation by hash, the last epoch cut where the budget ends. The running tokens of
a source, divided by the source's share of a block, give the block of each drawn document:
every block then holds all sources in their weights, and is read in the order of a second
hash. Without a budget the least one is taken that spends every document once, so nothing
is dropped and small sources repeat.

Running sums are taken in two steps: over buckets of the permutation (as many as keep a
bucket small), then within a bucket, so a source with a third of all rows is spread over
its buckets. Rows that are equal in id, source and text count as one in the sums, with their
number, so a row that a third of the table repeats is no hot bucket either. Whether a document is in the cut epoch depends on one cut-off per source.

Cases: a null or empty source is a source of its own, named ''. A null or blank text has no
tokens and is drawn like any other. Rows with equal doc_id, source and text are drawn alike.
Equal hashes at the cut-off stay out together. A source without tokens gets weight 0 and is
drawn once. An empty table gives an empty one. Extra columns are kept by ``mixed_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.columns import each_copy
from sparkloom.storage import staged

#: Exponents evaluated per aggregation: bisection steps are taken several at a time.
STEPS_AT_ONCE, ROUNDS = 4, 8
#: Rows in a bucket of a permutation, about.
BUCKET_ROWS = 1_000
HASH_BITS = 60


@dataclass(frozen=True)
class Target:
    """What the mixture must reach; entropy as a share of that of equal weights."""

    entropy: float = 0.95
    most_repeats: float = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 20
    seed: int = 17


def token_count(text: Column) -> Column:
    """Words of a text: the unit of budgets where no other is given."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("bigint")


def source_name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def order_hash(doc_id: Column, source: Column, digest: Column, epoch: Column, seed: int) -> Column:
    """60 bits that order a source's documents in an epoch; rows without an id differ by their text."""
    key = F.concat_ws(":", F.lit(seed), epoch.cast("string"), source, F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _bisect(shares: DataFrame, goal) -> float:
    """The largest exponent in [0, 1] at which ``goal`` (falling in the exponent) still holds.

    ``goal(z, e, low, high)`` gets sums over sources for one exponent a: z of p^a, e of
    p^a ln p, and the least and greatest share.
    """
    low, high, parts = 0.0, 1.0, 1 << STEPS_AT_ONCE
    for k in range(ROUNDS):
        tried = [low + (high - low) * i / parts for i in range(parts + 1)]
        cells = [c for a in tried for c in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]
        row = shares.agg(F.min("p"), F.max("p"), *cells).first()
        if row[0] is None:
            return 1.0
        good = [goal(row[2 + 2 * i], row[3 + 2 * i], row[0], row[1], a) for i, a in enumerate(tried)]
        if k == 0 and good[-1]:
            return 1.0
        last = max((i for i, g in enumerate(good) if g), default=-1)
        if last < 0:
            return low
        low, high = tried[last], tried[min(parts, last + 1)]
    return low


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for ``sources(tokens)``, to six decimals."""
    import math

    n, total = sources.where("tokens > 0").agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    enough = lambda z, e, low, high, a: math.log(z) - a * e / z >= target.entropy * math.log(n) - 1e-12
    repeats = lambda z, low, high, a: target.budget / total * low ** (a - 1) / z if target.budget else (high / low) ** (1 - a)
    too_often = lambda z, e, low, high, a: repeats(z, low, high, a) > target.most_repeats + 1e-12
    by_entropy = _bisect(shares, enough)
    by_limit = _bisect(shares, too_often)
    at_zero = shares.agg(F.sum(F.lit(1.0)), F.lit(0.0), F.min("p"), F.max("p")).first()
    limited = by_limit if too_often(*at_zero, 0.0) else 0.0
    return round(max(by_entropy, limited), 6)


def mixture(rows: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, rows, weight, goal, epochs, rest) by source, for ``rows(source, size, copies)``."""
    sources = staged(rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.sum("copies").alias("rows")), "sources")
    a = exponent(sources, target)
    total = F.broadcast(sources.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.sum(F.pow(F.col("tokens"), F.lit(a))).alias("z")))  # one row
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens"), F.lit(a)) / F.col("z"), 9)).otherwise(0.0)
    weighed = sources.join(total).select("source", "tokens", "rows", weight.alias("weight"), "total")
    if target.budget is None:
        cover = F.broadcast(weighed.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("budget")))  # one row
        goal = F.greatest("tokens", F.floor(F.round(F.col("weight") * F.col("budget"), 3)))
    else:
        cover = F.broadcast(weighed.agg(F.lit(float(target.budget)).alias("budget")))
        goal = F.floor(F.round(F.col("weight") * F.col("budget"), 3))
    planned = weighed.join(cover).withColumn("goal", F.when(F.col("tokens") > 0, goal).otherwise(0).cast("bigint"))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.greatest(F.lit(1), "tokens"))).otherwise(1).cast("bigint")
    return staged(planned.withColumn("epochs", epochs).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("tokens")), "mixture")


def _running(drawn: DataFrame, n_rows: int) -> DataFrame:
    """``drawn(source, epoch, h, size, ...)`` with ``before``: tokens of its source and epoch that come earlier."""
    bits = max(2, min(20, (max(1, n_rows) // BUCKET_ROWS).bit_length()))
    drawn = drawn.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    sums = drawn.groupBy("source", "epoch", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("h", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    within = drawn.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(starts, ["source", "epoch", "bucket"]).withColumn("before", F.col("start") + F.col("inside"))


def cut_offs(rows: DataFrame, plan: DataFrame, target: Target, n_rows: int) -> DataFrame:
    """The plan with ``cut``: documents of the last epoch whose hash is below it are drawn."""
    part = rows.join(plan.select("source", F.col("epochs").alias("epoch"), "rest"), "source").where("rest > 0")
    part = part.withColumn("h", order_hash(F.col("doc_id"), F.col("source"), F.col("digest"), F.col("epoch"), target.seed))
    over = _running(part, n_rows).where(F.col("before") + F.col("size") > F.col("rest"))
    cuts = over.groupBy("source").agg(F.min("h").alias("cut"))
    nothing = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(0)
    return staged(plan.join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", nothing)), "cuts")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, n_tokens, copies, size): rows that are equal in id, source and text as one."""
    slim = docs.select(docs["doc_id"].alias("doc_id"), source_name(docs["source"]).alias("source"), text_digest(docs["text"]).alias("digest"), token_count(docs["text"]).alias("n_tokens"))
    once = slim.groupBy("doc_id", "source", "digest", "n_tokens").agg(F.count("*").alias("copies"))
    return staged(once.withColumn("size", F.col("n_tokens") * F.col("copies")), "mixing-rows")


def _epochs(doc_id: Column, source: Column, digest: Column, seed: int) -> Column:
    """The epochs in which a document is drawn: all whole ones, and the last if below its cut-off."""
    in_last = order_hash(doc_id, source, digest, F.col("epochs"), seed) < F.col("cut")
    drawn = F.col("epochs") + F.when(in_last, 1).otherwise(0)
    return F.when(drawn > 0, F.sequence(F.lit(0).cast("bigint"), drawn - 1)).otherwise(F.array().cast("array<bigint>"))


def mix(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, place) of every draw; a block is read in the order of ``place``, a hash."""
    target = target or Target()
    rows = _rows(docs)
    n = rows.count()
    plan = cut_offs(rows, mixture(rows, target), target, n)
    drawn = rows.join(plan.select("source", "tokens", "weight", "epochs", "cut"), "source")
    drawn = drawn.withColumn("epoch", F.explode(_epochs(F.col("doc_id"), F.col("source"), F.col("digest"), target.seed)))
    drawn = drawn.withColumn("h", order_hash(F.col("doc_id"), F.col("source"), F.col("digest"), F.col("epoch"), target.seed))
    placed = each_copy(_running(drawn, n), "copies")
    share = F.greatest(F.lit(1.0), F.col("weight") * target.block_tokens)
    block = F.floor((F.col("epoch") * F.col("tokens") + F.col("before") + F.col("copy") * F.col("n_tokens")) / share)
    place = order_hash(F.col("doc_id"), F.col("source"), F.col("digest"), F.col("epoch"), target.seed + 1)
    return placed.select("doc_id", "source", "n_tokens", "weight", "epoch", block.alias("block"), place.alias("place"))


def mixed_documents(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn; texts meet the table of sources only."""
    target = target or Target()
    rows = _rows(docs)
    plan = cut_offs(rows, mixture(rows, target), target, rows.count()).select(F.col("source").alias("own"), "epochs", "cut")
    keyed = docs.select(F.struct("*").alias("doc"), docs["doc_id"].alias("id"), source_name(docs["source"]).alias("own"), text_digest(docs["text"]).alias("digest"))
    drawn = keyed.join(plan, "own").withColumn("epoch", F.explode(_epochs(F.col("id"), F.col("own"), F.col("digest"), target.seed)))
    return drawn.select("doc.*")


#: Near equal weights: the exponent is bisected, and small sources repeat, up to the limit.
QUERY = Target(entropy=0.99999, most_repeats=2.0, block_tokens=50_000)

ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row, coalesce(source, '') AS source, md5(coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS n_tokens FROM documents
),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT source, tokens / (sum(tokens) OVER ())::DOUBLE AS p, count(*) OVER () AS k FROM s WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN m ELSE lo END, CASE WHEN ok THEN hi ELSE m END FROM (
    SELECT i, lo, hi, m, (SELECT ln(sum(p ** m)) - m * sum(p ** m * ln(p)) / sum(p ** m) >= {QUERY.entropy} * ln(max(k)) - 1e-12 FROM p) AS ok
    FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 32))
),
e1 AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) >= {QUERY.entropy} * ln(max(k)) - 1e-12 FROM p) THEN 1.0 ELSE (SELECT lo FROM b WHERE i = 32) END AS a),
e2 AS (SELECT CASE WHEN max(p) / min(p) <= {QUERY.most_repeats} THEN 0.0 ELSE 1 - ln({QUERY.most_repeats}) / ln(max(p) / min(p)) END AS a FROM p),
a AS (SELECT round(greatest(e1.a, e2.a), 6) AS a FROM e1, e2),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(tokens ** a / (SELECT sum(tokens ** a) FROM s, a WHERE tokens > 0), 9) ELSE 0.0 END AS weight FROM s, a),
g AS (SELECT *, CASE WHEN tokens > 0 THEN greatest(tokens, floor(round(weight * (SELECT max(tokens / weight) FROM w WHERE weight > 0), 3)))::BIGINT ELSE 0 END AS goal FROM w),
m AS (SELECT source, tokens, weight, epochs, goal - epochs * tokens AS rest FROM (SELECT *, CASE WHEN tokens > 0 THEN goal // tokens ELSE 1 END AS epochs FROM g)),
x AS (SELECT d.*, m.tokens, weight, epochs, rest, unnest(generate_series(0, epochs)) AS epoch FROM d JOIN m USING (source)),
h AS (SELECT *, ('0x' || substr(md5('{QUERY.seed}:' || epoch || ':' || source || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 15))::BIGINT AS h FROM x),
r AS (SELECT *, (coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, digest, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS prior FROM h),
c AS (SELECT source, min(h) AS cut FROM r WHERE epoch = epochs AND prior + n_tokens > rest GROUP BY source)
SELECT doc_id, source, n_tokens, weight, epoch, floor((epoch * tokens + prior) / greatest(1.0, weight * {QUERY.block_tokens}))::BIGINT AS block,
  ('0x' || substr(md5('{QUERY.seed + 1}:' || epoch || ':' || source || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 15))::BIGINT AS place
FROM r LEFT JOIN c USING (source)
WHERE epoch < epochs OR (rest > 0 AND h < coalesce(cut, 9223372036854775807))
"""
