"""Association of entities: anchors and constraints of a question, conflicts of claims, levels of paths."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.columns import let
from sparkloom.functions.text import overlaps

# Bounds and word lists that results depend on.
ANCHORS, ANCHOR_CHARS, FAN_OUT = 8, 64, 24
FUNCTIONAL = ("located_in", "based_in", "headquartered_in", "resides_in", "status", "employment_status", "state", "result")
PRESENCE = "哪年|年份|何时|when|year|date|期间|时间段|period|duration"
PROJECT = r"worked\s+on|参与.{0,8}项目|共同.{0,8}项目|哪个项目|which\s+project"
# The words by which a question is cut. Latin ones are matched at the start of a word.
LIST_MARKS = ("、", "，", ",")
JOINING_MARKS = ("和", "与", "跟")
JOINING_WORD = "and"
RELATION_MARKS = ("同事", "合作", "关联", "关系")
RELATION_WORDS = ("coworker", "collaborate", "collaboration", "related")
LEAD_INS = ("是不是", "是否", "有什么", "什么")
TIME_MARKS = ("哪年", "何时", "什么时候")
SENTENCE_MARKS = ("?", "？", "。", "！", "!")
VERBS = ("worked", "were", "was", "are", "is", "have", "had", "collaborat", "related", "cowork")
NOT_NAMES = ("什么关系", "是不是同事", "是否合作", "有什么关系")
#: Stand for a joining word or mark, and for a mark of a list, between tokens.
JOINT, NEXT = "\u0001", "\u0002"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def question_tokens(asked: Column) -> Column:
    """Words of a question; marks and the fixed words of scripts without spaces are tokens of their own, joining ones are ``JOINT``, those of a list ``NEXT``."""
    longest = sorted((*RELATION_MARKS, *LEAD_INS, *TIME_MARKS, *SENTENCE_MARKS), key=len, reverse=True)
    spaced = F.regexp_replace(asked, "|".join(re.escape(x) for x in longest) + "|(19|20)[0-9]{2} ?年", " $0 ")
    for marks, sign in ((JOINING_MARKS, JOINT), (LIST_MARKS, NEXT)):
        for mark in marks:
            spaced = F.replace(spaced, F.lit(mark), F.lit(f" {sign} "))
    words = F.filter(F.split(spaced, " "), lambda t: t != "")
    return F.transform(words, lambda t: F.when(F.lower(t) == JOINING_WORD, JOINT).otherwise(t))


def _starts(token: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(token).startswith(w) for w in words))


def _before(tokens: Column, stop: Callable[[Column, Column], Column]) -> Column:
    """The tokens before the first one for which ``stop(token, next)`` holds."""
    marked = F.transform(tokens, lambda t, k: stop(t, F.coalesce(F.get(tokens, k + 1), F.lit(""))))
    at = F.array_position(marked, F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(tokens, F.lit(1), at - 1)).otherwise(tokens)


def _names(tokens: Column) -> Column:
    """What stands between joints and marks of a list."""
    return F.filter(F.transform(F.split(F.array_join(tokens, " "), f"[{JOINT}{NEXT}]"), lambda p: F.trim(p)), lambda p: p != "")


def anchors(question: Column) -> Column:
    """The entities that a question is about, eight at most.

    In this order: both of "between A and B"; the members of a list before the word that asks
    for a relation or time; the two around the first joint; runs of Chinese characters.
    """
    none = F.array().cast("array<string>")
    asked = squeezed(question)
    ends = lambda t, _: t.isin(*SENTENCE_MARKS) | _starts(t, VERBS)
    together = lambda t, n: F.lower(t).isin("work", "worked", "working") & (F.lower(n) == "together")
    relation = lambda t, n: t.isin(*RELATION_MARKS) | (t.isin(*LEAD_INS) & n.isin(*RELATION_MARKS)) | _starts(t, RELATION_WORDS) | together(t, n)
    when = lambda t, _: t.isin(*TIME_MARKS) | t.rlike("^(19|20)[0-9]{2} ?年?$") & t.endswith("年")

    def pair(tokens: Column) -> Column:
        """The text up to the first joint, and from there to a verb or the sentence's end."""
        at = F.array_position(tokens, F.lit(JOINT)).cast("int")
        left, right = F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(tokens, at + 1, F.size(tokens))
        said = lambda ts: F.array_join(F.transform(ts, lambda t: F.when(t == JOINT, JOINING_WORD).when(t == NEXT, ",").otherwise(t)), " ")
        names = lambda r: F.array(said(left), said(F.concat(F.slice(r, 1, 1), let(F.slice(r, F.lit(2), F.size(r)), lambda rest: _before(rest, ends)))))
        return F.when(at > 1, F.filter(let(right, names), lambda p: p != "")).otherwise(none)

    def members(tokens: Column) -> Column:
        clause = let(tokens, lambda t: let(_before(t, relation), lambda c: _before(c, when)))
        named = F.transform(_names(F.filter(clause, lambda t: ~t.isin(*SENTENCE_MARKS))), lambda p: F.regexp_replace(p, " ?[在于]$", ""))
        fits = lambda n: (F.size(n) >= 2) & (F.size(n) <= ANCHORS) & ~F.exists(n, lambda p: F.length(p) > ANCHOR_CHARS)
        return let(F.filter(named, lambda p: p != ""), lambda n: F.when(fits(n), n).otherwise(none))

    def between(tokens: Column) -> Column:
        at = F.array_position(F.transform(tokens, lambda t: F.lower(t)), F.lit("between")).cast("int")
        return F.when(at > 0, pair(F.slice(tokens, at + 1, F.size(tokens)))).otherwise(none)

    runs = F.filter(F.regexp_extract_all(asked, F.lit("[\u4e00-\u9fff]{2,8}"), F.lit(0)), lambda r: ~r.isin(*NOT_NAMES))
    first = lambda *ways: reduce(lambda later, way: F.when(F.size(way) > 0, way).otherwise(later), reversed(ways))
    found = let(question_tokens(asked), lambda t: let(between(t), lambda b: F.when(F.size(b) == 2, b).otherwise(let(members(t), lambda m: first(m, pair(t), runs)))))
    return F.slice(F.array_distinct(found), 1, ANCHORS)


def constraints(question: Column) -> Column:
    """(first_year, last_year, wants_time, wants_project): years that a claim must overlap, else whether it must have a time at all."""
    asked = F.lower(squeezed(question))
    years = F.transform(F.filter(F.regexp_extract_all(asked, F.lit("[0-9]+"), F.lit(0)), lambda y: y.rlike("^(19|20)[0-9]{2}$")), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("first_year"), F.array_max(years).alias("last_year"), ((F.size(years) == 0) & asked.rlike(PRESENCE)).alias("wants_time"), asked.rlike(PROJECT).alias("wants_project"))


def conflicts(claims: DataFrame) -> DataFrame:
    """(claim_id, other_id, reason): what contradicts each of ``claims(claim_id, source, target, predicate, first, last, status)``.

    A claim meets the ``FAN_OUT`` first others of its source by id. Two contradict if, at
    times that may overlap, one denies the other, their exclusive states differ, or a
    predicate that allows one object has two.
    """
    base = F.regexp_replace("predicate", "^not_", "")
    mine = claims.withColumn("base", base)
    first = Window.partitionBy("source").orderBy("claim_id")
    near = mine.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FAN_OUT).select(*(F.col(c).alias(f"o_{c}") for c in ("claim_id", "source", "target", "predicate", "base", "first", "last", "status")))
    pairs = mine.join(near, (F.col("source") == F.col("o_source")) & (F.col("base") == F.col("o_base"))).where(F.col("claim_id") != F.col("o_claim_id"))
    same, meet = F.col("target") == F.col("o_target"), overlaps(F.col("first"), F.col("last"), F.col("o_first"), F.col("o_last"))
    equal = F.col("predicate") == F.col("o_predicate")
    reason = (
        F.when(same & ~equal & meet, "contradictory_predicate")
        .when(same & equal & meet & (F.col("status") != F.col("o_status")), "qualifier_conflict")
        .when(equal & F.col("predicate").isin(*FUNCTIONAL) & ~same & meet, "object_value_conflict")
    )
    return pairs.select("claim_id", F.col("o_claim_id").alias("other_id"), reason.alias("reason")).where("reason IS NOT NULL")


def path_levels(paths: DataFrame, claims: DataFrame, unresolved: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(path_id, n_claims, n_conflicts, level) of ``paths(path_id, claim_id)`` for a question about some years.

    In this order: conflicted, if a claim of the path has a conflict; insufficient, if none is
    known to touch the years; adjacent_only, if a node of it (of ``unresolved(node)``) is not
    identified, or it is a lone ``related_to``; else direct (one claim) or composed.
    """
    found = conflicts(claims)
    pairs = found.select(F.least("claim_id", "other_id").alias("a"), F.greatest("claim_id", "other_id").alias("b"), "claim_id")
    own = paths.join(pairs, "claim_id").groupBy("path_id").agg(F.count_distinct("a", "b").alias("n_conflicts"))
    edges = paths.join(claims, "claim_id")
    lost = unresolved.select("node").distinct()
    edges = edges.join(lost.select(F.col("node").alias("source"), F.lit(1).alias("lost_source")), "source", "left").join(lost.select(F.col("node").alias("target"), F.lit(1).alias("lost_target")), "target", "left")
    touches = F.col("first").isNotNull() & (F.col("first") <= last_year) & (F.col("last") >= first_year)
    path = edges.groupBy("path_id").agg(F.count("*").alias("n_claims"), F.bool_or(touches).alias("timely"), F.bool_or(F.col("lost_source").isNotNull() | F.col("lost_target").isNotNull()).alias("lost"), F.min("predicate").alias("predicate"))
    level = (
        F.when(F.col("n_conflicts") > 0, "conflicted")
        .when(~F.col("timely"), "insufficient")
        .when(F.col("lost") | ((F.col("n_claims") == 1) & (F.col("predicate") == "related_to")), "adjacent_only")
        .when(F.col("n_claims") == 1, "direct")
        .otherwise("composed")
    )
    return path.join(own, "path_id", "left").na.fill(0, ["n_conflicts"]).select("path_id", "n_claims", "n_conflicts", level.alias("level"))
