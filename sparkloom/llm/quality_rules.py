"""Line-first cleaning with DataFrame functions only.

Each line is judged by four rules; a line of more than ``LONG_LINE`` characters is judged by
its sentences, so that a phrase costs a document on one line no more than its sentence.

* punctuation: marks glued to words, or shouted exclamations;
* navigation: separators between few words each, or a line that is a menu label;
* boilerplate: a phrase that sites repeat, in a line or sentence short enough to be one;
* ending: fewer than ``SHORT_LINE`` words and no mark at the end.

What fails is removed, and a document that loses too large a share of its characters is
rejected. Document-level measures (symbols, repeated lines, repeated 8-word windows)
come from the same pass. A row's result depends on that row alone, so skew in any key does
not matter and an executor's loss costs only its own tasks. The measures are one expression
in which every array is bound once: a filter on a measure, which the optimizer pushes below
the projection, computes it once more and not once for each use.

Cases: a null or blank text has no words and no lines, fails the base rule and is not
kept. Repeated rows get equal results. A line is compared with earlier lines exactly,
white space included. Windows are compared by a 64-bit hash of their words, so two
different windows of one text count as equal with odds near n^2 / 2^65.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.columns import free_name, let

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Characters of a line that is judged by its sentences, and of the longest unit that is boilerplate.
LONG_LINE = 300
#: Words, below which a line needs a mark at its end, and the most words to a separator of a menu.
SHORT_LINE, MENU_WORDS = 5, 6
SENTENCE = r"([.!?…]) +"
ENDED = r"[.!?…:;,][\"')\]»”]*[ \t\r]*$"
#: A line that is mostly decoration: marks glued to words, or shouted exclamations.
PUNCTUATION = r"([#*$%&]{2,}[^#*$%&]*){3}|(!!.*){2}"
#: A line of menu entries: separators between short labels, or a trail of links.
NAVIGATION = r"(?i)(\|[^|]*){3}|( [>»] [^>»]*){2}|^ *(home|menu|login|sign in|sign up|next|previous|back to top|skip to content)[ .!|]*$"
#: Phrases that sites repeat under every text.
BOILERPLATE = r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|enable javascript|subscribe to our|lorem ipsum|click here|follow us on|share this (article|page|post)|leave a (comment|reply)|terms and conditions|powered by wordpress|javascript is (disabled|required)|sign up for our newsletter|licensed under the|this work is licensed|alle rechte vorbehalten|tous droits r.serv.s|todos los derechos reservados"
#: Strings of which a text has one if a line of it can match; phrases in lower case.
PUNCTUATION_HINTS = ("##", "**", "$$", "%%", "&&", "#*", "*#", "!!", "#$", "$#", "#%", "%#", "#&", "&#", "*$", "$*", "*%", "%*", "*&", "&*", "$%", "%$", "$&", "&$", "%&", "&%")
NAVIGATION_HINTS = ("|", " > ", " » ", "home", "menu", "login", "sign in", "sign up", "next", "previous", "back to top", "skip to content")
BOILERPLATE_HINTS = ("all rights reserved", "terms of ", "privacy policy", "cookie ", "enable javascript", "subscribe to our", "lorem ipsum", "click here", "follow us on", "share this ", "leave a ", "terms and conditions", "powered by wordpress", "javascript is ", "sign up for our newsletter", "licensed under the", "this work is licensed", "alle rechte vorbehalten", "tous droits r", "todos los derechos reservados")


@dataclass(frozen=True)
class LineRules:
    """Patterns by rule, and the share of word characters that a kept document keeps at least."""

    punctuation: str = PUNCTUATION
    navigation: str = NAVIGATION
    boilerplate: str = BOILERPLATE
    least_share: float = 0.5
    least_words: int = 20
    most_repeated_percent: int = 30


def repeat_spans(keys: Column, window: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more; ``keys`` has a hash for each window."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, k: F.when(k == 0, window).otherwise(F.least(F.lit(window), s - F.get(starts, k - 1))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def starts(ranked: Column) -> Column:
        twin = lambda e, k: F.coalesce(e.key == F.get(ranked, k - 1).key, F.lit(False)) | F.coalesce(e.key == F.get(ranked, k + 1).key, F.lit(False))
        return F.sort_array(F.transform(F.filter(ranked, twin), lambda e: e.at))

    ranked = F.sort_array(F.transform(keys, lambda key, k: F.struct(key.alias("key"), k.alias("at"))))
    return let(ranked, lambda r: let(starts(r), covered))


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in ``words``, a bound array."""
    doubled = lambda h, step: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
    windows = lambda h: F.slice(doubled(h, 4), F.lit(1), F.size(h) - (WINDOW - 1))
    spans = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), repeat_spans(w)).otherwise(0)
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: let(windows(h4), spans))))
    return F.when(F.size(words) > WINDOW, hashed).otherwise(0).cast("long")


def unit_rule(unit: Column, hints: Column, rules: LineRules) -> Column:
    """The first rule that a line or sentence breaks: 1 punctuation, 2 navigation, 3 boilerplate, 4 ending; else 0."""
    n_words = F.size(F.split(F.btrim(unit, F.lit(SPACES)), SPACE_RUN))
    menu = unit.rlike(rules.navigation) & (n_words <= MENU_WORDS * F.greatest(F.lit(1), F.length(unit) - F.length(F.translate(unit, "|>»", ""))))
    return (
        F.when(hints.punctuation & unit.rlike(rules.punctuation), 1)
        .when(hints.navigation & menu, 2)
        .when(hints.boilerplate & (F.length(unit) <= LONG_LINE) & unit.rlike(rules.boilerplate), 3)
        .when(~unit.rlike(ENDED) & (n_words < SHORT_LINE), 4)
        .otherwise(0)
    )


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def _judged(lines: Column, hints: Column, rules: LineRules) -> Column:
    """For each line its clean text and the rules that its units broke."""

    def line(units: Column) -> Column:
        found = F.transform(units, lambda u: F.struct(u.alias("text"), unit_rule(u, hints, rules).alias("rule")))
        return let(found, lambda f: F.struct(F.array_join(F.transform(F.filter(f, lambda u: u.rule == 0), lambda u: u.text), " ").alias("clean"), F.transform(F.filter(f, lambda u: u.rule > 0), lambda u: u.rule).alias("broken")))

    units = lambda t: F.when(F.length(t) > LONG_LINE, F.filter(F.split(F.regexp_replace(t, SENTENCE, "$1\n"), "\n"), lambda u: F.btrim(u, F.lit(SPACES)) != "")).otherwise(F.array(t))
    return F.transform(lines, lambda t: let(units(t), line))


def measures(text: Column, rules: LineRules) -> Column:
    """All measures of a text as one struct."""
    hints = lambda body, lower: F.struct(any_of(body, PUNCTUATION_HINTS).alias("punctuation"), any_of(lower, NAVIGATION_HINTS).alias("navigation"), any_of(lower, BOILERPLATE_HINTS).alias("boilerplate"))
    broken = lambda judged: F.flatten(F.transform(judged, lambda j: j.broken))
    count = lambda b, rule: F.size(F.filter(b, lambda x: x == rule)).cast("long")
    clean = lambda judged: F.array_join(F.filter(F.transform(judged, lambda j: j.clean), lambda c: c != ""), "\n")

    def counts(body: Column, words: Column, lines: Column, judged: Column) -> Column:
        fields = lambda b, cleaned, word_chars, repeated: {
            "n_words": F.size(words).cast("long"),
            "word_chars": word_chars,
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated,
            "base_failed": (F.size(words) < rules.least_words) | (100 * repeated > rules.most_repeated_percent * F.size(words)),
            "punctuation_lines": count(b, 1),
            "navigation_lines": count(b, 2),
            "boilerplate_lines": count(b, 3),
            "short_lines": count(b, 4),
            "good_chars": F.when(F.size(b) > 0, F.length(F.translate(cleaned, SPACES, "")).cast("long")).otherwise(word_chars),
            "clean_text": cleaned,
        }
        as_struct = lambda named: F.struct(*(c.alias(k) for k, c in named.items()))
        joined = F.length(F.array_join(words, "")).cast("long")
        return let(broken(judged), lambda b: let(clean(judged), lambda c: let(joined, lambda n: let(repeated_words(words), lambda r: as_struct(fields(b, c, n, r))))))

    def of_body(body: Column) -> Column:
        words = let(F.btrim(body, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))
        lines = F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        return let(words, lambda w: let(lines, lambda ls: let(let(F.lower(body), lambda low: hints(body, low)), lambda h: let(_judged(ls, h, rules), lambda j: counts(body, w, ls, j)))))

    def verdict(m: Column) -> Column:
        kept = ~m.base_failed & (m.good_chars >= rules.least_share * m.word_chars)
        return F.struct(*(m[f].alias(f) for f in FIELDS[:6]), kept.alias("kept"), *(m[f].alias(f) for f in FIELDS[6:]))

    return let(let(F.coalesce(text.cast("string"), F.lit("")), of_body), verdict)


#: The measures in their order, without the verdict, which follows ``base_failed``.
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "punctuation_lines", "navigation_lines", "boilerplate_lines", "short_lines", "good_chars", "clean_text"]


def judge_lines(df: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """``df`` with a struct column ``quality`` (underscores are added while the name is taken): measures, cleaned text, verdict."""
    return df.withColumn(free_name(df, "quality"), measures(df[text], rules or LineRules()))


def quality_rules(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """One row per document: its measures, what each rule removed and the verdict."""
    fields = [*FIELDS[:6], "kept", *FIELDS[6:-1]]
    slim = docs.select(docs["doc_id"], docs["text"])
    return judge_lines(slim, rules=rules).select("doc_id", *(f"quality.{f}" for f in fields))


ORACLE = rf"""
WITH base AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, text, doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS w FROM base),
wins AS (
  SELECT rid, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM words)
),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, generate_series(0, {WINDOW - 1}) AS g(o) GROUP BY rid),
whole AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^ \t-\r]')),
units AS (
  SELECT rid, unnest(CASE WHEN length(line) > {LONG_LINE} THEN string_split(regexp_replace(line, '{SENTENCE}', '\1' || chr(10), 'g'), chr(10)) ELSE [line] END) AS unit FROM whole
),
judged AS (
  SELECT rid, length(regexp_replace(unit, '[ \t-\r]+', '', 'g')) AS chars,
    CASE WHEN regexp_matches(unit, '{PUNCTUATION}') THEN 1
         WHEN regexp_matches(unit, '{NAVIGATION}') AND len(w) <= {MENU_WORDS} * greatest(1, length(unit) - length(translate(unit, '|>»', ''))) THEN 2
         WHEN length(unit) <= {LONG_LINE} AND regexp_matches(unit, '{BOILERPLATE}') THEN 3
         WHEN NOT regexp_matches(unit, '{ENDED.replace("'", "''")}') AND len(w) < {SHORT_LINE} THEN 4 ELSE 0 END AS rule
  FROM (SELECT *, regexp_extract_all(unit, '[^ \t-\r]+') AS w FROM units) WHERE len(w) > 0
),
by_unit AS (
  SELECT rid, count(*) FILTER (rule = 1) AS p, count(*) FILTER (rule = 2) AS n, count(*) FILTER (rule = 3) AS b, count(*) FILTER (rule = 4) AS e,
    coalesce(sum(chars) FILTER (rule = 0), 0)::BIGINT AS good
  FROM judged GROUP BY rid
),
by_line AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM whole GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(p, 0)::BIGINT AS punctuation_lines, coalesce(by_unit.n, 0)::BIGINT AS navigation_lines, coalesce(b, 0)::BIGINT AS boilerplate_lines, coalesce(e, 0)::BIGINT AS short_lines,
    coalesce(good, 0)::BIGINT AS good_chars
  FROM words LEFT JOIN by_line USING (rid) LEFT JOIN by_unit USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND good_chars >= 0.5 * word_chars AS kept,
  punctuation_lines, navigation_lines, boilerplate_lines, short_lines, good_chars
FROM m
"""
