"""Text functions as column expressions, so that they run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and word lists that results depend on.
MAX_TERMS = 6
SLUG_CAP = 128
TAG_CAP = 64
LABEL_CAP = 48
ENTITY_CAP = 256
MODALITY_TERMS = {"figure": ["figure", "image", "chart", "diagram", "photo"], "table": ["table", "spreadsheet", "column", "row"], "equation": ["equation", "formula"]}
FILE_BUCKETS = {
    "document": ["pdf", "doc", "docx", "odt", "rtf"],
    "slides": ["ppt", "pptx"],
    "sheet": ["xls", "xlsx", "csv"],
    "text": ["md", "txt", "html", "htm", "json"],
    "image": ["png", "jpg", "jpeg", "gif", "webp"],
    "mail": ["eml"],
}
#: Full-width forms by their rule: each lies 0xFEE0 above its plain character; the wide blank is on its own.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
PLAIN_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " "


def terms(text: Column) -> Column:
    """Lower-cased word tokens."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda t: t != "")


def query_terms(text: Column, most: int = MAX_TERMS) -> Column:
    """Distinct terms of a query in order: runs of two or more CJK characters or of word letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[一-鿿]{2,}|[a-z0-9_]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two term sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_tokens(text: Column) -> Column:
    """White-space tokens longer than one character, lower-cased, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) > 1))


def slug(text: Column) -> Column:
    """Full-width forms become plain ones; lower case; white space and underscores become hyphens; other marks go; capped."""
    plain = F.translate(text, FULL_WIDTH, PLAIN_WIDTH)
    dashed = F.regexp_replace(F.lower(F.trim(plain)), r"[\s_]+", "-")
    kept = F.regexp_replace(dashed, r"[^\p{L}\p{N}-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, "-{2,}", "-"), "^-|-$", ""), 1, SLUG_CAP)


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def strip_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tag(text: Column) -> Column:
    return F.substring(F.lower(F.trim(text)), 1, TAG_CAP)


def label(text: Column, cap: int = LABEL_CAP) -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap - 1), F.lit("…"))).otherwise(text)


def entity_name(text: Column) -> Column:
    squeezed = strip_space(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.length(squeezed) > 0) & (F.length(squeezed) <= ENTITY_CAP), squeezed)


def key_values(detail: Column) -> Column:
    """A map of the ``key=value`` words of a log line."""
    pairs = F.filter(F.split(detail, " "), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value"))))


def format_key_values(pairs: Column) -> Column:
    """``key=value`` words in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e.key, F.lit("="), e.value)), " ")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def file_bucket(name: Column) -> Column:
    ext = extension(name)
    return reduce(lambda rest, kv: F.when(ext.isin(kv[1]), kv[0]).otherwise(rest), reversed(FILE_BUCKETS.items()), F.lit("other"))


def modality(query: Column) -> Column:
    """The kind of content a query asks for, or null."""
    words = terms(query)
    return reduce(lambda rest, kv: F.when(F.arrays_overlap(words, F.array(*map(F.lit, kv[1]))), kv[0]).otherwise(rest), reversed(MODALITY_TERMS.items()), F.lit(None).cast("string"))


def text_quality(text: Column) -> Column:
    """Mean line length, share of unusual characters and share of letters, and a verdict."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.lit(1), F.length(text))
    letters = (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))) / n
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()-]", "")) / n
    mean = F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines)).otherwise(0.0)
    return F.struct(mean.alias("mean_line"), odd.alias("odd"), letters.alias("letters"), ((mean >= 4) & (odd <= 0.2) & (letters >= 0.4)).alias("good"))


def year_interval(text: Column) -> Column:
    """(first, last) of the years named in a text; nulls where it names none."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("first"), F.array_max(years).alias("last"))


def overlaps(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Closed intervals meet; an unknown interval meets everything."""
    return F.coalesce((a_first <= b_last) & (b_first <= a_last), F.lit(True))


def without_code(markdown: Column) -> Column:
    """Fenced blocks and inline code blanked out."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?(```|$)", " "), r"`[^`\n]*`", " ")


def wiki_links(markdown: Column) -> Column:
    """Targets of double-bracket links outside code, in order: ``file:ID`` or ``wiki:SLUG``."""
    raw = F.regexp_extract_all(without_code(markdown), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    target = F.transform(raw, lambda x: F.trim(F.when(F.contains(x, F.lit("|")), F.regexp_extract(x, r"\|([^|]*)$", 1)).otherwise(x)))
    typed = F.transform(
        target,
        lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("file:"), t)).when(t.rlike("^file:[0-9]+$"), t).when(t.rlike("^wiki:.+"), F.concat(F.lit("wiki:"), slug(F.substring(t, 6, 1000)))),
    )
    return F.filter(typed, lambda t: t.isNotNull())


def markdown_links(markdown: Column) -> Column:
    """Targets of links to Markdown files outside code, without fragments."""
    return F.regexp_extract_all(without_code(markdown), F.lit(r"\]\(([^()\s#]+\.md)(?:#[^()\s]*)?\)"), F.lit(1))


def unmatched_like(text: str) -> str:
    """A LIKE pattern that finds ``text`` itself anywhere, with wildcards escaped by a backslash."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def identity(*fields: Column) -> Column:
    """SHA-256 over fields joined by the unit separator, nulls as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def analysed(text: Column, analyzer: str = "simple") -> Column:
    """Search tokens: words (``simple``), or words and the pairs of neighbours in runs of CJK characters (``cjk``)."""
    if analyzer == "simple":
        return terms(text)
    runs = F.regexp_extract_all(F.lower(text), F.lit("[一-鿿]+|[a-z0-9_]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[一-鿿]{2,}$"), pairs(r)).otherwise(F.array(r))))


def renamed_slug(markdown: Column, old: str, new: str) -> Column:
    """Links to the page ``old`` lead to ``new``; their shown text stays, and so does code."""
    pieces = F.regexp_extract_all(markdown, F.lit(r"(?s)```.*?(?:```|$)|`[^`\n]*`|\[\[[^\[\]\n]+\]\]|[^`\[]+|[`\[]"), F.lit(0))
    page = lambda p: F.regexp_extract(p, r"^\[\[(?:[^\[\]|]*\|)?\s*wiki:([^\[\]|]+)\]\]$", 1)
    shown = lambda p: F.regexp_extract(p, r"^\[\[([^\[\]|]*\|)", 1)
    link = lambda p: p.startswith("[[") & (slug(page(p)) == old)
    return F.array_join(F.transform(pieces, lambda p: F.when(link(p), F.concat(F.lit("[["), shown(p), F.lit(f"wiki:{new}]]"))).otherwise(p)), "")
