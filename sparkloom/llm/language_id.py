"""Language identification by Bayesian fusion of independent evidence.

For each text and each language l the posterior is proportional to

    P(text | l)^t * P(declared | l) * P(l | host)

and to ``NOISE`` * P(text | equally likely trigrams)^t for no language at all.

* text: hashed trigrams of letters over the whole text; a table fitted on a sample (about
  ``TRAIN_DOCS`` documents of each declared language, all where there are fewer, picked by
  hash); t tempers the product,
  whose factors are not independent, so that a long text counts as ``FULL`` trigrams.
* declared: the language that mark-up or metadata states, weighed by how far the statements
  of that value agree with the text evidence over the whole corpus.
* host: priors smoothed along the hierarchy corpus > address suffix > host, each level drawn
  to the one above with ``KAPPA`` pseudo-documents. They come from grouped sums of the text
  posteriors of all documents; sums are combined on the map side, so a host with a third
  of all rows is a row per task before the shuffle.

A declared code of two or three letters (what follows, as in ``en-GB``, is left out) is a
language if at least ``LEAST_DOCS`` texts with letters declare it and the sample of them has
``LEAST_TRIGRAMS`` trigrams; other values declare nothing, so a stray or invented code changes no result. The
model has ``SLOTS`` numbers for each language (64 KB in a worker) and each row a posterior of as
many numbers as there are languages: at most ``MOST_LANGUAGES``, those with most texts. The
smoothing of a language with little text is scaled down with it: what it has not seen stays less
likely in it than in no language, so it can't take in noise. A declaration helps to fit the table and is evidence too, but its weight as evidence is the
agreement of all texts that make it, so a wrong one yields to a clear text.

A document is rejected when it has no letters to go by or no language reaches ``least``: two
languages are in balance, or its letters are as likely in no language, as in keys and noise.

Cases: a null text has no letters and is rejected; a null host or declaration is a value of
its own that is pooled like others, and says nothing when declarations are null. Repeated
rows get equal results. Without any declared language there are no languages and every row
is rejected. Extra columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.columns import let
from sparkloom.storage import TEXT_BATCH_ROWS, small_batches, staged

#: Documents of each language that the trigram table is fitted on, about.
TRAIN_DOCS = 10_000
#: What a declared code needs to be a language, and how many languages a worker holds: 64 MB.
LEAST_DOCS, LEAST_TRIGRAMS, MOST_LANGUAGES = 5, 200, 1024
#: Trigrams from which on a language is smoothed in full, by half a trigram a slot.
SMOOTH_TRIGRAMS = 50_000
SLOTS = 1 << 14
#: Trigrams of a text that are numbers at once, and trigrams that are counted at once.
PIECE, HELD = 1 << 14, 1 << 19
FULL, TEMPER = 300, 0.2
KAPPA = 20.0
#: Prior probability that a text is in no language.
NOISE = 0.01
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigram_pieces(text: str | None) -> Iterator[np.ndarray]:
    """Slots of the trigrams of a text, at most ``PIECE`` at once: letters in lower case, runs of all else as one space."""
    data = b" ".join((text or "").lower().encode().translate(LETTERS).split())
    whole = np.frombuffer(b" " + data + b" " if data else b"", np.uint8)
    for at in range(0, len(whole) - 2, PIECE):
        b = whole[at : at + PIECE + 2].astype(np.int64)
        yield (b[:-2] * 0x9E3B + b[1:-1] * 0x85EB + b[2:] * 0xC2B3 + (b[:-2] * b[1:-1] * b[2:] >> 3)) & (SLOTS - 1)


def trigrams(text: str | None) -> np.ndarray:
    """All slots of ``trigram_pieces``."""
    return np.concatenate([np.empty(0, np.int64), *trigram_pieces(text)])


def counted(texts: Iterable[tuple[int, str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cell, n) of texts (language, text), from at most about twice ``HELD`` trigrams at once."""
    held: list[np.ndarray] = []
    size = 0
    for k, text in texts:
        for slots in trigram_pieces(text):
            held.append(k * SLOTS + slots)
            size += len(slots)
            if size >= HELD:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), return_counts=True)


def text_model(df: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """The languages, and the log-likelihood of each slot in each of them."""
    lettered = F.col(text).rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")
    shown = df.where((F.col(label) != "") & lettered)
    counts = shown.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    sizes = {r[0]: r.n for r in counts.orderBy(F.desc("n"), label).limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, SLOTS), np.float32)
    shares = [(l, k, int(min(1.0, TRAIN_DOCS / sizes[l]) * 1_000_000) + 1) for k, l in enumerate(languages)]
    declared = staged(df.sparkSession.createDataFrame(shares, f"`{label}` string, k int, share int"), "declared")
    sample = shown.join(declared, label).where(F.pmod(F.xxhash64(text, label), F.lit(1_000_000)) < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            if b.num_rows:
                for cell, n in counted(zip(b.column(1).to_pylist(), b.column(0).to_pylist())):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    cells = sample.select(text, "k").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = staged(cells, "trigrams", TEXT_BATCH_ROWS)  # else thousands of texts would be one batch, in the JVM and in the worker
    table = np.zeros((len(languages), SLOTS), np.float32)
    for r in cells.toLocalIterator():  # SLOTS rows a language at most
        table.reshape(-1)[r.cell] += r.n
    total = table.sum(axis=1, dtype=np.float64)
    known = total >= LEAST_TRIGRAMS
    table, total = table[known], total[known][:, None]
    table += (0.5 * np.minimum(1.0, total / SMOOTH_TRIGRAMS)).astype(np.float32)
    table /= table.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
    return [l for l, k in zip(languages, known) if k], np.log(table, out=table)


def _softmax(logs: Column) -> Column:
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    powers = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(logs, lambda v: let(powers(v), lambda w: let(total(w), lambda t: F.transform(w, lambda p: p / t))))


def _smoothed(sums: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
    """Sums ``s`` of each group and language ``i``, drawn to the prior ``p`` of the group above it."""
    group = [c for c in sums.columns if c not in ("i", "s")]
    totals = sums.groupBy(*group).agg(F.sum("s").alias("total"))
    prior = (F.col("s") + KAPPA * F.col("p")) / (F.col("total") + KAPPA)
    return sums.join(totals, group).join(above, [*on, "i"]).select(*group, "i", prior.alias("p"))


def _in_order(x: Column) -> Column:
    """The values of ``x`` by language, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("i", x.alias("x")))), lambda e: e.x)


def identify(df: DataFrame, text: Column, declared: Column, host: Column, keys: list[Column], least: float = 0.5) -> DataFrame:
    """``keys`` (named columns) of each row, language, confidence, accepted and text_language."""
    spark = df.sparkSession
    names = [f"key{k}" for k in range(len(keys))]
    lowered = F.lower(F.coalesce(host, F.lit("")))
    slim = df.select(
        *(c.alias(n) for c, n in zip(keys, names)),
        text.cast("string").alias("text"),
        F.lower(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)).alias("declared"),
        lowered.alias("host"),
        F.regexp_extract(lowered, r"\.([^.:]+)(:\d+)?$", 1).alias("suffix"),
    )
    languages, table = text_model(slim, "text", "declared")
    if not languages:
        none = F.lit(None).cast("string")
        return slim.select(*names, none.alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), none.alias("text_language"))
    slim = slim.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(""))
    held, at = spark.sparkContext.broadcast(table.T.copy()), slim.columns.index("text")

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for b in small_batches(batches):
            out, n = [], []
            for t in b.column(at).to_pylist():
                sums, length = np.zeros(logs.shape[1]), 0
                for slots in trigram_pieces(t):
                    length += len(slots)
                    sums += logs[slots].sum(axis=0, dtype=np.float64)
                n.append(length)
                sums = np.append(sums, -length * np.log(SLOTS)) * TEMPER * min(1.0, FULL / max(1, length))
                out.append((sums - sums[:-1].max()).tolist())
            kept = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=[*(x for x in b.schema.names if x != "text"), "n", "logs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text") + ", n bigint, logs array<double>"
    scored = staged(slim.mapInArrow(likelihood, schema), "likelihood", TEXT_BATCH_ROWS)
    k = len(languages)
    none = F.lit(float(np.log(NOISE)))  # the last of all logs stands for no language
    zeros = lambda last: F.concat(F.array_repeat(F.lit(0.0), k), F.array(last))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    spoken = lambda p: F.slice(p, 1, k)
    shares = scored.where("n > 0").withColumn("p", _softmax(plus(F.col("logs"), zeros(none))))
    each = shares.select("suffix", "host", "declared", F.posexplode(spoken(F.col("p"))).alias("i", "p"))
    cells = staged(each.groupBy("suffix", "host", "declared", "i").agg(F.sum("p").alias("s")), "host-sums")
    added = lambda *by: cells.groupBy(*by, "i").agg(F.sum("s").alias("s"))
    whole = staged(added(), "whole-sums")  # a row a language
    total = F.broadcast(whole.agg(F.sum("s").alias("total")))  # one row
    prior = whole.join(total).select("i", ((F.col("s") + 1.0) / (F.col("total") + k)).alias("p"))
    by_suffix = _smoothed(added("suffix"), prior, [])
    by_host = _smoothed(added("suffix", "host"), by_suffix, ["suffix"]).groupBy("suffix", "host").agg(_in_order(F.log("p")).alias("host_logs"))
    stated = added("declared").where("declared <> ''").join(whole.withColumnRenamed("s", "w"), "i")
    by_statement = stated.groupBy("declared").agg(_in_order(F.log((F.col("s") + 0.5) / (F.col("w") + 1.0))).alias("said_logs"))
    fused = scored.join(staged(by_host, "host-priors"), ["suffix", "host"], "left").join(staged(by_statement, "statements"), "declared", "left")
    host_logs = F.coalesce(F.concat("host_logs", F.array(none)), zeros(none))
    said_logs = F.coalesce(F.concat("said_logs", F.array(F.lit(0.0))), zeros(F.lit(0.0)))
    fused = fused.withColumn("posterior", spoken(_softmax(plus(plus(F.col("logs"), host_logs), said_logs))))
    tags = F.array(*(F.lit(x) for x in languages))
    pick = lambda a: F.when(F.col("n") > 0, F.get(tags, (F.array_position(a, F.array_max(a)) - 1).cast("int")))
    best = F.round(F.when(F.col("n") > 0, F.array_max("posterior")).otherwise(0.0), 6)
    return fused.select(*names, pick(F.col("posterior")).alias("language"), best.alias("confidence"), (best >= least).alias("accepted"), pick(spoken(F.col("logs"))).alias("text_language"))


def document_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, language, confidence, accepted, text_language); ``lang`` is the declaration and ``source`` the host."""
    found = identify(docs, docs["text"], docs["lang"], docs["source"], [docs["doc_id"]], least)
    return found.withColumnRenamed("key0", "doc_id")


def page_evidence(pages: DataFrame) -> tuple[Column, Column, Column]:
    """Text, declaration and host of (url, html): the ``lang`` of the mark-up is the declaration, the host is the address's."""
    html = pages["html"]
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    declared = F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return text, declared, F.regexp_extract(pages["url"], r"://([^/?#]*)", 1)


def page_languages(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """What ``document_languages`` gives, of (page_id, url, html)."""
    return identify(pages, *page_evidence(pages), [pages["page_id"]], least).withColumnRenamed("key0", "page_id")


def corpus_languages(docs: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, page_id, language, ...) of every document and every page, one of the ids null: one model and one set of priors for both."""
    none = F.lit(None).cast("bigint")
    text, declared, host = page_evidence(pages)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), none.alias("page_id"), docs["text"].alias("text"), docs["lang"].alias("declared"), docs["source"].alias("host"))
    rows = rows.unionByName(pages.select(none.alias("doc_id"), pages["page_id"].cast("bigint").alias("page_id"), text.alias("text"), declared.alias("declared"), host.alias("host")))
    found = identify(rows, rows["text"], rows["declared"], rows["host"], [rows["doc_id"], rows["page_id"]], least)
    return found.withColumnsRenamed({"key0": "doc_id", "key1": "page_id"})


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is accepted; only the keys of rejected rows meet them in a join."""
    found = identify(docs, docs["text"], docs["lang"], docs["source"], [docs["doc_id"], F.xxhash64(docs["text"], docs["lang"], docs["source"])], least)
    rejected = staged(found.where("NOT accepted").select("key0", "key1").distinct(), "rejected")
    same = docs["doc_id"].eqNullSafe(rejected["key0"]) & (F.xxhash64(docs["text"], docs["lang"], docs["source"]) == rejected["key1"])
    return docs.join(rejected, same, "left_anti")
