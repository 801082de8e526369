"""Exact token counts without token ids: pieces are counted once per distinct pre-token.

Each text is cut once into the frequencies of its pre-tokens. The pieces of each distinct
pre-token are counted once, by the library's model, in parallel; these counts are joined to
the frequencies and summed per document.

The join is split by frequency. Pre-tokens that are frequent in a bounded sample of texts
(``SAMPLE_DOCS``, picked by a hash of the doc_id) form a dictionary of at most ``HEAD``
entries, a few MB, which is broadcast; that takes the hot keys out of the shuffle. In it a
pre-token of more than ``HEAD_BYTES`` bytes, such as a ruler line, stands under its digest. Whatever the dictionary lacks, frequent or not, goes through a
distinct and a join by shuffle, so the sample affects the cost and never a count, and the
vocabulary may grow without bound.

Pre-tokens are cut with the pattern of the byte-level scheme where a text has only
characters whose classes all Unicode versions share, and by the library itself elsewhere.

Cases: a null text counts as empty: no bytes, no tokens. Special strings inside a text are
one token each, as the library has it by default. Repeated rows get equal results; an empty
table gives an empty one; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import TEXT_BATCH_ROWS, small_batches, staged

#: Entries of the broadcast dictionary, and the longest pre-token that stands in it itself.
HEAD, HEAD_BYTES = 1 << 17, 64
#: Texts from which the dictionary is drawn, about.
SAMPLE_DOCS = 8000
#: The byte-level alphabet by its rule: printable Latin-1 characters stand for their own byte, others follow from 256 on.
OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
ALPHABET = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in set(OWN))}
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 1 << 18
#: Pre-tokens that are Python objects at once where pieces are counted.
HELD_ROWS = 1 << 14
#: A fixed value: the pattern of byte-level pre-tokens.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ‐-‧€]")


class PreTokens:
    """Cuts texts into special strings and pre-tokens of one byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        scheme = held["pre_tokenizer"] or {}
        if scheme.get("type") != "ByteLevel" or scheme.get("add_prefix_space") or not scheme.get("use_regex") or held["normalizer"]:
            raise ValueError("a byte-level vocabulary without normalisation is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("special strings that take in their surroundings aren't supported")
        names = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def cut(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of special strings."""
        parts = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for part in parts:
            if UNUSUAL.search(part):
                found.update(part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part))
            else:
                found.update(PATTERN.findall(part))
        return found, len(parts) - 1

    def pieces(self, token: str) -> int:
        """Pieces of one pre-token, by the library's model."""
        return len(self.library.model.tokenize(token.encode().decode("latin-1").translate(ALPHABET)))


def brief(token: str) -> str:
    """The dictionary's key of a pre-token."""
    return token if len(token) <= HEAD_BYTES else "\0" + hashlib.md5(token.encode()).hexdigest()


def counted(pre: DataFrame, vocabulary: str) -> DataFrame:
    """``pre(pre)``, distinct pre-tokens, with ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(vocabulary)
        for b in small_batches(batches, HELD_ROWS):
            yield b.append_column("pieces", pa.array([cutter.pieces(t) for t in b.column(0).to_pylist()], pa.int32()))

    return pre.mapInArrow(run, "pre string, pieces int")


def frequent(texts: DataFrame, vocabulary: str, most: int) -> DataFrame:
    """The ``most`` most frequent pre-tokens of ``texts(text)``; long ones only if they come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = PreTokens(vocabulary), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], names=["pre", "n"])

        for b in small_batches(batches):
            for t in b.column(0).to_pylist():
                held.update(cutter.cut(t)[0])
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    seen = texts.mapInArrow(run, "pre string, n bigint").groupBy("pre").agg(F.sum("n").alias("n")).where((F.length("pre") <= HEAD_BYTES) | (F.col("n") > 1))
    return seen.orderBy(F.desc("n"), "pre").limit(most).select("pre")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a path that all executors have."""
    spark = docs.sparkSession
    slim = docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    parts = -(-max(1, slim.count()) // SAMPLE_DOCS)
    sample = slim.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("text")
    top = counted(frequent(sample, vocabulary, head), vocabulary)
    known = spark.sparkContext.broadcast({brief(r.pre): r.pieces for r in top.toLocalIterator()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, get = PreTokens(vocabulary), known.value.get
        for b in small_batches(batches):
            total, sizes, rest, times = [], [], [], []
            for t in b.column(1).to_pylist():
                found, n = cutter.cut(t)
                before = len(rest)
                for token, k in found.items():
                    if (pieces := get(token if len(token) <= HEAD_BYTES else brief(token))) is None:
                        rest.append(token)
                        times.append(k)
                    else:
                        n += pieces * k
                total.append(n)
                sizes.append(len(rest) - before)
            offsets = pa.array([0, *accumulate(sizes)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=["pre", "times"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(total, pa.int64()), lists], names=["doc_id", "n_bytes", "head_tokens", "rest"])

    sized = slim.select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    by_row = sized.mapInArrow(sums, f"doc_id {id_type}, n_bytes bigint, head_tokens bigint, rest array<struct<pre:string,times:bigint>>")
    by_row = staged(by_row.withColumn("row", F.monotonically_increasing_id()), "frequencies", TEXT_BATCH_ROWS)
    rare = by_row.select("row", F.explode("rest").alias("r")).select("row", "r.pre", "r.times")
    pieces = staged(counted(rare.select("pre").distinct(), vocabulary), "pieces")
    tail = rare.join(pieces, "pre").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("tail_tokens"))
    n = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return by_row.drop("rest").join(tail, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
