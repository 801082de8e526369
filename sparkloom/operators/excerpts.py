"""Literal excerpts: which of a set of strings stand in which texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import small_batches

#: Bytes of excerpts in a broadcast.
BLOCK_BYTES = 4 << 20


def literal_excerpts(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, excerpt) wherever ``items(item_id, excerpt)`` has a string that ``docs(doc_id, text)`` holds.

    The excerpts are measured first and dealt by hash into blocks of about ``block_bytes``;
    each is a broadcast whose automaton passes once over each text, in place. Null and empty
    excerpts and texts find nothing; equal excerpts count for each of their items.
    """
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "excerpt").where("excerpt <> ''")
    total = wanted.agg(F.sum(F.octet_length("excerpt") + 64)).first()[0] or 0
    parts = max(1, -(-total // block_bytes))

    def scan(k: int) -> DataFrame:
        block = wanted.where(F.pmod(F.xxhash64("excerpt"), F.lit(parts)) == k)
        held = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.excerpt) for r in block.toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owners: dict[str, list[int]] = {}
            for item, excerpt in held.value:
                owners.setdefault(excerpt, []).append(item)
            finder = ahocorasick.Automaton()
            for excerpt in owners:
                finder.add_word(excerpt, excerpt)
            if owners:
                finder.make_automaton()
            for b in small_batches(batches):
                found = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for excerpt in {e for _, e in finder.iter(text)} if text and owners else ():
                        found += [(doc, item, excerpt) for item in owners[excerpt]]
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "item_id", "excerpt"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, excerpt string")

    return reduce(DataFrame.unionByName, [scan(k) for k in range(parts)])
