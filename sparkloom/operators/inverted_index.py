"""An inverted index of texts as a table of posting blocks, with pruned top-k search and refresh by file.

Texts are cut into ranges of ``RANGE_DOCS`` as they come, and a range is inverted where it lies.
A row of the index is a block: the postings of one term in one range, with the largest
frequency among them. A term that a third of all texts have is many blocks, none larger than a
range, and only whole blocks are shuffled, once. The empty term stands for all texts of a
range. Ids and places are kept as steps from one to the next, and all numbers in as few bytes as
each needs. Rows lie in folders by a hash of the term, sorted by term and range, so a search opens the folders
of its terms, and reads block maxima without the postings (they are columns of their own).

A search for the k best takes two passes over these folders:

1. From the maxima: the sum of a range's maxima bounds the score of all its texts, and its
   largest maximum is reached by one of them. The k-th largest of these over the ranges, each
   of other texts, is a score that the k-th hit reaches at least. Ranges bounded below it go.
   Where every term is wanted, ranges that lack one go.
2. The blocks that are left are dealt by range, each once for all queries of a block of them, and
   scored where they meet: k texts of each query leave a range at most.

Texts that change are written as a further segment; the postings of an id in earlier segments
are dead from then on. A segment counts when its entry in ``segments`` is written, the last of
its files, so readers see whole segments only. ``compact`` merges segments into a new index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.topk import COVER, Running, TermBlock, cover_rank, query_blocks, rows_at_once
from sparkloom.storage import small_batches, staged

#: Texts in a range; bytes of index in a folder, about, and folders at most.
RANGE_DOCS, FOLDER_TEXTS, FOLDERS = 1024, 20_000, 4096
BLOCK = "term string, range bigint, n int, most int, texts binary, places binary"
BLOCKS = f"{BLOCK}, segment int, folder int"
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
NAMES = ["term", "range", "n", "most", "texts", "places"]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Cells of so many whole numbers each; a number is of seven bits a byte, low ones first, and the last byte has no eighth."""
    v = values.astype(np.int64).view(np.uint64)
    lengths = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        more = v >= np.uint64(1 << bits)
        if not more.any():
            break
        lengths += more
    ends = np.cumsum(lengths)
    out, starts = np.empty(int(ends[-1]) if len(v) else 0, np.uint8), ends - lengths
    for at in range(int(lengths.max()) if len(v) else 0):
        mine = np.flatnonzero(lengths > at)
        part = (v[mine] >> np.uint64(7 * at)) & np.uint64(127)
        out[starts[mine] + at] = part | (np.uint64(128) * (lengths[mine] > at + 1))
    cells = np.append(0, ends)[np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cells.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(cells: pa.Array) -> np.ndarray:
    """The numbers of all cells."""
    b = np.frombuffer(b"".join(cells.to_pylist()), np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).view(np.int64)


def _since(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each part of so many values."""
    sums = np.append(0, np.cumsum(values))
    return sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)


def _packed_texts(ids: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Cells of (step from the id before, frequency) for each posting."""
    before = np.append(0, ids[:-1])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    steps = ids - before
    return packed(np.column_stack([(steps << 1) ^ (steps >> 63), tfs]).ravel(), 2 * sizes)


def _texts(cells: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and frequencies of all cells of so many postings."""
    pairs = unpacked(cells).reshape(-1, 2)
    steps = (pairs[:, 0].view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(pairs[:, 0] & 1) if len(pairs) else pairs[:, 0]
    return _since(steps, sizes), pairs[:, 1]


def _inverted(texts: pa.Table, number: int) -> pa.RecordBatch:
    """The blocks of one range of (id, terms)."""
    ids, terms = (texts.column(x).combine_chunks() for x in range(2))
    ids, lengths = ids.to_numpy(zero_copy_only=False).astype(np.int64), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    words = terms.flatten()
    real = pc.fill_null(pc.not_equal(words, ""), False)
    some = real.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(ids)), lengths)[some]
    place = (np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths))[some]
    coded = words.filter(real).dictionary_encode()
    code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    order = np.argsort(code, kind="stable")  # a term's texts and places stay in order
    code, text, place = code[order], text[order], place[order]
    begins = np.ones(len(code), bool)
    begins[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    tfs, steps = np.diff(np.append(first, len(code))), place - np.where(begins, 0, np.append(0, place[:-1]))
    sizes, spans = np.bincount(code[first], minlength=len(names)), np.bincount(code, minlength=len(names))
    most = np.maximum.reduceat(tfs, np.cumsum(sizes) - sizes) if len(names) else np.empty(0, np.int64)
    n = len(ids)
    whole = lambda own, values: np.append(np.int64(own), values)  # noqa: E731  the empty term comes first
    columns = [pa.concat_arrays([pa.array([""], names.type), names]), pa.array(np.full(1 + len(names), number, np.int64)), pa.array(whole(n, sizes), pa.int32()), pa.array(whole(0, most), pa.int32())]
    columns += [_packed_texts(np.concatenate([ids, ids[text[first]]]), np.concatenate([np.zeros(n, np.int64), tfs]), whole(n, sizes)), packed(steps, whole(0, spans))]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _blocks(docs: DataFrame, range_docs: int) -> DataFrame:
    """Posting blocks of ``docs(id, terms)``; a range is of one task, numbered within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32
        for b in small_batches(batches):
            held.append(b)
            rows += b.num_rows
            while rows >= range_docs:
                table = pa.Table.from_batches(held)
                yield _inverted(table.slice(0, range_docs), number)
                held, rows, number = table.slice(range_docs).to_batches(), rows - range_docs, number + 1
        if rows:
            yield _inverted(pa.Table.from_batches(held), number)

    return docs.where(docs["id"].isNotNull()).select(docs["id"].cast("bigint").alias("id"), docs["terms"]).mapInArrow(run, BLOCK)


class TextIndex:
    """The index in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.segments = sorted(r.segment for r in spark.read.parquet(f"{path}/segments").select("segment").collect())  # a row each
        shape = spark.read.parquet(f"{path}/segments").where("segment = 0").first()
        self.range_docs, self.folders = shape.range_docs, shape.folders

    @classmethod
    def build(cls, docs: DataFrame, path: str, range_docs: int = RANGE_DOCS) -> TextIndex:
        """Index ``docs(id, terms)``; ids are distinct, rows without one are left out."""
        folders = max(16, min(FOLDERS, docs.count() // FOLDER_TEXTS))
        _write(docs.sparkSession, path, 0, _blocks(docs, range_docs), range_docs, folders)
        return cls(docs.sparkSession, path)

    def refresh(self, docs: DataFrame, removed: DataFrame | None = None) -> TextIndex:
        """Replace the texts of ``docs(id, terms)``, add new ones, and take out ``removed(id)``."""
        ids = docs.select(docs["id"].cast("bigint").alias("id"))
        gone = ids if removed is None else ids.unionByName(removed.select(removed["id"].cast("bigint").alias("id")))
        segment = self.segments[-1] + 1
        gone.where("id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
        _write(self.spark, self.path, segment, _blocks(docs, self.range_docs), self.range_docs, self.folders)
        return TextIndex(self.spark, self.path)

    def compact(self, path: str) -> TextIndex:
        """The live postings as one segment in another folder, their ranges dealt by a hash of the id."""
        rows = self._live(self._postings(self.postings()))
        ranges = max(1, rows.where("term = ''").count() // self.range_docs)
        by_range = rows.groupBy("term", F.pmod(F.xxhash64("id"), F.lit(ranges)).alias("range"))
        made = by_range.agg(F.sort_array(F.collect_list(F.struct("id", "tf", "places"))).alias("p"), F.max("tf").alias("most"))  # a range's texts at most
        lists = made.select("term", "range", F.size("p").alias("n"), "most", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.flatten("p.places").alias("places"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                flat = [b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (4, 5, 6)]
                sizes, spans = (b.column(x).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (4, 6))
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in range(4)), _packed_texts(flat[0], flat[1], sizes), packed(flat[2], spans)], names=NAMES)

        _write(self.spark, path, 0, lists.mapInArrow(run, BLOCK), self.range_docs, self.folders)
        return TextIndex(self.spark, path)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The blocks of the given terms, from their folders only."""
        rows = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/postings").where(F.col("segment").isin(self.segments))
        if terms is None:
            return rows
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
        folders = [r.folder for r in wanted.select(_folder(F.col("term"), self.folders).alias("folder")).distinct().collect()]  # ``FOLDERS`` at most
        return rows.where(F.col("folder").isin(folders)).join(F.broadcast(wanted), "term", "left_semi")

    def _postings(self, blocks: DataFrame) -> DataFrame:
        """(segment, range, term, id, tf, places): ``blocks`` as a row for each posting."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches):
                sizes = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, tfs = _texts(b.column(4), sizes)
                row = pa.array(np.repeat(np.arange(b.num_rows), sizes))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tfs)), pa.int32()), pa.array(unpacked(b.column(5)), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(x).take(row) for x in range(3)), pa.array(ids), pa.array(tfs, pa.int32()), lists], names=["segment", "range", "term", "id", "tf", "places"])

        return blocks.select("segment", "range", "term", "n", "texts", "places").mapInArrow(run, "segment int, range bigint, term string, id bigint, tf int, places array<int>")

    def _latest(self) -> DataFrame | None:
        """(id, latest): ids that a later segment than the first has, which makes their earlier postings dead."""
        if len(self.segments) == 1:
            return None
        gone = self.spark.read.schema("id bigint, segment int").parquet(f"{self.path}/gone").where(F.col("segment").isin(self.segments))
        return gone.groupBy("id").agg(F.max("segment").alias("latest"))

    @cached_property
    def _dead(self) -> DataFrame | None:
        """(segment, range, id): the dead texts of each range."""
        latest = self._latest()
        if latest is None:
            return None
        rows = self._postings(self.postings([""])).select("segment", "range", "id").join(latest, "id")
        return staged(rows.where("segment < latest").select("segment", "range", "id"), "dead-texts")

    def _live(self, rows: DataFrame) -> DataFrame:
        latest = self._latest()
        if latest is None:
            return rows
        return rows.join(latest, "id", "left").where(F.col("latest").isNull() | (F.col("segment") == F.col("latest"))).drop("latest")

    def blocks(self, block: list, k: int, every: bool) -> DataFrame:
        """(query_id, segment, range, term, n): the blocks that a block of queries (id, terms) has to read."""
        asked = self.spark.createDataFrame(sorted({(int(r[0]), t) for r in block for t in r[1]}), "query_id bigint, term string")
        need = self.spark.createDataFrame([(int(r[0]), len(set(r[1]))) for r in block], "query_id bigint, need int")
        heads = self.postings(sorted({t for r in block for t in r[1]})).select("segment", "range", "term", "n", "most")
        heads = staged(heads, "block-maxima").join(F.broadcast(asked), "term")  # it is read twice
        by = ["query_id", "segment", "range"]
        sums = heads.groupBy(*by).agg(F.sum("most").alias("bound"), F.max("most").alias("reached"), F.count("*").alias("terms"))
        if every:
            left = sums.join(F.broadcast(need), "query_id").where(F.col("terms") == F.col("need"))
        else:
            if self._dead is not None:  # a maximum may be that of a dead posting
                dead = self._dead.select("segment", "range", F.lit(True).alias("dead")).distinct()
                sums = sums.join(dead, ["segment", "range"], "left").withColumn("reached", F.when(F.col("dead").isNull(), F.col("reached")))
            sums = staged(sums, "range-bounds")
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("reached")))
            least = sums.select("query_id", "reached", place.alias("place")).where(F.col("place") == k).select("query_id", F.coalesce("reached", F.lit(0)).alias("least"))
            left = sums.join(F.broadcast(least), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0)))  # a row a query
        return heads.join(staged(left.select(*by), "ranges"), by).select(*by, "term", "n")

    def search(self, queries: DataFrame, k: int, every: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k best texts of each of ``queries(query_id, terms)``, with any term or with every one."""
        found = None
        for block in query_blocks(queries):
            block = [r for r in block if r[1]]
            if not block:
                continue
            wanted = staged(self.blocks(block, k, every).select("segment", "range", "term").distinct(), "wanted-blocks")
            rows = self.postings(sorted({t for r in block for t in r[1]})).join(wanted, ["segment", "range", "term"], "left_semi")
            part = self._best(rows.select("segment", "range", "term", "n", "texts", *(["places"] if every else [])), block, k, every)
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
            part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")

    def _best(self, rows: DataFrame, block: list, k: int, every: bool) -> DataFrame:
        """(query_id, id, score): the k best of each query in each range of ``rows(segment, range, term, n, texts, ...)``.

        A query may meet ranges that it doesn't want: there it has fewer than all terms, or no
        score that the k best let in.
        """
        held = self.spark.sparkContext.broadcast(TermBlock(block))

        def one(blocks: pa.Table, dead: pa.Table | None = None) -> pa.Table:
            asked = held.value
            if not blocks.num_rows:
                return FOUND.empty_table()
            sizes = blocks.column("n").to_numpy().astype(np.int64)
            flat, tfs = _texts(blocks.column("texts"), sizes)
            ids, text = np.unique(flat, return_inverse=True)
            gone = np.isin(ids, dead.column("id").to_numpy()) if dead is not None else np.zeros(len(ids), bool)
            codes, bounds = [asked.codes[t] for t in blocks.column("term").to_pylist()], np.append(0, np.cumsum(sizes))
            where = dict(zip(codes, zip(bounds[:-1], bounds[1:])))
            if every:
                places, first = _since(unpacked(blocks.column("places")), tfs), np.append(0, np.cumsum(tfs))
                order = np.lexsort((text, np.repeat(np.arange(len(sizes)), sizes)))  # a block's texts by id
                text, tfs, first = text[order], tfs[order], first[:-1][order]
            parts, step = [], rows_at_once(len(ids), len(asked.names))
            for low in range(0, len(asked.names), step):
                n = min(step, len(asked.names) - low)
                times, terms = np.zeros((n, len(ids))), np.zeros((n, len(ids)), np.int32)
                for c, (a, b) in where.items():
                    who = asked.queries[asked.starts[c] : asked.starts[c + 1]]
                    who = who[(who >= low) & (who < low + n)] - low
                    cells = np.ix_(who, text[a:b])
                    times[cells] += tfs[a:b]
                    terms[cells] += 1
                score = np.where((terms > 0) & ~gone, COVER * times, -np.inf)
                if every:
                    score = np.full(score.shape, -np.inf)
                    for q, d in zip(*np.nonzero((terms == asked.need[low : low + n, None]) & (terms > 0) & ~gone)):
                        at = []
                        for c in asked.terms[low + q]:
                            a, b = where[c]
                            p = a + np.searchsorted(text[a:b], d)
                            at += [(x, c) for x in places[first[p] : first[p] + tfs[p]].tolist()]
                        at.sort()
                        score[q, d] = cover_rank([c for _, c in at], [p for p, _ in at], int(asked.need[low + q])) + 1e-9  # halves go up
                running = Running(n, k)
                running.add(np.round(score, 6), ids)
                q, best, own = running.best()
                parts.append((asked.names[low + q], own, best))
            return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=FOUND)

        ranges, kinds = rows.groupBy("segment", "range"), "query_id bigint, id bigint, score double"
        if self._dead is None:
            return ranges.applyInArrow(lambda blocks: one(blocks), kinds)
        return ranges.cogroup(self._dead.groupBy("segment", "range")).applyInArrow(lambda blocks, dead: one(blocks, dead), kinds)


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _write(spark: SparkSession, path: str, segment: int, blocks: DataFrame, range_docs: int, folders: int) -> None:
    """One segment of ``blocks``; its entry comes last."""
    placed = blocks.withColumn("folder", _folder(F.col("term"), folders)).repartition(F.col("folder"), F.pmod("range", F.lit(8)))
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("texts", "places")}  # hardly two cells are equal
    placed.sortWithinPartitions("folder", "term", "range").write.mode("overwrite").options(**plain).partitionBy("folder").parquet(f"{path}/postings/segment={segment}")
    entry = spark.createDataFrame([(segment, range_docs, folders)], "segment int, range_docs int, folders int")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/segments")
