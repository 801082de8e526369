"""Trees of summaries over the vectors of files: clusters, levels that can be resumed, one root.

A level clusters the nodes of each file that has several: the first free node takes its
nearest free neighbours, again and again. Files of up to ``PART_NODES`` nodes are clustered
in one task each. Larger ones are clustered in rounds over all tasks, with the same result:
the first free nodes are the seeds of a round, every free node is compared with them where
it lies, and each seed's nearest are settled in order, as long as their neighbours suffice.

A summary is the first sentences of its members, its vector their mean. A cluster of one goes
up as it is. After the stated number of levels the nodes that a file has left are merged into
its root; a file with more than ``ROOT_MEMBERS`` nodes left first gets further levels. With a
limit on summaries a file's tree ends where the limit is reached.

With a folder a build leaves a checkpoint of each level, under a fingerprint of its nodes and
options. A build that was stopped goes on after the last level that was entered whole; a build
over other nodes starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.storage import exists, staged

#: Levels before the root, nodes clustered by one task, nodes that a root merges.
TREE_LEVELS, PART_NODES, ROOT_MEMBERS = 4, 4096, 64
#: Seeds and their neighbours in a round over a large file.
SEEDS, NEIGHBOURS = 512, 512
#: Summaries of a level are numbered from this times the level.
LEVEL_IDS = 1_000_000_000_000
# The least and largest cluster, and how many times the limit on summaries a level may have clusters.
SMALLEST, LARGEST, CAP_FACTOR = 2, 8, 2


def cluster_size(n: Column, share: float, most: int | None) -> Column:
    """Members of a cluster in a file of ``n`` nodes, so that clusters are about ``share`` of them."""
    target = F.greatest(F.lit(1), F.ceil(n * share - 1e-9))
    if most is not None:
        target = F.when(n > most * CAP_FACTOR, F.least(target, F.lit(max(most * CAP_FACTOR, most + 1)))).otherwise(target)
    return F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.ceil(n / target))).cast("int")


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def greedy_clusters(vectors: np.ndarray, size: int) -> list[list[int]]:
    """The first free vector and its nearest free neighbours by cosine, again and again; single ones where fewer than ``size`` are left."""
    v = unit(vectors)
    free, out = np.arange(len(v)), []
    while len(free):
        seed, rest = free[0], free[1:]
        taken = rest[np.lexsort((rest, -np.round(v[rest] @ v[seed], 9)))][: size - 1] if len(rest) >= size - 1 else rest[:0]
        out.append([int(seed), *map(int, taken)])
        free = np.setdiff1d(rest, taken)
    return out


def _whole_files(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, seed) of files that a task can hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id").reset_index(drop=True)
        seed = np.zeros(len(pdf), np.int64)
        for members in greedy_clusters(np.stack(pdf["embedding"].to_list()).astype(float), int(pdf["size"][0])):
            seed[members] = pdf["node_id"][members[0]]
        return pd.DataFrame({"file_id": pdf["file_id"], "node_id": pdf["node_id"], "seed": seed})

    return nodes.groupBy("file_id").applyInPandas(run, "file_id bigint, node_id bigint, seed bigint")


def _nearest(free: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file_id, seed, node_id, place): the ``NEIGHBOURS`` nearest free nodes of each seed, from one scan for each block of seeds."""
    spark, parts = free.sparkSession, []
    block: list = []

    def scan(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast({f: (np.array([r.node_id for r in block if r.file_id == f]), unit(np.array([r.embedding for r in block if r.file_id == f]))) for f in {r.file_id for r in block}})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                files, ids = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
                for f in np.unique(files):
                    if f not in held.value:
                        continue
                    mine = np.flatnonzero(files == f)
                    mine = mine[np.argsort(ids[mine], kind="stable")]  # equal scores go by id
                    names, q = held.value[f]
                    v = unit(b.column(2).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1))
                    score = np.round(q @ v.T, 9)
                    score[names[:, None] >= ids[mine][None, :]] = -np.inf  # earlier nodes are seeds before this one, or taken
                    few = min(NEIGHBOURS, len(mine))
                    order = np.argsort(-score, axis=1, kind="stable")[:, :few]
                    best = np.take_along_axis(score, order, axis=1)
                    ok = best > -np.inf
                    at = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), f)), pa.array(names[at[0]]), pa.array(ids[mine][order[at]]), pa.array(best[at])], names=["file_id", "seed", "node_id", "score"])

        return free.select("file_id", "node_id", "embedding").mapInArrow(run, "file_id bigint, seed bigint, node_id bigint, score double")

    for row in seeds.orderBy("file_id", "node_id").toLocalIterator():
        block.append(row)
        if len(block) == SEEDS * 4:
            parts.append(scan(block))
            block = []
    if block:
        parts.append(scan(block))
    place = F.row_number().over(Window.partitionBy("file_id", "seed").orderBy(F.desc("score"), "node_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= NEIGHBOURS)


def _large_files(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, seed) of files that a task can't hold: rounds of ``SEEDS`` seeds a file."""
    free, done = nodes, []
    while True:
        numbered = free.withColumn("at", F.row_number().over(Window.partitionBy("file_id").orderBy("node_id")))
        left = free.groupBy("file_id").agg(F.count("*").alias("left"))
        seeds = staged(numbered.where(F.col("at") <= SEEDS).join(left, "file_id").select("file_id", "node_id", "at", "size", "left", "embedding"), "seeds")
        if seeds.isEmpty():
            break
        near = _nearest(free, seeds)
        lists = near.groupBy("file_id", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda e: e.node_id).alias("near"))  # ``NEIGHBOURS`` at most
        asked = seeds.select("file_id", F.col("node_id").alias("seed"), "size", "left").join(lists, ["file_id", "seed"], "left")

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            """The seeds of a file in order: each takes its nearest free ones, until one's neighbours do not suffice."""
            pdf = pdf.sort_values("seed")
            taken: dict[int, int] = {}
            size, left = int(pdf["size"].iloc[0]), int(pdf["left"].iloc[0])
            for seed, near in zip(pdf["seed"].tolist(), pdf["near"]):
                if seed in taken:
                    continue
                near = [] if near is None else near
                rest = left - len(taken) - 1
                want = size - 1 if rest >= size - 1 else 0
                got = [n for n in map(int, near) if n not in taken][:want]
                if len(got) < want:  # of more free nodes than its neighbours; the next round has them
                    break
                taken |= {seed: seed} | {n: seed for n in got}
            return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]] * len(taken), "node_id": list(taken), "seed": list(taken.values())}, dtype=np.int64)

        made = staged(asked.groupBy("file_id").applyInPandas(settle, "file_id bigint, node_id bigint, seed bigint"), "clustered")
        done.append(made)
        free = staged(free.join(made.select("file_id", "node_id"), ["file_id", "node_id"], "left_anti"), "free-nodes")
    return reduce(DataFrame.unionByName, done)


def cluster_nodes(nodes: DataFrame, target_share: float = 0.5, most: int | None = None) -> DataFrame:
    """(file_id, node_id, cluster) of ``nodes(file_id, node_id, embedding)``: clusters of 2 to 8, and single nodes where too few are left."""
    n = nodes.groupBy("file_id").agg(F.count("*").alias("n"))
    sized = nodes.select("file_id", "node_id", F.col("embedding").cast("array<double>").alias("embedding")).join(n, "file_id").withColumn("size", cluster_size(F.col("n"), target_share, most))
    seeded = _whole_files(sized.where(F.col("n") <= PART_NODES))
    large = staged(sized.where(F.col("n") > PART_NODES).drop("n"), "large-files")
    if not large.isEmpty():
        seeded = seeded.unionByName(_large_files(large))
    order = Window.partitionBy("file_id").orderBy("seed")
    return seeded.withColumn("cluster", (F.dense_rank().over(order) - 1).cast("int")).drop("seed")


def _summaries(members: DataFrame) -> DataFrame:
    """(file_id, node_id, embedding, text) of ``members(file_id, top, m)`` grouped by ``top``."""
    own = F.array_sort(F.collect_list("m"))  # eight, or the members of a root
    total = lambda x: F.aggregate(F.slice(x, F.lit(2), F.size(x)), F.get(x, F.lit(0)).embedding, lambda a, m: F.zip_with(a, m.embedding, lambda u, v: u + v))
    made = members.groupBy("file_id", F.col("top").alias("node_id")).agg(own.alias("x"))
    return made.select("file_id", "node_id", F.transform(total(F.col("x")), lambda v: v / F.size("x")).alias("embedding"), F.array_join(F.transform("x", lambda m: m.said), " ").alias("text"))


def _level(front: DataFrame, level: int, target_share: float, most: int | None, levels: int) -> tuple[DataFrame, DataFrame]:
    """One level of every file that has several nodes and may have more summaries: (nodes that are done, the next front)."""
    n = front.groupBy("file_id").agg(F.count("*").alias("n"), F.max("made").alias("made"))
    goes_on = F.col("n") > 1 if most is None else (F.col("n") > 1) & (F.col("made") < most)
    state = staged(n.select("file_id", "n", F.col("made").alias("before"), goes_on.alias("open"), ((F.lit(level) > levels) & (F.col("n") <= ROOT_MEMBERS)).alias("ends")), "tree-state")
    open_ = front.join(state.where("open").drop("open"), "file_id")
    clustered = cluster_nodes(open_.where("NOT ends").select("file_id", "node_id", "embedding"), target_share, most)
    joined = open_.where("NOT ends").join(clustered, ["file_id", "node_id"]).unionByName(open_.where("ends").withColumn("cluster", F.lit(0)))
    joined = joined.withColumn("members", F.count("*").over(Window.partitionBy("file_id", "cluster")))  # eight, or ROOT_MEMBERS
    numbers = joined.select("file_id", "cluster", "members", "before").distinct().withColumn("nth", F.sum((F.col("members") > 1).cast("int")).over(Window.partitionBy("file_id").orderBy("cluster")))
    # clusters after the limit are left without a parent, single ones among them too
    fits = F.lit(True) if most is None else F.when(F.col("members") > 1, F.col("nth") + F.col("before") <= most).otherwise(F.col("nth") + F.col("before") < most)
    numbers = numbers.select("file_id", "cluster", fits.alias("fits"))
    parent = F.when((F.col("members") > 1) & F.col("fits"), F.lit(level * LEVEL_IDS) + F.col("cluster"))
    placed = staged(joined.join(numbers, ["file_id", "cluster"]).withColumn("parent_id", parent), "tree-nodes")
    said = F.regexp_extract("text", r"(?s)^\s*(.*?[.!?。](?=\s|$)|.*)", 1)
    members = placed.where("parent_id IS NOT NULL").select("file_id", F.col("parent_id").alias("top"), F.struct("node_id", "embedding", said.alias("said")).alias("m"))
    count = placed.where("parent_id IS NOT NULL").groupBy("file_id").agg((F.max("before") + F.count_distinct("parent_id")).alias("made"))
    up = placed.where("members = 1 AND fits").select("file_id", "node_id", "embedding", "text", "level")
    made = _summaries(members).withColumn("level", F.lit(level)).unionByName(up).join(count, "file_id", "left").na.fill(0, ["made"])
    done = placed.where("NOT (members = 1 AND fits)").select("file_id", "level", "node_id", "parent_id", "text")
    closed = front.join(state.where("NOT open").select("file_id"), "file_id", "left_semi").select("file_id", "level", "node_id", F.lit(None).cast("bigint").alias("parent_id"), "text")
    return done.unionByName(closed), made.select(*front.columns)


def _fingerprint(nodes: DataFrame, options: tuple) -> str:
    n, check = nodes.agg(F.count("*"), F.sum(F.xxhash64("file_id", "node_id", "text", "embedding", F.lit(repr(options))).cast("decimal(38,0)"))).first()
    return f"{n}-{check or 0}"


def summary_tree(nodes: DataFrame, target_share: float = 0.5, levels: int = TREE_LEVELS, most: int | None = None, folder: str | None = None) -> DataFrame:
    """(file_id, level, node_id, parent_id, text): ``nodes(file_id, node_id, embedding, text)`` and the summaries above them.

    ``level`` is the level that made the node, 0 for those that were given; a top has no parent.
    """
    spark = nodes.sparkSession
    slim = nodes.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("node_id").cast("bigint").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"), "text")
    base = None if folder is None else f"{folder}/{_fingerprint(slim, (target_share, levels, most))}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        if base is None:
            return staged(df, f"tree-{name.split('/')[0]}")
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    front = slim.select("*", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("made"))
    done_schema = "file_id bigint, level int, node_id bigint, parent_id bigint, text string"
    done, level = [], 1
    while base is not None and exists(spark, f"{base}/entry/{level}/_SUCCESS"):
        done.append(spark.read.schema(done_schema).parquet(f"{base}/done/{level}"))
        front = spark.read.schema(front.schema).parquet(f"{base}/front/{level}")
        level += 1
    if not done:
        front = kept(front, "front/0")
    while not front.isEmpty():
        finished, after = _level(front, level, target_share, most, levels)
        done.append(kept(finished, f"done/{level}"))
        front = kept(after, f"front/{level}")
        if base is not None:
            kept(spark.range(1), f"entry/{level}")
        level += 1
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], done_schema)
