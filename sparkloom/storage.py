"""Reading the input tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of whole texts that are Python objects at once: bounds a worker's memory.
TEXT_BATCH_ROWS = 512
#: Bytes of Arrow data that become Python objects at once, but for a single row.
TEXT_BATCH_BYTES = 4 << 20
#: Bytes below which Spark doesn't cut a scan.
SMALLEST_SPLIT = 4 << 20
#: Folders of intermediate tables that are removed at the end.
_RUNS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, on any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are work to read: spread over all cores where it is too small for a scan to do so.

    Spark cuts no scan into pieces of less than ``SMALLEST_SPLIT`` bytes, nor a row group at
    all; only a table of fewer bytes than that for each core is dealt out by a shuffle.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, name)
    return rows.repartition(cores) if size < SMALLEST_SPLIT * cores else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs inside one process (tests) a
    temporary folder takes its place; on a cluster its absence is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def _folder(spark: SparkSession, place: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; it goes when the driver's JVM ends, or with ``clear``."""
    place = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    if place not in _RUNS:
        _RUNS.add(place)
        files, path = _folder(spark, place)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return place


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own below that of this application."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, place: str) -> bool:
    files, path = _folder(spark, place)
    return files.exists(path)


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that read them must have been used."""
    files, path = _folder(spark, run_dir(spark))
    files.delete(path, True)


def staged(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives the
    planner the true size of what follows, so that small tables are broadcast only
    when their files are below ``spark.sql.autoBroadcastJoinThreshold``. ``batch_rows``
    bounds the rows of an Arrow batch in this write, and in no other.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        if batch_rows:
            spark.conf.set(setting, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = TEXT_BATCH_ROWS, size: int = TEXT_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of few rows and bytes, so that little of a batch becomes Python objects at once.

    The batches themselves are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield from _halved(b.slice(at, rows), size)


def _halved(b: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows < 2 or b.nbytes <= size:
        yield b
        return
    for at, n in ((0, b.num_rows // 2), (b.num_rows // 2, b.num_rows)):
        yield from _halved(b.slice(at, n), size)


def small_frames(frames: Iterator[pd.DataFrame], rows: int = TEXT_BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Frames cut like ``small_batches``, so that what is made of whole texts is passed on a few texts at a time."""
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows].reset_index(drop=True)
