"""Shared helpers: durable cuts of lineage, row batches, crc-based splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has no such setting and all its tasks run in the driver's process (tests) a temporary folder is
    used; a cluster without the setting is an error, as executors could not read what others wrote.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tabulon.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("tabulon.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python exits."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, label: str = "cut", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage ends there.

    A lost executor costs no more than the tasks that ran on it; nothing is kept on one machine. The shuffle files of the write
    go as soon as it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a written path (any file system Spark knows)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(df: DataFrame) -> None:
    """Removes what ``cut`` wrote for ``df``; only once no later plan reads it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session may be gone at exit; its folder goes with the cluster's clean-up
            return


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def column_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (faster on large arrays of hashes than NumPy's own hash table)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    return x[starts], np.diff(np.append(starts, len(x)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def chunks_of(items: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths sum to at most ``most`` bytes (one longer item stands alone)."""
    start, total = 0, 0
    for i, x in enumerate(items):
        if i > start and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)
