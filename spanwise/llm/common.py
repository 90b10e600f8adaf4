"""Shared helpers: tables in the shared folder, Bloom filters of fixed size, text batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # texts handled together inside a task
FILE_BYTES = 4 << 20  # texts that a file of an intermediate table stands for


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local session without that setting
    (tests) gets a folder of its own; on a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Tables:
    """Intermediate tables of one operator call, written once as Parquet to the shared folder and
    read back: lineage ends there, and a lost executor costs a re-read instead of a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.files: int | None = None

    def fit(self, size: int) -> None:
        """From now on tables get a file per FILE_BYTES of the ``size`` bytes of text that the operator reads, or per core, at
        most.  Many shuffle partitions over little data made hundreds of files of a few rows of every table; where the shared
        folder is a mounted disk, an executor's JVM starts three processes for each file, and its memory counts twice meanwhile."""
        self.files = max(self.spark.sparkContext.defaultParallelism, size // FILE_BYTES)

    def fitted(self, df: DataFrame) -> DataFrame:
        """The same rows, in as many partitions as files are wanted; a task then goes through several of the old ones, one by one."""
        return df.coalesce(self.files) if self.files else df

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        self.fitted(df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


def tidy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever other columns there are."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def encode(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches whose texts hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return freed memory of this Python process to the system: the process stays for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


BLOOM_BITS = 1 << 24  # two megabytes, whatever the input


def bloom_positions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (keys >> np.uint64(40)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def bloom_build(df: DataFrame, key: str | Column) -> np.ndarray:
    """Bloom filter (two bits per key) of a 64-bit column as one byte per eight bits.

    The words are OR-ed on the executors; at most BLOOM_BITS / 64 words reach the driver, however
    many keys there are.  The filter only saves work: whatever passes is joined exactly afterwards.
    """

    def words(batches):
        bits = np.zeros(BLOOM_BITS, dtype=bool)
        for b in batches:
            for p in bloom_positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                bits[p] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed[at], pa.int64())], ["at", "word"])

    key = F.col(key) if isinstance(key, str) else key
    keys = df.select(key.cast("long").alias("key")).where("key is not null")
    rows = keys.mapInArrow(words, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    out = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    table = rows.toArrow()
    out[table["at"].to_numpy()] = table["word"].to_numpy()
    return out.view(np.uint8)


def bloom_has(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = None
    for p in bloom_positions(keys):
        hit = (bloom[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        out = hit if out is None else out & hit
    return out.astype(bool)


def maybe_in(bloom, column: Column) -> Column:
    """Boolean column: may the id be among the filter's keys?  False for null ids."""

    @F.pandas_udf("boolean")
    def test(ids: pd.Series) -> pd.Series:
        return pd.Series(bloom_has(bloom.value, ids.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)))

    return F.coalesce(test(F.coalesce(column.cast("long"), F.lit(0))), F.lit(False)) & column.isNotNull()


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``.  Rows that the fixed-size filter
    rules out are not shuffled; the others are anti-joined."""
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).where("__gone is not null").distinct()
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_build(gone, "__gone"))
    marked = docs.withColumn("__maybe", maybe_in(bloom, F.col(f"`{id_col}`")))
    some = marked.where("__maybe").join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").unionByName(some).drop("__maybe")
