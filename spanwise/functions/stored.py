"""Intermediate tables, written once to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from spanwise.session import ensure_checkpoint_dir


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and return the re-read table.

    The re-read table cuts lineage (a lost executor re-reads files instead of
    recomputing the ingest) and gives later queries column pruning, filter
    pushdown and real size statistics for AQE.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spanwise-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``write_table`` (nothing may read it any more)."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_version(spark, path: str) -> tuple:
    """Length and change time of every file under ``path``: differs when the input was replaced."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
