"""Helpers that every corpus operator shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker holds as Python objects at once.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session has none (a test) a temporary folder is set, which the process removes at its end; a cluster
    must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        made = tempfile.mkdtemp(prefix="navgraph-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; Spark deletes it when no plan refers to it any more, where
    the cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote, through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the column's text form, modulo ``divisor``: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % divisor


def hash_limit(rows: int, total: int) -> int:
    """The signed 64-bit hash below which ``rows`` of ``total`` rows lie on average, however small that share."""
    return (rows << 64) // total - (1 << 63)


def drawn(key: Column, rows: int, total: int) -> Column:
    """Whether a row belongs to a sample of about ``rows`` of ``total`` rows, by the hash of its key."""
    return F.lit(True) if rows >= total else F.xxhash64(key, F.lit("fit")) < F.lit(hash_limit(rows, total))


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """Arrow batches in parts of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_str(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")
