"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import os
import re
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-only lower-casing of UTF-8 bytes.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Rows of a batch that are turned into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as there are cores where the scan gives fewer (a small table of one row group); others stay unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def hashed_share(n: int, of: int, seed: int, *columns: str) -> Column:
    """Whether a row is among about n of ``of`` rows, by a hash of its columns; nothing depends on the rows' order or place."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 40)))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (string), under fixed names, whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hash_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. One of our own only where none is named and all runs in one JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("spark.tidegrid.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="spark-tidegrid-")
        spark.conf.set("spark.tidegrid.scratch", own)
    return own


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Paths written inside each open ``passing`` block.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """At the end, what ``stored`` has written inside is removed, but for tables that it was told to keep: nothing else may be read afterwards."""
    _PASSING.append([])
    try:
        yield
    finally:
        remove(spark, *_PASSING.pop())


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """The same rows, written to the shared folder and read again: a cut of the lineage that no executor's loss undoes.

    A join of two such tables reads two plain shuffles, so that Spark can split a key which very many rows share.
    """
    path = scratch_path(df.sparkSession, what)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller pieces of each batch, so that a worker holds few long texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
