"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table for words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+: A-Z become a-z, every separator a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
#: Byte table that only lower-cases A-Z.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Stands for a missing doc_id in keys; sorts before every real id.
NO_ID = -(2**63)

#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint folder.

    Only in local mode (tests, a laptop) a temporary one is set where the session names
    none. On a cluster that is an error: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracespark-"))
    return context.getCheckpointDir().get().rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation, and what
    depends on how rows were dealt out stays as it was written. The shuffle files
    behind the table are not needed any more and go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_key(doc_id: str = "doc_id") -> Column:
    """``doc_id`` as a long that is never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def any_key(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """``doc_id`` of any type as a long that is never null: integers as they are, others by hash."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return id_key(doc_id) if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(doc_id)


def row_tie(text: str = "text") -> Column:
    """Tells rows of one doc_id apart by their text; equal rows stay together."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def chunks(table, size: int = 256):
    """Slices of an Arrow batch, so that only a few long texts are Python objects at once."""
    for at in range(0, table.num_rows, size):
        yield table.slice(at, size)


def as_bytes(part, column: str = "text") -> list[bytes]:
    """A text column's UTF-8 bytes; nulls are empty."""
    return [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def byte_chunks(table, column: str, most: int = 4 << 20):
    """Slices of an Arrow batch of about ``most`` bytes in a column, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < table.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield table.slice(at, end - at)
        at = end
