"""Helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder
    of its own, and a cluster an error, as its machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="bracketry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch that is sent to Python while a table is saved; a longer row is a batch by itself.
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. Arrow batches are of
    BATCH_BYTES at most meanwhile; the session's own setting is put back."""
    conf, path = df.sparkSession.conf, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = conf.get(_BATCH_BYTES, None)
    conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_BATCH_BYTES)
        else:
            conf.set(_BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that Python and Arrow have freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back to the system, as workers are kept for other tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def held_out(doc_id: str, n: int, is_: int):
    """True where the remainder is ``is_``; rows without an id are held out too, as nothing may be learned from them."""
    return F.coalesce(remainder(doc_id, n) == is_, F.lit(True))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, found by counting no more than one more than that."""
    return df.limit(rows + 1).count() <= rows


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same in batches of so many rows at most, so that few texts are held as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread_over(df: DataFrame, salts: int) -> DataFrame:
    """Every row of a small side ``salts`` times with __salt 0, 1, ...: the other side's rows of a frequent key, with a salt
    each, then meet it in as many tasks."""
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt(salts: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int") if columns else F.lit(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
