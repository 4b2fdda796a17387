"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, saved, shared_dir

__all__ = ["BATCH_BYTES", "bounded_batches", "discard", "fresh", "release", "saved", "shared_dir", "table", "texts_of", "tidy", "with_columns"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read only through Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, bound the bytes of a batch of rows that a query sends to a Python worker.

    Spark's own bounds, 10,000 rows or 64 MB, are held several times over in a
    worker (Arrow, pandas, bytes); texts of any length need a lower one.  A
    lower one that is set already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the next like it that is no column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    """The texts of an Arrow batch."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array], first: int = 0, size: int | None = None) -> pa.RecordBatch:
    """Rows of an Arrow batch with columns put in or replaced.

    All others stay as they are: pandas would make floats of whole numbers
    beside a null.
    """
    part = batch.slice(first, size)
    held = dict(zip(part.schema.names, part.columns)) | columns
    return pa.RecordBatch.from_arrays(list(held.values()), list(held))


def tidy(f):
    """A mapInPandas or mapInArrow function that gives freed memory back to the system when its task ends.

    Python workers are used again by later tasks and stages; without this they
    keep the most that any task before has taken.
    """

    def run(batches):
        yield from f(batches)
        import ctypes

        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now.

    The cleaner acts when the driver's JVM collects garbage, which a driver
    that only submits jobs seldom does by itself.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

