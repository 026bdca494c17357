"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.session import shared_path

BATCH_BYTES = 8 << 20  # of one batch between Spark and Python


def bounded_batches(spark: SparkSession) -> None:
    """Hold batches to Python to ``BATCH_BYTES``: they are counted in rows otherwise, however long a text is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps neither recompute
    it nor depend on the executors that made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contents(messages: DataFrame) -> DataFrame:
    """Only ``id`` and ``content`` (null: empty), whatever else the table holds; batches are bounded."""
    bounded_batches(messages.sparkSession)
    return messages.select("id", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of a stream of batches as tuples of the named columns."""
    for batch in batches:
        yield from zip(*[column(batch, n).to_pylist() for n in names])


def edge_batch(found: list[tuple[bytes, bytes | None]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
