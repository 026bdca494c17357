"""Live marts on Structured Streaming: hourly trend, distinct counts, de-duplication, incremental
silver, and source exports as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from restomart.operators.orders import SourceRows
from restomart.operators.validate import problems_of
from restomart.sources.exports import stream_records
from restomart.sources.silver import SCHEMAS, conform
from restomart.sources.store import SilverStore

LATENESS = "2 hours"
MERGE_EVERY = 50  # micro-batches
SKETCH_BITS = 14  # a relative error of about 0.8 %


def distinct_orders(orders: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drop repeated (source, source_order_id) that arrive within the lateness; keys older than that leave
    the state, so a later repeat counts as new."""
    return orders.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(
        ["source", "source_order_id"])


def hourly_trend(orders: DataFrame, lateness: str = LATENESS, distinct: str | None = None) -> DataFrame:
    """Orders and revenue per location and hour; one state row per location and open hour.

    ``distinct`` names a column of which the values are counted; the state holds a sketch of bounded size
    for it, and sketches of several hours or locations can be united afterwards.
    """
    sketch = [F.hll_sketch_agg(distinct, SKETCH_BITS).alias("sketch")] if distinct else []
    return (
        orders.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "location_name")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_cents").alias("total_cents"), *sketch)
        .select(F.col("w.start").alias("hour_start"), "location_name", "orders", "total_cents",
                *(["sketch"] if distinct else []))
    )


def distinct_count(sketches: DataFrame, *keys: str) -> DataFrame:
    """Distinct values per ``keys``, from the united sketches of stored hours."""
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def _stored(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(last merged micro-batch or -1, micro-batches after it) by the folders that are complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1, []
    done = [s.getPath().getName() for s in files.listStatus(root)
            if s.isDirectory() and files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = lambda kind: [int(n.split("=")[1]) for n in done if n.startswith(f"{kind}=")]
    merged = max(numbers("merged"), default=-1)
    return merged, sorted(n for n in numbers("batch") if n > merged)


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest stored value per key."""
    merged, batches = _stored(spark, path)
    folders = [(merged, f"{path}/merged={merged}")] if merged >= 0 else []
    stored = None
    for number, folder in folders + [(b, f"{path}/batch={b}") for b in batches]:
        rows = spark.read.parquet(folder).withColumn("_batch", F.lit(number))
        stored = rows if stored is None else stored.unionByName(rows)
    values = F.struct(*[c for c in stored.columns if c not in (*keys, "_batch")])
    return stored.groupBy(*keys).agg(F.max_by(values, "_batch").alias("v")).select(*keys, "v.*")


def keep_updates(path: str, keys: list[str], merge_every: int = MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """Store each micro-batch in a folder of its own; a repeated batch replaces itself. After every
    ``merge_every`` of them the newest values so far become one folder and the older ones go; the last
    merged folder stays for readers that still use it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        before, waiting = _stored(spark, path)
        if len(waiting) < merge_every:
            return
        latest_updates(spark, path, keys).write.mode("overwrite").parquet(f"{path}/merged={waiting[-1]}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            kind, _, number = status.getPath().getName().partition("=")
            if (kind == "batch" and int(number) <= before) or (kind == "merged" and int(number) < before):
                files.delete(status.getPath(), True)
    return write


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, drain: bool,
             mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def start_hourly(orders: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS,
                 drain: bool = True, distinct: str | None = None, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Run the trend; ``drain`` processes what is there and stops."""
    return _started(hourly_trend(orders, lateness, distinct),
                    keep_updates(path, ["hour_start", "location_name"], merge_every), checkpoint, drain, "update")


def start_upsert(stream: DataFrame, store: SilverStore, table: str, keys: list[str], checkpoint: str,
                 latest: str | None = None, drain: bool = True, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Add every micro-batch to a stored table, once even if it is replayed; the table's files are
    rewritten only when ``merge_every`` batches have come together."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        store.append(table, batch, keys, checkpoint, batch_id, latest)
        if len(store.state().tables[table].deltas) >= merge_every:
            store.compact(table)
    return _started(stream, merge, checkpoint, drain)


def start_exports(spark: SparkSession, kind: str, folder: str, rows_of: Callable[[DataFrame], SourceRows],
                  store: SilverStore, set_aside: str, checkpoint: str, drain: bool = True,
                  files_per_batch: int = 100) -> StreamingQuery:
    """Take in export files (one record per line) as they arrive in ``folder``.

    Every micro-batch passes the validation of its record kind. Records that fit go through ``rows_of`` into
    the store's orders, items and payments; the others are written to ``set_aside`` with their
    file, text and problems, and stop nothing. A replayed batch changes nothing.
    """
    def take(batch: DataFrame, batch_id: int) -> None:
        checked = batch.withColumn("problems", problems_of(batch, kind)).persist()
        try:
            bad = checked.filter(F.size("problems") > 0)
            text = F.coalesce("_corrupt_record", F.to_json(F.struct(*[
                c for c in batch.columns if c not in ("seq", "file", "_corrupt_record")])))
            bad.select("file", text.alias("record"), "problems").write.mode("overwrite").parquet(
                f"{set_aside}/batch={batch_id}")
            rows = rows_of(checked.filter(F.size("problems") == 0).drop("problems", "_corrupt_record"))
            for table, df in (("orders", rows.orders), ("order_items", rows.items), ("payments", rows.payments)):
                store.append(table, conform(df, table).select(*SCHEMAS[table]), ["id"], f"{checkpoint}/{table}", batch_id)
        finally:
            checked.unpersist()
    return _started(stream_records(spark, kind, folder, files_per_batch), take, checkpoint, drain)


def set_aside_counts(spark: SparkSession, set_aside: str) -> DataFrame:
    """(path, message, records): the problems of records that were set aside; a record counts once."""
    found = spark.read.parquet(set_aside)
    problem: Column = F.explode("problems").alias("p")
    return found.select("file", "record", problem).groupBy("p.path", "p.message").agg(
        F.count(F.lit(1)).alias("records"))
