"""Readers of the source exports: one row per record, typed, never inferred.

``layout="document"`` reads whole JSON documents with the records in an array (one task per
file); ``layout="lines"`` reads one record per line and splits large files. Each row keeps
where it came from in ``seq``: first-seen order is the file and the position in it for
documents, and for lines the given order column and id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.session import stored
from restomart.sources.export_specs import RECORDS, ddl_schema, ddl_type

CORRUPT = "_corrupt_record"
SEQ = "struct<place: string, position: bigint, id: string>"

# Column that orders records of line files, and the record's id.
LINE_ORDER = {
    "toast_orders": ("openedDate", "guid"), "doordash_orders": ("created_at", "external_delivery_id"),
    "square_locations": (None, "id"), "square_catalog": (None, "id"),
    "square_orders": ("created_at", "id"), "square_payments": ("created_at", "id"),
}


def seq_of(place: Column, position: Column, key: Column) -> Column:
    return F.struct(place.alias("place"), position.alias("position"), key.alias("id")).cast(SEQ)


def read_records(spark: SparkSession, kind: str, path: str, layout: str = "document",
                 keep_corrupt: bool = False) -> DataFrame:
    spec, array = RECORDS[kind]
    _, key = LINE_ORDER[kind]
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if layout == "lines":
        df = _placed_lines(reader.schema(f"{ddl_schema(spec)}, {CORRUPT} string").json(path), kind)
    else:
        schema = f"`{array}` array<{ddl_type(spec)}>, {CORRUPT} string"
        whole = (reader.schema(schema).option("multiLine", True).json(path)
                 .select(F.col("_metadata.file_path").alias("file"), array, CORRUPT))
        # posexplode_outer keeps a row for a document that did not parse at all.
        rows = whole.select("file", CORRUPT, F.posexplode_outer(array).alias("_pos", "_record"))
        if not keep_corrupt:
            rows = rows.filter(F.col("_record").isNotNull())
        df = rows.select("_record.*", CORRUPT, "file", F.col("_pos")).withColumn(
            "seq", seq_of(F.col("file"), F.col("_pos"), F.col(key))).drop("_pos")
    return df if keep_corrupt else df.drop(CORRUPT)


def _placed_lines(df: DataFrame, kind: str) -> DataFrame:
    order, key = LINE_ORDER[kind]
    place = F.col(order) if order else F.lit("")
    return df.withColumn("seq", seq_of(place, F.lit(0), F.col(key))).withColumn(
        "file", F.col("_metadata.file_path"))


def stream_records(spark: SparkSession, kind: str, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records of line files as they arrive in a folder; a line that does not parse keeps its text."""
    reader = (spark.readStream.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .option("maxFilesPerTrigger", files_per_batch))
    return _placed_lines(reader.schema(f"{ddl_schema(RECORDS[kind][0])}, {CORRUPT} string").json(folder), kind)


def read_toast(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    return read_records(spark, "toast_orders", path, layout)


def read_doordash(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    return read_records(spark, "doordash_orders", path, layout)


@dataclass(frozen=True)
class SquareExport:
    locations: DataFrame
    catalog: DataFrame
    orders: DataFrame
    payments: DataFrame


def read_square(spark: SparkSession, folder: str, layout: str = "document") -> SquareExport:
    return SquareExport(**{
        name: read_records(spark, f"square_{name}", f"{folder}/{name}.json", layout)
        for name in ("locations", "catalog", "orders", "payments")})


@dataclass(frozen=True)
class Exports:
    toast: DataFrame
    doordash: DataFrame
    square: SquareExport


def read_exports(spark: SparkSession, toast: str, doordash: str, square: str,
                 layout: str = "document") -> Exports:
    return Exports(read_toast(spark, toast, layout), read_doordash(spark, doordash, layout),
                   read_square(spark, square, layout))


SQUARE = ("locations", "catalog", "orders", "payments")


def landed(exports: Exports, *names: str) -> Exports:
    """The exports as Parquet in the scratch folder: the documents are parsed once, and each table that is made
    from them reads only the fields it needs. ``names``: those that are read more than once (toast, doordash
    and Square's); without any, all are written."""
    def kept(df: DataFrame | None, name: str) -> DataFrame | None:
        return df if df is None or names and name not in names else stored(df, f"export-{name}")

    square = {n: kept(getattr(exports.square, n), n) for n in SQUARE}
    return Exports(kept(exports.toast, "toast"), kept(exports.doordash, "doordash"), SquareExport(**square))
