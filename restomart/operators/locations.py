"""Unified locations and the map from any source's id to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.fixed_values import DEFAULT_TIMEZONE


def stable_id(*parts) -> Column:
    """The same key on every run: a hash of the natural key."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def build_locations(config: DataFrame, square_locations: DataFrame) -> DataFrame:
    square = square_locations.select(
        F.col("id").alias("_sid"), F.col("timezone").alias("_tz"),
        F.col("address").alias("_address"),
        F.to_json(F.struct("id", "name", "address", "timezone", "status", "type", "merchant_id"))
        .alias("_raw"))
    a = F.col("_address")
    address = F.struct(
        a["address_line_1"].alias("line1"), a["locality"].alias("city"),
        a["administrative_district_level_1"].alias("state"), a["postal_code"].alias("zip"),
        a["country"].alias("country"))
    return (
        config.join(square, F.col("square_id") == F.col("_sid"), "left")
        .select(
            stable_id("location", F.col("name")).alias("id"), "name",
            F.when(F.col("_sid").isNotNull(), address).alias("address"),
            F.coalesce("_tz", F.lit(DEFAULT_TIMEZONE)).alias("timezone"),
            "toast_id", "doordash_id", "square_id",
            F.to_json(F.struct("name", "toast_id", "doordash_id", "square_id",
                               F.col("_raw").alias("square_location"))).alias("raw_data"))
    )


def location_xref(locations: DataFrame) -> DataFrame:
    """(key, location_id): any source id or the name; on a clash the later id wins."""
    keys = F.array("toast_id", "doordash_id", "square_id", "name")
    return (locations.select(F.col("id").alias("location_id"), F.explode(keys).alias("key"))
            .filter(F.col("key").isNotNull())
            .groupBy("key").agg(F.max("location_id").alias("location_id")))
