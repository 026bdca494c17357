"""Silver tables derived from a star-schema dataset (orders, lineitem, part, ...)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.fixed_values import DEFAULT_TIMEZONE
from restomart.sources.silver import Silver

# Star-schema codes -> silver codes.
ORDER_TYPE_BY_PRIORITY = {
    "1-URGENT": "delivery", "2-HIGH": "pickup", "3-MEDIUM": "dine_in",
    "4-NOT SPECIFIED": "takeout", "5-LOW": "dine_in",
}
CHANNEL_BY_SEGMENT = {
    "AUTOMOBILE": "delivery_app", "BUILDING": "online", "FURNITURE": "third_party",
    "HOUSEHOLD": "pos", "MACHINERY": "pos",
}
STATUS_BY_FLAG = {"F": "completed", "O": "delivered", "P": "cancelled"}
SOURCE_BY_REMAINDER = {0: "toast", 1: "doordash", 2: "square"}
PAYMENT_BY_REMAINDER = {0: "credit", 1: "cash", 2: "wallet", 3: "platform", 4: "other"}
BRAND_BY_REMAINDER = {0: "visa", 1: "mastercard", 2: "amex"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(column, mapping: dict):
    """CASE over a small fixed mapping; null where nothing matches."""
    expr = None
    for key, value in mapping.items():
        expr = F.when(column == key, value) if expr is None else expr.when(column == key, value)
    return expr


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    total = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "orders")
        .select(
            key.alias("id"), "o_custkey", "o_orderpriority", "o_orderstatus",
            total.alias("total_cents"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=key % 24)).alias("created_at"),
            F.when(key % 7 != 0, F.expr("cast(round(o_totalprice * 100) as bigint) * 8 div 100"))
            .alias("tax_cents"),
            F.when(key % 5 != 0, total % 1000).alias("tip_cents"),
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _order_facts(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    key, total = F.col("id"), F.col("total_cents")
    delivery = key % 3 == 1
    return facts.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "id",
        lookup(key % 3, SOURCE_BY_REMAINDER).alias("source"),
        key.cast("string").alias("source_order_id"),
        F.when(key % 97 != 0, F.col("c_nationkey")).alias("location_id"),
        lookup(F.col("o_orderpriority"), ORDER_TYPE_BY_PRIORITY).alias("order_type"),
        lookup(F.col("c_mktsegment"), CHANNEL_BY_SEGMENT).alias("channel"),
        lookup(F.col("o_orderstatus"), STATUS_BY_FLAG).alias("status"),
        "created_at",
        (F.col("created_at") + F.expr("interval 45 minutes")).alias("closed_at"),
        (total - F.coalesce("tax_cents", F.lit(0)) - F.coalesce("tip_cents", F.lit(0)))
        .alias("subtotal_cents"),
        "tax_cents", "tip_cents", "total_cents",
        F.when(delivery, total % 700).alias("delivery_fee_cents"),
        F.when(delivery, total % 500).alias("service_fee_cents"),
        F.when(delivery, F.expr("total_cents * 15 div 100")).alias("commission_cents"),
        F.when(delivery, key % 4 == 0).alias("contains_alcohol"),
        F.when(delivery, key % 8 == 0).alias("is_catering"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, total = F.col("l_partkey"), F.col("total_price_cents")
    base = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.when(~((F.col("l_linenumber") == 7) & (part % 11 == 0)), part).alias("product_id"),
        F.when(F.col("l_linenumber") % 2 == 0, part).alias("variation_id"),
        F.concat(F.lit("item "), part.cast("string")).alias("original_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("total_price_cents"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax_percent"),
        F.when(F.col("l_returnflag") == "R", F.lit("no onions")).alias("special_instructions"),
    )
    return base.select(
        "id", "order_id", "product_id", "variation_id", "original_name", "quantity",
        F.floor(total / F.col("quantity") + 0.5).cast("bigint").alias("unit_price_cents"),
        "total_price_cents",
        F.expr("total_price_cents * tax_percent div 100").alias("tax_cents"),
        F.lit(None).cast("array<struct<name: string, price: bigint, modifier_id: string>>")
        .alias("modifiers"),
        "special_instructions",
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("id"), F.col("o_custkey")
    return _order_facts(spark, sf_dir).filter(key % 10 != 0).select(
        F.concat(F.lit("p"), key.cast("string")).alias("id"),
        key.alias("order_id"),
        F.concat(F.lit("src"), key.cast("string")).alias("source_payment_id"),
        lookup(customer % 5, PAYMENT_BY_REMAINDER).alias("payment_type"),
        F.when(customer % 5 == 0, lookup(customer % 4, BRAND_BY_REMAINDER)).alias("card_brand"),
        F.when(customer % 5 == 0, F.lpad((key % 10000).cast("string"), 4, "0")).alias("last_four"),
        F.col("total_cents").alias("amount_cents"),
        "tip_cents",
        F.when(customer % 2 == 0, F.expr("total_cents * 3 div 100")).alias("processing_fee_cents"),
        (F.col("created_at") + F.expr("interval 1 hour")).alias("created_at"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.lit(DEFAULT_TIMEZONE).alias("timezone"),
        F.concat(F.lit("t"), "n_nationkey").alias("toast_id"),
        F.concat(F.lit("d"), "n_nationkey").alias("doordash_id"),
        F.concat(F.lit("s"), "n_nationkey").alias("square_id"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    return table(spark, sf_dir, "part").select(kind.alias("id"), kind.alias("name")).distinct()


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 50 != 7, F.col("p_type")).alias("category_id"),
        F.col("p_brand").alias("description"),
    )


def product_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product_id"),
        F.concat("p_size", F.lit(" pcs")).alias("name"), F.lit("quantity").alias("variation_type"),
    )


def product_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product_id"),
        F.concat("p_brand", F.lit(" "), "p_name").alias("raw_name"), F.lit("square").alias("source"),
    )


def silver_from_star(spark: SparkSession, sf_dir: str) -> Silver:
    builders = (locations, categories, products, product_variations, product_aliases, orders,
                order_items, payments)
    return Silver(**{b.__name__: partial(b, spark, sf_dir) for b in builders})
