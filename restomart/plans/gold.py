"""Eight analytics marts over silver.

Sums run on whole cents and become dollars after aggregation, so the aggregates stay on
long buffers. Distinct order counts never use ``count(distinct)``, which would expand the
input once per distinct group: order marts count rows (``orders.id`` is a key, checked by
``operators.quality``), item marts first reduce to one row per order and key.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.fixed_values import COMPLETED_STATUSES, SOURCES, TAKEOUT_TYPES
from restomart.functions.money_time import (
    dollars, fee_dollars, local_clock, mean_dollars, weekday_name, weekday_number,
)
from restomart.sources.silver import Silver


@dataclass(frozen=True)
class Scope:
    """Optional filters, applied at the scan. ``date_to`` is inclusive."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    location: str | None = None

    def on_time(self, df: DataFrame, column: str = "created_at") -> DataFrame:
        # Stored orders lie in date folders; one day of slack covers any session time zone.
        folders = "order_date" in df.columns and column == "created_at"
        day = dt.timedelta(days=1)
        if self.date_from is not None:
            df = df.filter(F.col(column) >= F.lit(self.date_from))
            if folders:
                df = df.filter(F.col("order_date") >= F.lit(self.date_from - day))
        if self.date_to is not None:
            df = df.filter(F.col(column) < F.lit(self.date_to + day))
            if folders:
                df = df.filter(F.col("order_date") <= F.lit(self.date_to + day))
        return df

    def on_place(self, df: DataFrame, column: str = "location_name") -> DataFrame:
        if self.location is not None:
            df = df.filter(F.col(column).ilike(f"%{self.location}%"))
        return df


ALL = Scope()


def is_completed() -> Column:
    return F.col("status").isin(COMPLETED_STATUSES)


def completed_orders(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    """Completed orders with their location, money still in cents."""
    places = s.locations.select(
        F.col("id").alias("_place"), F.col("name").alias("location_name"), "timezone")
    orders = s.orders.filter(is_completed())
    if not local_time:
        orders = scope.on_time(orders)
    joined = orders.join(places, F.col("location_id") == F.col("_place"), "left")
    clock = local_clock("created_at", "timezone" if local_time else None)
    if local_time:
        joined = joined.withColumn("_clock", clock)
        joined = scope.on_time(joined, "_clock").drop("_clock")
    return scope.on_place(
        joined.withColumns({"clock": clock, "order_date": F.to_date(clock)})
    )


def gold_orders(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    pretax = (F.col("total_cents") - F.coalesce("tax_cents", F.lit(0))
              - F.coalesce("tip_cents", F.lit(0)))
    return completed_orders(s, scope, local_time).select(
        F.col("id").alias("order_id"), "source", "source_order_id", "channel", "order_type",
        "status", "created_at", "closed_at", "order_date",
        F.hour("clock").alias("order_hour"),
        weekday_number("clock").alias("day_of_week"),
        weekday_name("clock").alias("day_name"),
        F.col("_place").alias("location_id"), "location_name", "timezone",
        dollars("subtotal_cents").alias("subtotal"),
        dollars("tax_cents").alias("tax"),
        dollars("tip_cents").alias("tip"),
        dollars("total_cents").alias("total"),
        fee_dollars("delivery_fee_cents").alias("delivery_fee"),
        fee_dollars("service_fee_cents").alias("service_fee"),
        fee_dollars("commission_cents").alias("commission"),
        dollars(pretax).alias("pretax_total"),
        "contains_alcohol", "is_catering",
    )


def _catalog(s: Silver) -> DataFrame:
    kinds = s.categories.select(F.col("id").alias("_kind"), F.col("name").alias("category_name"))
    return (
        s.products.select(F.col("id").alias("_product"), F.col("name").alias("product_name"),
                          "category_id")
        .join(kinds, F.col("category_id") == F.col("_kind"), "left")
        .drop("_kind", "category_id")
    )


def gold_order_items(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    labels = s.product_variations.select(
        F.col("id").alias("_label"), F.col("name").alias("variation_name"), "variation_type")
    orders = completed_orders(s, scope, local_time).select(
        F.col("id").alias("_order"), F.col("created_at").alias("order_created_at"), "order_date",
        F.hour("clock").alias("order_hour"), "source", "channel", "order_type", "location_name")
    # The order join comes last and is inner: the status filter rejects items without an order.
    return (
        s.order_items
        .join(_catalog(s), F.col("product_id") == F.col("_product"), "left")
        .join(labels, F.col("variation_id") == F.col("_label"), "left")
        .join(orders, F.col("order_id") == F.col("_order"))
        .select(
            F.col("id").alias("order_item_id"), "order_id",
            F.col("original_name").alias("raw_item_name"),
            F.col("_product").alias("product_id"), "product_name", "category_name",
            F.col("_label").alias("variation_id"), "variation_name", "variation_type",
            "quantity",
            dollars("unit_price_cents").alias("unit_price"),
            dollars("total_price_cents").alias("total_price"),
            dollars("tax_cents").alias("item_tax"),
            "modifiers", "special_instructions",
            "order_created_at", "order_date", "order_hour", "source", "channel", "order_type",
            "location_name",
        )
    )


def _rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _sum_where(condition: Column, value: str) -> Column:
    return F.sum(F.when(condition, F.col(value)).otherwise(0))


def _order_type_is(kind: str) -> Column:
    column = F.col("order_type")
    return column.isin(TAKEOUT_TYPES) if kind == "takeout" else column == kind


ORDER_TYPE_GROUPS = ["dine_in", "delivery", "takeout"]


def gold_daily_sales(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    by_type = {k: _order_type_is(k) for k in ORDER_TYPE_GROUPS}
    by_source = {k: F.col("source") == k for k in SOURCES}
    aggs = [F.count(F.lit(1)).alias("order_count"), F.sum("total_cents").alias("revenue"),
            F.count("total_cents").alias("_n")]
    for split in (by_type, by_source):
        aggs += [_rows_where(c).alias(f"{k}_orders") for k, c in split.items()]
        aggs += [_sum_where(c, "total_cents").alias(f"{k}_revenue") for k, c in split.items()]
    fee = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    aggs += [F.sum("tip_cents").alias("total_tips"),
             fee("delivery_fee_cents").alias("total_delivery_fees"),
             fee("commission_cents").alias("total_commission"),
             F.sum("tax_cents").alias("total_tax")]
    money = lambda names: [dollars(n, total=True).alias(n) for n in names]
    return (
        completed_orders(s, scope, local_time).groupBy("location_name", "order_date").agg(*aggs)
        .select(
            "location_name", "order_date", "order_count", *money(["revenue"]),
            mean_dollars("revenue", "_n").alias("avg_order_value"),
            *[f"{k}_orders" for k in by_type], *money([f"{k}_revenue" for k in by_type]),
            *[f"{k}_orders" for k in by_source], *money([f"{k}_revenue" for k in by_source]),
            *money(["total_tips", "total_delivery_fees", "total_commission", "total_tax"]),
        )
    )


def gold_hourly_trends(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    # The weekday follows from the date, so it is derived after grouping.
    return (
        completed_orders(s, scope, local_time)
        .groupBy("location_name", "order_date", F.hour("clock").alias("order_hour"))
        .agg(
            F.count(F.lit(1)).alias("orders"), F.sum("total_cents").alias("_revenue"),
            F.count("total_cents").alias("_n"), F.sum("tip_cents").alias("_tips"),
            *[_rows_where(F.col("channel") == c).alias(f"{c}_orders")
              for c in ("pos", "online", "delivery_app")],
        )
        .select(
            "location_name", "order_date", "order_hour",
            weekday_number("order_date").alias("day_of_week"),
            weekday_name("order_date").alias("day_name"), "orders",
            dollars("_revenue", total=True).alias("revenue"),
            mean_dollars("_revenue", "_n").alias("avg_order_value"),
            dollars("_tips", total=True).alias("tips"),
            "pos_orders", "online_orders", "delivery_app_orders",
        )
    )


def sold_items(s: Silver, scope: Scope, named: str, local_time: bool = False) -> DataFrame:
    """Item lines of completed orders, in cents, with product and order attributes.

    Products join first (a dimension, broadcast by its size), orders last, so after a
    shuffled join the rows are still partitioned by order for the per-order reduction.
    """
    orders = completed_orders(s, scope, local_time).select(
        F.col("id").alias("_order"), "created_at", "source", "order_type", "location_name")
    lines = s.order_items.select(
        "order_id", "product_id", "quantity", "unit_price_cents", "total_price_cents")
    return (
        lines.join(_catalog(s).filter(F.col(named).isNotNull()),
                   F.col("product_id") == F.col("_product"))
        .join(orders, F.col("order_id") == F.col("_order"))
    )


def _line_sums() -> list[Column]:
    return [F.sum("quantity").alias("units"), F.sum("total_price_cents").alias("revenue"),
            F.sum("unit_price_cents").alias("prices"),
            F.count("unit_price_cents").alias("lines")]


def _add_up(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


UNIT_GROUPS = [f"{k}_units" for k in ORDER_TYPE_GROUPS]


def _product_location(s: Silver, scope: Scope, local_time: bool) -> DataFrame:
    """Sums per product, category and location; an order counts once per key."""
    keys = ["product_name", "category_name", "location_name"]
    units = [F.sum(F.when(_order_type_is(k), F.col("quantity")).otherwise(0)).alias(f"{k}_units")
             for k in ORDER_TYPE_GROUPS]
    per_order = (
        sold_items(s, scope, "product_name", local_time).groupBy("order_id", *keys)
        .agg(*_line_sums(), *units, F.min("created_at").alias("first_sale"),
             F.max("created_at").alias("last_sale"))
    )
    return per_order.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders_containing"),
        *_add_up("units", "revenue", "prices", "lines", *UNIT_GROUPS),
        F.min("first_sale").alias("first_sale"), F.max("last_sale").alias("last_sale"))


def gold_product_by_location(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    return _product_location(s, scope, local_time).select(
        "product_name", "category_name", "location_name", "orders_containing",
        F.col("units").alias("total_units_sold"),
        dollars("revenue", total=True).alias("total_revenue"),
        mean_dollars("prices", "lines").alias("avg_unit_price"), *UNIT_GROUPS)


def gold_product_performance(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    # An order has one location, so per-location order counts add up to the product's.
    return (
        _product_location(s, scope, local_time).groupBy("product_name", "category_name")
        .agg(*_add_up("orders_containing", "units", "revenue", "prices", "lines", *UNIT_GROUPS),
             F.count("location_name").alias("locations_sold_at"),
             F.min("first_sale").alias("first_sale"), F.max("last_sale").alias("last_sale"))
        .select(
            "product_name", "category_name", "orders_containing",
            F.col("units").alias("total_units_sold"),
            dollars("revenue", total=True).alias("total_revenue"),
            mean_dollars("prices", "lines").alias("avg_unit_price"),
            "locations_sold_at", *UNIT_GROUPS, "first_sale", "last_sale")
    )


def gold_category_performance(s: Silver, scope: Scope = ALL, local_time: bool = False) -> DataFrame:
    keys = ["category_name", "location_name"]
    sold = sold_items(s, scope, "category_name", local_time)
    by_source = [F.sum(F.when(F.col("source") == k, F.col("total_price_cents")).otherwise(0))
                 .alias(f"{k}_revenue") for k in SOURCES]
    revenue_names = [f"{k}_revenue" for k in SOURCES]
    sums = ["units", "revenue", "prices", "lines", *revenue_names]
    # An order's few product names travel with its sums; spread out again, its sums and its count go to
    # the first, so one reduction gives the order counts and the variety.
    per_order = sold.groupBy("order_id", *keys).agg(
        *_line_sums(), *by_source, F.sort_array(F.collect_set("product_name")).alias("_names"))
    spread = per_order.select(*keys, *sums, F.posexplode_outer("_names").alias("_at", "product_name"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    per_product = spread.groupBy(*keys, "product_name").agg(
        F.count_if(first).alias("orders_containing"), *[F.sum(F.when(first, F.col(n))).alias(n) for n in sums])
    totals = per_product.groupBy(*keys).agg(
        F.count("product_name").alias("products_in_category"), *_add_up("orders_containing", *sums))
    return totals.select(
        *keys, "products_in_category", "orders_containing",
        F.col("units").alias("total_units_sold"),
        dollars("revenue", total=True).alias("total_revenue"),
        mean_dollars("prices", "lines").alias("avg_item_price"),
        *[dollars(n, total=True).alias(n) for n in revenue_names])


def gold_payments(s: Silver, scope: Scope = ALL) -> DataFrame:
    orders = s.orders.filter(is_completed()).select(F.col("id").alias("_order"), "location_id")
    places = s.locations.select(F.col("id").alias("_place"), F.col("name").alias("location_name"))
    paid = (
        scope.on_time(s.payments).select(
            "order_id", "payment_type", "card_brand", F.to_date("created_at").alias("payment_date"),
            "amount_cents", "tip_cents", "processing_fee_cents")
        .join(orders, F.col("order_id") == F.col("_order"))
        .join(places, F.col("location_id") == F.col("_place"))
    )
    return (
        scope.on_place(paid)
        .groupBy("payment_type", "card_brand", "location_name", "payment_date")
        .agg(F.count(F.lit(1)).alias("payment_count"), F.sum("amount_cents").alias("_amount"),
             F.count("amount_cents").alias("_n"), F.sum("tip_cents").alias("_tips"),
             F.sum("processing_fee_cents").alias("_fees"))
        .select(
            "payment_type", "card_brand", "location_name", "payment_date", "payment_count",
            dollars("_amount", total=True).alias("total_amount"),
            dollars("_tips", total=True).alias("total_tips"),
            mean_dollars("_amount", "_n").alias("avg_payment_amount"),
            dollars("_fees", total=True).alias("total_processing_fees"))
    )


MARTS = {
    f.__name__: f for f in (
        gold_orders, gold_order_items, gold_daily_sales, gold_product_performance,
        gold_hourly_trends, gold_category_performance, gold_product_by_location, gold_payments)
}


def register_marts(spark: SparkSession, s: Silver, materialize: bool = False) -> None:
    """Expose silver and the marts to SQL text; ``materialize`` stores the marts as tables."""
    from restomart.sources.silver import register

    register(spark, s.tables())
    for name, build in MARTS.items():
        if materialize:
            build(s).write.mode("overwrite").saveAsTable(name)
        else:
            build(s).createOrReplaceTempView(name)
