"""Ready-made questions over the marts. Every function takes silver and an optional scope."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restomart.fixed_values import BEVERAGE_PATTERN, PAYMENT_TYPES, SOURCES
from restomart.functions.money_time import dollars, mean_dollars
from restomart.plans.gold import (
    ALL, Scope, sold_items, completed_orders, gold_daily_sales, gold_hourly_trends, gold_order_items,
    gold_payments, gold_product_by_location, gold_product_performance,
)
from restomart.sources.silver import Silver


def data_range(s: Silver) -> DataFrame:
    """First and last order time over all orders."""
    return s.orders.agg(F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def distinct_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct().orderBy("name")


def beverage_categories(categories: DataFrame, pattern: str = BEVERAGE_PATTERN) -> DataFrame:
    return categories.filter(F.col("name").rlike(f"(?i){pattern}"))


def products_in(s: Silver, categories: DataFrame) -> DataFrame:
    """Products of the given categories."""
    return s.products.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")


# Relative periods count from the last (or first) day that has orders, not from today.
_PERIODS = {
    "last_day": lambda lo, hi: (hi, hi),
    "yesterday": lambda lo, hi: (F.date_sub(hi, 1), F.date_sub(hi, 1)),
    "last_week": lambda lo, hi: (F.date_sub(hi, 6), hi),
    "this_month": lambda lo, hi: (F.trunc(hi, "month"), hi),
    "first_week": lambda lo, hi: (lo, F.date_add(lo, 6)),
    "first_month": lambda lo, hi: (F.trunc(lo, "month"), F.last_day(lo)),
}
PERIODS = sorted(_PERIODS)


def _bounds(s: Silver, period: str):
    span = data_range(s)
    lo, hi = _PERIODS[period](F.to_date("earliest"), F.to_date("latest"))
    return span.select(lo.alias("d")).scalar(), span.select(hi.alias("d")).scalar()


def near_period(s: Silver, period: str) -> Silver:
    """The same tables with only the stored date folders of the period, a day wider on either side
    since stored dates and report dates may lie in different time zones."""
    if "order_date" not in s.orders.columns:
        return s
    first, last = _bounds(s, period)
    near = F.col("order_date").between(F.date_sub(first, 1), F.date_add(last, 1))
    return s.with_tables(orders=s.orders.filter(near))


def in_period(df: DataFrame, s: Silver, period: str, column: str = "order_date") -> DataFrame:
    """Keep rows of a named period; its bounds come from a scalar subquery over the orders."""
    first, last = _bounds(s, period)
    return df.filter(F.col(column).between(first, last))


def _total_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(dollars(F.sum("total_cents"), total=True).alias("revenue"))


def sales_by_location(s: Silver, scope: Scope = ALL) -> DataFrame:
    return _total_by(completed_orders(s, scope), "location_name").orderBy("location_name")


def revenue_on(s: Silver, day: dt.date) -> DataFrame:
    return _total_by(completed_orders(s, Scope(day, day)), "order_date")


def revenue_in(s: Silver, period: str) -> DataFrame:
    daily = in_period(gold_daily_sales(near_period(s, period)), s, period)
    return (daily.groupBy("order_date").agg(F.sum("revenue").alias("revenue"))
            .orderBy("order_date"))


def top_items(s: Silver, n: int = 10, scope: Scope = ALL) -> DataFrame:
    """Best sellers by units; ties by name."""
    return (
        gold_product_performance(s, scope)
        .groupBy("product_name").agg(F.sum("total_units_sold").alias("units"),
                                     F.sum("total_revenue").alias("revenue"))
        .orderBy(F.desc("units"), "product_name").limit(n)
    )


def top_products(s: Silver, n: int = 5, scope: Scope = ALL) -> DataFrame:
    return (
        gold_product_performance(s, scope)
        .select("product_name", "category_name", "total_revenue")
        .orderBy(F.desc("total_revenue"), "product_name", "category_name").limit(n)
    )


def compare_locations(s: Silver, first: str, second: str, scope: Scope = ALL) -> DataFrame:
    wanted = F.col("location_name").ilike(f"%{first}%") | F.col("location_name").ilike(f"%{second}%")
    return (
        completed_orders(s, scope).filter(wanted).groupBy("location_name")
        .agg(F.count(F.lit(1)).alias("order_count"),
             dollars(F.sum("total_cents"), total=True).alias("revenue"),
             mean_dollars(F.sum("total_cents"), F.count("total_cents")).alias("avg_order_value"))
        .orderBy("location_name")
    )


def location_ranking(s: Silver, scope: Scope = ALL) -> DataFrame:
    """All locations with their revenue, best first."""
    return (_total_by(completed_orders(s, scope), "location_name")
            .orderBy(F.desc("revenue"), "location_name"))


def hourly_sales(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_hourly_trends(s, scope).groupBy("order_hour")
            .agg(F.sum("revenue").alias("revenue")).orderBy("order_hour"))


def first_week_revenue(s: Silver) -> DataFrame:
    return revenue_in(s, "first_week")


def top_items_at(s: Silver, location: str, n: int = 10) -> DataFrame:
    return (
        gold_product_by_location(s, Scope(location=location))
        .select("product_name", "category_name", "location_name", "total_units_sold",
                "total_revenue")
        .orderBy(F.desc("total_units_sold"), "product_name", "category_name", "location_name")
        .limit(n)
    )


def beverage_sales(s: Silver, scope: Scope = ALL, pattern: str = BEVERAGE_PATTERN) -> DataFrame:
    drinks = (s.categories.filter(F.col("name").rlike(f"(?i){pattern}"))
              .select(F.col("name").alias("category_name")))
    return (
        sold_items(s, scope, "category_name").join(drinks, "category_name", "left_semi")
        .groupBy("location_name").agg(dollars(F.sum("total_price_cents"), total=True).alias("revenue"))
        .orderBy(F.desc("revenue"), "location_name")
    )


def category_ranking(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (sold_items(s, scope, "category_name").groupBy("category_name")
            .agg(dollars(F.sum("total_price_cents"), total=True).alias("revenue"))
            .orderBy(F.desc("revenue"), "category_name"))


def delivery_vs_dine_in(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (completed_orders(s, scope).filter(F.col("order_type").isin("delivery", "dine_in"))
            .groupBy("order_type")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 dollars(F.sum("total_cents"), total=True).alias("revenue"))
            .orderBy("order_type"))


def source_revenue(s: Silver, source: str, scope: Scope = ALL) -> DataFrame:
    return _total_by(completed_orders(s, scope).filter(F.col("source") == source), "source")


def source_mix(s: Silver, scope: Scope = ALL) -> DataFrame:
    """Revenue per source and its share of the whole."""
    per_source = completed_orders(s, scope).groupBy("source").agg(
        F.sum("total_cents").alias("cents"))
    whole = F.sum("cents").over(Window.partitionBy())  # one row per source
    return per_source.select(
        "source", dollars("cents", total=True).alias("revenue"),
        (F.col("cents").cast("double") / whole.cast("double")).alias("share"),
    ).orderBy(F.desc("revenue"), "source")


def takeout_by_location(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_daily_sales(s, scope).groupBy("location_name")
            .agg(F.sum("takeout_orders").alias("takeout_orders")).orderBy("location_name"))


def peak_hours(s: Silver, scope: Scope = ALL, n: int = 1) -> DataFrame:
    """Busiest hours per location: most orders first, earlier hour on ties."""
    per_hour = gold_hourly_trends(s, scope).groupBy("location_name", "order_hour").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
    order = Window.partitionBy("location_name").orderBy(F.desc("orders"), "order_hour")
    return (per_hour.withColumn("peak_rank", F.row_number().over(order))
            .filter(F.col("peak_rank") <= n).orderBy("location_name", "peak_rank"))


def order_value_by_channel(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (completed_orders(s, scope).groupBy("channel")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 mean_dollars(F.sum("total_cents"), F.count("total_cents")).alias("avg_order_value"))
            .orderBy("channel"))


def delivery_trend(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_daily_sales(s, scope).groupBy("order_date")
            .agg(F.sum("delivery_orders").alias("delivery_orders")).orderBy("order_date"))


def payment_methods(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_payments(s, scope).groupBy("payment_type")
            .agg(F.sum("payment_count").alias("payment_count"))
            .orderBy(F.desc("payment_count"), "payment_type"))


def card_brands(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_payments(s, scope).filter(F.col("card_brand").isNotNull()).groupBy("card_brand")
            .agg(F.sum("payment_count").alias("payment_count"))
            .orderBy(F.desc("payment_count"), "card_brand"))


def pivot_to_columns(df: DataFrame, rows: str, columns: str, values: list[str],
                     measure: Column) -> DataFrame:
    """Second dimension as columns, zero where empty; the values are named up front, so the
    plan needs no extra pass to find them."""
    wide = df.groupBy(rows).pivot(columns, values).agg(measure)
    return wide.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


def payment_type_by_source(s: Silver, scope: Scope = ALL) -> DataFrame:
    """Payments of all orders, whatever their status."""
    orders = s.orders.select(F.col("id").alias("_order"), "source")
    paid = scope.on_time(s.payments).join(orders, F.col("order_id") == F.col("_order"))
    return pivot_to_columns(paid, "source", "payment_type", PAYMENT_TYPES,
                            F.count(F.lit(1))).orderBy("source")


WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def hourly_by_weekday(s: Silver, days: tuple[str, ...] = ("friday", "saturday"),
                      scope: Scope = ALL) -> DataFrame:
    hours = gold_hourly_trends(s, scope)
    sums = [F.sum(F.when(F.col("day_of_week") == WEEKDAYS.index(d), F.col("revenue")).otherwise(0))
            .cast("decimal(20,2)").alias(f"{d}_sales") for d in days]
    return hours.groupBy("order_hour").agg(*sums).orderBy("order_hour")


def orders_by_location_over_time(s: Silver, names: list[str], scope: Scope = ALL) -> DataFrame:
    return pivot_to_columns(gold_daily_sales(s, scope), "order_date", "location_name", names,
                            F.sum("order_count")).orderBy("order_date")


def category_by_source(s: Silver, scope: Scope = ALL) -> DataFrame:
    lines = gold_order_items(s, scope).filter(F.col("category_name").isNotNull())
    return pivot_to_columns(lines, "category_name", "source", SOURCES,
                            F.sum("total_price").cast("decimal(20,2)")).orderBy("category_name")


def hourly_orders(s: Silver, scope: Scope = ALL) -> DataFrame:
    return (gold_hourly_trends(s, scope).groupBy("order_hour")
            .agg(F.sum("orders").alias("orders")).orderBy("order_hour"))
