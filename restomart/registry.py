"""Registered queries over a star-schema folder, keyed by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restomart import fixed_values as V
from restomart.functions import codes
from restomart.functions.names import NameConfig, match_key, normalize_label, rule_match
from restomart.functions.text import (
    edit_distance, header_label, is_proper_case, normalize_category, normalize_product_name,
    strip_diacritics,
)
from restomart.operators import catalog as C
from restomart.operators import orders as O
from restomart.operators import quality as Q
from restomart.operators import shape
from restomart.operators.fuzzy import dense_rank_rows, near_pairs
from restomart.operators.locations import build_locations, location_xref
from restomart.operators.validate import validate_records
from restomart.plans import conversations, gold, query_log, recipes, usage
from restomart.plans.normalize import build_catalog, normalize
from restomart.session import freed_shuffles, shared_path, split_skewed_joins, stored
from restomart.sources import star_exports as X
from restomart.sources.export_specs import RECORDS
from restomart.sources.exports import Exports, SquareExport, landed
from restomart.sources.silver import Silver, conform
from restomart.sources.star_adapter import silver_from_star, table
from restomart.sources.store import SilverStore, load_stats
from restomart.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, decimals as doubles and times as UTC wall clock, so that engines
    print equal values alike."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            columns.append(F.to_json(f"`{field.name}`").alias(field.name))
            continue
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            utc = F.to_utc_timestamp(column, F.current_timezone())
            column = utc.cast("timestamp_ntz").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def on_silver(build: Callable[[Silver], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(silver_from_star(spark, sf_dir)))


DAY = dt.date(1998, 3, 2)
NATIONS = [f"NATION_{i}" for i in range(25)]

MARTS: dict[str, Query] = {name: on_silver(build) for name, build in gold.MARTS.items()}

RECIPES: dict[str, Query] = {name: on_silver(build) for name, build in {
    "r01_sales_by_location": recipes.sales_by_location,
    "r02_revenue_on_date": lambda s: recipes.revenue_on(s, DAY),
    "r02_revenue_yesterday": lambda s: recipes.revenue_in(s, "yesterday"),
    "r02_revenue_last_week": lambda s: recipes.revenue_in(s, "last_week"),
    "r02_revenue_this_month": lambda s: recipes.revenue_in(s, "this_month"),
    "r02_revenue_first_month": lambda s: recipes.revenue_in(s, "first_month"),
    "r03_top_items": recipes.top_items,
    "r03_top_products": recipes.top_products,
    "r04_compare_locations": lambda s: recipes.compare_locations(s, "nation_3", "nation_14"),
    "r05_location_ranking": recipes.location_ranking,
    "r06_hourly_sales": recipes.hourly_sales,
    "r06_hourly_sales_on_day": lambda s: recipes.hourly_sales(s, gold.Scope(DAY, DAY)),
    "r07_first_week_revenue": recipes.first_week_revenue,
    "r08_top_items_at_location": lambda s: recipes.top_items_at(s, "nation_7"),
    "r09_beverage_sales": lambda s: recipes.beverage_sales(s, pattern="promo|economy"),
    "r10_category_ranking": recipes.category_ranking,
    "r11_delivery_vs_dine_in": recipes.delivery_vs_dine_in,
    "r12_source_revenue": lambda s: recipes.source_revenue(s, "doordash"),
    "r12_source_mix": recipes.source_mix,
    "r13_takeout_by_location": recipes.takeout_by_location,
    "r14_peak_hours": recipes.peak_hours,
    "r15_order_value_by_channel": recipes.order_value_by_channel,
    "r16_delivery_trend": recipes.delivery_trend,
    "r17_payment_methods": recipes.payment_methods,
    "r17_card_brands": recipes.card_brands,
    "r18_payment_type_by_source": recipes.payment_type_by_source,
    "r19_hourly_by_weekday": recipes.hourly_by_weekday,
    "r20_orders_by_location_over_time":
        lambda s: recipes.orders_by_location_over_time(s, NATIONS),
    "r21_category_by_source": recipes.category_by_source,
    "r22_hourly_orders": recipes.hourly_orders,
}.items()}


def _star(build: Callable[[SparkSession, str], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(build(spark, sf_dir))


def _xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return location_xref(silver_from_star(spark, sf_dir).locations)


def _toast(spark: SparkSession, sf_dir: str):
    return O.toast_rows(X.toast_documents(spark, sf_dir), _xref(spark, sf_dir), keep_raw=False)


def _doordash(spark: SparkSession, sf_dir: str):
    return O.doordash_rows(X.doordash_documents(spark, sf_dir), _xref(spark, sf_dir), keep_raw=False)


def _square(spark: SparkSession, sf_dir: str):
    return O.square_rows(
        X.square_orders(spark, sf_dir), X.square_payments(spark, sf_dir),
        X.square_catalog(spark, sf_dir), _xref(spark, sf_dir), keep_raw=False)


def _toast_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = O.toast_selections(O.live_toast_orders(X.toast_documents(spark, sf_dir)), "guid")
    return lines.select("guid", "check_no", "line_no",
                        F.col("selection.displayName").alias("name"),
                        F.size("selection.modifiers").alias("modifier_count"))


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [conform(r.orders, "orders") for r in
             (_toast(spark, sf_dir), _doordash(spark, sf_dir), _square(spark, sf_dir))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("source", "order_type", "channel", "status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_cents").alias("total_cents"))


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = landed(Exports(X.toast_documents(spark, sf_dir), X.doordash_documents(spark, sf_dir), SquareExport(
        None, None, X.square_orders(spark, sf_dir), X.square_payments(spark, sf_dir))))
    places = _xref(spark, sf_dir)
    rows = [O.toast_rows(exports.toast, places, keep_raw=False), O.doordash_rows(exports.doordash, places, keep_raw=False),
            O.square_rows(exports.square.orders, exports.square.payments, X.square_catalog(spark, sf_dir), places, keep_raw=False)]
    stack = lambda frames, t: conform(frames[0], t).unionByName(conform(frames[1], t)).unionByName(
        conform(frames[2], t))
    silver = Silver(orders=stack([r.orders for r in rows], "orders"),
                    payments=stack([r.payments for r in rows], "payments"))
    return Q.integrity_report(exports, silver)


RAW_FIELDS = {
    "toast": {"behavior": ("$.diningOption.behavior", "string"), "first_check": ("$.checks[0].amount", "bigint"),
              "first_item": ("$.checks[0].selections[0].displayName", "string")},
    "doordash": {"method": ("$.order_fulfillment_method", "string"), "payout": ("$.merchant_payout", "bigint"),
                 "alcohol": ("$.contains_alcohol", "boolean")},
    "square": {"register": ("$.source.name", "string"), "total": ("$.total_money.amount", "bigint"),
               "first_line": ("$.line_items[0].catalog_object_id", "string")},
}


def _raw(source: str) -> Callable[[SparkSession, str], DataFrame]:
    """Fields of the source's own records, read from what silver's orders keep of them."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        places = _xref(spark, sf_dir)
        orders = {
            "toast": lambda: O.toast_rows(X.toast_documents(spark, sf_dir), places).orders,
            "doordash": lambda: O.doordash_rows(X.doordash_documents(spark, sf_dir), places).orders,
            "square": lambda: O.square_rows(X.square_orders(spark, sf_dir), X.square_payments(spark, sf_dir),
                                            X.square_catalog(spark, sf_dir), places).orders}[source]()
        return O.raw_fields(orders, RAW_FIELDS[source]).select("source_order_id", *RAW_FIELDS[source])
    return build


def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the declared records: DoorDash orders of which some lack a field somewhere."""
    key = F.substring("external_delivery_id", 2, 20).cast("bigint")
    gone = lambda every, name: F.when(key % every != 0, F.col(name)).alias(name)
    item = lambda i: F.when((key % 23 == 0) & (i["quantity"] == 2), i.withField("category", F.lit(None))).otherwise(i)
    docs = X.doordash_documents(spark, sf_dir).withColumns({
        "store_id": gone(29, "store_id"), "dasher_tip": gone(31, "dasher_tip"), "is_catering": gone(37, "is_catering"),
        "delivery_time": gone(2, "delivery_time"), "order_items": F.when(key % 41 != 0, F.transform("order_items", item))})
    found = validate_records(docs, RECORDS["doordash_orders"][0])
    return found.groupBy("path", "message").agg(F.count(F.lit(1)).alias("violations"))


EXPORTS: dict[str, Query] = {name: _star(build) for name, build in {
    "p03_toast_selections": _toast_selections,
    "p07_toast_orders": lambda s, d: _toast(s, d).orders,
    "p10_toast_items": lambda s, d: _toast(s, d).items.drop("seq"),
    "p13_toast_payments": lambda s, d: _toast(s, d).payments,
    "p08_doordash_orders": lambda s, d: _doordash(s, d).orders,
    "p11_doordash_items": lambda s, d: _doordash(s, d).items.drop("seq"),
    "p14_doordash_payments": lambda s, d: _doordash(s, d).payments,
    "p09_square_orders": lambda s, d: _square(s, d).orders,
    "p12_square_items": lambda s, d: _square(s, d).items,
    "p15_square_payments": lambda s, d: _square(s, d).payments,
    "u01_stacked_orders": _stacked,
    "q04_integrity_report": _integrity,
    "s11_validation": _validation,
    **{f"p18_{source}_raw_fields": _raw(source) for source in RAW_FIELDS},
}.items()}


# Names ---------------------------------------------------------------------------------------

def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.raw_names(spark, sf_dir).distinct()


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.name_features(_names(spark, sf_dir), X.STAR_NAMES)
    tidy = df.withColumn("t", normalize_label("pattern_label", X.STAR_NAMES))
    return tidy.select("original_name", "base", "text", F.col("t.label").alias("label"),
                       F.col("t.kind").alias("kind"))


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _names(spark, sf_dir).withColumn("r", rule_match("original_name", X.STAR_NAMES))
    return df.filter(F.col("r").isNotNull()).select("original_name", "r.rule", "r.label")


def _star_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_from_star(spark, sf_dir).products.select(
        F.col("id").alias("product_id"), F.col("id").alias("product_rank"),
        match_key("name", X.STAR_NAMES).alias("product_text"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.name_features(_names(spark, sf_dir), X.STAR_NAMES).select("text").distinct()
    return C.find_products(names, _star_products(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.name_features(_names(spark, sf_dir), X.STAR_NAMES).select(
        F.col("text").alias("probe_text")).distinct()
    index = _star_products(spark, sf_dir).select(F.col("product_text").alias("index_text")).distinct()
    return near_pairs(names, index, 3).select("probe_text", "index_text", "distance").distinct()


def _first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First part per lower-trimmed name."""
    return C.first_spellings(silver_from_star(spark, sf_dir).products, "name", "id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in the order of their first sale."""
    sold = X.raw_names(spark, sf_dir, "l_orderkey", "l_linenumber")
    first = F.struct(F.lit(1), F.struct(F.lit(""), F.col("l_orderkey"), F.col("original_name")),
                     F.lit(0), F.col("l_linenumber")).cast(C.FIRST)
    none = F.lit(None).cast("string")
    return sold.groupBy("original_name").agg(F.min(first).alias("first")).select(
        "first", F.lit("toast").alias("source"), F.col("original_name").alias("source_id"),
        "original_name", none.alias("category_id"), none.alias("description"),
        none.alias("category_name"), F.lit(None).cast(C.NO_VARIATIONS).alias("variations"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assign_groups(_candidates(spark, sf_dir), X.STAR_NAMES).select(
        "original_name", "rank", "group_rank")


def _products(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Grouped names and their products; sold names carry no category here."""
    grouped = C.assign_groups(_candidates(spark, sf_dir), X.STAR_NAMES)
    return grouped, C.build_products(grouped, spark.createDataFrame([], "key string, category_id string"))


def _catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _products(spark, sf_dir)[1].select(
        "product_rank", "name", F.get_json_object("raw_data", "$.item_count").cast("bigint").alias("item_count"))


def _catalog_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, products = _products(spark, sf_dir)
    ranks = products.select(F.col("id").alias("product_id"), "product_rank")
    return C.product_xref(grouped, products).join(ranks, "product_id").select("kind", "key", "product_rank")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as labels of their brand: near spellings become one."""
    names = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("product_id"), F.col("p_partkey").alias("rank"),
        F.lit(0).alias("position"), F.col("p_name").alias("label"), F.lit("size").alias("kind"),
        F.col("p_name").alias("source_raw_name"))
    return C.unify_labels(names).variations.select("product_id", "name", "source_raw_name")


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(F.concat(
        F.lit("\U0001F354 "), "p_type", F.lit("  & "), F.upper("p_brand"), F.lit(" ")).alias("raw"),
        "p_partkey")
    return (raw.withColumn("category", normalize_category("raw")).groupBy("category")
            .agg(F.min("p_partkey").alias("first_part")))


DISH_NAMES = NameConfig(groups=[])


def _label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a rule goes before that of a pattern."""
    return C.name_features(_names(spark, sf_dir), X.STAR_NAMES).select("original_name", "label", "label_kind")


def _ordered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog items and sold names of all sources, numbered by priority of the source and first appearance."""
    found = C.catalog_candidates(X.dish_exports(spark, sf_dir))  # each export is read once
    return dense_rank_rows(found, "first").select("source", "original_name", "category_name", "rank")


def _stepwise(query: Query) -> Query:
    """A query of many steps, of which each frees its shuffle files."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with freed_shuffles(spark):
            return query(spark, sf_dir)
    return run


def _dish_catalog(spark: SparkSession, sf_dir: str):
    return build_catalog(X.dish_exports(spark, sf_dir), DISH_NAMES)  # each export with lines is read once


@_stepwise
def _described_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the first description and category that any of their names has."""
    catalog = _dish_catalog(spark, sf_dir)
    kinds = catalog.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return catalog.products.join(kinds, "category_id", "left").select(
        "name", "description", "category_name", F.get_json_object("raw_data", "$.item_count").cast("bigint").alias("item_count"))


@_stepwise
def _shelf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _dish_catalog(spark, sf_dir)
    names = catalog.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return catalog.labels.variations.join(names, "product_id").select(
        "product_name", "name", "variation_type", "source_raw_name")


def _dish_silver(spark: SparkSession, sf_dir: str, *landing: str) -> Silver:
    return normalize(landed(X.dish_exports(spark, sf_dir), *landing), X.dish_places(spark, sf_dir), DISH_NAMES, keep_raw=False)


# Lines are attached in so many slices of whole orders: ids are long, so a join of all lines writes more than the tables hold.
LINE_SLICES = 8


@_stepwise
def _attached_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sold line with the product, category and variation that were found for its name or catalog id."""
    s = _dish_silver(spark, sf_dir, "toast", "doordash", "orders")
    named = lambda df, key, *columns: df.select(F.col("id").alias(key), *columns)
    products = stored(
        named(s.products, "product_id", F.col("name").alias("product_name"), "category_id")
        .join(named(s.categories, "category_id", F.col("name").alias("category_name")), "category_id", "left")
        .drop("category_id"), "products")
    variations = stored(named(s.product_variations, "variation_id", F.col("name").alias("variation_name"), "variation_type"),
                        "variations")

    def attached(i: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("order_id"), F.lit(LINE_SLICES)) == i
        return (
            s.order_items.filter(mine)
            .join(named(s.orders, "order_id", "source", "source_order_id", "location_id").filter(mine), "order_id")
            .join(named(s.locations, "location_id", F.col("name").alias("location_name")), "location_id")
            .join(products, "product_id", "left")
            .join(variations, "variation_id", "left")
            .select("source", "source_order_id", "location_name", "original_name", "quantity", "total_price_cents",
                    "product_name", "category_name", "variation_name", "variation_type"))

    return reduce(DataFrame.unionByName, [stored(attached(i), "lines") for i in range(LINE_SLICES)])


@_stepwise
def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _dish_silver(spark, sf_dir, "toast", "doordash")
    names = s.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return s.product_aliases.join(names, "product_id").select("source", "raw_name", "product_name")


def _unified_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured locations with what Square's export adds to them."""
    square = X.dish_exports(spark, sf_dir).square.locations
    return build_locations(X.dish_places(spark, sf_dir), square).select(
        "name", "timezone", "toast_id", "doordash_id", "square_id", F.col("address.city").alias("city"),
        F.get_json_object("raw_data", "$.square_location").isNotNull().alias("has_square"))


NAMES: dict[str, Query] = {name: _star(build) for name, build in {
    "n01_name_features": _extracted,
    "n05_find_products": _found,
    "n06_rule_match": _ruled,
    "n11_labels": _labels,
    "n12_near_pairs": _near,
    "n13_product_groups": _grouped,
    "n14_products": _catalog_products,
    "n14_product_keys": _catalog_keys,
    "n16_categories": _categories,
    "n18_label_override": _label_override,
    "u02_candidates": _ordered_candidates,
    "a11_described_products": _described_products,
    "n15_shelf_labels": _shelf_labels,
    "j07_attached_lines": _attached_lines,
    "n17_aliases": _aliases,
    "p16_locations": _unified_places,
    "w01_first_names": _first_names,
}.items()}


# Silver operators, quality, shaping ----------------------------------------------------------

def _order_pairs(s: Silver) -> DataFrame:
    """Orders with their payments, kept orders only."""
    keys = s.orders.select(F.col("id").alias("_o"), "source", "total_cents")
    return s.payments.join(keys, F.col("order_id") == F.col("_o")).groupBy("source").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount_cents").alias("amount_cents"),
        F.sum("total_cents").alias("total_cents"))


def _with_items(s: Silver) -> DataFrame:
    return Q.orders_with_items(s.orders, s.order_items).select("id", "source")


def _places(s: Silver) -> DataFrame:
    """Orders found by the id their source uses for a location."""
    prefix = F.element_at(F.create_map(F.lit("toast"), F.lit("t"), F.lit("doordash"), F.lit("d"),
                                       F.lit("square"), F.lit("s")), F.col("source"))
    orders = s.orders.select("id", F.concat(prefix, F.col("location_id").cast("string")).alias("place"))
    return O.with_location(orders, "place", location_xref(s.locations)).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("orders"))


def _chart(s: Silver) -> DataFrame:
    """Cents to dollars and pie columns on a per-channel result."""
    df = s.orders.groupBy("channel").agg(
        F.sum("total_cents").alias("total_cents"),
        F.count(F.lit(1)).cast("string").alias("order_count"))
    kinds = shape.ColumnKinds(["total_cents", "order_count"], ["channel"])
    return shape.format_for_chart(df, shape.choose_axes(df.columns, kinds, "pie"), kinds)


def _long(s: Silver) -> DataFrame:
    df = s.orders.agg(F.sum("total_cents").alias("total_cents"), F.sum("tip_cents").alias("tip_cents"),
                      F.count(F.lit(1)).alias("order_count"))
    return shape.wide_to_long(df, df.columns)


def _display(s: Silver) -> DataFrame:
    return shape.display_text(s.orders.select("id", "is_catering", "tip_cents", "channel"))


def _deleted(s: Silver) -> DataFrame:
    left = Q.delete_orders(s, s.orders.filter(F.col("status") == "cancelled"))
    return load_stats({"orders": left.orders, "order_items": left.order_items,
                       "payments": left.payments})


def _defaults(s: Silver) -> DataFrame:
    return Q.with_defaults(s.orders, "orders").groupBy("source").agg(
        *[F.sum(c).alias(c) for c in ("tax_cents", "tip_cents", "commission_cents")],
        F.count(F.when(~F.col("is_catering"), 1)).alias("not_catering"))


def _duplicates(s: Silver) -> DataFrame:
    return Q.duplicate_keys(s.product_aliases, ["raw_name", "source"])


OPERATORS: dict[str, Query] = {name: on_silver(build) for name, build in {
    "a09_data_range": recipes.data_range,
    "a10_location_names": lambda s: recipes.distinct_names(s.locations),
    "a10_category_names": lambda s: recipes.distinct_names(s.categories),
    "c03_chart_values": _chart,
    "c05_wide_to_long": _long,
    "c08_display_text": _display,
    "j04_orders_by_place_id": _places,
    "j06_order_payments": _order_pairs,
    "j12_orders_with_items": _with_items,
    "j13_orders_without_payment":
        lambda s: Q.orders_without_payment(s.orders, s.payments).select("id", "source"),
    "p20_location_match":
        lambda s: gold.Scope(location="NATION_2").on_place(s.locations, "name").select("id", "name"),
    "p21_beverage_products": lambda s: recipes.products_in(
        s, recipes.beverage_categories(s.categories, "promo|small")).select("id", "name"),
    "q03_payment_coverage": lambda s: Q.payment_coverage(s.orders, s.payments),
    "q06_duplicate_aliases": _duplicates,
    "q07_orphans": lambda s: Q.reference_rule_counts(s.tables()),
    "q08_row_rules": lambda s: Q.row_rule_counts(s.tables()),
    "q09_defaults": _defaults,
    "q10_cascading_delete": _deleted,
    "s08_load_stats": lambda s: load_stats(s.tables()),
}.items()}


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(F.array(*[F.lit(x) for x in (
            "DINE_IN", "TAKE_OUT", "DELIVERY", "PICKUP", "Curbside", "CARD", "Cash", "AMERICAN_EXPRESS",
            "", "POS", "THIRD_PARTY", "Shop Online")]), (1 + F.col("o_orderkey") % 12).cast("int"))
        .alias("code"))
    return raw.select(
        "o_orderkey", codes.toast_order_type("code").alias("toast_type"),
        codes.toast_channel("code").alias("toast_channel"),
        codes.doordash_order_type("code").alias("doordash_type"),
        codes.square_order_type("code").alias("square_type"),
        codes.square_channel("code").alias("square_channel"),
        codes.payment_type("code").alias("payment"), codes.card_brand("code").alias("brand"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", edit_distance("p_name", "p_type").alias("distance"),
        edit_distance("p_name", "p_type", 9).alias("bounded"),
        is_proper_case("p_name").alias("proper"),
        normalize_product_name(F.concat("p_type", F.lit("  "), "p_name")).alias("clean"),
        F.try_divide("p_retailprice", F.col("p_size") - 11).alias("ratio"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", header_label(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("label"))


def _plain_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_diacritics("text").alias("text"))


def _column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of text columns by their values: numbers, codes such as 3d, flags."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("string").alias("amount"),
        F.concat("l_linenumber", F.lit("d")).alias("code"), F.col("l_returnflag").alias("flag"), "l_partkey")
    kinds = shape.classify(df)
    return spark.createDataFrame([(c, c in kinds.numeric) for c in df.columns], "name string, is_numeric boolean")


SCALARS: dict[str, Query] = {name: _star(build) for name, build in {
    "c01_column_kinds": _column_kinds, "f01_codes": _codes, "f09_text": _distances,
    "f10_plain_letters": _plain_letters, "f24_header_labels": _headers}.items()}


# Conversations, usage, query log, live -------------------------------------------------------

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), "role",
        F.col("text").alias("content"))


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    opened = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return conversations.touched_at(opened, messages)


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn",
        F.when(turn % 3 != 0, F.col("text")).otherwise("  ").alias("partial"),
        F.when(turn % 2 == 0, F.col("text")).otherwise("").alias("streamed"),
        F.when(turn % 5 == 0, '[{"type":"bar"}]').when(turn % 5 == 1, "[]").alias("charts"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    model = F.element_at(F.array(*[F.lit(m[0]) for m in V.MODEL_PRICES]),
                         (1 + (F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("process_id"), F.col("turn").alias("seq"), model.alias("model"),
        F.concat(F.lit("step "), F.col("turn") % 4).alias("label"), size.alias("prompt_tokens"),
        F.when(F.col("turn") % 2 == 0, F.floor(size / 3)).alias("cached_tokens"),
        F.floor(size / 2).alias("completion_tokens"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.call_costs(_calls(spark, sf_dir), usage.price_table(spark))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ["SELECT updated_at, note FROM t -- ", "WITH x AS (SELECT 1) SELECT * FROM x; ",
              "drop table orders ", "SELECT 1; DELETE FROM orders ", " select created_by from log ",
              "Update t SET a = 1; insert into t VALUES (2) "]
    pick = F.element_at(F.array(*[F.lit(x) for x in shapes]),
                        (1 + (F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(pick, F.regexp_replace("text", "[^A-Za-z ]", "")).alias("sql"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers with fences, remarks and semicolons around the statement."""
    word = F.regexp_replace("text", "[^A-Za-z ]", "x")
    fence = F.lit("`" * 3)
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.element_at(F.array(
            F.concat(fence, F.lit("sql\nSELECT '"), word, F.lit("'\nFROM t;\n"), fence),
            F.concat(F.lit("name FROM t WHERE a = '"), word, F.lit("' ;\nNote: "), word),
            F.concat(F.lit("WITH a AS (SELECT 1)\n-- select "), word, F.lit("\nSELECT 2\nExplanation: x")),
            F.concat(F.lit("SELECT 3\n-- note: "), word, F.lit("\nFROM u"))),
            (1 + (F.col("conv_id") + F.col("turn")) % 4).cast("int")).alias("raw"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber")
    return query_log.vote(lines.select(
        F.col("l_orderkey").alias("question_id"), number.alias("candidate_id"),
        F.concat(F.lit("SELECT "), number).alias("sql"),
        F.concat(F.lit('[{"n":'), (F.col("l_quantity") % 3).cast("int"), F.lit("}]")).alias("result"),
        F.when(F.col("l_returnflag") == "R", "failed").alias("error"))).drop("sql")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as live orders: streamed hour by hour, then read back."""
    events = (spark.readStream.schema(table(spark, sf_dir, "events").schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    orders = events.filter(F.col("event_type") == "purchase").select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("place "), F.col("user_id") % 7).alias("location_name"),
        F.round(F.col("value") * 100).cast("bigint").alias("total_cents"))
    out = shared_path(spark, "hourly")
    live.start_hourly(orders, out, shared_path(spark, "hourly-state")).awaitTermination()
    found = live.latest_updates(spark, out, ["hour_start", "location_name"])
    return found.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


def _live_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per place from united hourly sketches, and whether they are within 3 % of an exact count."""
    events = (spark.readStream.schema(table(spark, sf_dir, "events").schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    place = F.concat(F.lit("place "), F.col("user_id") % 7).alias("location_name")
    orders = events.select(F.col("ts").cast("timestamp").alias("created_at"), place,
                           F.lit(0).cast("bigint").alias("total_cents"), "user_id")
    out = shared_path(spark, "hourly-users")
    live.start_hourly(orders, out, shared_path(spark, "hourly-users-state"), distinct="user_id").awaitTermination()
    found = live.distinct_count(live.latest_updates(spark, out, ["hour_start", "location_name"]), "location_name")
    exact = table(spark, sf_dir, "events").groupBy(place).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("distinct_values") - F.col("users")) <= 0.03 * F.col("users")
    return found.join(exact, "location_name").select("location_name", "users", near.alias("within_bound"))


WEEK = 7 * 24 * 3600


def _live_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that come again: 30 minutes later (a repeat) and three weeks later (by then forgotten).
    They arrive week by week."""
    sold = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        F.col("event_id").cast("string").alias("source_order_id"), F.col("ts").cast("timestamp").alias("created_at"))
    later = lambda every, seconds: sold.filter(F.col("source_order_id") % every == 0).withColumn(
        "created_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(seconds)))
    arrived = sold.unionByName(later(3, 1800)).unionByName(later(5, 3 * WEEK)).withColumn("source", F.lit("square"))
    arrived = arrived.withColumn("week", F.floor(F.unix_timestamp("created_at") / WEEK))
    inbox = shared_path(spark, "inbox")
    for week in sorted(r[0] for r in arrived.select("week").distinct().collect()):
        arrived.filter(F.col("week") == week).drop("week").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(arrived.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    out = shared_path(spark, "distinct")
    (live.distinct_orders(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", shared_path(spark, "distinct-state")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out).select(
        "source_order_id", F.col("created_at").cast("timestamp_ntz"))


def _live_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DoorDash exports taken in as line files: some without a store, some with a text for a sum, some torn."""
    docs = X.doordash_documents(spark, sf_dir)
    key = F.substring("external_delivery_id", 2, 20).cast("bigint")
    line = F.to_json(F.struct(*[c for c in docs.columns if c not in ("seq", "file")]))
    line = (F.when(key % 29 == 0, F.regexp_replace(line, '"store_id":"[^"]*",', ""))
            .when(key % 31 == 0, F.regexp_replace(line, '"order_subtotal":[0-9]+', '"order_subtotal":"much"'))
            .when(key % 37 == 0, F.substring(line, 1, 60)).otherwise(line))
    inbox, aside = shared_path(spark, "exports"), shared_path(spark, "set-aside")
    # Packed files are read whole, each by a task, so they are kept small and more of them make a batch.
    docs.select(line.alias("value")).write.option("maxRecordsPerFile", 20_000).text(inbox, compression="gzip")
    store = SilverStore(spark, shared_path(spark, "live-store"))
    places = _xref(spark, sf_dir)
    live.start_exports(spark, "doordash_orders", inbox, lambda good: O.doordash_rows(good, places), store, aside,
                       shared_path(spark, "exports-state")).awaitTermination()
    loaded = store.read("orders").groupBy(F.lit("loaded").alias("outcome"), F.col("order_type").alias("detail")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("total_cents").alias("total_cents"))
    bad = spark.read.parquet(aside).groupBy(
        F.lit("set aside").alias("outcome"),
        F.when(F.size("problems") > 1, "several").otherwise(F.col("problems")[0]["path"]).alias("detail")).agg(
        F.count(F.lit(1)).alias("records")).withColumn("total_cents", F.lit(None).cast("bigint"))
    return loaded.unionByName(bad)


def _stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments saved, then a batch of changed and new ones merged, one added by a stream and replayed; the
    same sums before and after that batch is merged."""
    payments = conform(silver_from_star(spark, sf_dir).payments, "payments")
    store = SilverStore(spark, shared_path(spark, "store"))
    store.save({"payments": payments})
    number = F.col("order_id").cast("bigint")
    changed = payments.filter(number % 50 == 7).withColumn("amount_cents", F.col("amount_cents") + 1)
    new = payments.filter(number % 50 == 9).withColumn("id", F.concat(F.lit("new"), "id"))
    store.upsert({"payments": changed.unionByName(new)})
    added = payments.filter(number % 50 == 7).withColumn("amount_cents", F.lit(5).cast("bigint"))
    for _ in range(2):
        store.append("payments", added, ["id"], "live", 0)
    by = ["payment_type", "created_at"]
    sums = [F.count(F.lit(1)).alias("payments"), F.sum("amount_cents").alias("amount_cents")]
    before = store.read("payments").groupBy(*by).agg(*sums)
    store.compact("payments")
    after = store.read("payments").groupBy(*by).agg(*sums)
    return before.join(after, [*by, "payments", "amount_cents"])


LOGS: dict[str, Query] = {name: _star(build) for name, build in {
    "h01_conversation_list": lambda s, d: conversations.list_conversations(_messages(s, d)),
    "h03_touched_conversations": _touched,
    "h02_conversation_messages":
        lambda s, d: conversations.conversation_messages(_messages(s, d), 7),
    "h04_history_lines": lambda s, d: conversations.history_lines(_messages(s, d)),
    "h05_stored_answers": lambda s, d: conversations.stored_answers(_captured(s, d)),
    "k01_audit": lambda s, d: query_log.audit(_statements(s, d)),
    "k01_offending_keywords": lambda s, d: query_log.offending_keywords(_statements(s, d)),
    "k02_clean_statements": lambda s, d: _answers(s, d).select(
        "conv_id", "turn", query_log.clean_statement("raw").alias("sql")),
    "l01_call_costs": _costs,
    "l02_usage_by_process": lambda s, d: usage.usage_totals(_costs(s, d), "process_id"),
    "l02_usage_by_model": lambda s, d: usage.usage_totals(_costs(s, d), "model"),
    "v01_vote": _votes,
    "w04_running_costs": lambda s, d: usage.running_costs(_costs(s, d)).select(
        "process_id", "seq", "total_cost", "running_cost", "running_calls"),
    "st1_live_hourly": _live,
    "st1_live_distinct_users": _live_users,
    "st2_live_distinct_orders": _live_distinct,
    "st3_stored_payments": _stored_upsert,
    "s02_live_exports": _live_exports,
}.items()}


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        split_skewed_joins(spark)
        return query(spark, sf_dir)
    return run


def all_queries() -> dict[str, Query]:
    found = {**MARTS, **RECIPES, **EXPORTS, **NAMES, **OPERATORS, **SCALARS, **LOGS}
    return {name: _prepared(query) for name, query in found.items()}
