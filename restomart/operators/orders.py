"""Orders, items and payments of each source as silver rows.

Item rows leave here with ``raw name`` and lookup keys; products are attached once per distinct
name by ``operators.catalog``. Order totals and the "has items" test read the nested arrays of
the order itself, so a source's orders need one pass and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart.functions import codes
from restomart.functions.money_time import iso_timestamp, rounded_ratio
from restomart.functions.text import leading_integer
from restomart.operators.locations import stable_id
from restomart.sources.silver import MODIFIERS


@dataclass(frozen=True)
class SourceRows:
    orders: DataFrame
    items: DataFrame
    payments: DataFrame


def order_id(source: str, key: Column) -> Column:
    return stable_id("order", source, key)


def with_location(df: DataFrame, key: str, xref: DataFrame) -> DataFrame:
    """Attach ``location_id``; orders of unknown places drop out."""
    return df.join(xref.select(F.col("key").alias(key), "location_id"), key)


def modifiers(items: Column, name=None, price=None, modifier_id=None) -> Column:
    """Any source's modifiers in one shape; a missing array is empty."""
    def one(m: Column) -> Column:
        pick = lambda field: m[field] if field else F.lit(None)
        return F.struct(pick(name).cast("string").alias("name"),
                        pick(price).cast("bigint").alias("price"),
                        pick(modifier_id).cast("string").alias("modifier_id"))
    return F.coalesce(F.transform(items, one), F.array()).cast(MODIFIERS)


def raw(*columns) -> Column:
    """The source record as JSON, for auditing."""
    return F.to_json(F.struct(*columns))


def raw_fields(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with columns read from ``raw_data``: name -> (path, type).

    The text is parsed once into a VARIANT and every field is read from that; text that is no JSON, an
    absent field and a value of another type give null.
    """
    return df.withColumn("_raw", F.try_parse_json("raw_data")).withColumns(
        {name: F.try_variant_get("_raw", path, kind) for name, (path, kind) in fields.items()}).drop("_raw")


# Toast ---------------------------------------------------------------------------------------

def live_toast_orders(orders: DataFrame) -> DataFrame:
    """Orders and checks that are neither voided nor deleted."""
    return (orders.filter(~F.col("voided") & ~F.col("deleted"))
            .withColumn("checks", F.filter("checks", lambda c: ~c["voided"] & ~c["deleted"])))


def toast_selections(live: DataFrame, *keep: str) -> DataFrame:
    """One row per selection that was not voided, with its check and selection position."""
    return (
        live.select(*keep, "seq", F.posexplode("checks").alias("check_no", "_check"))
        .select(*keep, "seq", "check_no",
                F.posexplode("_check.selections").alias("line_no", "selection"))
        .filter(~F.col("selection.voided"))
    )


def toast_payments(live: DataFrame, *keep: str) -> DataFrame:
    """One row per payment that was not fully refunded."""
    return (
        live.select(*keep, F.posexplode("checks").alias("check_no", "_check"))
        .select(*keep, "check_no",
                F.posexplode("_check.payments").alias("payment_no", "payment"))
        .filter(~F.col("payment.refundStatus").eqNullSafe(F.lit("FULL_REFUND")))
    )


def _check_sum(field: str) -> Column:
    return F.aggregate("checks", F.lit(0).cast("bigint"), lambda acc, c: acc + c[field])


def toast_rows(orders: DataFrame, xref: DataFrame, keep_raw: bool = True) -> SourceRows:
    live = with_location(live_toast_orders(orders), "restaurantGuid", xref)
    has_items = F.exists("checks", lambda c: F.exists(c["selections"], lambda s: ~s["voided"]))
    live = live.filter(has_items).withColumn("order_id", order_id("toast", F.col("guid")))
    silver_orders = live.select(
        F.col("order_id").alias("id"), F.lit("toast").alias("source"),
        F.col("guid").alias("source_order_id"), "location_id",
        codes.toast_order_type("diningOption.behavior").alias("order_type"),
        codes.toast_channel("source").alias("channel"), F.lit("completed").alias("status"),
        iso_timestamp("openedDate").alias("created_at"),
        iso_timestamp("closedDate").alias("closed_at"),
        _check_sum("amount").alias("subtotal_cents"), _check_sum("taxAmount").alias("tax_cents"),
        _check_sum("tipAmount").alias("tip_cents"), _check_sum("totalAmount").alias("total_cents"),
        *([raw(*[c for c in orders.columns if c not in ("seq", "file")]).alias("raw_data")]
          if keep_raw else []),
    )
    line = F.col("selection")
    items = toast_selections(live, "order_id").select(
        "seq", "check_no", "line_no",
        stable_id("item", F.col("order_id"), F.col("check_no"), F.col("line_no")).alias("id"),
        "order_id", F.lit("toast").alias("source"),
        line["displayName"].alias("original_name"),
        line["quantity"].cast("int").alias("quantity"),
        rounded_ratio(line["preDiscountPrice"], line["quantity"]).alias("unit_price_cents"),
        line["price"].alias("total_price_cents"), line["tax"].alias("tax_cents"),
        modifiers(line["modifiers"], "displayName", "price").alias("modifiers"),
        F.lit(None).cast("string").alias("special_instructions"),
        *([F.to_json(line).alias("raw_data")] if keep_raw else []),
    )
    paid = F.col("payment")
    payments = toast_payments(live, "order_id").select(
        stable_id("payment", F.col("order_id"), F.col("check_no"), F.col("payment_no")).alias("id"),
        "order_id", paid["guid"].alias("source_payment_id"),
        codes.payment_type(paid["type"]).alias("payment_type"),
        codes.card_brand(paid["cardType"]).alias("card_brand"),
        paid["last4Digits"].alias("last_four"), paid["amount"].alias("amount_cents"),
        paid["tipAmount"].alias("tip_cents"),
        paid["originalProcessingFee"].alias("processing_fee_cents"),
        iso_timestamp(paid["paidDate"]).alias("created_at"),
        *([F.to_json(paid).alias("raw_data")] if keep_raw else []),
    )
    return SourceRows(silver_orders, items, payments)


# DoorDash ------------------------------------------------------------------------------------

def doordash_items(orders: DataFrame, *keep: str) -> DataFrame:
    return orders.select(*keep, "seq", F.posexplode("order_items").alias("line_no", "item"))


def doordash_rows(orders: DataFrame, xref: DataFrame, keep_raw: bool = True) -> SourceRows:
    kept = with_location(orders, "store_id", xref).filter(F.size("order_items") > 0)
    kept = kept.withColumn("order_id", order_id("doordash", F.col("external_delivery_id")))
    finished = F.coalesce(codes.text_or_null("delivery_time"), F.col("pickup_time"))
    silver_orders = kept.select(
        F.col("order_id").alias("id"), F.lit("doordash").alias("source"),
        F.col("external_delivery_id").alias("source_order_id"), "location_id",
        codes.doordash_order_type("order_fulfillment_method").alias("order_type"),
        F.lit("delivery_app").alias("channel"), F.lower("order_status").alias("status"),
        iso_timestamp("created_at").alias("created_at"),
        iso_timestamp(codes.text_or_null(finished)).alias("closed_at"),
        F.col("order_subtotal").alias("subtotal_cents"), F.col("tax_amount").alias("tax_cents"),
        F.col("dasher_tip").alias("tip_cents"),
        F.col("total_charged_to_consumer").alias("total_cents"),
        F.col("delivery_fee").alias("delivery_fee_cents"),
        F.col("service_fee").alias("service_fee_cents"),
        F.col("commission").alias("commission_cents"), "contains_alcohol", "is_catering",
        *([raw(*[c for c in orders.columns if c not in ("seq", "file")]).alias("raw_data")]
          if keep_raw else []),
    )
    line = F.col("item")
    items = doordash_items(kept, "order_id").select(
        "seq", F.lit(0).alias("check_no"), "line_no",
        stable_id("item", F.col("order_id"), F.lit(0), F.col("line_no")).alias("id"),
        "order_id", F.lit("doordash").alias("source"),
        line["name"].alias("original_name"),
        line["quantity"].cast("int").alias("quantity"),
        line["unit_price"].alias("unit_price_cents"),
        line["total_price"].alias("total_price_cents"),
        F.lit(None).cast("bigint").alias("tax_cents"),
        modifiers(line["options"], "name", "price").alias("modifiers"),
        codes.text_or_null(line["special_instructions"]).alias("special_instructions"),
        *([F.to_json(line).alias("raw_data")] if keep_raw else []),
    )
    # The platform pays the merchant once per order.
    payments = kept.select(
        stable_id("payment", F.col("order_id"), F.lit("platform")).alias("id"), "order_id",
        F.concat(F.lit("dd_pay_"), "external_delivery_id").alias("source_payment_id"),
        F.lit("platform").alias("payment_type"), F.lit(None).cast("string").alias("card_brand"),
        F.lit(None).cast("string").alias("last_four"), F.col("merchant_payout").alias("amount_cents"),
        F.col("dasher_tip").alias("tip_cents"), F.col("commission").alias("processing_fee_cents"),
        iso_timestamp(F.coalesce(codes.text_or_null(finished), F.col("created_at")))
        .alias("created_at"),
        *([raw(F.lit("doordash").alias("source"),
               F.col("external_delivery_id").alias("order_id"), "merchant_payout", "commission")
           .alias("raw_data")] if keep_raw else []),
    )
    return SourceRows(silver_orders, items, payments)


# Square --------------------------------------------------------------------------------------

def catalog_items(catalog: DataFrame) -> DataFrame:
    return catalog.filter((F.col("type") == "ITEM") & F.col("item_data").isNotNull()).select(
        F.col("id").alias("item_id"), F.col("item_data").alias("item"), "seq")


def catalog_variations(catalog: DataFrame) -> DataFrame:
    """(variation_id, item_id, item_name, variation_name) with positions."""
    return (
        catalog_items(catalog)
        .select("item_id", F.col("item.name").alias("item_name"), "seq",
                F.posexplode("item.variations").alias("variation_no", "v"))
        .select(F.col("v.id").alias("variation_id"), "item_id", "item_name",
                F.col("v.item_variation_data.name").alias("variation_name"), "seq", "variation_no")
    )


def square_rows(orders: DataFrame, payments: DataFrame, catalog: DataFrame, xref: DataFrame,
                keep_raw: bool = True) -> SourceRows:
    places = xref.select(F.col("key").alias("_place_key"), F.col("location_id").alias("_place"))
    kept = orders.join(places, F.col("location_id") == F.col("_place_key"))
    kept = kept.filter(F.size("line_items") > 0).withColumn(
        "order_id", order_id("square", F.col("id")))
    total, tax, tip = (F.col(f"{f}.amount") for f in
                       ("total_money", "total_tax_money", "total_tip_money"))
    first_type = F.get("fulfillments", F.lit(0))["type"]
    silver_orders = kept.select(
        F.col("order_id").alias("id"), F.lit("square").alias("source"),
        F.col("id").alias("source_order_id"), F.col("_place").alias("location_id"),
        F.coalesce(codes.square_order_type(first_type), F.lit("dine_in")).alias("order_type"),
        codes.square_channel("source.name").alias("channel"), F.lower("state").alias("status"),
        iso_timestamp("created_at").alias("created_at"),
        iso_timestamp("closed_at").alias("closed_at"), (total - tax - tip).alias("subtotal_cents"),
        tax.alias("tax_cents"), tip.alias("tip_cents"), total.alias("total_cents"),
        *([raw(*[c for c in orders.columns if c not in ("seq", "file")]).alias("raw_data")]
          if keep_raw else []),
    )
    line = F.col("line")
    shelf = catalog_variations(catalog).select(
        F.col("variation_id").alias("catalog_id"), "item_id", "item_name", "variation_name")
    label = F.when(F.col("variation_name") != "Regular",
                   F.concat(F.lit(" - "), "variation_name")).otherwise("")
    lines = kept.select("order_id", F.posexplode("line_items").alias("line_no", "line")).withColumn(
        "catalog_id", line["catalog_object_id"])
    quantity, paid = leading_integer(line["quantity"]), line["total_money"]["amount"]
    items = lines.join(shelf, "catalog_id", "left").select(
        stable_id("item", F.col("order_id"), F.lit(0), F.col("line_no")).alias("id"),
        "order_id", F.lit("square").alias("source"),
        F.coalesce(F.concat("item_name", label), F.col("catalog_id")).alias("original_name"),
        F.col("item_id").alias("catalog_id"), F.col("variation_name").alias("catalog_label"),
        quantity.alias("quantity"), rounded_ratio(paid, quantity).alias("unit_price_cents"),
        paid.alias("total_price_cents"), F.lit(None).cast("bigint").alias("tax_cents"),
        modifiers(line["applied_modifiers"], modifier_id="modifier_id").alias("modifiers"),
        F.lit(None).cast("string").alias("special_instructions"),
        *([F.to_json(line).alias("raw_data")] if keep_raw else []),
    )
    by_card = (F.col("source_type") == "CARD") & F.col("card_details").isNotNull()
    by_wallet = (F.col("source_type") == "WALLET") & F.col("wallet_details").isNotNull()
    keys = kept.select("order_id", F.col("id").alias("_key"))
    silver_payments = payments.join(keys, payments["order_id"] == F.col("_key")).select(
        stable_id("payment", keys["order_id"], F.col("id")).alias("id"), keys["order_id"],
        F.col("id").alias("source_payment_id"),
        F.when(by_card, "credit").when(F.col("source_type") == "CASH", "cash")
        .when(by_wallet, "wallet").otherwise("other").alias("payment_type"),
        F.when(by_card, codes.card_brand("card_details.card.card_brand"))
        .when(by_wallet, codes.card_brand("wallet_details.brand")).alias("card_brand"),
        F.when(by_card, F.col("card_details.card.last_4")).alias("last_four"),
        F.col("amount_money.amount").alias("amount_cents"),
        F.col("tip_money.amount").alias("tip_cents"),
        F.lit(None).cast("bigint").alias("processing_fee_cents"),
        iso_timestamp("created_at").alias("created_at"),
        *([raw(*[payments[c] for c in payments.columns if c not in ("seq", "file")])
           .alias("raw_data")] if keep_raw else []),
    )
    return SourceRows(silver_orders, items, silver_payments)
