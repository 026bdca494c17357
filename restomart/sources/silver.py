"""The silver tables as one value, with their schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLE_NAMES = ("locations", "categories", "products", "product_variations", "product_aliases",
               "orders", "order_items", "payments")


class Silver:
    """Eight tables by name, parents before children.

    A table may be given as a function; it is then built when first asked for, so a
    question that needs two tables does not open the other six.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown silver tables: {sorted(unknown)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES if name in self._tables}

    def with_tables(self, **tables: DataFrame) -> "Silver":
        return Silver(**{**self._tables, **tables})


ADDRESS = "struct<line1: string, city: string, state: string, zip: string, country: string>"
MODIFIERS = "array<struct<name: string, price: bigint, modifier_id: string>>"

# Column name -> type, in table order.
SCHEMAS: dict[str, dict[str, str]] = {
    "locations": dict(
        id="string", name="string", address=ADDRESS, timezone="string", toast_id="string",
        doordash_id="string", square_id="string", created_at="timestamp", raw_data="string"),
    "categories": dict(id="string", name="string", raw_data="string"),
    "products": dict(
        id="string", name="string", category_id="string", description="string",
        created_at="timestamp", raw_data="string"),
    "product_variations": dict(
        id="string", product_id="string", name="string", variation_type="string",
        source_raw_name="string", raw_data="string"),
    "product_aliases": dict(id="string", product_id="string", raw_name="string", source="string"),
    "orders": dict(
        id="string", source="string", source_order_id="string", location_id="string",
        order_type="string", channel="string", status="string", created_at="timestamp",
        closed_at="timestamp", subtotal_cents="bigint", tax_cents="bigint", tip_cents="bigint",
        total_cents="bigint", delivery_fee_cents="bigint", service_fee_cents="bigint",
        commission_cents="bigint", contains_alcohol="boolean", is_catering="boolean",
        raw_data="string"),
    "order_items": dict(
        id="string", order_id="string", product_id="string", variation_id="string",
        original_name="string", quantity="int", unit_price_cents="bigint",
        total_price_cents="bigint", tax_cents="bigint", modifiers=MODIFIERS,
        special_instructions="string", raw_data="string"),
    "payments": dict(
        id="string", order_id="string", source_payment_id="string", payment_type="string",
        card_brand="string", last_four="string", amount_cents="bigint", tip_cents="bigint",
        processing_fee_cents="bigint", created_at="timestamp", raw_data="string"),
    "conversations": dict(id="string", created_at="timestamp", updated_at="timestamp"),
    "messages": dict(
        id="string", conversation_id="string", role="string", content="string", charts="string",
        created_at="timestamp"),
}

def ddl(table: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in SCHEMAS[table].items())


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project a frame onto the declared columns of ``table``; absent columns become null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
        for name, kind in SCHEMAS[table].items()
    ])


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Make frames addressable from SQL text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, table_type string, is_temporary boolean")
