"""Data quality as tables: counts against the sources and rule violations inside silver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restomart import fixed_values as V
from restomart.operators.orders import live_toast_orders
from restomart.sources.exports import Exports
from restomart.sources.silver import Silver

# Allowed codes, required columns, keys and references of silver.
DOMAINS = {
    "orders": {"source": V.SOURCES, "order_type": V.ORDER_TYPES, "channel": V.CHANNELS,
               "status": V.ORDER_STATUSES},
    "payments": {"payment_type": V.PAYMENT_TYPES, "card_brand": V.CARD_BRANDS},
    "product_variations": {"variation_type": V.VARIATION_TYPES},
    "product_aliases": {"source": V.SOURCES},
    "messages": {"role": V.MESSAGE_ROLES},
}
REQUIRED = {
    "locations": ["id", "name"],
    "categories": ["id", "name"],
    "products": ["id", "name"],
    "product_variations": ["id", "product_id", "name"],
    "product_aliases": ["id", "product_id", "raw_name", "source"],
    "orders": ["id", "source", "source_order_id", "location_id", "order_type", "channel",
               "created_at", "subtotal_cents", "total_cents"],
    "order_items": ["id", "order_id", "original_name", "quantity", "unit_price_cents",
                    "total_price_cents"],
    "payments": ["id", "order_id", "payment_type", "amount_cents"],
}
KEYS = {
    "locations": [["id"], ["name"]],
    "categories": [["id"], ["name"]],
    "products": [["id"]],
    "product_variations": [["id"], ["product_id", "name"]],
    "product_aliases": [["id"], ["raw_name", "source"]],
    "orders": [["id"], ["source", "source_order_id"]],
    "order_items": [["id"]],
    "payments": [["id"]],
}
REFERENCES = [
    ("products", "category_id", "categories"),
    ("product_variations", "product_id", "products"),
    ("product_aliases", "product_id", "products"),
    ("orders", "location_id", "locations"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("order_items", "variation_id", "product_variations"),
    ("payments", "order_id", "orders"),
]
DEFAULTS = {
    "orders": {"tax_cents": 0, "tip_cents": 0, "delivery_fee_cents": 0, "service_fee_cents": 0,
               "commission_cents": 0, "contains_alcohol": False, "is_catering": False},
    "order_items": {"quantity": 1, "tax_cents": 0},
    "payments": {"tip_cents": 0, "processing_fee_cents": 0},
}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def integrity_report(exports: Exports, silver: Silver) -> DataFrame:
    """(metric, source, expected, actual, ok): orders and payments against the exports, and
    orders without payment (expected none).

    Each export and each silver table is read once: an export's payments are counted inside its
    orders' arrays, and silver's payments shrink to one row per order before they meet the orders.
    """
    live = live_toast_orders(exports.toast)
    paid = F.aggregate("checks", F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.size(F.filter(
        c["payments"], lambda p: ~p["refundStatus"].eqNullSafe(F.lit("FULL_REFUND")))).cast("bigint"), F.lit(0)))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counted = lambda df, source, orders, payments: df.select(
        F.lit(source).alias("source"), orders.alias("orders"), payments.alias("payments"))
    expected = _union([
        counted(live, "toast", one, paid), counted(exports.doordash, "doordash", one, one),
        counted(exports.square.orders, "square", one, none), counted(exports.square.payments, "square", none, one)])
    return _compared(expected, silver.orders, silver.payments)


def compare_counts(source_orders: DataFrame, source_payments: DataFrame, orders: DataFrame,
                   payments: DataFrame) -> DataFrame:
    """``integrity_report`` on source frames that have one row per order or payment and ``source``."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    expected = source_orders.select("source", one.alias("orders"), none.alias("payments")).unionByName(
        source_payments.select("source", none.alias("orders"), one.alias("payments")))
    return _compared(expected, orders, payments)


def _compared(expected: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """The report from one aggregate per side; totals come from the few rows per source."""
    per_order = payments.groupBy(F.col("order_id").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    both = orders.select("id", "source").join(per_order, F.col("id") == F.col("_o"), "full")
    unpaid = F.col("id").isNotNull() & F.col("_n").isNull()
    actual = both.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("id").alias("orders"), F.coalesce(F.sum("_n"), F.lit(0)).alias("payments"),
        F.count_if(unpaid).alias("unpaid"))
    wanted = expected.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.sum("orders").alias("orders"), F.sum("payments").alias("payments"))
    sides = wanted.select("source", *[F.col(c).alias(f"{c}_expected") for c in ("orders", "payments")], F.lit(0).alias("unpaid_expected")).join(
        actual.select("source", *[F.col(c).alias(f"{c}_actual") for c in ("orders", "payments", "unpaid")]), "source", "full")
    sums = [F.coalesce(F.sum(f"{m}_{side}"), F.lit(0)).cast("bigint").alias(f"{m}_{side}")
            for m in ("orders", "payments", "unpaid") for side in ("expected", "actual")]
    totals = sides.groupingSets([[F.col("source")], []], "source").agg(F.grouping("source").alias("_total"), *sums)
    lines = F.inline(F.array(*[F.struct(
        F.lit(name).alias("metric"), F.col(f"{m}_expected").alias("expected"), F.col(f"{m}_actual").alias("actual"))
        for m, name in (("orders", "orders"), ("payments", "payments"), ("unpaid", "orders without payment"))]))
    out = totals.select(F.when(F.col("_total") == 1, "total").otherwise(F.col("source")).alias("source"), lines)
    # A source without rows on either side has no line, and unpaid orders are told in total only.
    kept = F.when(F.col("metric") == "orders without payment", F.col("source") == "total").otherwise(
        (F.col("source") == "total") | (F.col("expected") > 0) | (F.col("actual") > 0))
    return out.filter(kept).select("metric", "source", "expected", "actual",
                                   (F.col("expected") == F.col("actual")).alias("ok"))


def succeeded(report: DataFrame) -> DataFrame:
    """One row: every line is ok."""
    return report.agg(F.bool_and("ok").alias("success"))


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders that have a line."""
    keys = items.select(F.col("order_id").alias("_o"))
    return orders.join(keys, F.col("id") == F.col("_o"), "left_semi")


def orders_without_payment(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return orders.join(payments.select(F.col("order_id").alias("_o")),
                       F.col("id") == F.col("_o"), "left_anti")


def payment_coverage(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """(with_payment, without_payment). Payments shrink to one row per order first."""
    paid = payments.groupBy(F.col("order_id").alias("_o")).agg(F.lit(True).alias("_paid"))
    marked = orders.select("id").join(paid, F.col("id") == F.col("_o"), "left")
    return marked.agg(F.count("_paid").alias("with_payment"),
                      F.count(F.when(F.col("_paid").isNull(), 1)).alias("without_payment"))


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose code is not allowed; null is a matter of ``missing_values``."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.col(c).isNull()
    return df.filter(condition)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def orphans(child: DataFrame, reference: str, parent: DataFrame) -> DataFrame:
    """Rows that point to no parent."""
    return child.filter(F.col(reference).isNotNull()).join(
        parent.select(F.col("id").alias("_parent")), F.col(reference) == F.col("_parent"),
        "left_anti")


def row_rules(table: str) -> dict[str, Column]:
    """``rule|column`` and the condition that breaks it, for the rules that a row alone decides."""
    rules = {f"domain|{column}": F.col(column).isNotNull() & ~F.col(column).isin(allowed)
             for column, allowed in DOMAINS.get(table, {}).items()}
    return rules | {f"not_null|{column}": F.col(column).isNull() for column in REQUIRED.get(table, [])}


def row_rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Domain and not-null violations; every table is scanned once for all its rules."""
    parts = []
    for name, df in tables.items():
        checks = row_rules(name)
        if not checks:
            continue
        counted = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in checks.items()])
        long = counted.unpivot([], [f"`{k}`" for k in checks], "_rule", "violations")
        pieces = F.split("_rule", r"\|")
        parts.append(long.select(
            pieces[0].alias("rule"), F.lit(name).alias("table_name"),
            pieces[1].alias("column_name"), "violations"))
    return _union(parts)


def key_rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        for keys in KEYS.get(name, []):
            parts.append(duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit("unique").alias("rule"), F.lit(name).alias("table_name"),
                F.lit(", ".join(keys)).alias("column_name"), "violations"))
    return _union(parts)


def reference_rule_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for child, column, parent in REFERENCES:
        if child in tables and parent in tables:
            lost = orphans(tables[child].select(column), column, tables[parent])
            parts.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit("reference").alias("rule"), F.lit(child).alias("table_name"),
                F.lit(column).alias("column_name"), "violations"))
    return _union(parts)


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([row_rule_counts(tables), key_rule_counts(tables), reference_rule_counts(tables)])


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows to load, rows to set aside) by the table's domains and required columns."""
    bad = F.lit(False)
    for broken in row_rules(table).values():
        bad = bad | broken
    return df.filter(~bad), df.filter(bad)


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Declared defaults for absent values (silver itself keeps nulls)."""
    return df.fillna({k: v for k, v in DEFAULTS.get(table, {}).items() if k in df.columns})


def delete_orders(silver: Silver, doomed: DataFrame) -> Silver:
    """Remove orders (``doomed``: id) together with their items and payments."""
    gone = doomed.select(F.col("id").alias("_gone")).distinct()
    drop = lambda df, key: df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    return silver.with_tables(
        orders=drop(silver.orders, "id"), order_items=drop(silver.order_items, "order_id"),
        payments=drop(silver.payments, "order_id"))
