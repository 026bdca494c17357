"""Source codes to silver codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from restomart import fixed_values as V
from restomart.functions.text import col


def _map(key: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _mapped(code, mapping: dict[str, str], any_case: bool = False) -> Column:
    """Listed codes by the table, others in lower case."""
    code = col(code)
    return F.coalesce(_map(F.upper(code) if any_case else code, mapping), F.lower(code))


def toast_order_type(code) -> Column:
    return _mapped(code, V.TOAST_ORDER_TYPES)


def toast_channel(code) -> Column:
    return _mapped(code, V.TOAST_CHANNELS)


def doordash_order_type(code) -> Column:
    return _mapped(code, V.DOORDASH_ORDER_TYPES)


def square_order_type(code) -> Column:
    return _mapped(code, V.SQUARE_ORDER_TYPES)


def square_channel(name) -> Column:
    return F.when(F.contains(F.lower(col(name)), F.lit("online")), "online").otherwise("pos")


def payment_type(code) -> Column:
    return _mapped(code, V.PAYMENT_TYPE_CODES, any_case=True)


def card_brand(code) -> Column:
    """Null for a missing or empty brand."""
    return _mapped(F.nullif(col(code), F.lit("")), V.CARD_BRAND_CODES, any_case=True)


def text_or_null(value) -> Column:
    return F.nullif(col(value), F.lit(""))


def lookup_text(key, mapping: dict[str, str]) -> Column:
    return _map(col(key), mapping)
