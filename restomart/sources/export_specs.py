"""Declared shapes of the source exports.

A spec is a nested dict: ``{field: type}``, a list with one spec for arrays, a string for
scalars. ``?`` after a type allows null or absence; ``=x`` demands the value ``x``. A leading
``?`` key in a nested dict makes the whole struct optional.
"""

# Field names and types of the exported documents.
MONEY = {"amount": "bigint", "currency": "string"}
NAMED = {"guid": "string", "name": "string", "entityType": "string"}

TOAST_ORDER = {
    "guid": "string", "entityType": "string", "externalId": "string?",
    "revenueCenter": NAMED,
    "server": {"guid": "string", "firstName": "string", "lastName": "string",
               "entityType": "string"},
    "restaurantGuid": "string", "businessDate": "string", "openedDate": "string",
    "closedDate": "string", "paidDate": "string", "voided": "boolean", "deleted": "boolean",
    "diningOption": {"guid": "string", "name": "string", "behavior": "string",
                     "entityType": "string"},
    "checks": [{
        "guid": "string", "entityType": "string", "displayNumber": "string",
        "openedDate": "string", "closedDate": "string", "paidDate": "string",
        "voided": "boolean", "deleted": "boolean",
        "selections": [{
            "guid": "string", "entityType": "string", "displayName": "string",
            "itemGroup": NAMED, "item": NAMED, "quantity": "bigint",
            "preDiscountPrice": "bigint", "price": "bigint", "tax": "bigint",
            "voided": "boolean",
            "modifiers": [{"guid": "string", "entityType": "string", "displayName": "string",
                           "price": "bigint"}],
        }],
        "payments": [{
            "guid": "string", "entityType": "string", "paidDate": "string",
            "paidBusinessDate": "string", "type": "string", "cardType": "string?",
            "last4Digits": "string?", "amount": "bigint", "tipAmount": "bigint",
            "originalProcessingFee": "bigint", "refundStatus": "string",
        }],
        "amount": "bigint", "taxAmount": "bigint", "totalAmount": "bigint",
        "tipAmount": "bigint",
    }],
    "source": "string", "voidDate": "string?", "voidBusinessDate": "string?",
}
TOAST_DOCUMENT = {
    "restaurant": {"guid": "string", "name": "string", "managementGroupGuid": "string"},
    "locations": [{
        "guid": "string", "name": "string",
        "address": {"line1": "string", "city": "string", "state": "string", "zip": "string",
                    "country": "string"},
        "timezone": "string",
    }],
    "orders": [TOAST_ORDER],
}

DOORDASH_ORDER = {
    "external_delivery_id": "string", "store_id": "string", "order_fulfillment_method": "string",
    "order_status": "string", "created_at": "string", "pickup_time": "string",
    "delivery_time": "string?",
    "order_items": [{
        "item_id": "string", "name": "string", "quantity": "bigint", "unit_price": "bigint",
        "total_price": "bigint", "special_instructions": "string",
        "options": [{"name": "string", "price": "bigint"}], "category": "string",
    }],
    "order_subtotal": "bigint", "delivery_fee": "bigint", "service_fee": "bigint",
    "dasher_tip": "bigint", "tax_amount": "bigint", "total_charged_to_consumer": "bigint",
    "commission": "bigint", "merchant_payout": "bigint", "contains_alcohol": "boolean",
    "is_catering": "boolean",
}
DOORDASH_DOCUMENT = {
    "merchant": {"merchant_id": "string", "business_name": "string", "currency": "string"},
    "stores": [{
        "store_id": "string", "name": "string",
        "address": {"street": "string", "city": "string", "state": "string",
                    "zip_code": "string", "country": "string"},
        "timezone": "string",
    }],
    "orders": [DOORDASH_ORDER],
}

SQUARE_LOCATION = {
    "id": "string", "name": "string",
    "address": {"address_line_1": "string", "locality": "string",
                "administrative_district_level_1": "string", "postal_code": "string",
                "country": "string"},
    "timezone": "string", "status": "string", "type": "string", "merchant_id": "string",
}
SQUARE_CATALOG_OBJECT = {
    "type": "string", "id": "string", "present_at_location_ids": ["string", "?"],
    "item_data": {
        "?": True, "name": "string", "description": "string?", "category_id": "string?",
        "variations": [{
            "type": "string=ITEM_VARIATION", "id": "string",
            "item_variation_data": {"item_id": "string", "name": "string",
                                    "pricing_type": "string", "price_money": MONEY},
        }],
    },
    "category_data": {"?": True, "name": "string"},
    "modifier_data": {"?": True, "name": "string", "price_money": {"?": True, **MONEY}},
}
SQUARE_ORDER = {
    "id": "string", "location_id": "string", "reference_id": "string",
    "source": {"name": "string"}, "created_at": "string", "updated_at": "string",
    "closed_at": "string", "state": "string", "version": "bigint",
    "line_items": [{
        "uid": "string", "catalog_object_id": "string", "quantity": "string",
        "item_type": "string", "gross_sales_money": MONEY, "total_money": MONEY,
        "applied_modifiers": [{"modifier_id": "string"}, "?"],
    }],
    "fulfillments": [{"uid": "string", "type": "string", "state": "string"}],
    "total_money": MONEY, "total_tax_money": MONEY, "total_tip_money": MONEY,
}
SQUARE_PAYMENT = {
    "id": "string", "order_id": "string", "location_id": "string", "created_at": "string",
    "updated_at": "string", "amount_money": MONEY, "tip_money": MONEY, "total_money": MONEY,
    "status": "string", "source_type": "string",
    "card_details": {
        "?": True, "status": "string",
        "card": {"card_brand": "string", "last_4": "string", "exp_month": "bigint?",
                 "exp_year": "bigint?"},
        "entry_method": "string",
    },
    "cash_details": {"?": True, "buyer_supplied_money": MONEY, "change_back_money": MONEY},
    "wallet_details": {"?": True, "status": "string", "brand": "string"},
}

# Record spec and the array that holds the records in a whole document.
RECORDS = {
    "toast_orders": (TOAST_ORDER, "orders"),
    "doordash_orders": (DOORDASH_ORDER, "orders"),
    "square_locations": (SQUARE_LOCATION, "locations"),
    "square_catalog": (SQUARE_CATALOG_OBJECT, "objects"),
    "square_orders": (SQUARE_ORDER, "orders"),
    "square_payments": (SQUARE_PAYMENT, "payments"),
}


def ddl_type(spec) -> str:
    """A spec as a Spark type."""
    if isinstance(spec, dict):
        fields = ", ".join(f"`{k}`: {ddl_type(v)}" for k, v in spec.items() if k != "?")
        return f"struct<{fields}>"
    if isinstance(spec, list):
        return f"array<{ddl_type(spec[0])}>"
    return spec.split("=")[0].rstrip("?")


def ddl_schema(spec: dict) -> str:
    return ", ".join(f"`{k}` {ddl_type(v)}" for k, v in spec.items() if k != "?")
