"""Small exports of the three sources with every edge the rules name."""

import json

LOCATIONS = {"locations": [
    {"name": "Downtown", "toast_id": "t1", "doordash_id": "d1", "square_id": "s1"},
    {"name": "Airport", "toast_id": "t2", "doordash_id": "d2", "square_id": "s2"},
]}


def usd(amount):
    return {"amount": amount, "currency": "USD"}


def selection(guid, name, qty=1, price=999, before=None, tax=80, voided=False, group="Burgers",
              modifiers=()):
    return {"guid": guid, "entityType": "S", "displayName": name,
            "itemGroup": {"guid": "g", "name": group, "entityType": "G"},
            "item": {"guid": "i", "name": name, "entityType": "I"}, "quantity": qty,
            "preDiscountPrice": price if before is None else before, "price": price, "tax": tax,
            "voided": voided,
            "modifiers": [{"guid": "m", "entityType": "M", "displayName": n, "price": p}
                          for n, p in modifiers]}


def toast_payment(guid, amount=1079, kind="CREDIT", card="VISA", refund="NONE"):
    return {"guid": guid, "entityType": "P", "paidDate": "2025-01-02T12:45:00.000Z",
            "paidBusinessDate": "20250102", "type": kind, "cardType": card,
            "last4Digits": "4242" if card else None, "amount": amount, "tipAmount": 200,
            "originalProcessingFee": 30, "refundStatus": refund}


def check(guid, selections, payments, voided=False, deleted=False, amount=999, tax=80, tip=200):
    return {"guid": guid, "entityType": "C", "displayNumber": "1",
            "openedDate": "2025-01-02T12:00:00.000Z", "closedDate": "2025-01-02T12:45:00.000Z",
            "paidDate": "2025-01-02T12:45:00.000Z", "voided": voided, "deleted": deleted,
            "selections": selections, "payments": payments, "amount": amount, "taxAmount": tax,
            "totalAmount": amount + tax, "tipAmount": tip}


def toast_order(guid, checks, place="t1", voided=False, deleted=False, behavior="DINE_IN",
                source="POS"):
    return {"guid": guid, "entityType": "O", "externalId": None,
            "revenueCenter": {"guid": "r", "name": "r", "entityType": "R"},
            "server": {"guid": "s", "firstName": "A", "lastName": "B", "entityType": "S"},
            "restaurantGuid": place, "businessDate": "20250102",
            "openedDate": "2025-01-02T12:00:00.000Z", "closedDate": "2025-01-02T12:45:00.000Z",
            "paidDate": "2025-01-02T12:45:00.000Z", "voided": voided, "deleted": deleted,
            "diningOption": {"guid": "d", "name": "d", "behavior": behavior, "entityType": "D"},
            "checks": checks, "source": source, "voidDate": None, "voidBusinessDate": None}


def toast_document():
    one = lambda n, name="Hamburger", **k: check(
        f"c{n}", [selection(f"s{n}", name, **k)], [toast_payment(f"p{n}")])
    return {"restaurant": {"guid": "r", "name": "R", "managementGroupGuid": "m"}, "locations": [],
            "orders": [
        toast_order("plain", [one(1)]),
        toast_order("voided", [one(2)], voided=True),
        toast_order("deleted", [one(3)], deleted=True),
        toast_order("elsewhere", [one(4)], place="t9"),
        toast_order("two-checks", [
            one(5, "Hamburgr", qty=2, price=1999),
            check("c6", [selection("s6", "Buffalo Wings 12pcs", group="🍗 Wings"),
                         selection("s7", "Soda", voided=True)],
                  [toast_payment("p6", refund="FULL_REFUND"), toast_payment("p7", 500, "CASH", None)],
                  amount=500, tax=40, tip=0),
            check("c8", [selection("s8", "Ghost")], [toast_payment("p8")], voided=True)],
            behavior="TAKE_OUT", source="ONLINE"),
        toast_order("no-items", [check("c9", [selection("s9", "Soda", voided=True)],
                                       [toast_payment("p9")])]),
        toast_order("no-quantity", [one(10, "Crème Brûlée", qty=0, group="BURGERS",
                                        modifiers=[("extra", 50)])], place="t2"),
    ]}


def dash_order(key, items, store="d1", method="MERCHANT_DELIVERY", delivered=True):
    return {"external_delivery_id": key, "store_id": store, "order_fulfillment_method": method,
            "order_status": "DELIVERED" if delivered else "PICKED_UP",
            "created_at": "2025-01-03T18:00:00Z", "pickup_time": "2025-01-03T18:20:00Z",
            "delivery_time": "2025-01-03T18:45:00Z" if delivered else None, "order_items": items,
            "order_subtotal": 1998, "delivery_fee": 399, "service_fee": 199, "dasher_tip": 500,
            "tax_amount": 160, "total_charged_to_consumer": 3256, "commission": 300,
            "merchant_payout": 2456, "contains_alcohol": False, "is_catering": False}


def dash_item(key, name, qty=2, note="", category="Burgers"):
    return {"item_id": key, "name": name, "quantity": qty, "unit_price": 999,
            "total_price": 999 * qty, "special_instructions": note,
            "options": [{"name": "cheese", "price": 100}], "category": category}


def dash_document():
    return {"merchant": {"merchant_id": "m", "business_name": "b", "currency": "USD"}, "stores": [],
            "orders": [
        dash_order("dd1", [dash_item("i1", "hamburger", note="no onions"),
                           dash_item("i2", "Expresso", 1, category="Drinks")]),
        dash_order("dd2", [dash_item("i3", "Totally Unknown Special Dish")], method="PICKUP",
                   delivered=False),
        dash_order("dd3", [dash_item("i4", "Hamburger")], store="d9"),
        dash_order("dd4", []),
    ]}


def square_item(key, name, variations, category="CAT1", description="tasty"):
    return {"type": "ITEM", "id": key, "item_data": {
        "name": name, "description": description, "category_id": category, "variations": [
            {"type": "ITEM_VARIATION", "id": v, "item_variation_data": {
                "item_id": key, "name": label, "pricing_type": "FIXED_PRICING",
                "price_money": usd(999)}} for v, label in variations]}}


def square_order(key, lines, place="s1", kind="PICKUP", source="Register"):
    return {"id": key, "location_id": place, "reference_id": "r", "source": {"name": source},
            "created_at": "2025-01-04T09:00:00Z", "updated_at": "2025-01-04T09:00:00Z",
            "closed_at": "2025-01-04T09:10:00Z", "state": "COMPLETED", "version": 1,
            "line_items": [
                {"uid": f"{key}-{i}", "catalog_object_id": v, "quantity": q, "item_type": "ITEM",
                 "gross_sales_money": usd(a), "total_money": usd(a),
                 **({"applied_modifiers": [{"modifier_id": m} for m in mods]} if mods else {})}
                for i, (v, q, a, mods) in enumerate(lines)],
            "fulfillments": [{"uid": "f", "type": kind, "state": "COMPLETED"}] if kind else [],
            "total_money": usd(1079), "total_tax_money": usd(80), "total_tip_money": usd(0)}


def square_payment(key, order, kind="CARD", **details):
    return {"id": key, "order_id": order, "location_id": "s1", "created_at": "2025-01-04T09:10:00Z",
            "updated_at": "2025-01-04T09:10:00Z", "amount_money": usd(1079), "tip_money": usd(0),
            "total_money": usd(1079), "status": "COMPLETED", "source_type": kind, **details}


CARD = {"card_details": {"status": "CAPTURED", "entry_method": "EMV",
                         "card": {"card_brand": "VISA", "last_4": "4242"}}}
WALLET = {"wallet_details": {"status": "CAPTURED", "brand": "APPLE_PAY"}}
CASH = {"cash_details": {"buyer_supplied_money": usd(2000), "change_back_money": usd(921)}}


def square_documents():
    return {
        "locations": {"locations": [{
            "id": "s1", "name": "Downtown", "timezone": "America/Chicago", "status": "ACTIVE",
            "type": "PHYSICAL", "merchant_id": "m", "address": {
                "address_line_1": "1 Main St", "locality": "X", "postal_code": "1",
                "administrative_district_level_1": "IL", "country": "US"}}]},
        "catalog": {"objects": [
            {"type": "CATEGORY", "id": "CAT1", "category_data": {"name": "🍔 Burgers"}},
            {"type": "CATEGORY", "id": "CAT2", "category_data": {"name": "burgers"}},
            {"type": "CATEGORY", "id": "CAT3", "category_data": {"name": "Drinks"}},
            square_item("IT1", "Hamburger", [("V1", "Regular"), ("V2", "Large"), ("V3", "lg")]),
            square_item("IT2", "Cold Brew", [("V4", "Regular"), ("V5", "16 pcs")], "CAT3", None),
            square_item("IT3", "Wings", [("V6", "Buffalo Wings 12pc")], "CAT2", ""),
            {"type": "MODIFIER", "id": "M1", "modifier_data": {"name": "Cheese"}},
        ]},
        "orders": {"orders": [
            square_order("sq1", [("V1", "1", 999, ())]),
            square_order("sq2", [("V2", "2", 2001, ("M1",)), ("nope", "2.5", 500, ())],
                         kind="DELIVERY", source="Square Online"),
            square_order("sq3", [("V6", "1", 1299, ())], kind=None),
            square_order("sq4", [("V1", "1", 999, ())], place="s9"),
            square_order("sq5", []),
        ], "cursor": None},
        "payments": {"payments": [
            square_payment("pay1", "sq1", **CARD), square_payment("pay2", "sq2", "CASH", **CASH),
            square_payment("pay3", "sq2", "WALLET", **WALLET),
            square_payment("pay4", "sq2", "WALLET"), square_payment("pay5", "sq4", **CARD),
        ], "cursor": None},
    }


def write_exports(folder):
    (folder / "square").mkdir()
    (folder / "toast.json").write_text(json.dumps(toast_document(), ensure_ascii=False))
    (folder / "doordash.json").write_text(json.dumps(dash_document()))
    for name, document in square_documents().items():
        (folder / "square" / f"{name}.json").write_text(json.dumps(document, ensure_ascii=False))
    return folder


def write_lines(folder):
    (folder / "square").mkdir()
    dump = lambda path, rows: path.write_text(
        "\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    dump(folder / "toast.json", toast_document()["orders"])
    dump(folder / "doordash.json", dash_document()["orders"])
    arrays = {"locations": "locations", "catalog": "objects", "orders": "orders",
              "payments": "payments"}
    for name, document in square_documents().items():
        dump(folder / "square" / f"{name}.json", document[arrays[name]])
    return folder
