import datetime as dt

import pytest

from export_fixtures import LOCATIONS, write_exports, write_lines
from restomart.functions.names import NameConfig
from restomart.operators.validate import validate_exports
from restomart.plans.normalize import normalize
from restomart.sources.config import ConfigError, location_config, name_config
from restomart.sources.exports import read_exports


def silver_of(spark, folder, layout="document", **options):
    exports = read_exports(spark, f"{folder}/toast.json", f"{folder}/doordash.json",
                           f"{folder}/square", layout)
    return normalize(exports, location_config(spark, LOCATIONS), NameConfig(), **options)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    silver = silver_of(spark, write_exports(tmp_path_factory.mktemp("exports")))
    return {n: [r.asDict(recursive=True) for r in d.collect()] for n, d in silver.tables().items()}


def by(rows, key):
    return {r[key]: r for r in rows}


def test_orders(tables):
    orders = by(tables["orders"], "source_order_id")
    assert set(orders) == {"plain", "two-checks", "no-quantity", "dd1", "dd2", "sq1", "sq2", "sq3"}
    pick = lambda k, *names: tuple(orders[k][n] for n in names)
    money = ("subtotal_cents", "tax_cents", "tip_cents", "total_cents")
    kind = ("order_type", "channel", "status")
    assert pick("plain", *kind, *money) == ("dine_in", "pos", "completed", 999, 80, 200, 1079)
    assert pick("two-checks", *kind, *money) == (
        "takeout", "online", "completed", 1499, 120, 200, 1619)
    assert pick("dd1", *kind, *money) == (
        "delivery", "delivery_app", "delivered", 1998, 160, 500, 3256)
    assert pick("dd1", "delivery_fee_cents", "service_fee_cents", "commission_cents") == (
        399, 199, 300)
    assert pick("dd2", "order_type", "status", "closed_at") == (
        "pickup", "picked_up", dt.datetime(2025, 1, 3, 18, 20))
    assert pick("sq1", *kind, *money) == ("pickup", "pos", "completed", 999, 80, 0, 1079)
    assert pick("sq2", "order_type", "channel") == ("delivery", "online")
    assert orders["sq3"]["order_type"] == "dine_in"
    assert orders["plain"]["tax_cents"] == 80 and orders["plain"]["delivery_fee_cents"] is None
    places = by(tables["locations"], "id")
    assert places[orders["plain"]["location_id"]]["name"] == "Downtown"
    assert places[orders["no-quantity"]["location_id"]]["name"] == "Airport"


def test_locations(tables):
    places = by(tables["locations"], "name")
    assert places["Downtown"]["timezone"] == "America/Chicago"
    assert places["Downtown"]["address"]["state"] == "IL"
    assert places["Airport"]["timezone"] == "America/New_York"
    assert places["Airport"]["address"] is None


def test_payments(tables):
    paid = by(tables["payments"], "source_payment_id")
    assert set(paid) == {"p1", "p5", "p7", "p10", "dd_pay_dd1", "dd_pay_dd2", "pay1", "pay2",
                         "pay3", "pay4"}
    pick = lambda k: tuple(paid[k][n] for n in (
        "payment_type", "card_brand", "last_four", "amount_cents", "tip_cents",
        "processing_fee_cents"))
    assert pick("p1") == ("credit", "visa", "4242", 1079, 200, 30)
    assert pick("p7") == ("cash", None, None, 500, 200, 30)
    assert pick("dd_pay_dd1") == ("platform", None, None, 2456, 500, 300)
    assert pick("pay1") == ("credit", "visa", "4242", 1079, 0, None)
    assert [pick(k)[:2] for k in ("pay2", "pay3", "pay4")] == [
        ("cash", None), ("wallet", "apple_pay"), ("other", None)]
    assert paid["dd_pay_dd2"]["created_at"] == dt.datetime(2025, 1, 3, 18, 20)


def test_items_and_catalog(tables):
    products = by(tables["products"], "id")
    labels = by(tables["product_variations"], "id")
    orders = by(tables["orders"], "id")
    got = {}
    for r in tables["order_items"]:
        product = products.get(r["product_id"], {}).get("name")
        label = labels.get(r["variation_id"], {}).get("name")
        got[(orders[r["order_id"]]["source_order_id"], r["original_name"])] = (
            product, label, r["quantity"], r["unit_price_cents"], r["total_price_cents"])
    assert got == {
        ("plain", "Hamburger"): ("Hamburger", None, 1, 999, 999),
        ("two-checks", "Hamburgr"): ("Hamburger", None, 2, 1000, 1999),
        ("two-checks", "Buffalo Wings 12pcs"): ("Wings", "12 pcs", 1, 999, 999),
        ("no-quantity", "Crème Brûlée"): ("Crème Brûlée", None, 0, None, 999),
        ("dd1", "hamburger"): ("Hamburger", None, 2, 999, 1998),
        ("dd1", "Expresso"): ("Coffee", "Expresso", 1, 999, 999),
        ("dd2", "Totally Unknown Special Dish"): (
            "Totally Unknown Special Dish", None, 2, 999, 1998),
        ("sq1", "Hamburger"): ("Hamburger", None, 1, 999, 999),
        ("sq2", "Hamburger - Large"): ("Hamburger", "Large", 2, 1001, 2001),
        ("sq2", "nope"): (None, None, 2, 250, 500),
        ("sq3", "Wings - Buffalo Wings 12pc"): ("Wings", "12 pcs", 1, 1299, 1299),
    }


def test_products_categories_labels(tables):
    names = {c["id"]: c["name"] for c in tables["categories"]}
    assert sorted(names.values()) == ["Burgers", "Drinks", "Wings"]
    products = by(tables["products"], "name")
    assert set(products) == {"Hamburger", "Coffee", "Wings", "Crème Brûlée",
                             "Totally Unknown Special Dish"}
    category = lambda p: names.get(products[p]["category_id"])
    assert [category(p) for p in ("Hamburger", "Coffee", "Wings")] == ["Burgers", "Drinks", "Burgers"]
    assert products["Hamburger"]["description"] == "tasty"
    shown = {(p["name"], v["name"], v["variation_type"]) for v in tables["product_variations"]
             for p in tables["products"] if p["id"] == v["product_id"]}
    assert ("Hamburger", "Large", None) in shown
    assert ("Coffee", "Cold Brew", "semantic") in shown
    assert ("Wings", "12 pcs", "quantity") in shown


def test_aliases(tables):
    products = {p["id"]: p["name"] for p in tables["products"]}
    got = {(a["source"], a["raw_name"]): products[a["product_id"]] for a in tables["product_aliases"]}
    assert got[("square", "Hamburger")] == "Hamburger"
    assert got[("toast", "Hamburgr")] == "Hamburger"
    assert got[("doordash", "Expresso")] == "Coffee"
    assert len({(s, n.lower()) for s, n in got}) == len(got)


def test_modifiers_and_notes(tables):
    items = {}
    for r in tables["order_items"]:
        items.setdefault(r["original_name"], r)
    assert items["Crème Brûlée"]["modifiers"] == [
        {"name": "extra", "price": 50, "modifier_id": None}]
    assert items["Hamburger - Large"]["modifiers"] == [
        {"name": None, "price": None, "modifier_id": "M1"}]
    assert items["nope"]["modifiers"] == []
    assert items["hamburger"]["special_instructions"] == "no onions"
    assert items["Expresso"]["special_instructions"] is None
    assert '"displayName":"Hamburgr"' in items["Hamburgr"]["raw_data"]


def test_lines_layout_gives_the_same_orders(spark, tables, tmp_path):
    silver = silver_of(spark, write_lines(tmp_path), "lines")
    got = {r.source_order_id: r.total_cents for r in silver.orders.collect()}
    assert got == {r["source_order_id"]: r["total_cents"] for r in tables["orders"]}


def test_compat_matches_product_names_only(spark, tmp_path):
    silver = silver_of(spark, write_exports(tmp_path), compat=True)
    products = {r.id: r.name for r in silver.products.collect()}
    got = {r.original_name: products.get(r.product_id) for r in silver.order_items.collect()}
    # The rule product is called "Coffee", which is not near "Expresso".
    assert got["Expresso"] is None
    assert got["Hamburgr"] == "Hamburger"


def test_validation_lists_every_problem(spark, tmp_path):
    folder = write_exports(tmp_path)
    text = (folder / "toast.json").read_text()
    text = text.replace('"restaurantGuid": "t9"', '"restaurantGuid": 7.5e3, "x": 1')
    text = text.replace('"behavior": "TAKE_OUT", ', "").replace('"tax": 80, "voided": true', '"tax": "x", "voided": true')
    (folder / "toast.json").write_text(text)
    got = validate_exports(spark, {
        "toast_orders": f"{folder}/toast.json", "square_catalog": f"{folder}/square/catalog.json",
        "doordash_orders": f"{folder}/doordash.json"}).collect()
    paths = {(r.record, r.path, r.message) for r in got}
    assert (4, "diningOption.behavior", "expected string") in paths
    assert (4, "checks.1.selections.1.tax", "expected number") in paths
    assert all(r.file.endswith("toast.json") for r in got)


def test_config_problems_stop_the_job(spark):
    with pytest.raises(ConfigError, match="locations.0.toast_id"):
        location_config(spark, {"locations": [{"name": "A", "doordash_id": "d", "square_id": "s"}]})
    with pytest.raises(ConfigError, match="at least one of suffix or keywords"):
        name_config({"patterns": [{"name": "n", "regex": "x", "type": "size", "format": "{1}"}],
                     "abbreviations": {}}, {"groups": [{"base_name": "X"}]})
