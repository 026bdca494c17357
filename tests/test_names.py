import pytest
from pyspark.sql import functions as F

from restomart.functions import codes, names, text
from restomart.functions.money_time import half_up, rounded_ratio

CONFIG = names.NameConfig()
# Patterns that leave "- Large" and "extra large" to the label clean-up.
LOOSE = names.NameConfig(patterns=[
    {"name": "q", "regex": r"\s*(\d+)\s*(pcs?|pieces?)\s*$", "flags": "i", "type": "quantity",
     "format": "{1} pcs"}])


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_extract_variation(spark):
    got = values(spark, ["Churros 12pcs", "Lg Coke", "Fries - Large", "  Burger  ", "Ale pint",
                         "Latte dbl shot", "Pie slice", "12 pcs", "Lg Fries 6 pieces"],
                 lambda x: names.extract_variation(x, CONFIG))
    assert [tuple(r) for r in got] == [
        ("Churros", "12 pcs", "quantity"), ("Coke", "Large", "size"), ("Fries", "Large", "size"),
        ("Burger", None, None), ("Ale", "Pint", "serving"), ("Latte", "Double", "strength"),
        ("Pie", "Slice", "serving"), ("", "12 pcs", "quantity"), ("Lg Fries", "6 pcs", "quantity")]


def test_match_key(spark):
    assert values(spark, ["Lg Coke", "Fries - Large", "OJ", "Ribs"],
                  lambda x: names.match_key(x, CONFIG)) == [
        "coca-cola", "french fries", "orange juice", "ribs"]


@pytest.mark.parametrize("config,label,want", [
    (CONFIG, "Buffalo Wings 12pc", ("12 pcs", "quantity")), (CONFIG, "lg", ("Large", "size")),
    (CONFIG, "sm", ("Small", "size")), (CONFIG, "med", ("Medium", "size")),
    (CONFIG, "- Large", ("Large", "size")), (CONFIG, "extra large", ("Large", "size")),
    (LOOSE, "- Large", ("Large", None)), (LOOSE, "extra large", ("Extra Large", None)),
    (LOOSE, "XL deal", ("XL deal", None))])
def test_normalize_label(spark, config, label, want):
    assert tuple(values(spark, [label], lambda x: names.normalize_label(x, config))[0]) == want


def test_rule_match(spark):
    config = names.NameConfig(groups=[
        {"base_name": "Wings", "suffix": "Wings"},
        {"base_name": "Coffee", "suffix": "Coffee", "keywords": ["espresso", "cold brew"]},
        {"base_name": "Cheese Pizza", "suffix": "cheese pizza"}])
    got = values(spark, ["Buffalo Wings", "Wings", "Buffalo Wngs", "Expresso", "Onion Rings",
                         "Extra Cheese Pizza", "Vanilla COLD BREW ", "Wngs", "Hot wings deluxe"],
                 lambda x: names.rule_match(x, config))
    assert [tuple(r) if r else None for r in got] == [
        ("Wings", "Buffalo"), ("Wings", None), ("Wings", "Buffalo"), ("Coffee", "Expresso"), None,
        ("Cheese Pizza", "Extra"), ("Coffee", "Vanilla COLD BREW"), ("Wings", None),
        ("Wings", "Hot wings deluxe")]


def test_default_rules_keep_their_order(spark):
    got = values(spark, ["cheesesteak sandwich", "Diet Coke", "Sandwhich"],
                 lambda x: names.rule_match(x, CONFIG)["rule"])
    assert got == ["Steak", "Soft Drink", "Sandwich"]


def test_category(spark):
    assert values(spark, ["🍔 Burgers", "  Multiple   Spaces  ", "burgers and fries", "BURGERS",
                          "🍟 Sides & Appetizers"], text.normalize_category) == [
        "Burgers", "Multiple Spaces", "Burgers And Fries", "Burgers", "Sides & Appetizers"]


@pytest.mark.parametrize("a,b,bound,want", [
    ("cat", "hat", None, 1), ("cats", "cat", None, 1), ("kitten", "sitting", None, 3),
    ("saturday", "sunday", None, 3), ("hello", "", None, 5), ("Hello", "hello", None, 0),
    ("abc", "xyz", 2, 3), ("abc", "xyz", 1, 2), ("a", "abcdefghijk", 5, 6), ("", "abcdef", 3, 6)])
def test_edit_distance(spark, a, b, bound, want):
    assert spark.range(1).select(text.edit_distance(F.lit(a), F.lit(b), bound)).first()[0] == want


def test_edit_distance_options(spark):
    row = spark.range(1).select(
        text.edit_distance(F.lit("ABC"), F.lit("abc"), case_sensitive=True),
        text.edit_distance(F.lit("Bogotá"), F.lit("Bogota"), strip_accents=True)).first()
    assert tuple(row) == (3, 0)


def test_codes(spark):
    run = lambda f, *xs: values(spark, xs, f)
    assert run(codes.toast_order_type, "DINE_IN", "TAKE_OUT", "DELIVERY", "CURBSIDE") == [
        "dine_in", "takeout", "delivery", "curbside"]
    assert run(codes.toast_channel, "POS", "ONLINE", "THIRD_PARTY", "Kiosk") == [
        "pos", "online", "third_party", "kiosk"]
    assert run(codes.doordash_order_type, "MERCHANT_DELIVERY", "PICKUP", "Drone") == [
        "delivery", "pickup", "drone"]
    assert run(codes.square_order_type, "PICKUP", "SHIPMENT") == ["pickup", "shipment"]
    assert run(codes.square_channel, "Square Online", "Register") == ["online", "pos"]
    assert run(codes.payment_type, "CREDIT", "card", "Cash", "WALLET", "other", "GIFT") == [
        "credit", "credit", "cash", "wallet", "other", "gift"]
    assert run(codes.card_brand, "VISA", "AMERICAN_EXPRESS", "", None, "Jcb") == [
        "visa", "amex", None, None, "jcb"]


def test_scalars(spark):
    row = spark.range(1).select(
        half_up(F.lit(-2.5)), half_up(F.lit(2.5)), rounded_ratio(F.lit(5), F.lit(0)),
        rounded_ratio(F.lit(999), F.lit(2)), text.leading_integer(F.lit("2.5")),
        text.leading_integer(F.lit("x")), text.header_label(F.lit("avg_unitPrice usd")),
        text.normalize_product_name(F.lit("  Big \t MAC ")), text.is_proper_case(F.lit("Abc")),
        text.is_proper_case(F.lit("1bc"))).first()
    assert tuple(row) == (-2, 3, None, 500, 2, None, "Avg UnitPrice Usd", "big mac", True, False)


def test_shelf_labels_are_tidied_once_per_spelling(spark, monkeypatch):
    from restomart.functions.names import NameConfig
    from restomart.operators import catalog as C

    seen, tidy = [], C.with_square_label
    monkeypatch.setattr(C, "with_square_label", lambda df, *rest: (seen.append(df.count()), tidy(df, *rest))[1])
    grouped = spark.range(6).selectExpr(
        "id AS group_rank", "id AS rank", "concat('n', id) AS original_name", "cast(null AS string) AS label",
        "cast(null AS string) AS label_kind",
        "array(named_struct('id', 'a', 'name', 'Regular'), named_struct('id', 'b', 'name', 'Lg')) AS variations")
    products = spark.range(6).selectExpr("concat('p', id) AS id", "id AS product_rank")
    found = C.label_candidates(grouped, products, NameConfig(groups=[])).collect()
    assert seen == [2]
    assert sorted((r.product_id, r.label, r.source_raw_name) for r in found) == [
        (f"p{i}", "Large", f"n{i} - Lg") for i in range(6)]


def test_candidates_need_no_landed_exports(spark, sf_dir, monkeypatch):
    from restomart import registry

    def fail(_):
        raise AssertionError("exports that are read once were written")
    monkeypatch.setattr(registry, "landed", fail)
    assert registry.NAMES["u02_candidates"](spark, sf_dir).count() > 0
