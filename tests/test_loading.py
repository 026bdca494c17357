"""What must not be lost or counted twice on the way into the store."""

import pytest
from export_fixtures import LOCATIONS, write_exports
from pyspark.sql import functions as F

from restomart.operators.grouping import group_names
from restomart.operators.shape import classify
from restomart.operators.validate import InvalidExports, checked_exports
from restomart.plans import gold, recipes
from restomart.plans.normalize import normalize
from restomart.functions.names import NameConfig
from restomart.sources.config import location_config
from restomart.sources.silver import Silver, conform
from restomart.sources.star_adapter import silver_from_star
from restomart.sources.store import SilverStore, latest_per_key


def test_rows_without_an_order_value_are_kept(spark):
    df = spark.createDataFrame([("1", "a", None), ("1", "b", None), ("2", "c", None), ("2", "d", 5)],
                               "id string, v string, t int")
    got = {r.id: r.v for r in latest_per_key(df, ["id"], "t").collect()}
    assert got["1"] in ("a", "b") and got["2"] == "d"
    again = {r.id: r.v for r in latest_per_key(df.orderBy(F.desc("v")), ["id"], "t").collect()}
    assert again == got
    assert latest_per_key(df, ["id"], None).filter("v is null").isEmpty()


def test_repeated_rows_of_one_load_count_once(spark, sf_dir, tmp_path):
    star = silver_from_star(spark, sf_dir)
    orders = conform(star.orders.withColumn("id", F.col("id").cast("string")), "orders")
    store = SilverStore(spark, str(tmp_path))
    for clean in (True, False):
        store.load(Silver(orders=orders.unionAll(orders)), clean=clean)
        assert store.read("orders").count() == orders.count()


def test_relative_periods_read_only_their_folders(spark, sf_dir, tmp_path):
    star = silver_from_star(spark, sf_dir)
    store = SilverStore(spark, str(tmp_path))
    orders = conform(star.orders.withColumn("id", F.col("id").cast("string")), "orders")
    store.save({"orders": orders, "locations": conform(star.locations, "locations")})
    stored = store.silver()
    got = recipes.revenue_in(stored, "last_week")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, recipes.revenue_in(star, "last_week").collect()))


def test_invalid_exports_stop_the_job(spark, tmp_path):
    folder = write_exports(tmp_path)
    args = (spark, f"{folder}/toast.json", f"{folder}/doordash.json", f"{folder}/square")
    silver = normalize(checked_exports(*args), location_config(spark, LOCATIONS), NameConfig())
    assert silver.orders.count() > 0
    good = (folder / "toast.json").read_text()
    (folder / "toast.json").write_text(good.replace('"quantity": 1', '"quantity": 1.5'))
    with pytest.raises(InvalidExports, match="quantity: expected number") as error:
        checked_exports(*args)
    assert error.value.counts[0]["violations"] > 0
    (folder / "toast.json").write_text(good[:-40])
    with pytest.raises(InvalidExports):
        checked_exports(*args)


def test_codes_are_no_numbers(spark):
    df = spark.createDataFrame([("1", "1d", "2.5e3", ""), ("-2", "1f", "", " ")], "a string, b string, c string, d string")
    assert classify(df).numeric == ["a", "c", "d"]


def test_grouping_does_not_depend_on_the_order_of_the_rows(spark):
    names = [(i, t, t, t, False) for i, t in enumerate(["Soup", "Soups", "Sour", "Salad", "Salads", "Sald", "Tea"])]
    schema = "rank bigint, text string, base string, key string, improper boolean"
    runs = [{r["rank"]: r.leader for r in group_names(spark.createDataFrame(rows, schema)).collect()}
            for rows in (names, names[::-1], names[3:] + names[:3])]
    assert runs[0] == runs[1] == runs[2]


def test_completed_orders_keep_their_count(spark, sf_dir):
    star = silver_from_star(spark, sf_dir)
    daily = gold.gold_daily_sales(star).agg(F.sum("order_count")).first()[0]
    assert daily == gold.completed_orders(star).select("id").distinct().count()
