import datetime as dt

import pytest
from pyspark.sql import functions as F

from restomart.functions.sql_guard import is_read_only, read_only
from restomart.operators import quality as Q
from restomart.plans import gold
from restomart.plans.recipes import sales_by_location
from restomart.sources.silver import Silver, conform, list_tables
from restomart.sources.star_adapter import silver_from_star
from restomart.sources.store import LoadRejected, SilverStore, latest_per_key, load_stats, query


def orders(spark, rows):
    df = spark.createDataFrame(
        rows, "id string, source string, source_order_id string, location_id string, "
              "order_type string, channel string, status string, created_at timestamp, "
              "subtotal_cents bigint, total_cents bigint")
    return conform(df, "orders")


def order(key, status="completed", day=1, total=100, kind="dine_in", place="L1"):
    return (key, "toast", key, place, kind, "pos", status, dt.datetime(2025, 1, day, 10), total, total)


def test_versions_upsert_and_clean_load(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    places = conform(spark.createDataFrame([("L1", "Downtown")], "id string, name string"), "locations")
    first = store.save({"locations": places, "orders": orders(spark, [order("a"), order("b")])})
    second = store.upsert({"orders": orders(spark, [order("b", total=700), order("c", day=2)])})
    assert (first, second) == (1, 2)
    got = {r.id: r.total_cents for r in store.read("orders").collect()}
    assert got == {"a": 100, "b": 700, "c": 100}
    assert store.read("locations").count() == 1
    store.load(Silver(orders=orders(spark, [order("z")])), clean=True)
    assert [r.id for r in store.read("orders").collect()] == ["z"]
    log = {(r.table_name, r.version): r.row_count for r in store.log().collect()}
    assert log == {("locations", 1): 1, ("orders", 1): 2, ("orders", 2): 3, ("orders", 3): 1}
    with pytest.raises(LookupError):
        store.read("payments")


def test_date_range_reads_only_its_folders(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    store.save({"orders": orders(spark, [order("a"), order("b", day=2), order("c", day=3)])})
    plan = store.read("orders").filter(F.col("order_date") == dt.date(2025, 1, 2))
    assert [r.id for r in plan.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(order_date" in plan._jdf.queryExecution().toString()


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, t int, v string")
    assert sorted((r.id, r.v) for r in latest_per_key(df, ["id"], "t").collect()) == [
        ("a", "y"), ("b", "z")]


ACCEPTED = ["SELECT 1", "  with x as (select 1) select * from x", "select updated_at from orders",
            "SELECT created_by, deleted_flag FROM t", "SELECT 'x' AS dropped"]
REJECTED = ["UPDATE t SET a = 1", "SELECT 1; DELETE FROM t", "DROP TABLE t", "", "EXPLAIN SELECT 1",
            "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "select 1; truncate t",
            "SELECT 1; ALTER TABLE t ADD c INT", "create table t(a int)"]


def test_read_only_guard(spark):
    texts = ACCEPTED + REJECTED
    want = [True] * len(ACCEPTED) + [False] * len(REJECTED)
    assert [is_read_only(t) for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.ok for r in df.select("i", read_only("t").alias("ok")).orderBy("i").collect()] == want


def test_query_over_registered_marts(spark, sf_dir):
    s = silver_from_star(spark, sf_dir)
    gold.register_marts(spark, s)
    got = query(spark, "SELECT location_name, SUM(total) AS revenue FROM gold_orders "
                       "GROUP BY location_name")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sales_by_location(s).collect()}
    assert "gold_payments" in {r.name for r in list_tables(spark).collect()}
    with pytest.raises(PermissionError):
        query(spark, "DROP VIEW gold_orders")


@pytest.mark.parametrize("mart,keys,distinct", [
    (gold.gold_daily_sales, ["location_name", "order_date"], {"order_count": "order_id"}),
    (gold.gold_hourly_trends, ["location_name", "order_date", "order_hour"], {"orders": "order_id"}),
])
def test_order_marts_equal_count_distinct(spark, sf_dir, mart, keys, distinct):
    s = silver_from_star(spark, sf_dir)
    plain = gold.gold_orders(s).groupBy(*keys).agg(
        *[F.count_distinct(c).alias(n) for n, c in distinct.items()])
    rows = lambda df: sorted(map(str, df.select(*keys, *distinct).collect()))
    assert rows(mart(s)) == rows(plain)


def test_item_marts_equal_count_distinct(spark, sf_dir):
    s = silver_from_star(spark, sf_dir)
    items = gold.gold_order_items(s).filter("category_name is not null")
    plain = items.groupBy("category_name", "location_name").agg(
        F.count_distinct("order_id").alias("orders_containing"),
        F.count_distinct("product_name").alias("products_in_category"))
    rows = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows(gold.gold_category_performance(s)) == rows(plain)


def test_item_marts_need_no_shuffle_between_join_and_order_reduction(spark, sf_dir):
    s = silver_from_star(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = gold.gold_product_by_location(s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Expand" not in plan
    above_join = plan[:plan.index("SortMergeJoin [order_id")]
    assert above_join.count("Exchange hashpartitioning") == 1


def test_scope_reaches_the_scan(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    places = conform(spark.createDataFrame([("L1", "Downtown")], "id string, name string"), "locations")
    store.save({"locations": places, "orders": orders(spark, [order("a"), order("b", day=2)])})
    day = dt.date(2025, 1, 2)
    df = gold.gold_daily_sales(store.silver(), gold.Scope(day, day, "town"))
    assert [(r.order_count, str(r.revenue)) for r in df.collect()] == [(1, "1.00")]
    scan = next(line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
                if "FileScan" in line and "order_date" in line)
    assert "PartitionFilters: [isnotnull(order_date" in scan
    assert "created_at" in scan.split("DataFilters")[1]


def test_local_time_moves_the_date(spark):
    places = conform(spark.createDataFrame(
        [("L1", "Downtown", "America/New_York")], "id string, name string, timezone string"), "locations")
    late = ("a", "toast", "a", "L1", "dine_in", "pos", "completed", dt.datetime(2025, 1, 2, 3), 1, 1)
    s = Silver(locations=places, orders=orders(spark, [late]))
    hours = lambda **k: [(str(r.order_date), r.order_hour) for r in gold.gold_orders(s, **k).collect()]
    assert hours() == [("2025-01-02", 3)]
    assert hours(local_time=True) == [("2025-01-01", 22)]


def test_integrity_flags_missing_rows(spark):
    src = spark.createDataFrame([("toast",)] * 3, "source string")
    full = spark.createDataFrame([("a", "toast"), ("b", "toast"), ("c", "toast")], "id string, source string")
    paid = spark.createDataFrame([("a", "toast"), ("b", "toast"), ("c", "toast")],
                                 "order_id string, source string")
    run = lambda o, p: Q.succeeded(Q.compare_counts(src, src, o, p)).first().success
    assert run(full, paid) is True
    assert run(full.filter("id <> 'c'"), paid) is False
    assert run(full, paid.filter("order_id <> 'c'")) is False


def test_quality_report_and_quarantine(spark):
    df = orders(spark, [order("a"), order("a", kind="brunch"), order("b", status=None),
                        order("c", place=None), order("d", place="L9", status="open")])
    places = conform(spark.createDataFrame([("L1", "Downtown")], "id string, name string"), "locations")
    got = {(r.rule, r.table_name, r.column_name): r.violations
           for r in Q.quality_report({"orders": df, "locations": places}).collect()}
    assert got[("domain", "orders", "order_type")] == 1
    assert got[("domain", "orders", "status")] == 1
    assert got[("not_null", "orders", "location_id")] == 1
    assert got[("unique", "orders", "id")] == 1
    assert got[("reference", "orders", "location_id")] == 1
    good, bad = Q.quarantine(df, "orders")
    assert sorted(r.id for r in good.collect()) == ["a", "b"]
    assert sorted(r.id for r in bad.collect()) == ["a", "c", "d"]


def test_load_stats(spark):
    assert {tuple(r) for r in load_stats({"x": spark.range(3), "y": spark.range(0)}).collect()} == {
        ("x", 3), ("y", 0)}


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_upsert_rewrites_only_the_folders_it_touches(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    store.save({"orders": orders(spark, [order("a"), order("b", day=2), order("c", day=3), order("d", day=4)])})
    before = store.state().tables["orders"].parts
    old = files_of(tmp_path)
    moved = orders(spark, [order("b", day=5, total=9), order("e", day=3)])
    store.upsert({"orders": moved})
    after = store.state().tables["orders"].parts
    assert {p for p in before if after.get(p) == before[p]} == {"order_date=2025-01-01", "order_date=2025-01-04"}
    assert set(after) - set(before) == {"order_date=2025-01-05"} and "order_date=2025-01-02" not in after
    assert {k: v for k, v in files_of(tmp_path).items() if k in old} == old
    got = {r.id: (r.order_date.day, r.total_cents) for r in store.read("orders").collect()}
    assert got == {"a": (1, 100), "b": (5, 9), "c": (3, 100), "d": (4, 100), "e": (3, 100)}
    assert store.log().filter("version = 2").first().row_count == 5


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = SilverStore(spark, str(tmp_path)), SilverStore(spark, str(tmp_path))
    one.save({"orders": orders(spark, [order("a")])})
    publish, raced = SilverStore._publish, []

    def slow(store, version, entries):
        if not raced:
            raced.append(two.upsert({"orders": orders(spark, [order("a", total=5), order("c", day=2)])}))
        return publish(store, version, entries)

    monkeypatch.setattr(SilverStore, "_publish", lambda s, *a: slow(s, *a) if s is one else publish(s, *a))
    assert one.upsert({"orders": orders(spark, [order("b"), order("c", day=2, total=7)])}) == 3 and raced == [2]
    assert {r.id: r.total_cents for r in one.read("orders").collect()} == {"a": 5, "b": 100, "c": 7}
    places = conform(spark.createDataFrame([("L1", "Downtown")], "id string, name string"), "locations")
    raced.clear()
    assert one.save({"locations": places}) == 5  # the orders that came between are kept
    assert store_rows(one) == {"orders": 3, "locations": 1}
    assert not one._publish(5, [{"table_name": "orders", "kind": "table", "row_count": 0, "replaces": True}])
    assert store_rows(two) == {"orders": 3, "locations": 1}


def store_rows(store):
    return {n: df.count() for n, df in store.silver().tables().items()}


def test_added_batches_are_small_replayed_once_and_merged(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    many = [order(f"o{i}", day=1 + i % 25) for i in range(500)]
    store.save({"orders": orders(spark, many)})
    old = files_of(tmp_path)
    batch = orders(spark, [order("o3", day=9, total=1), order("new")])
    for _ in range(2):  # the second is a replay
        assert store.append("orders", batch, ["id"], "s1", 0) == 2
    later = orders(spark, [order("o3", day=10, total=2)])
    store.append("orders", later, ["id"], "s1", 1)
    store.append("orders", orders(spark, [order("x", day=11)]), ["id"], "s2", 0)
    more = [p for p in files_of(tmp_path) if p not in old]
    assert 0 < len(more) <= 12 and store.state().version == 4
    want = {r.id: (r.order_date, r.total_cents) for r in store.read("orders").collect()}
    assert len(want) == 502 and want["o3"] == (dt.date(2025, 1, 10), 2)
    before = store.state().tables["orders"].parts
    store.compact("orders")
    state = store.state().tables["orders"]
    assert not state.deltas and state.row_count == 502
    assert sum(state.parts[p] != before[p] for p in before) == 4  # days 1, 4, 10 and 11
    assert {r.id: (r.order_date, r.total_cents) for r in store.read("orders").collect()} == want
    assert store.append("orders", batch, ["id"], "s1", 1) == 5 and store.compact("orders") == 5


def test_added_rows_are_shuffled_only_where_needed(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    store.append("orders", orders(spark, [order("a"), order("b"), order("b")]), ["id"], "s1", 0)
    store.append("orders", orders(spark, [order("a", day=2, total=7), order("c")]), ["id"], "s1", 1)
    found = store.read("orders")
    assert sorted((r.id, r.total_cents, r.order_date.day) for r in found.collect()) == [("a", 7, 2), ("b", 100, 1), ("c", 100, 1)]
    sums = found.agg(F.sum("total_cents"))
    assert "raw_data" not in sums._jdf.queryExecution().executedPlan().toString()  # columns nobody asked for stay unread


def test_load_stops_on_broken_rules_before_its_version(spark, tmp_path):
    store = SilverStore(spark, str(tmp_path))
    places = conform(spark.createDataFrame([("L1", "Downtown"), ("L2", "Uptown")], "id string, name string"), "locations")
    good = Silver(locations=places, orders=orders(spark, [order("a"), order("a")]))
    assert store.load(good, enforce=True) == 1
    pays = conform(spark.createDataFrame([("p1", "a", "credit", 5), ("p2", "zz", "gold", 5), ("p3", None, "cash", 5)],
                                         "id string, order_id string, payment_type string, amount_cents bigint"), "payments")
    again = conform(spark.createDataFrame([("L3", "Same"), ("L4", "Same")], "id string, name string"), "locations")
    twice = orders(spark, [order("b", place="L9"), order("c", kind="brunch"), ("d", *order("a")[1:])])
    with pytest.raises(LoadRejected) as error:
        store.load(Silver(locations=again, orders=twice, payments=pays), enforce=True)
    assert set(error.value.counts) == {
        ("locations", "unique", "name", 2), ("orders", "domain", "order_type", 1), ("orders", "reference", "location_id", 1),
        ("payments", "domain", "payment_type", 1), ("payments", "not_null", "order_id", 1),
        ("payments", "reference", "order_id", 1)}
    assert store.state().version == 1 and store_rows(store) == {"locations": 2, "orders": 1}
    assert store.load(Silver(locations=again, orders=twice, payments=pays)) == 2


def test_a_load_counts_while_it_writes(spark, tmp_path):
    opened = []
    store = SilverStore(spark, str(tmp_path))
    base = SilverStore._base
    store._base = lambda table, parts: opened.append(table) or base(store, table, parts)
    store.load(Silver(orders=orders(spark, [order("a"), order("b", day=2)])), enforce=True)
    assert opened.count("orders") <= 1  # only as parents, by id
    assert store.log().first().row_count == 2
