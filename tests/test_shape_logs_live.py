import datetime as dt

import pytest
from pyspark.sql import functions as F

from restomart.operators import shape
from restomart.plans import conversations, query_log, usage
from restomart.sources.silver import conform
from restomart.sources.store import SilverStore
from restomart.streaming import live


def frame(spark, **columns):
    names = ", ".join(columns)
    return spark.createDataFrame([tuple(v for v in columns.values())]).toDF(*names.split(", "))


def test_classify_looks_at_all_rows(spark):
    df = spark.createDataFrame([("12", "x", 1, "1"), ("3.5", "y", 2, "b"), (None, "z", 3, "2")],
                               "a string, b string, c int, d string")
    kinds = shape.classify(df)
    assert (kinds.numeric, kinds.category) == (["a", "c"], ["b", "d"])


@pytest.mark.parametrize("chart,numeric,category,want", [
    ("line", ["hour", "revenue"], ["location"], ("hour", "revenue")),
    ("line", ["order_hour", "revenue"], ["order_date"], ("order_date", "order_hour")),
    ("area", ["order_hour", "revenue"], [], ("order_hour", "revenue")),
    ("bar", ["revenue"], ["name"], ("name", "revenue")),
    ("bar", ["a", "b"], [], ("a", "b")), ("pie", [], ["x", "y"], ("x", "y")),
    ("radar", ["v"], ["k"], ("k", "v")), ("radial", ["v"], [], (None, "v"))])
def test_axes(chart, numeric, category, want):
    spec = shape.choose_axes(category + numeric, shape.ColumnKinds(numeric, category), chart)
    assert (spec.x, spec.y) == want


def test_table_and_empty_charts(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert shape.chart_spec(df, "table").columns == ["n", "t"]
    assert shape.chart_spec(df.limit(0), "bar").x is None
    assert shape.chart_spec(df, "none").x is None


def test_pie_frame_converts_cents(spark):
    df = spark.createDataFrame([("pos", 1234, "7")], "channel string, total_cents bigint, n string")
    kinds = shape.classify(df)
    spec = shape.choose_axes(df.columns, kinds, "pie")
    row = shape.format_for_chart(df, spec, kinds).first().asDict()
    assert row == {"channel": "pos", "total": 12.34, "n": 7.0, "name": "pos", "value": 12.34}


def test_bar_frame_turns_one_wide_row_into_rows(spark):
    df = spark.createDataFrame([(5, 2.5)], "dine_in int, take_out double")
    kinds = shape.classify(df)
    long, names = shape.bar_frame(df, shape.ChartSpec("bar", "dine_in", "take_out"), kinds)
    assert names == ["value"]
    assert sorted(tuple(r) for r in long.collect()) == [("dine in", 5.0), ("take out", 2.5)]
    two = df.unionAll(df)
    assert shape.bar_frame(two, shape.ChartSpec("bar", "x", "y"), kinds)[1] == ["dine_in", "take_out"]


def test_display_and_summary(spark):
    df = spark.createDataFrame([(1234567.5, None, True, [1])],
                               "n double, t string, b boolean, a array<int>")
    assert tuple(shape.display_text(df).first()) == ("1,234,567.5", "-", "Yes", "[1]")
    got = shape.summary(spark.range(25), ["id"])
    assert got["row_count"] == 25 and [r["id"] for r in got["rows"]] == list(range(10))
    assert shape.header_labels(spark, ["total_units", "avgPrice"]) == ["Total Units", "AvgPrice"]


def test_cleaned_statements(spark):
    texts = ["```sql\nSELECT 1;\n```", "a FROM t\nNote: x", "WITH q AS (SELECT 1)\n-- select it\nSELECT 2",
             "SELECT 1\n-- note: because\nFROM t", "SELECT 1\nThis query counts", "SELECT ';' ;  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    run = lambda **k: [r.y for r in df.select("i", query_log.clean_statement("x", **k).alias("y"))
                       .orderBy("i").collect()]
    assert run() == ["SELECT 1", "SELECT a FROM t", "WITH q AS (SELECT 1)\n-- select it\nSELECT 2",
                     "SELECT 1", "SELECT 1\nThis query counts", "SELECT ';' "]
    assert run(repaired=True)[3:5] == ["SELECT 1\n-- note: because\nFROM t", "SELECT 1"]


def test_vote_ties_go_to_the_first(spark):
    rows = [(1, 1, "s1", "[1]", None), (1, 2, "s2", "[2]", None), (1, 3, "s3", "[2]", None),
            (2, 1, "a", "[9]", None), (2, 2, "b", "[8]", None), (2, 3, "c", None, "bad")]
    df = spark.createDataFrame(
        rows, "question_id int, candidate_id int, sql string, result string, error string")
    got = {r.question_id: (r.sql, r.votes, r.confidence) for r in query_log.vote(df).collect()}
    assert got == {1: ("s2", 2, 2 / 3), 2: ("a", 1, 0.5)}


def test_costs(spark):
    calls = spark.createDataFrame(
        [("p", i, m, "x", 1_000_000, c, 1_000_000) for i, (m, c) in enumerate(
            [("grok-4.1-fast", None), ("gpt-5.2", 500_000), ("gpt-oss-20b", 0)])],
        "process_id string, seq bigint, model string, label string, prompt_tokens bigint, "
        "cached_tokens bigint, completion_tokens bigint")
    costs = usage.call_costs(calls, usage.price_table(spark))
    got = {r.model: float(r.total_cost) for r in costs.collect()}
    assert got == {"grok-4.1-fast": 0.7, "gpt-5.2": 14.9625, "gpt-oss-20b": 0.375}
    running = usage.running_costs(costs, bucket_rows=2).orderBy("seq").collect()
    assert [float(r.running_cost) for r in running] == [0.7, 15.6625, 16.0375]
    assert [r.running_calls for r in running] == [1, 2, 3]


def test_conversations(spark):
    t = lambda m: dt.datetime(2025, 1, 1, 0, m)
    rows = [("c1", "assistant", "hi", t(0)), ("c1", "user", "x" * 60, t(1)), ("c1", "user", "late", t(2)),
            ("c2", "user", "hello", t(5))]
    m = spark.createDataFrame(rows, "conversation_id string, role string, content string, created_at timestamp")
    listed = [(r.conversation_id, r.preview, r.message_count)
              for r in conversations.list_conversations(m).collect()]
    assert listed == [("c2", "hello", 1), ("c1", "x" * 50, 3)]
    text = conversations.history_text(m, "c1").first().context
    assert text == "Previous conversation:\nAssistant: hi\nUser: " + "x" * 60 + "\n\n"
    assert conversations.history_text(m, "c2").isEmpty()
    c = spark.createDataFrame([("c1", t(0)), ("c3", t(9))], "id string, created_at timestamp")
    assert {r.id: r.updated_at for r in conversations.touched_at(c, m).collect()} == {
        "c1": t(2), "c3": t(9)}
    assert conversations.conversation_exists(c, "c3") and not conversations.conversation_exists(c, "c2")


def test_stored_answers(spark):
    rows = [("a", "part", "full", '[{"x":1}]'), ("b", " ", "", '[{"x":1}]'), ("c", "part", "full", None),
            ("d", "part", " ", "[]"), ("e", "", "", None)]
    df = spark.createDataFrame(rows, "conversation_id string, partial string, streamed string, charts string")
    got = [(r.conversation_id, r.content, r.charts is not None) for r in
           conversations.stored_answers(df).orderBy("conversation_id", "step").collect()]
    assert got == [("a", "part", False), ("a", "full", True), ("b", "", True), ("c", "full", False),
                   ("d", "part", False)]


def live_rows(spark, folder, name, rows):
    spark.createDataFrame(rows, "id string, source string, source_order_id string, "
                                "created_at timestamp, location_name string, total_cents bigint"
                          ).coalesce(1).write.parquet(f"{folder}/{name}")


def test_streaming_equals_batch_and_upserts(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2025, 1, 1, h, m)
    inbox = tmp_path / "in"
    live_rows(spark, inbox, "one", [("1", "toast", "1", at(9), "A", 100), ("1", "toast", "1", at(9, 5), "A", 100),
                                    ("2", "toast", "2", at(9, 30), "A", 50)])
    schema = spark.read.parquet(f"{inbox}/one").schema
    stream = lambda: (spark.readStream.schema(schema).option("recursiveFileLookup", True)
                      .option("maxFilesPerTrigger", 1).parquet(str(inbox)))
    live_rows(spark, inbox, "two", [("3", "toast", "3", at(10), "A", 70), ("4", "toast", "4", at(9, 50), "B", 5)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.start_hourly(stream(), out, state).awaitTermination()
    got = {(r.hour_start.hour, r.location_name): (r.orders, r.total_cents)
           for r in live.latest_updates(spark, out, ["hour_start", "location_name"]).collect()}
    assert got == {(9, "A"): (3, 250), (9, "B"): (1, 5), (10, "A"): (1, 70)}

    store = SilverStore(spark, str(tmp_path / "store"))
    unique = live.distinct_orders(stream())
    orders = unique.select("id", "source", "source_order_id", "created_at", "total_cents")
    conformed = conform(orders, "orders")
    live.start_upsert(conformed, store, "orders", ["id"], str(tmp_path / "state2")).awaitTermination()
    assert sorted(r.id for r in store.read("orders").collect()) == ["1", "2", "3", "4"]
