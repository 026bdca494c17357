"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: local threads, BENCH_RUNS: timed runs after one warm-up.
Results go to the no-op sink, so every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from restomart import registry
from restomart.plans import gold
from restomart.session import build_session
from restomart.sources.star_adapter import silver_from_star

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = [
    *gold.MARTS, "r01_sales_by_location", "r02_revenue_last_week", "r03_top_items",
    "r08_top_items_at_location", "r09_beverage_sales", "r12_source_mix", "r14_peak_hours",
    "r16_delivery_trend", "r18_payment_type_by_source", "r19_hourly_by_weekday",
    "r20_orders_by_location_over_time", "r21_category_by_source", "p12_square_items",
    "q07_orphans", "q08_row_rules", "v01_vote", "n05_find_products", "n11_labels", "n12_near_pairs",
    "q04_integrity_report",
]


def plain_daily_sales(spark, sf_dir):
    """The daily mart with literal distinct counts, for comparison."""
    o = gold.gold_orders(silver_from_star(spark, sf_dir))
    distinct = lambda c: F.count_distinct(F.when(c, F.col("order_id")))
    kinds = {k: gold._order_type_is(k) for k in gold.ORDER_TYPE_GROUPS}
    kinds.update({k: F.col("source") == k for k in gold.SOURCES})
    return o.groupBy("location_name", "order_date").agg(
        F.count_distinct("order_id").alias("order_count"), F.sum("total").alias("revenue"),
        *[distinct(c).alias(f"{k}_orders") for k, c in kinds.items()],
        *[F.sum(F.when(c, F.col("total")).otherwise(0)).alias(f"{k}_revenue")
          for k, c in kinds.items()],
        F.sum("tip").alias("total_tips"), F.sum("commission").alias("total_commission"))


def plain_product_by_location(spark, sf_dir):
    """The product mart with a literal distinct count, for comparison."""
    items = gold.gold_order_items(silver_from_star(spark, sf_dir)).filter("product_name is not null")
    return items.groupBy("product_name", "category_name", "location_name").agg(
        F.count_distinct("order_id").alias("orders_containing"), F.sum("quantity"),
        F.sum("total_price"), F.avg("unit_price"))


def seconds(spark, query) -> float:
    def once() -> float:
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start
    once()
    return round(statistics.median(once() for _ in range(RUNS)), 3)


def main() -> None:
    spark = build_session("restomart-bench", **{
        "spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "6g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.all_queries()
    times = {name: seconds(spark, every[name]) for name in HEADLINES}
    compare = {"gold_daily_sales_count_distinct": seconds(spark, plain_daily_sales),
               "gold_product_by_location_count_distinct": seconds(spark, plain_product_by_location)}
    print(json.dumps({"metric": "headline queries, median seconds summed",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "comparison": compare, "sf": os.path.basename(SF_DIR.rstrip("/")),
                      "cpus": int(CPUS), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
