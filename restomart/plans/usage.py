"""Model-usage cost accounting over a call log (process_id, seq, model, label, token counts)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restomart.fixed_values import MODEL_PRICES

CALL_COST = "decimal(20,9)"
COST = "decimal(36,9)"
COSTS = ["input_cost", "cached_cost", "output_cost", "total_cost"]
# Rows of one process and bucket are summed together before the running total crosses buckets.
BUCKET_ROWS = 100_000


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(m, *[Decimal(str(p)) for p in prices]) for m, *prices in MODEL_PRICES]
    kind = "decimal(9,3)"
    return spark.createDataFrame(
        rows, f"model string, input_price {kind}, cached_price {kind}, output_price {kind}")


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Exact dollars per call: uncached, cached and output tokens at their price per million."""
    cached = F.coalesce("cached_tokens", F.lit(0))
    def cost(tokens, price):
        return (tokens.cast("decimal(18,0)") * F.col(price) * F.lit(Decimal("0.000001"))).cast(CALL_COST)
    priced = calls.join(prices, "model").withColumns({
        "input_tokens": F.col("prompt_tokens") - cached, "cached_tokens": cached})
    return (
        priced.withColumns({
            "input_cost": cost(F.col("input_tokens"), "input_price"),
            "cached_cost": cost(F.col("cached_tokens"), "cached_price"),
            "output_cost": cost(F.col("completion_tokens"), "output_price")})
        .withColumn("total_cost", (F.col("input_cost") + F.col("cached_cost")
                                   + F.col("output_cost")).cast(CALL_COST))
        .drop("input_price", "cached_price", "output_price")
    )


def usage_totals(costs: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and costs per key (process, model, label)."""
    tokens = ["input_tokens", "cached_tokens", "completion_tokens"]
    total_tokens = F.col("input_tokens") + F.col("cached_tokens") + F.col("completion_tokens")
    return costs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in tokens],
        F.sum(total_tokens).alias("total_tokens"),
        *[F.sum(c).cast(COST).alias(c) for c in COSTS])


def running_costs(costs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Running cost and call count per process in ``seq`` order.

    A process of any length is cut into buckets of ``seq``: buckets are summed first, the sums
    run over buckets, and rows run inside their bucket, so no task sees a whole process.
    """
    bucketed = costs.withColumn("_bucket", F.floor(F.col("seq") / bucket_rows))
    sums = bucketed.groupBy("process_id", "_bucket").agg(
        F.sum("total_cost").alias("_cost"), F.count(F.lit(1)).alias("_calls"))
    before = (Window.partitionBy("process_id").orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    offsets = sums.select(
        "process_id", "_bucket",
        F.coalesce(F.sum("_cost").over(before), zero).cast("decimal(32,9)").alias("_cost"),
        F.coalesce(F.sum("_calls").over(before), zero).alias("_calls"))
    inside = (Window.partitionBy("process_id", "_bucket").orderBy("seq")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (
        bucketed.join(offsets, ["process_id", "_bucket"])
        .withColumns({
            "running_cost": (F.sum("total_cost").over(inside) + F.col("_cost")).cast(COST),
            "running_calls": F.count(F.lit(1)).over(inside) + F.col("_calls")})
        .drop("_bucket", "_cost", "_calls")
    )
