"""Connected components of an edge table, by repeated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``component`` (its smallest vertex) for edges ``a``, ``b``.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    the rounds grow with the logarithm of a component's width. Labels of a round are written to
    the shared folder. Minima are taken before the shuffle, so a vertex of many edges is no
    hot group. Rows with a null end are ignored; without edges the result is empty.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b")
    both = materialize(pairs.select("a", "b").unionAll(pairs.select(F.col("b"), F.col("a"))).distinct(),
                       "component-edges")
    labels = materialize(both.groupBy(F.col("a").alias("vertex")).agg(
        F.least(F.col("vertex"), F.min("b")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("vertex").alias("b"), F.col("component").alias("near"))
        lower = (both.join(seen, "b").groupBy(F.col("a").alias("vertex")).agg(F.min("near").alias("near"))
                 .join(labels, "vertex").select("vertex", F.least("near", "component").alias("label"),
                                                F.col("component").alias("before")))
        jump = labels.select(F.col("vertex").alias("label"), F.col("component").alias("further"))
        after = materialize(lower.join(jump, "label", "left").select(
            "vertex", F.least("label", F.coalesce("further", "label")).alias("component"), "before"), "labels")
        if after.filter("component <> before").isEmpty():
            return after.select("vertex", "component")
        labels = after.select("vertex", "component")
