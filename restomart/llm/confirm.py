"""Links between texts, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import column, edge_batch, materialize
from restomart.llm.shingles import set_key, shingle_set, text_bytes

SLICE = 1000  # partners of one text that one task compares it with


def _fitting(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = column(batch, "set_key").to_pylist()
            sets = (shingle_set(t, width) for t in text_bytes(column(batch, "content")))
            fits = [len(s) > 0 and set_key(s) == k for k, s in zip(keys, sets)]
            yield batch.filter(pa.array(fits, pa.bool_())).select(["set_key", "content"])
    return run


def class_texts(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """One text for each ``set_key`` of ``wanted`` (``set_key``, ``first_id``), fetched from ``texts`` (``id``,
    ``content``) by id; of several rows of one id those count that have the set."""
    return texts.join(wanted, F.col("id").eqNullSafe(F.col("first_id"))).select("set_key", "content").mapInArrow(
        _fitting(width), "set_key binary, content string").dropDuplicates(["set_key"])


def _similar(width: int, percent: int):
    """Edges whose sets are similar; each group has the text of ``a`` first, then those of its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            found = []
            for a, b, text in zip(column(batch, "a"), column(batch, "b"), text_bytes(column(batch, "content"))):
                shingles = shingle_set(text, width)
                if not b.is_valid:
                    centre = shingles
                    continue
                both = np.concatenate([centre, shingles])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    found.append((a.as_py(), b.as_py()))
            yield edge_batch(found)
    return run


def confirmed(edges: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``edges`` (``a``, ``b``) whose texts (``set_key``, ``content``) are ``percent`` or more alike.

    A text travels once per slice of its partners and no row holds two texts; a task holds one set and
    a batch of texts, whatever the number of partners.
    """
    edges = materialize(edges.distinct(), "candidate-pairs")
    slices = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    cut = edges.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), "slices").alias("slice"))
    partners = cut.join(texts, F.col("b") == F.col("set_key")).select("a", "slice", "b", "content")
    centres = cut.select("a", "slice").distinct().join(texts, F.col("a") == F.col("set_key")).select(
        "a", "slice", F.lit(None).cast("binary").alias("b"), "content")
    return materialize(
        partners.unionByName(centres).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
        .mapInArrow(_similar(width, percent), "a binary, b binary"), "links")
