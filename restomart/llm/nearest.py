"""Nearest vectors by multi-index hashing of learnt rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


SAMPLE_ROWS = 4_000  # vectors that rotation and radius are learnt on
MAX_BITS = 64
SUBSTRING = 8  # bits of a substring, so a table has 256 buckets
SHARD_ROWS = 4_096  # indexed vectors in one block
QUERY_ROWS = 1_024  # queries in one block
ASKED_ROWS = 128  # queries that search a block at once
WIDER = 4  # further bits of the radius for a query that found too few
COVER = 0.95  # share of true neighbours in the sample that the radius must hold
ROTATION_ROUNDS = 30

_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


@dataclass
class BinaryCodes:
    """Signs of centred, rotated vectors; ``radius`` holds most true neighbours."""
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of packed codes, eight bytes at a time where they fill that."""
    if a.shape[-1] == 8:
        return np.bitwise_count(a.view(np.uint64)[..., 0] ^ b.view(np.uint64)[..., 0])
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def learn_codes(x: np.ndarray, k: int, rows: int | None = None, seed: int = 10) -> BinaryCodes:
    """Principal axes, then the rotation that brings the vectors nearest to their signs.

    The radius is the ``COVER`` quantile of the code distances between sampled vectors and their
    true nearest in the sample: as many as make up the share that ``k`` is of all ``rows``, and one at
    least. So it shrinks as the table grows.
    """
    centre = x.mean(axis=0)
    bits = min(MAX_BITS, x.shape[1])
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False)
    axes = axes[:bits].T
    low = (x - centre) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ROTATION_ROUNDS):
        u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
        turn = (u @ v).T
    codes = BinaryCodes(centre, axes @ turn, axes.shape[1])
    packed = codes.encode(x)
    probe = x[:512]
    product = probe @ x.T
    product[np.arange(len(probe)), np.arange(len(probe))] = -np.inf
    take = min(-(-k * len(x) // max(rows or 0, len(x))), len(x) - 1)
    if take > 0:
        near = np.argpartition(-product, take - 1, axis=1)[:, :take]
        distance = hamming(packed[:len(probe), None, :], packed[near])
        codes.radius = int(np.ceil(np.quantile(distance, COVER)))
    return codes


class MultiIndex:
    """The codes of a block with one table of 256 buckets for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [np.ascontiguousarray(c) for c in codes.T]  # the bucket of every row

    def within(self, codes: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which rows lie within each asked code's radius: by the pigeonhole principle one of the first
        ``radius % m + 1`` substrings differs in at most ``radius // m`` bits or one of the others
        in fewer, so only the rows in those buckets are compared."""
        m = len(self.tables)
        hit = np.zeros((len(codes), len(self.codes)), bool)
        for j, buckets in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            hit |= (_DISTANCE[codes[:, j]] <= reach[:, None])[:, buckets]
        rows = np.flatnonzero(hit.any(axis=0))
        hit[:, rows] &= hamming(codes[:, None], self.codes[rows]) <= radius[:, None]
        return hit


def best_of_block(x: np.ndarray, ids: np.ndarray, tables: MultiIndex, q: np.ndarray, own: np.ndarray, codes: np.ndarray,
                  radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked row, indexed row, score) of the ``k`` best within the radius for each asked vector. It grows
    for those that found fewer than there are, so no block is searched in another way."""
    other = ids != own[:, None]
    wanted, reach = np.minimum(other.sum(axis=1), k), np.full(len(q), radius)
    hit = tables.within(codes, reach) & other
    while len(few := np.flatnonzero(hit.sum(axis=1) < wanted)):
        reach[few] += WIDER
        hit[few] = tables.within(codes[few], reach[few]) & other[few]
    with np.errstate(all="ignore"):
        rough = np.where(hit, q @ x.T, -np.inf)
        if k < len(x):
            # The rough product only leaves out what rounding cannot bring among the best.
            slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0.0)
            least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - slack
            hit &= ~(rough < least[:, None])
        asked, rows = np.nonzero(hit)
        score = (x[rows] * q[asked]).sum(axis=1)
    order = np.lexsort((ids[rows], -score, asked))
    asked, rows, score = asked[order], rows[order], score[order]
    place = np.arange(len(asked)) - np.searchsorted(asked, asked)
    return asked[place < k], rows[place < k], score[place < k]


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors as doubles, without those that are null, zero or not finite throughout."""
    v = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 20,
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` vectors of largest inner product for every query, other than the query's own id.

    The reference data of this library has no vectors, so the operator is general: ``vectors`` and
    ``queries`` have ``id`` (long) and ``vector`` (numbers, one length). Gives ``query_id``, ``rank`` (from
    1), ``id`` and ``score`` (the inner product in double precision), nearest first, ties to the
    smaller id; fewer than ``k`` rows only where there are fewer candidates.

    Codes are learnt on up to ``sample_rows`` vectors drawn by hash; every vector is indexed. The
    index is dealt by hash into blocks of about ``SHARD_ROWS`` rows, each with its own substring
    tables; every block of queries visits every block, gets all codes within the radius, reranks
    them by the original vectors and keeps its ``k`` best. The radius grows for a query that finds fewer.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do null
    ids. Repeated candidate rows count as candidates of their own; repeated query rows are one
    query. Vectors of another length than the most common one take no part. Other columns are
    ignored. Without vectors or queries the result is empty.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    usable = _usable(vectors).filter("id is not null")
    sizes = usable.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "id", "score")
    size, rows = sizes[0]["size"], sizes[0]["n"]
    usable = usable.filter(F.size("vector") == size)
    asked = _usable(queries).filter((F.size("vector") == size) & F.col("id").isNotNull()).dropDuplicates(["id"])

    # Copies of one vector share their lot, and only one of them enters the sample.
    lot = F.pmod(F.xxhash64("vector"), F.lit(1_000_000))
    sample = usable.filter(lot < 2_000_000 * sample_rows / rows).select("vector").distinct().orderBy(
        F.xxhash64("vector"), "vector").limit(sample_rows).toPandas()
    if not len(sample):
        sample = usable.select("vector").limit(1).toPandas()
    codes = learn_codes(np.stack(sample["vector"].to_numpy()), k, rows)

    shards, blocks = -(-rows // SHARD_ROWS), max(1, -(-asked.count() // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    index = usable.select("*", own(shards, 1).alias("shard"), every(blocks).alias("block"))
    asked = asked.select("*", own(blocks, 2).alias("block"), every(shards).alias("shard"))

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        have = have.sort_values("id", kind="stable")
        x, ids = np.stack(have["vector"].to_numpy()), have["id"].to_numpy()
        tables = MultiIndex(codes.encode(x))
        q, own, out = np.stack(want["vector"].to_numpy()), want["id"].to_numpy(), []
        for i in range(0, len(q), ASKED_ROWS):
            part, mine = q[i:i + ASKED_ROWS], own[i:i + ASKED_ROWS]
            asked, rows, score = best_of_block(x, ids, tables, part, mine, codes.encode(part), codes.radius, k)
            out.append(pd.DataFrame({"query_id": mine[asked], "id": ids[rows], "score": score}))
        return pd.concat(out)

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
