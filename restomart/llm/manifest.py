"""Merkle manifest of stored orders: one hash tree per source, proofs by one multiproof per leaf partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restomart.llm.common import materialize
from restomart.session import split_skewed_joins
from restomart.sources.silver import SCHEMAS

FIELDS = tuple(SCHEMAS["orders"])
PART_LEAVES = 10_000  # consecutive leaves of one leaf partition
FIRST_STEP = 22  # levels joined in the first round above the leaf partitions, and in each later one
NEXT_STEP = 12
TOP = -1  # number of the tree over the sources

NODE = "tree long, n long, level int, idx long, digest string, is_root boolean"
NEED = "part long, tree long, level int, idx long"


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves: 0 for a lone leaf."""
    return max(n - 1, 0).bit_length()


def _width(n: int, level: int) -> int:
    return -(-n >> level)


def missing_coordinates(places: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The least (level, index) set that, with the leaves at ``places``, yields all their proofs.

    On each level a sibling is missing if it exists and is not derived from what is known below;
    siblings on one another's paths are never asked for, and a shared one is asked for once.
    """
    known, out = np.unique(np.fromiter(places, np.int64)), []
    for level in range(height(n)):
        beside = known ^ 1
        absent = beside[(beside < _width(n, level)) & ~np.isin(beside, known, assume_unique=True)]
        out += [(level, int(i)) for i in absent]
        known = np.unique(known >> 1)
    return out


def _derived(levels: dict[int, dict[int, str]], n: int, upto: int) -> list[tuple[int, int]]:
    """Fill in every parent of which all children are known; the coordinates that were added."""
    added = []
    for level in range(min(levels, default=0), min(upto, height(n))):
        here, above, width = levels.get(level, {}), levels.setdefault(level + 1, {}), _width(n, level)
        for i, digest in here.items():
            if i & 1 or i >> 1 in above:
                continue
            pair = (digest,) if i + 1 >= width else (digest, here.get(i + 1))
            if pair[-1] is not None:
                above[i >> 1] = _hash(*pair)
                added.append((level + 1, i >> 1))
    return added


def _outermost(leaves: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Nodes that a leaf partition derives alone and of which the parents need other partitions."""
    digests, out, start = leaves.sort_values("place")["leaf"].tolist(), [], 0
    for run in runs.sort_values("tree").itertuples():
        levels = {0: dict(zip(range(run.first, run.first + run.m), digests[start:start + run.m]))}
        start += run.m
        _derived(levels, run.n, height(run.n))
        for level, nodes in levels.items():
            above = levels.get(level + 1, {})
            out += [(run.tree, run.n, level, i, d, level == height(run.n)) for i, d in nodes.items()
                    if i >> 1 not in above]
    return pd.DataFrame(out, columns=["tree", "n", "level", "idx", "digest", "is_root"])


def _joined(upto: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        levels: dict[int, dict[int, str]] = {}
        for level, i, digest in zip(nodes["level"], nodes["idx"], nodes["digest"]):
            levels.setdefault(level, {})[i] = digest
        tree, n = nodes["tree"].iat[0], int(nodes["n"].iat[0])
        out = [(tree, n, level, i, levels[level][i], level == height(n)) for level, i in _derived(levels, n, upto)]
        return pd.DataFrame(out, columns=["tree", "n", "level", "idx", "digest", "is_root"])
    return run


def _grown(nodes: DataFrame, tallest: int, step: int) -> DataFrame:
    """``nodes`` with all nodes above them, a block of ``step`` levels at a time: a block holds what
    lies under one node of its upper level, so no group grows with the tree."""
    base = 0
    while base < tallest:
        upto = base + step
        block = nodes.filter((F.col("level") >= base) & (F.col("level") <= upto))
        above = block.groupBy("tree", F.expr(f"shiftright(idx, {upto} - level)")).applyInPandas(_joined(upto), NODE)
        nodes = nodes.unionByName(materialize(above, "manifest-nodes"))
        base, step = upto, NEXT_STEP
    return nodes


def _needed(runs: pd.DataFrame) -> pd.DataFrame:
    part = runs["part"].iat[0]
    out = [(part, TOP, *at) for at in missing_coordinates(runs["rank"], int(runs["sources"].iat[0]))]
    for run in runs.itertuples():
        out += [(part, run.tree, *at) for at in missing_coordinates(range(run.first, run.first + run.m), run.n)]
    return pd.DataFrame(out, columns=["part", "tree", "level", "idx"])


def _path(levels: dict[int, dict[int, str]], place: int, n: int) -> list[tuple[str, bool]]:
    """Siblings from the leaf at ``place`` up, each with whether it stands left; "" where there is none."""
    out = []
    for level in range(height(n)):
        beside = levels[level][place ^ 1] if place ^ 1 < _width(n, level) else ""
        out.append((beside, bool(place & 1)))
        place >>= 1
    return out


def _folded(digest: str, path: list[tuple[str, bool]]) -> str:
    for beside, left in path:
        digest = _hash(beside, digest) if left else _hash(digest, beside)
    return digest


def _expanded(leaves: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one partition from its runs and the nodes fetched for it."""
    leaves = leaves.sort_values("place")
    fetched: dict[int, dict[int, dict[int, str]]] = {}
    for node in facts[facts["m"] == 0].itertuples():
        fetched.setdefault(node.tree, {}).setdefault(node.level, {})[node.idx] = node.digest
    runs = list(facts[facts["m"] > 0].sort_values("tree").itertuples())
    own, received = leaves["leaf"].tolist(), leaves["received_leaf"].fillna(leaves["leaf"]).tolist()
    start, top, trees = 0, fetched.get(TOP, {}), {}
    for run in runs:
        levels = trees[run.tree] = fetched.get(run.tree, {})
        levels.setdefault(0, {}).update(zip(range(run.first, run.first + run.m), own[start:start + run.m]))
        start += run.m
        _derived(levels, run.n, height(run.n))
        top.setdefault(0, {})[run.rank] = levels[height(run.n)][0]
    sources = runs[0].sources
    _derived(top, sources, height(sources))
    root, out, at = top[height(sources)][0], [], 0
    for run in runs:
        upper, subroot = _path(top, run.rank, sources), top[0][run.rank]
        for place in range(run.first, run.first + run.m):
            path = _path(trees[run.tree], place, run.n) + upper
            folded = _folded(received[at], path)
            out.append((subroot, root, _hash(*[beside for beside, _ in path]), folded, folded == root))
            at += 1
    out = pd.DataFrame(out, columns=["subroot", "root", "proof_sha256", "folded_root", "verified"])
    return pd.concat([leaves[["id_text", "source", "leaf"]].reset_index(drop=True), out], axis=1)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _placed(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``place``, the number of each row in ascending order (nulls first, text bytewise)."""
    order = [F.col(c).asc_nulls_first() for c in by]
    stored = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("sorted_part")
    rows = stored.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    # One row per sorted partition, so the running sum and the broadcast are of that many rows.
    starts = rows.select("sorted_part", (F.sum("rows").over(Window.orderBy("sorted_part")) - F.col("rows")).alias("start"))
    here = stored.select("*", part).join(F.broadcast(starts), "sorted_part")
    return here.select(*df.columns, (F.col("start") + F.col("at") - F.shiftleft("sorted_part", 33)).alias("place"))


def order_manifest(orders: DataFrame, fields: Sequence[str] = FIELDS,
                   received: Mapping[str, Column] | None = None) -> DataFrame:
    """Merkle tree over stored orders, with every order's proof checked against what was received.

    Takes ``orders`` (``id``, ``source`` and the hashed ``fields``; any table with these columns will
    do) and gives per row ``id``, ``source``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``,
    ``folded_root``, ``verified``.

    A leaf is the SHA-256 of its fields in the given order, each ``-`` if null, else byte count, colon
    and text. The leaves of a source ascend by ``id``; each two consecutive nodes are hashed into one
    (a last single one alone) up to the subroot of the source, and the subroots, by source, likewise up
    to the root. ``proof_sha256`` is the hash of a leaf's siblings from the bottom to the root.
    ``received`` gives, for the fields that may have changed on the way, the value as received;
    ``folded_root`` is the root that the received order and the stored siblings lead to, and
    ``verified`` whether it is the stored root.

    Leaves are sorted by range and cut into partitions of ``PART_LEAVES`` consecutive ones, whatever
    their sources. Each partition asks for the least set of nodes that it cannot derive, gets them by one
    join, derives what its proofs share, and expands the proofs itself. Only nodes that cross partitions
    are stored, some 30 for a partition.

    A null source is a source of its own and comes first, a null id comes first in its source. Rows of one
    id follow each other by leaf, equal rows are leaves of their own. Null fields hash as ``-``, empty
    ones as ``0:``; fields of other types are hashed in their text form. Other columns are ignored. An
    empty table gives an empty result.
    """
    split_skewed_joins(orders.sparkSession)
    now = [F.col(f) for f in fields]
    then = [(received or {}).get(f, F.col(f)) for f in fields]
    leaves = orders.select("source", "id", _leaf(now).alias("leaf"), _leaf(then).alias("received_leaf"))
    leaves = leaves.select("source", "id", "leaf", F.nullif("received_leaf", F.col("leaf")).alias("received_leaf"),
                           F.monotonically_increasing_id().alias("copy"))
    # The number of a stored row ends every tie, so that even equal rows spread over the sorted partitions.
    leaves = _placed(materialize(leaves, "manifest-leaves"),
                     ["source", "id", "leaf", "received_leaf", "copy"], "manifest-ordered")
    leaves = leaves.withColumn("part", F.floor(F.col("place") / PART_LEAVES))
    runs = materialize(leaves.groupBy("part", "source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("m")),
                       "manifest-runs")
    sources = runs.groupBy("source").agg(F.min("start").alias("tree"), F.sum("m").alias("n"))
    sources = materialize(_placed(sources, ["tree"], "manifest-sources"), "manifest-sources")
    size = sources.agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    runs = materialize(runs.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "part", "tree", "n", F.col("place").alias("rank"), F.lit(size["sources"]).alias("sources"),
        (F.col("start") - F.col("tree")).alias("first"), "m"), "manifest-runs")

    by_part = lambda df: df.groupBy("part")
    lean = leaves.select("part", "place", "leaf")
    nodes = materialize(by_part(lean).cogroup(by_part(runs)).applyInPandas(_outermost, NODE), "manifest-nodes")
    nodes = _grown(nodes, height(size["n"] or 0), FIRST_STEP)
    top = nodes.filter("is_root").select("tree", "digest").join(sources.select("tree", "place"), "tree").select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(size["sources"]).alias("n"), F.lit(0).alias("level"),
        F.col("place").alias("idx"), "digest", F.lit(size["sources"] == 1).alias("is_root"))
    nodes = nodes.unionByName(_grown(materialize(top, "manifest-nodes"), height(size["sources"]), NEXT_STEP))

    fetched = by_part(runs).applyInPandas(_needed, NEED).join(nodes, ["tree", "level", "idx"]).select(
        "part", "tree", "level", "idx", "digest")
    facts = materialize(runs.unionByName(fetched, allowMissingColumns=True).fillna(0, ["m", "n", "rank", "sources", "first"])
                        .fillna(-1, ["level", "idx"]), "manifest-fetched")
    wide = leaves.select("part", "place", F.col("id").cast("string").alias("id_text"), "source", "leaf", "received_leaf")
    kind = orders.schema["source"].dataType.simpleString()
    proofs = by_part(wide).cogroup(by_part(facts)).applyInPandas(
        _expanded, f"id_text string, source {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                   "folded_root string, verified boolean")
    return proofs.select(F.col("id_text").cast(orders.schema["id"].dataType).alias("id"), *proofs.columns[1:])
