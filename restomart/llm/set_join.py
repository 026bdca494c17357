"""Messages whose shingle sets are alike: an exact join by R-trees over group counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import column, contents, edge_batch, materialize, rows_of
from restomart.llm.components import connected_components
from restomart.llm.confirm import class_texts, confirmed
from restomart.llm.shingles import SHINGLE_WORDS, set_key, shingle_set, text_bytes
from restomart.session import split_skewed_joins

COUNTERS = 1 << 18  # shared counters that order shingles from rare to frequent
LEAST_GROUPS = 16
GROUP_SIZE = 2  # shingles that share a group on average, at most
ROUGH = 4  # groups of a point that are one group of its rough form
LEAF, FANOUT = 16, 8
TILE_ROWS, TILE_BYTES = 1024, 16 << 20
ROUNDS = 2  # searches for nearest partners before the search for all
CHUNK = 1 << 22  # counts that are compared at once

Batches = Iterator[pa.RecordBatch]


def _short(key: bytes) -> int:
    """The first half of a set's key."""
    return int.from_bytes(key[:8], "little", signed=True)


def point(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group.

    There is a power of two of groups, at least one for each ``GROUP_SIZE`` shingles and so many that a byte
    holds each count. A group is the leading bits of a hash, so neighbours add up to the groups of a
    shorter point.
    """
    n = max(LEAST_GROUPS, 1 << (max(len(shingles) - 1, 1) // GROUP_SIZE).bit_length())
    while True:
        counts = np.bincount((shingles >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64), minlength=n)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        n *= 2


def rough(counts: np.ndarray) -> np.ndarray:
    """The point with ``ROUGH`` groups in one, unless too few or too full ones would be left."""
    wide = counts.reshape(-1, ROUGH).sum(axis=1)
    return wide.astype(np.uint8) if len(wide) >= LEAST_GROUPS and wide.max() < 256 else counts


def folded(points: list[np.ndarray], n: int) -> np.ndarray:
    """Points of at least ``n`` groups as rows of ``n`` counts."""
    return np.stack([p.reshape(n, -1).sum(axis=1, dtype=np.int32) for p in points]).astype(np.int16 if n > LEAST_GROUPS else np.int32)


def _scan(width: int):
    """Size, key and point (also in a rough form) of each message's set, and at the end of the task its
    shingles by shared counter."""
    names = ["id", "n_shingles", "set_key", "short", "point", "rough", "counters", "counts"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Batches) -> Batches:
        totals, id_type = np.zeros(COUNTERS, np.int64), None
        for batch in batches:
            ids = column(batch, "id")
            id_type, found = ids.type, []
            for text in text_bytes(column(batch, "content")):
                shingles = shingle_set(text, width)
                np.add.at(totals, (shingles % np.uint64(COUNTERS)).astype(np.int64), 1)
                if len(shingles):
                    key, counts = set_key(shingles), point(shingles)
                    found.append((len(shingles), key, _short(key), counts.tobytes(), rough(counts).tobytes(), None, None))
                else:
                    found.append((0, *[None] * 6))
            columns = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], names=names)
        used = np.flatnonzero(totals)
        if len(used):
            nothing = [pa.nulls(1, kind) for kind in (id_type, *kinds[:5])]
            yield pa.RecordBatch.from_arrays(
                [*nothing, pa.array([used.astype(np.int32)]), pa.array([totals[used]])], names=names)
    return run


def _levels(scanned: DataFrame) -> np.ndarray:
    """Coarse frequency of each counter over all messages (four levels for each doubling)."""
    pairs = scanned.select(F.explode(F.arrays_zip("counters", "counts")).alias("c")).groupBy("c.counters").agg(
        F.sum("c.counts").alias("n"))
    out = np.zeros(COUNTERS, np.uint8)
    for r in pairs.collect():
        out[r["counters"]] = 1 + int(4 * np.log2(r["n"]))
    return out


def prefix(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as a similar set can lack, and one more."""
    wanted = len(shingles) - -(-percent * len(shingles) // 100) + 1
    order = np.lexsort((shingles, levels[(shingles % np.uint64(len(levels))).astype(np.int64)]))
    return shingles[order[:wanted]]


def _cells(width: int, percent: int, levels: np.ndarray):
    """The cells of each different set that a task meets."""
    def run(batches: Batches) -> Batches:
        seen: set[bytes] = set()
        for batch in batches:
            parts, owners = [], []
            for text in text_bytes(column(batch, "content")):
                shingles = shingle_set(text, width)
                if len(shingles) and (key := set_key(shingles)) not in seen:
                    seen.add(key)
                    parts.append(prefix(shingles, levels, percent).view(np.int64))
                    owners.append(_short(key))
            if parts:
                short = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(short)], names=["cell", "short"])
    return run


class CountTree:
    """An R-tree over points of group counts, packed by halving along the widest coordinate.

    Each node keeps the largest count of every group, the bounds of the set sizes below it, and the
    component if all of its points are of one. Two sets share at most the summed minima of their counts,
    so a node is left out if even its largest counts leave too little in common.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray, percent: int):
        self.percent = percent
        if len(points) <= LEAF:
            self.order, self.levels = np.arange(len(points)), [(points, sizes, sizes, components, None)]
            return
        order, stack = [], [np.arange(len(points))]
        while stack:
            at = stack.pop()
            if len(at) <= LEAF:
                order.append(at)
                continue
            spread = np.ptp(points[at], axis=0)
            by = at[np.argsort(points[at, spread.argmax()], kind="stable")]
            half = -(-len(at) // 2 // LEAF) * LEAF
            stack += [by[half:], by[:half]]
        self.order = np.concatenate(order)
        p, s, c = points[self.order], sizes[self.order], components[self.order]
        # From the points up: largest counts, sizes, component (-1: several), children of each node.
        self.levels = [(p, s, s, c, None)]
        starts = np.cumsum([0, *map(len, order)])
        while True:
            heads, ends = starts[:-1], starts[1:]
            _, low, high, of, _ = self.levels[-1]
            least, most = np.minimum.reduceat(of, heads), np.maximum.reduceat(of, heads)
            self.levels.append((np.maximum.reduceat(self.levels[-1][0], heads), np.minimum.reduceat(low, heads),
                                np.maximum.reduceat(high, heads), np.where(least == most, least, -1), (heads, ends)))
            if len(heads) <= FANOUT:
                break
            starts = np.append(np.arange(0, len(heads), FANOUT), len(heads))

    def search(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked point, indexed point, bound on the overlap) of all pairs that may be similar and are
        of different components."""
        top = len(self.levels[-1][0])
        asked, node = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            counts, low, high, of, children = self.levels[depth]
            bound = np.empty(len(asked), np.int64)
            step = max(1, CHUNK // points.shape[1])
            for i in range(0, len(asked), step):
                bound[i:i + step] = np.minimum(points[asked[i:i + step]], counts[node[i:i + step]]).sum(axis=1, dtype=np.int64)
            s = sizes[asked]
            near = ((100 + self.percent) * bound >= self.percent * (s + low[node])) & (
                100 * high[node] >= self.percent * s) & (100 * s >= self.percent * low[node]) & (
                (of[node] < 0) | (of[node] != components[asked]))
            asked, node, bound = asked[near], node[near], bound[near]
            if children is not None:
                times = (children[1] - children[0])[node]
                first = np.repeat(children[0][node] - np.cumsum(times) + times, times)
                asked, node = np.repeat(asked, times), first + np.arange(times.sum())
        return asked, self.order[node], bound


class _Tile:
    """Rows of one cell as arrays; points of one length are searched together."""

    def __init__(self, rows: list[tuple], codes: dict[bytes, int]):
        self.keys = [r[0] for r in rows]
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.components = np.array([codes.setdefault(r[2] or r[0], len(codes)) for r in rows])
        self.points = [np.frombuffer(r[3], np.uint8) for r in rows]
        lengths = np.array([len(p) for p in self.points])
        self.of_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}

    def part(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return folded([self.points[i] for i in at], n), self.sizes[at], self.components[at]


def _fitting_sizes(tile: _Tile, percent: int) -> bool:
    """Whether any two rows of a tile, which come by size, may be similar by their sizes."""
    return bool((100 * tile.sizes[:-1] >= percent * tile.sizes[1:]).any())


def _pairs(one: _Tile, two: _Tile, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two tiles that may be similar, and the bound on what they share. Points whose sets could be of
    fitting sizes are compared in the groups of the shorter one."""
    found = [(np.empty(0, np.int64),) * 3]
    for n, ours in one.of_length.items():
        for m, theirs in two.of_length.items():
            if 100 * one.sizes[ours].max() < percent * two.sizes[theirs].min() or (
                    100 * two.sizes[theirs].max() < percent * one.sizes[ours].min()):
                continue
            tree = CountTree(*two.part(theirs, min(n, m)), percent)
            a, b, bound = tree.search(*one.part(ours, min(n, m)))
            found.append((ours[a], theirs[b], bound))
    a, b, bound = map(np.concatenate, zip(*found))
    if one is two:
        once = b < a
        a, b, bound = a[once], b[once], bound[once]
    return a, b, bound


def _tiles(batches: Batches) -> Iterator[tuple[int, list[tuple]]]:
    """(cell, rows) of a stream sorted by cell, cut into tiles of bounded size."""
    last, held, weight = None, [], 0
    for cell, *row in rows_of(batches, "cell", "set_key", "n_shingles", "component", "point", "members"):
        if held and (cell != last or len(held) == TILE_ROWS or weight > TILE_BYTES):
            yield last, held
            held, weight = [], 0
        last = cell
        held.append(tuple(row))
        weight += len(row[3])
    if held:
        yield last, held


NEAREST = "a binary, b binary, share double"


def _partner_batch(found: list[tuple[bytes, bytes | None, float | None]]) -> pa.RecordBatch:
    a, b, share = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(share, pa.float64())], names=["a", "b", "share"])


def _best(near: DataFrame) -> DataFrame:
    """Of the partners that a row has in all its cells the one that may have the most in common with it, so that the
    links of a crowd are as many as its rows. What this leaves apart is left to the later searches."""
    return near.filter("b is not null").groupBy("b").agg(F.min_by("a", F.struct(F.negative("share"), "a")).alias("a")).select("a", "b")


def _nearest(percent: int):
    """For each row of a tile the partner before it that may have the most in common with it, and that share.

    With a null partner come the other rows that later searches need: those that are a partner only, and
    every row of a cell that this tile does not hold as a whole.
    """
    def run(batches: Batches) -> Batches:
        found: list[tuple] = []
        for _, rows in _tiles(batches):
            tile, whole = _Tile(rows, {}), len(rows) == rows[0][4]
            if len(rows) > 1 and _fitting_sizes(tile, percent):
                a, b, bound = _pairs(tile, tile, percent)
                share = bound / (tile.sizes[a] + tile.sizes[b])
                order = np.lexsort((b, -share, a))
                first = order[np.append(True, a[order][1:] != a[order][:-1])] if len(a) else order
                found += [(tile.keys[b[i]], tile.keys[a[i]], float(share[i])) for i in first]
                found += [(tile.keys[i], None, None) for i in np.setdiff1d(b, a)] if whole else []
            found += [] if whole else [(k, None, None) for k in tile.keys]
            if len(found) > 10_000:
                yield _partner_batch(found)
                found = []
        yield _partner_batch(found)
    return run


def _largest_counts(batches: Batches) -> Batches:
    """The largest counts of each tile, of a stream of its points sorted by tile."""
    last, most = None, None
    for *tile, counts in rows_of(batches, "cell", "band", "part", "point"):
        counts = folded([np.frombuffer(counts, np.uint8)], LEAST_GROUPS)[0]
        if last is not None and tile != last:
            yield _tile_batch(last, most)
        most = counts if tile != last else np.maximum(most, counts)
        last = tile
    if last is not None:
        yield _tile_batch(last, most)


def _tile_batch(tile: list[int], most: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in tile), pa.array([most], pa.list_(pa.int32()))],
                                      names=["cell", "band", "part", "most"])


def _joining(one: _Tile, two: _Tile, sets: tuple[list[np.ndarray], list[np.ndarray]], percent: int) -> list[tuple[bytes, bytes]]:
    """The similar pairs of two tiles, by their whole ``sets``, that join components which those before have not joined."""
    found, (a, b, _) = [], _pairs(one, two, percent)
    if not len(a):
        return found
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    lengths = [len(s) for part in sets for s in part]
    numbers = np.split(np.unique(np.concatenate([s for part in sets for s in part]), return_inverse=True)[1], np.cumsum(lengths)[:-1])
    ours, theirs = numbers[:len(sets[0])], numbers[len(sets[0]):] or numbers
    marked = np.zeros(max(n.max() for n in numbers) + 1, bool)
    joined = np.arange(1 + max(one.components.max(), two.components.max()))
    for i, partners in zip(a[np.append(True, a[1:] != a[:-1])], np.split(b, np.flatnonzero(a[1:] != a[:-1]) + 1)):
        partners = partners[joined[two.components[partners]] != joined[one.components[i]]]
        if not len(partners):
            continue
        marked[ours[i]] = True
        shared = np.array([np.count_nonzero(marked[theirs[j]]) for j in partners])
        marked[ours[i]] = False
        for j in partners[100 * shared >= percent * (one.sizes[i] + two.sizes[partners] - shared)]:
            x, y = joined[one.components[i]], joined[two.components[j]]
            if x != y:
                joined[joined == y] = x
                found.append((one.keys[i], two.keys[j]))
    return found


def _links(percent: int):
    """Links of two tiles, fewer than their rows, that join the same components as all of their links; rows come sorted
    by pair of tiles and side."""
    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        codes: dict[bytes, int] = {}
        tiles, sets = [], ([], [])
        for side in (0, 1):
            of = [(r[1:], np.frombuffer(r[4], np.uint64)) for r in rows if r[0] == side]
            sets[side].extend(s for _, s in of)
            tiles += [_Tile([(*r[:3], point(s)) for r, s in of], codes)] if of else []
        return _joining(tiles[0], tiles[-1], sets, percent)

    def run(batches: Batches) -> Batches:
        last, held = None, []
        for *pair, side, key, size, component, shingles in rows_of(
                batches, "cell", "left", "right", "side", "set_key", "n_shingles", "component", "shingles"):
            if held and pair != last:
                yield edge_batch(links(held))
                held = []
            last, row = pair, (side, key, size, component, shingles)
            held.append(row)
        if held:
            yield edge_batch(links(held))
    return run


def _sets(width: int):
    """The shingles of each text."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            sets = [shingle_set(t, width).tobytes() for t in text_bytes(column(batch, "content"))]
            yield pa.RecordBatch.from_arrays([column(batch, "set_key"), pa.array(sets, pa.binary())], names=["set_key", "shingles"])
    return run


def _widest(members: DataFrame) -> DataFrame:
    """Members without the cells whose members all have one other cell as their largest: each pair meets there too."""
    size = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(members.select("cell", "set_key").join(size, "cell"), "sized-cells")
    largest = sized.groupBy("set_key").agg(F.max(F.struct("n", "cell")).alias("largest"))
    inside = sized.join(largest, "set_key").groupBy("cell").agg(
        F.min("largest").alias("l"), F.max("largest").alias("h")).filter("l = h and h.cell <> cell")
    return materialize(members.join(inside.select("cell"), "cell", "left_anti"), "widest-cells")


def _mixed(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the cells that hold several components, with the component."""
    of = labels.select(F.col("vertex").alias("set_key"), F.col("component").alias("found"))
    labelled = materialize(crowded.join(of, "set_key", "left").select(
        "cell", "set_key", "n_shingles", F.coalesce("found", "set_key").alias("component")), "labelled-cells")
    several = labelled.groupBy("cell").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h")
    return materialize(labelled.join(several.select("cell"), "cell"), "mixed-cells")


def _sorted(members: DataFrame, points: DataFrame, percent: int, which: str = "point") -> DataFrame:
    """Members with their points and the number of members of their cell, by cell and size. Cells of one member,
    or of two that do not fit by their sizes, are left out."""
    order = ("cell", "n_shingles", "set_key")
    low, high = F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), low, high).filter(
        (F.col("members") > 2) | ((F.col("members") == 2) & (100 * F.col("low") >= percent * F.col("high"))))
    return members.join(sizes.select("cell", "members"), "cell").join(
        points.select("set_key", F.col(which).alias("point")), "set_key").select(
        "cell", "set_key", "n_shingles", "component", "point", "members").repartitionByRange(*order).sortWithinPartitions(*order)


def _between_tiles(members: DataFrame, points: DataFrame, whole: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of different components that join all that can be joined, from trees over tiles of every cell."""
    tile, weights = ["cell", "band", "part"], (F.count(F.lit(1)) / TILE_ROWS, F.sum("n_shingles") * 8 / TILE_BYTES)
    cells = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.greatest(*weights).alias("weight")).filter("n > 1")
    # Sets of bands that are no neighbours are too unlike in size.
    band = F.when(F.col("weight") > 1, F.floor(F.log("n_shingles") / math.log(100 / percent + 0.01))).otherwise(0)
    banded = materialize(members.join(cells, "cell").withColumn("band", band.cast("long")).drop("n", "weight"), "banded")
    parts = banded.groupBy("cell", "band").agg(F.ceil(F.greatest(*weights)).alias("parts"))
    rows = materialize(banded.join(parts, ["cell", "band"]).withColumn(
        "part", F.pmod(F.xxhash64("set_key"), "parts")).drop("parts"), "tiles")
    most = rows.join(points.select("set_key", "point"), "set_key").select(*tile, "point").repartition(*tile).sortWithinPartitions(
        *tile).mapInArrow(_largest_counts, "cell long, band long, part long, most array<int>")
    bounds = rows.groupBy(*tile).agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("component").alias("l"), F.max("component").alias("h"))
    nodes = materialize(bounds.join(most, tile).withColumn("tile", F.struct("band", "part")), "tile-nodes")
    one, two = nodes.alias("x"), nodes.alias("y")
    shared = F.aggregate(F.zip_with("x.most", "y.most", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v)
    pairs = one.join(two, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.tile") <= F.col("y.tile"))).filter(
        (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
        & ~((F.col("x.l") == F.col("y.h")) & (F.col("x.h") == F.col("y.l")))
        & ((100 + percent) * shared >= percent * (F.col("x.low") + F.col("y.low")))).select(
        "x.cell", F.col("x.tile").alias("left"), F.col("y.tile").alias("right"))
    sides = pairs.select("cell", "left", "right", F.lit(0).alias("side"), "left.band", "left.part").unionByName(
        pairs.filter("left <> right").select("cell", "left", "right", F.lit(1).alias("side"), "right.band", "right.part"))
    sets = materialize(whole.join(rows.select("set_key").distinct(), "set_key", "left_semi").mapInArrow(
        _sets(width), "set_key binary, shingles binary"), "sets")
    pair = ["cell", "left", "right"]
    return sides.join(rows, tile).drop("band", "part").join(sets, "set_key").repartition(*pair).sortWithinPartitions(
        *pair, "side", "set_key").mapInArrow(
        _links(percent), "a binary, b binary")


def linked_messages(messages: DataFrame, width: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """Groups of messages linked by sets of ``width``-word shingles that are ``percent`` or more alike.

    Takes ``messages`` (``id``, ``content``); gives per row ``id``, ``n_shingles`` and ``component_id``
    (smallest id reachable by links, itself included).

    The join is exact. Equal sets are one class. A class is a point: its shingles, hashed into groups, are
    counted, and two sets share at most the summed minima of their counts. Space is first cut into cells: two similar
    sets share one of their rarest shingles (rare by counters over all messages), so each class lies in the cells of
    those, and cells with the same members count once. Each cell has an R-tree over its points, in tiles
    of bounded size; a search goes down only where the summed minima of a node's largest counts leave enough
    in common. Classes without a possible partner leave, first by points of few groups, then of more. Surviving pairs
    are verified on whole sets. The first rounds ask for every point's nearest partner, then for those of
    one point of each component; the last compares all remaining pairs of different components, in the widest cells
    only, and verifies them where they meet. It lists a link only if it joins components that two tiles have not
    joined yet, so no search lists more pairs than it reads rows, whatever a crowd's size.

    Null or blank content has no shingles and is linked with nothing. Repeated rows link with each other. A
    null id takes part in links; its component is that of the others, or null where no member has an
    id. Texts are taken whole. Other columns are ignored. An empty table gives an empty result.
    """
    split_skewed_joins(messages.sparkSession)
    texts, kind = contents(messages), messages.schema["id"].dataType.simpleString()
    scanned = materialize(texts.mapInArrow(
        _scan(width), f"id {kind}, n_shingles long, set_key binary, short long, point binary, rough binary, "
                      "counters array<int>, counts array<long>"), "message-sets")
    rows = scanned.filter("n_shingles is not null").select("id", "n_shingles", "set_key")
    classes = materialize(scanned.filter("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("first_id"), F.any_value("short").alias("short"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("point").alias("point"), F.any_value("rough").alias("rough")), "classes")
    placed = materialize(texts.select("content").mapInArrow(
        _cells(width, percent, _levels(scanned)), "cell long, short long"), "cells")
    full = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    shared = materialize(placed.join(full, "cell"), "shared-cells")
    part = lambda by: F.sum(F.pmod(F.shiftright("short", by), F.lit(1 << 24)))
    same = ["n", "least", "most", "one", "two"]
    cells = shared.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("short").alias("least"), F.max("short").alias("most"),
        part(0).alias("one"), part(24).alias("two")).filter("least <> most").groupBy(*same).agg(F.min("cell").alias("cell"))
    crowded = materialize(shared.join(cells.select("cell"), "cell").distinct().join(
        classes.select("short", "set_key", "n_shingles"), "short").drop("short"), "crowded-cells")

    # A class without a possible partner in any of its cells, by rough points and then by full ones, is done.
    alone = crowded.withColumn("component", F.lit(None).cast("binary"))  # each its own
    for which in ("rough", "point"):
        near = materialize(_sorted(alone, classes, percent, which).mapInArrow(_nearest(percent), NEAREST), "near")
        left = near.select(F.explode(F.array("a", "b")).alias("set_key")).filter("set_key is not null").distinct()
        alone = materialize(alone.join(left, "set_key", "left_semi"), "crowded-cells")
    crowded = alone.drop("component")
    wanted = crowded.select("set_key").distinct().join(classes, "set_key").select("set_key", "first_id")
    whole = materialize(class_texts(texts, wanted, width), "class-texts")
    links, labels = None, None
    for i in range(ROUNDS):
        if i:
            members = _mixed(crowded, labels).groupBy("cell", "component").agg(
                F.min_by(F.struct("set_key", "n_shingles"), F.xxhash64("set_key", F.lit(i))).alias("m")).select(
                "cell", "m.*", "component")
            near = _sorted(members, classes, percent).mapInArrow(_nearest(percent), NEAREST)
        found = confirmed(_best(near), whole, width, percent)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = materialize(connected_components(links), "labels")
    rest = _mixed(crowded, labels) if labels is not None else crowded.withColumn("component", F.col("set_key"))
    last = _between_tiles(_widest(rest), classes, whole, width, percent)
    labels = connected_components(last if links is None else links.unionByName(last))

    of = classes.join(labels, F.col("set_key") == F.col("vertex"), "left").select(
        "set_key", "first_id", F.coalesce("component", "set_key").alias("component"))
    of = materialize(of, "class-components")
    lowest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = of.join(lowest, "component").select("set_key", "component_id")
    alone = F.col("set_key").isNull()
    return rows.join(found, "set_key", "left").select(
        "id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
