"""Near-duplicate messages: one-permutation hashing, banded buckets, star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import column, contents, edge_batch, materialize, rows_of
from restomart.llm.components import connected_components
from restomart.llm.confirm import class_texts, confirmed
from restomart.llm.shingles import SHINGLE_WORDS, mix, set_key, shingle_set, text_bytes

BINS = 128
BAND_ROWS = 4
PROBE_ROUNDS = 1024
SKETCH_SLACK = 4.5  # standard deviations below the asked similarity that a sketch may show
BLOCK_ROWS = 1024

_ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * 2 + 1
_PROBES = np.random.default_rng(21).integers(0, BINS, (PROBE_ROUNDS, BINS))
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One minimum per bin of a single permutation; an empty bin takes that of the first full bin
    in its own random sequence of bins, so bins of two sets agree with the sets' similarity."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.append(at[1:], len(shingles)) > at
    out = np.where(full, shingles[np.minimum(at, len(shingles) - 1)], np.uint64(0))
    empty = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(empty):
            return out
        found = full[probe[empty]]
        out[empty[found]] = out[probe[empty[found]]]
        empty = empty[~found]
    out[empty] = out[np.argmax(full)]
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(-1, BAND_ROWS) * _ODD[8:8 + BAND_ROWS]
    return mix(bands.sum(axis=1, dtype=np.uint64) + np.arange(len(bands), dtype=np.uint64) * _ODD[16])


def _sketches(width: int):
    """Per message the size and key of its set, its band keys, and 16 bits of each bin of its sketch."""
    names = ["id", "n_shingles", "set_key", "bands", "bins"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in text_bytes(column(batch, "content")):
                shingles = shingle_set(text, width)
                if len(shingles):
                    bins = sketch(shingles)
                    found.append((len(shingles), set_key(shingles), _band_keys(bins).view(np.int64),
                                  bins.astype(np.uint16).tobytes()))
                else:
                    found.append((0, None, None, None))
            columns = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *map(pa.array, columns, kinds)], names=names)
    return run


def _short_sets(width: int):
    """Per class its set in 32-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.unique(shingle_set(t, width).astype(np.uint32)).tobytes() for t in text_bytes(column(batch, "content"))]
            yield pa.RecordBatch.from_arrays([column(batch, "set_key"), pa.array(short, pa.binary())], names=["set_key", "short"])
    return run


def _block_pairs(percent: int):
    """Candidate pairs within each block pair of a bucket: from different components, of fitting sizes,
    near by their sketches, and similar by short hashes, which can only make two sets look more alike. Rows come sorted by bucket and block pair; one block pair is held at a time."""
    share = percent / 100
    least = int(BINS * (share - SKETCH_SLACK * np.sqrt(share * (1 - share) / BINS)))

    def pairs(rows: list[tuple], left: int, right: int) -> Iterator[tuple[bytes, bytes]]:
        keys, size, component, block, bins, short = zip(*rows)
        short = [np.frombuffer(x, np.uint32) for x in short]
        codes: dict[bytes, int] = {}
        component = np.array([codes.setdefault(c, len(codes)) for c in component])
        size, block = np.array(size), np.array(block)
        bins = np.frombuffer(b"".join(bins), np.uint16).reshape(-1, BINS)
        for i in np.flatnonzero(block == left):
            mates = (block == right) & (component != component[i])
            mates &= (np.arange(len(keys)) > i) | (left != right)
            mates &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            mates = np.flatnonzero(mates)
            for j in mates[(bins[mates] == bins[i]).sum(axis=1) >= least]:
                merged = max(size[i] - len(short[i]), size[j] - len(short[j]))
                shared = merged + len(np.intersect1d(short[i], short[j], assume_unique=True))
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    yield min(keys[i], keys[j]), max(keys[i], keys[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for bucket, left, right, *row in rows_of(batches, "bucket", "left", "right", "set_key", "n_shingles",
                                                 "component", "block", "bins", "short"):
            if held and (bucket, left, right) != last:
                yield edge_batch(list(pairs(held, *last[1:])))
                held = []
            last = bucket, left, right
            held.append(tuple(row))
        if held:
            yield edge_batch(list(pairs(held, *last[1:])))
    return run


def near_duplicates(messages: DataFrame, width: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """Groups of messages whose word shingle sets are ``percent`` or more alike (Jaccard).

    Takes ``messages`` (``id``, ``content``); gives per row ``id``, ``n_shingles``,
    ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (the row's id
    is that id).

    Messages of the same set are one class from the start. Classes whose sketches agree in a band
    share a bucket; in each bucket only the links to one centre are tried, so candidates grow with
    the rows. Buckets that still hold several components afterwards are compared in blocks of
    bounded size by sketches and short hashes, and give only similar pairs of different components. All links are confirmed
    on full sets, fetched by key. 128 bins in 32 bands miss a pair of similarity 0.8 with
    probability 5e-8; the sketches allow ``SKETCH_SLACK`` standard deviations.

    Null or blank content has no shingles and is linked with nothing. Repeated rows link with each
    other and share a component; rows of one id have one ``kept`` value. A null id takes part in
    links; its component is that of the others, or null (and kept) where no member has an id.
    Other columns are ignored. An empty table gives an empty result.
    """
    texts, kind = contents(messages), messages.schema["id"].dataType.simpleString()
    rows = materialize(texts.mapInArrow(
        _sketches(width), f"id {kind}, n_shingles long, set_key binary, bands array<long>, bins binary"), "sketches")
    classes = materialize(rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("bands").alias("bands"), F.any_value("bins").alias("bins")), "classes")
    members = classes.select("set_key", "n_shingles", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("set_key", "n_shingles")).alias("centre"),
    ).filter("size > 1").select("bucket", "centre")
    crowded = materialize(members.join(centres, "bucket"), "crowded-buckets")
    fits = 100 * F.least("n_shingles", "centre.n_shingles") >= percent * F.greatest(
        "n_shingles", "centre.n_shingles")
    stars = crowded.filter(fits & (F.col("set_key") != F.col("centre.set_key"))).select(
        F.col("centre.set_key").alias("a"), F.col("set_key").alias("b"))

    wanted = crowded.select("set_key").distinct().join(classes, "set_key").select("set_key", "first_id")
    whole = materialize(class_texts(texts, wanted, width), "class-texts")
    links = confirmed(stars, whole, width, percent)
    labels = connected_components(links)

    labelled = crowded.join(labels, crowded.set_key == labels.vertex, "left").select(
        "bucket", "set_key", "n_shingles", F.coalesce("component", "set_key").alias("component"))
    mixed = labelled.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
    ).filter("low <> high").select("bucket", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks"))
    rest = labelled.join(mixed, "bucket").withColumn(
        "block", F.pmod(F.xxhash64("set_key", "bucket"), "blocks").cast("int"))
    paired = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    short = whole.join(rest.select("set_key").distinct(), "set_key", "left_semi").mapInArrow(
        _short_sets(width), "set_key binary, short binary")
    pairs = paired.join(classes.select("set_key", "bins"), "set_key").join(short, "set_key").select(
        "bucket", "set_key", "n_shingles", "component", "block", "left", "right", "bins", "short",
    ).repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "set_key").mapInArrow(
        _block_pairs(percent), "a binary, b binary")
    labels = connected_components(links.unionAll(confirmed(pairs, whole, width, percent)))

    of_class = classes.select("set_key", "first_id").join(
        labels, F.col("set_key") == F.col("vertex"), "left").select(
        "set_key", "first_id", F.coalesce("component", "set_key").alias("component"))
    of_class = materialize(of_class, "class-components")
    lowest = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = of_class.join(lowest, "component").select("set_key", "component_id")
    alone = F.col("set_key").isNull()
    out = rows.select("id", "n_shingles", "set_key").join(found, "set_key", "left").select(
        "id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
