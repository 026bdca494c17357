"""Packing of messages into training sequences by bin completion."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restomart.llm.common import contents, materialize
from restomart.llm.bin_completion import complete_bins

END_ID = 2
RANK_ROWS = 5_000  # rows that one window of equal lengths orders
REMEMBERED = 500_000  # words whose ids one Python worker remembers

# Fixed value: the byte-level vocabulary's own pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: visible ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer(dict):
    """Ids of a byte-level tokenizer file, as little-endian unsigned 32-bit bytes.

    No token of this kind holds a space after another character, so a text falls apart before
    every space that follows a non-space. Ids of a word are looked up, or merged and remembered.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, before = spec["model"], spec["pre_tokenizer"]
        rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i
                for i, m in enumerate(model["merges"])}
        ordered = all(model["vocab"].get(a + b) == 256 + i for (a, b), i in rank.items())
        if not (ordered and before["type"] == "ByteLevel" and not before.get("add_prefix_space")
                and spec.get("normalizer") is None):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_byte = _byte_characters()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        super().__init__()
        self.special = added
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks,
                                          special_tokens=added)

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(" " + word)).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.encoding.encode(text, allowed_special="all")).tobytes()
        first, *words = text.split(" ")
        # After another white space, or at the start, a space is not a border.
        if not first or first[-1:].isspace() or any(not w or w[-1].isspace() for w in words):
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        return array("I", self.encoding.encode_ordinary(first)).tobytes() + b"".join(
            map(self.__getitem__, words))


_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def cut(ids: bytes) -> list[tuple[int, int, int, int]]:
        n = len(ids) // 4
        stops = range((n - 1) % capacity + 1, n + 1, capacity)
        starts = [0, *stops[:-1]]
        return [(i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(starts, stops))]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = byte_tokenizer(tokenizer).ids
        for part in parts:
            yield pd.Series([cut(encode(text) + end) for text in part], dtype=object)

    return F.pandas_udf(run, PIECES)


def pack_messages(messages: DataFrame, tokenizer: str, capacity: int = 1024,
                  end_id: int = END_ID) -> DataFrame:
    """Packs all messages into few sequences of at most ``capacity`` tokens.

    Takes ``messages`` (``id``, ``content``) and a byte-level ``.json`` tokenizer file that
    executors can open. A message is its ids followed by ``end_id``; a longer one is cut into
    pieces of ``capacity`` tokens, of which the first may be shorter. Gives per piece ``id``,
    ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` (of its ids as unsigned little-endian
    32-bit numbers), ``sequence_id`` and ``offset`` (gapless from 0).

    Only the number of pieces of each length, at most ``capacity`` rows, goes to the driver, where
    ``complete_bins`` decides which lengths lie together and how often. Pieces of one length are
    interchangeable: they are numbered in windows of about ``RANK_ROWS`` rows, so a length that a
    third of all pieces share is no single task, and their numbers say where they go.

    Null or empty content is one piece of the end id. Repeated rows are packed as often as they
    occur; a null id is kept; other columns are ignored; an empty table gives an empty result.
    """
    cut = _pieces(tokenizer, capacity, end_id)
    pieces = materialize(contents(messages).select("id", cut("content").alias("pieces"))
                         .select("id", F.inline_outer("pieces")), "pieces")
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(
        _places(complete_bins(counts, capacity)),
        "length long, low long, high long, sequence long, each long, at long")

    parts = max(1, sum(counts.values()) // RANK_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)))
    before = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    ranked = pieces.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32", "start")) - 1)
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first"))
    place = F.col("rank") - F.col("low")
    # The plan has a few rows for each length up to the capacity, whatever the number of pieces.
    return ranked.join(F.broadcast(plan), "length").filter("rank >= low and rank < high").select(
        "id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("each")) * F.col("length")).alias("offset"))


def _places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, ...]]:
    """For each length the ranges of piece numbers, the first sequence they go to, how many of
    them each sequence takes, and where in it they begin."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, copies in plan:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            low = used.get(length, 0)
            used[length] = low + each * copies
            rows.append((length, low, used[length], sequence, each, at))
            at += each * length
        sequence += copies
    return rows
