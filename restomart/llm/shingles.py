"""Word shingles of texts as 64-bit hashes, computed on the bytes of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
PIECE = 1 << 18  # bytes of a text that are hashed at once

_BASE = 0x9E3779B97F4A7C15
_ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * 2 + 1


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text in UTF-8; A-Z are lower-cased, ASCII white space separates.

    A word is a polynomial of its bytes, read off prefix sums. A long text is taken in pieces; a word
    that runs over their ends is put together from its parts, so memory follows the number of words.
    """
    out, open_hash, open_length = [], 0, 0
    for start in range(0, len(data), PIECE):
        piece = _LOWER[data[start:start + PIECE]]
        inside = ~_GAP[piece]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * inside * _POWERS[:len(piece)], out=total[1:])
        turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = turns[::2], turns[1::2]
        found = (total[last] - total[first]) * _INVERSE[first]
        if open_length and (not len(first) or first[0] > 0):
            out.append(np.array([open_hash], np.uint64))
            open_hash = open_length = 0
        if len(first) and first[0] == 0 and open_length:
            joined = (open_hash + pow(_BASE, open_length, 1 << 64) * int(found[0])) % (1 << 64)
            if last[0] == len(piece):  # the word fills the piece
                open_hash, open_length = joined, open_length + len(piece)
                continue
            found[0], open_hash, open_length = joined, 0, 0
        if len(last) and last[-1] == len(piece):
            open_hash, open_length = int(found[-1]), int(last[-1] - first[-1])
            found = found[:-1]
        out.append(found)
    if open_length:
        out.append(np.array([open_hash], np.uint64))
    return mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def shingle_set(text: str | np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (or of its bytes).

    A text of fewer than ``width`` words is one shingle, a text without words has none.
    """
    if isinstance(text, str):
        text = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i:len(h) - n + 1 + i] * _ODD[i]
    total = mix(total)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit key of a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a column without nulls, without copying them."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for start, end in zip(places[:-1], places[1:]):
        yield whole[start:end]
