"""Word shingles of whole texts as 64-bit hashes, with numpy over Arrow buffers.

Words are runs of anything but the six ASCII spaces (0x20, 0x09-0x0D); A-Z count as a-z. A text's set holds
the hashes of its distinct n-word shingles; a text of fewer than n words gives one shingle, its whole word
sequence; a null or wordless text gives the empty set. Two different shingles share a hash with chance 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _odd_words(tag: str, count: int) -> np.ndarray:
    """`count` fixed odd 64-bit numbers that depend on the tag alone."""
    digests = (hashlib.blake2b(f"{tag}:{i}".encode(), digest_size=8).digest() for i in range(count))
    return np.frombuffer(b"".join(digests), dtype="<u8").copy() | _U64(1)


def _byte_table() -> np.ndarray:
    table = _odd_words("byte", 256)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_BYTE_WORDS = _byte_table()
_PLACE = _odd_words("place", 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least `length` of each."""
    size = max(BLOCK_BYTES, 1 << (length - 1).bit_length() if length > 1 else 1)
    if size not in _CACHE:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(size, _U64(base), dtype=_U64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        if size > BLOCK_BYTES:
            return out[0], out[1]
        _CACHE[size] = (out[0], out[1])
    return _CACHE[size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[starts[i]:ends[i]] (adjacent), and the number of words of each."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=_U64), np.zeros(len(starts), dtype=np.int64)
    solid = ~_IS_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[starts[starts < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[ends[ends > 0] - 1] = False
    first = np.flatnonzero(solid & ~before)
    last = np.flatnonzero(solid & ~after)
    power, inverse = _powers(n)
    total = np.cumsum(_BYTE_WORDS[data] * power[:n], dtype=_U64)
    hashes = total[last]
    hashes[first > 0] -= total[first[first > 0] - 1]
    hashes *= inverse[first]
    counts = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    return mix64(hashes + (last - first).astype(_U64)), counts


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if len(words) == 0:
        return np.empty(0, dtype=_U64)
    if len(words) < n:
        return mix64(np.array([np.sum(words * _PLACE[: len(words)], dtype=_U64) + _U64(len(words))], dtype=_U64))
    room = len(words) - n + 1
    out = words[:room] * _PLACE[0]
    for i in range(1, n):
        out = out + words[i : i + room] * _PLACE[i]
    return np.unique(mix64(out))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data, offsets


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    if len(column) == 0:
        return
    data, offsets = text_buffers(column)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        base = offsets[row]
        hashes, counts = word_hashes(data[base : offsets[stop]], offsets[row:stop] - base, offsets[row + 1 : stop + 1] - base)
        at = 0
        for count in counts:
            yield shingle_set(hashes[at : at + count], n)
            at += count
        row = stop
