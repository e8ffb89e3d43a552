"""Whole texts as flat bytes: word positions and word hashes without Python strings.

Everything here works on a slice of an Arrow string column: one uint8 array and
the offsets of its rows. Words are maximal runs of bytes of a class, which is
exact for UTF-8 as long as bytes of 0x80 and more are all in or all out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: words between white space
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: words of digits, letters a-z and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    values[0x41:0x5B] = values[0x61:0x7B]  # A-Z counts as a-z
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_VALUES = _byte_values()


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE)]))
            _powers["down"] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE_INVERSE)]))
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes: whole rows, at least one each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(body: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (n + 1)."""
    if len(body) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[body]
    edge = np.zeros(len(body), bool)
    firsts = offsets[:-1]
    edge[firsts[firsts < len(body)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z; equal words have equal hashes in any text."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(body))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_VALUES[body] * up[: len(body)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _GOLDEN)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, by its first word; runs may cross rows."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:count].copy()
        for j in range(1, n):
            out *= _BASE
            out += hashes[j : j + count]
        return mix(out + np.uint64(n))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every item, given the index of each row's first item (n + 1)."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
