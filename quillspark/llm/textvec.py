"""Vectorised words, hashes and shingles over Arrow string columns, for use inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z; UTF-8 bytes
of other characters pass unchanged. Word hashes are 64-bit polynomial hashes over a fixed random
byte table, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once.
CHUNK_BYTES = 2_000_000

_rng = np.random.default_rng(20240607)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: For words of letters and digits: other ASCII bytes separate.
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWERED = _BYTE[_LOWER]
_PLACE = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_UNDO = np.uint64(pow(int(_ODD), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, CHUNK_BYTES + 1), base, np.uint64))))
        _powers[name] = have
    return have[:n]


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within the bytes); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        at = offsets[first : last + 1]
        yield first, last, data[at[0] : at[-1]], at - at[0]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of each word, and for each text the number of its first word (one more than texts).

    letters: words are runs of ASCII letters, digits and bytes from 128. prefix: the hashes of that
    many leading bytes come second.
    """
    n = len(data)
    none = np.zeros(0, np.uint64)
    if not n:
        return (none, *[none] * bool(prefix), np.zeros(len(offsets), np.int64))
    space = (_NOT_LETTER if letters else _SPACE)[data]
    begins = np.empty(n, bool)
    begins[0], begins[1:] = True, space[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begins & ~space)
    ends = np.empty(n, bool)
    ends[-1], ends[:-1] = True, space[1:]
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    stops = np.flatnonzero(ends & ~space) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWERED if lower else _BYTE)[data] * _power(_ODD, "up", n), out=sums[1:])
    undo = _power(_UNDO, "down", n + 1)[starts]

    def hashed(to: np.ndarray) -> np.ndarray:
        return mix((sums[to] - sums[starts]) * undo + (to - starts).astype(np.uint64))

    return (hashed(stops), *[hashed(np.minimum(stops, starts + prefix))] * bool(prefix), np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words of one text; of the whole text if it has fewer words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    if n < width:
        return mix(((hashes * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n))[None]).view(np.int64)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out += hashes[i : n - width + 1 + i] * _PLACE[i]
    return mix(out).view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """An Arrow list column of numpy arrays."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
