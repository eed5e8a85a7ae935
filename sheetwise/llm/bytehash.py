"""Vectorised hashes over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base or of its inverse modulo 2**64."""
    name = "inv" if inverse else "pow"
    if len(_POWERS.get(name, ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        p = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        p[0] = 1
        _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[i] the sum of table[data[j]] * base**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data)), out=out[1:])
    return out


def spans(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of data[lo:hi], equal for equal bytes wherever they stand."""
    return mix((p[hi] - p[lo]) * powers(int(lo.max()) + 1 if len(lo) else 1, True)[lo])


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of at most about `most` bytes, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def column(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary or string column without copying; nulls are empty."""
    import pyarrow as pa

    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    n = len(array)
    if array.null_count:
        array = array.fill_null(b"" if "binary" in str(array.type) else "")
    bufs = array.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if n else data[:0], offsets - (offsets[0] if n else 0)
