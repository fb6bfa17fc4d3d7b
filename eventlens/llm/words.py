"""Words of UTF-8 texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in runs of about so many bytes; a longer text stands alone.
RUN = 2_000_000
#: Words are hashed in blocks of about so many bytes.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space, and of words of small letters, digits and non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(29))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _INVERSE = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        n = max(n, 2 * BLOCK)
        _POWER, _INVERSE = powers(int(_BASE), n), powers(pow(int(_BASE), -1, 1 << 64), n)
    return _POWER, _INVERSE


def runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RUN, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashed(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, ASCII capitals lowered, and where each text's words begin."""
    data = LOWER[data]
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
        first, last = starts[a], ends[b - 1]
        power, inverse = _tables(int(last - first) + 1)
        total = np.zeros(last - first + 1, U64)
        np.cumsum(_BYTE[data[first:last]] * power[: last - first], out=total[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        a = b
    return out, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out *= _BASE
        out += words[j : j + n]
    return mix(out)
