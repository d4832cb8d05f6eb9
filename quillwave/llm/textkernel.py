"""Vectorised word and shingle hashing over Arrow string columns.

Every text operator in this package works inside an Arrow task on whole texts.  The helpers here turn a
string column into flat numpy arrays (bytes, word bounds, 64-bit word hashes, 64-bit shingle hashes) without
a Python loop over words.  Null texts count as empty.  Work is cut into slices of ``SLICE_BYTES`` so memory
follows the slice, not the batch; one text longer than that is a slice of its own and its bytes are hashed
in pieces of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64


def byte_class(pattern_bytes) -> np.ndarray:
    """A 256-entry membership table for the given byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: ``[^\x20\x09-\x0D]+``: anything but ASCII white space.
NON_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, and every byte of non-ASCII text.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a uint64 array."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _cache or len(_cache["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        _cache["p"], _cache["q"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _cache["p"], _cache["q"]


def lower(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (or of one row)."""
    _, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the row that it belongs to; words never cross rows."""
    inside = table[data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(len(inside), dtype=bool)
    edge[0] = inside[0]
    edge[1:] = inside[1:] & ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    edge[-1] = inside[-1]
    edge[:-1] = inside[:-1] & ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    edge[cuts] = inside[cuts]
    ends = np.flatnonzero(edge) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes give equal hashes everywhere.

    Spans must be in order of their starts.  A span sum is taken from prefix sums of keyed bytes times powers
    of an odd base, so the cost is a few operations a byte whatever the spans are.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = max(at + 1, int(np.searchsorted(starts, first + SLICE_BYTES // 2, side="left")))
        s, e = starts[at:upto] - first, ends[at:upto] - first
        n = int(e.max())
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[data[first : first + n]] * power[:n], dtype=np.uint64, out=sums[1:])
        out[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _U(0x9FB21C651E98DF25)
        at = upto
    return mix(out)


_SHINGLE = [_U(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8AED2A6BB9A1C7E5, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xE7037ED1A0B428DB)]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word shingle and the index of its first word; shingles never cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, k * 0x2545F4914F6CDD1D & (1 << 64) - 1, dtype=np.uint64)
    for i in range(k):
        total += words[i : i + n] * _SHINGLE[i % 8]
        if k > 8:
            mix(total)
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(total[first]), first


def whole_hash(words: np.ndarray) -> np.uint64:
    """The hash of a sequence shorter than a shingle, taken as one."""
    return shingle_hashes(words, np.zeros(len(words), np.int64), len(words))[0][0]


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words[start:end] for each run of word hashes, by prefix sums as in `span_hashes`."""
    n = len(words)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * power[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row (k up to 8), across rows too."""
    n = len(words) - k + 1
    total = np.full(max(n, 0), k * 0x2545F4914F6CDD1D & (1 << 64) - 1, dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        total += words[i : i + n] * _SHINGLE[i]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    out, reach = values, 1
    while 2 * reach <= width:
        out, reach = np.minimum(out[:-reach], out[reach:]), 2 * reach
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out
