"""Vectorised text kernels shared by the training-data operators.

All kernels work on the UTF-8 bytes of whole Arrow string columns.  Every
separator used by the operators is an ASCII character, so splitting bytes gives
the same words as splitting code points.  Texts are taken in slices of about
``SLICE_BYTES`` so that memory does not follow the Arrow batch size; a text
larger than that forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the whitespace splitter and of the alphanumeric splitter.
NON_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise and in place on a copy."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, off = column_bytes(texts)
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the range of its words."""
    inside = kind[data]
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:]
    lasts = off[1:][off[1:] > 0] - 1
    finishes[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words wherever they stand."""
    out = np.empty(len(starts), _U)
    at, n = 0, len(starts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        part = data[a:b]
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, _U)
        np.cumsum(_BYTE[LOWER[part] if lower else part] * up[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out)


def window_hashes(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes (none if there are fewer)."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, _U)
    h = mix(hashes ^ _U(salt)) if salt else hashes
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(h * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1] + _U(length))


def owners(ranges: np.ndarray) -> np.ndarray:
    """For each element the index of the text whose range holds it."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before, counts) + np.repeat(starts, counts)


def binary_column(pieces: list[bytes]) -> pa.Array:
    return pa.array(pieces, pa.binary())


def slide(pick, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's (kept) words joined by one space: bytes and offsets."""
    doc = owners(ranges)
    if keep is not None:
        starts, ends, doc = starts[keep], ends[keep], doc[keep]
    n = len(ranges) - 1
    counts = np.bincount(doc, minlength=n)
    chars = np.bincount(doc, weights=ends - starts, minlength=n).astype(np.int64)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[ends] -= 1
    mask = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    gaps = ends[:-1][doc[:-1] == doc[1:]] if len(ends) else ends
    out = data.copy()
    out[gaps] = 0x20
    mask[gaps] = True
    return out[mask], np.concatenate([[0], np.cumsum(chars + np.maximum(counts - 1, 0))])
