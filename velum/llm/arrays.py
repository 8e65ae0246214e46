"""Vectorised text primitives on Arrow string buffers: words, lines, hashes of spans, sliding minima.

Texts stay UTF-8 bytes; a chunk of rows is one byte array with document offsets, so that a pass costs a few
nanoseconds a byte and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte value, for two independent hashes.
BYTE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MULT = _rng.integers(1, 1 << 63, size=1024, dtype=np.uint64) * U(2) + U(1)
ADD = _rng.integers(0, 1 << 63, size=1024, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, n + 1)
        b = BASE[which]
        ab = [np.full(size, U(x)) for x in (b, pow(b, -1, 1 << 64))]
        for x in ab:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        have = (ab[0], ab[1])
        if size <= 1 << 22:
            _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        p, self.inv = powers(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def byte_spans(data: np.ndarray, which: int = 0) -> Spans:
    return Spans(BYTE[which][data], which)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows of about ``limit`` bytes of text (a longer text stands alone), with its bytes and offsets."""
    data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def split(data: np.ndarray, offs: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes outside ``is_gap`` that lie in one document: starts, ends, document index."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return split(data, offs, SPACE)


def first_of(doc: np.ndarray, n: int) -> np.ndarray:
    """For sorted document indexes: where each of n documents begins, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    got, size = x, 1
    while size * 2 <= w:
        got = np.minimum(got[: len(got) - size], got[size:])
        size *= 2
    return np.minimum(got[: len(x) - w + 1], got[w - size : w - size + len(x) - w + 1])


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def distinct_sorted(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each document's hashes in place and drop repeats: values and new bounds."""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    if not len(h):
        return h, bounds
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][bounds[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def squeeze(x: np.ndarray) -> bytes:
    """An array of integers or floats as zstd-packed byte planes, after its length."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def expand(raw: bytes, kind) -> np.ndarray:
    """What :func:`squeeze` packed, as an array of ``kind``."""
    n, kind = int.from_bytes(raw[:8], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], decompressed_size=n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges ``start, start + 1, ...`` of each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
