"""Vectorised helpers over Arrow string columns: bytes, words, lines and their hashes.

Texts stay one contiguous UTF-8 buffer per slice; everything below works on that buffer with numpy,
so the cost per byte is a few nanoseconds and nothing is looped per word in Python.  Null texts count
as empty.  ``slices`` bounds the bytes held at once, whatever the Arrow batch size is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(0, 2**64 - 1, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)
_PRIME = U(2**31 - 1)
#: Of each lane of span hashes: base, its inverse, bytes' values.
_LANES = [(int(b), pow(int(b), -1, 2**31 - 1), _RNG.integers(1, 2**31 - 1, 256, dtype=np.uint64)) for b in _RNG.integers(2**24, 2**31 - 1, 2)]
_POWERS: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder modulo the prime."""
    return (x & _PRIME) + (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.ones(1, np.uint32)
        while len(full) < max(n, 1 << 16):
            more = _fold(_fold(full.astype(np.uint64) * U(pow(base, len(full), 2**31 - 1))))
            full = np.append(full, np.where(more >= _PRIME, more - _PRIME, more).astype(np.uint32))
        have = _POWERS[base] = full
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def slices(batches, column: str, max_bytes: int = 1 << 20):
    """Split record batches so that ``column`` holds at most ``max_bytes`` per piece (one row at least).

    A piece's arrays take some dozens of bytes per byte of text, and several tasks share an executor.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary() if pa.types.is_binary(batch.schema.field(column).type) else pa.large_string())
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del arr, off
        pa.default_memory_pool().release_unused()  # workers live on for other stages


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null rows are empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of each row's bytes are set in ``mask``."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set bytes that don't cross rows: starts, ends, row numbers."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums, a row a lane, from which ``span_hash`` takes the hash of any span.

    Sums of bytes' values by powers modulo a prime, twice: modulo 2**64 texts as different as Thue-Morse strings would be one.
    """
    out = np.zeros((len(_LANES), len(data) + 1), np.uint64)
    for to, (base, _, byte) in zip(out, _LANES):
        np.cumsum(_fold(_fold(byte[data] * _powers(base, len(data)))), out=to[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    held = U(0)
    for of, (_, inverse, _) in zip(prefix, _LANES):
        x = _fold(_fold(of[ends] - of[starts])) * _powers(inverse, len(of))[starts]
        x = _fold(_fold(_fold(x)))
        held = held << U(31) | np.where(x == _PRIME, U(0), x)
    return mix(held + (ends - starts).astype(np.uint64) * STEP)


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive items of one row: first item's index, hash."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    acc = h[at]
    for j in range(1, n):
        acc = acc * STEP + h[at + j]
    return at, mix(acc)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a window of ``length`` from any start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
