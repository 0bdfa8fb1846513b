"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

A batch of texts is one byte array plus offsets; words, lines and shingles are found and hashed
with numpy over that array, so no Python object is made per word. Slices bound the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64
#: Multipliers of the hashes (odd 64-bit numbers).
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
STEP = U(0xD1342543DE82EF95)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * M2
    x ^= x >> U(27)
    x *= M3
    x ^= x >> U(31)
    return x


#: A random 64-bit value for each byte, made from a fixed seed.
BYTE_VALUE = mix((np.arange(256, dtype=U) + U(1)) * M1)


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES, texts: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of runs of at most ``texts`` texts and about ``limit`` bytes; one text is never split."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + texts)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    border = offsets[(offsets > 0) & (offsets < n)]
    before[border], after[border - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than the six separators), and each text's first word index (n + 1)."""
    starts, ends = runs(~SEPARATOR[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


#: Another set of such values, for hashes that are independent of the first.
OTHER_VALUE = mix((np.arange(256, dtype=U) + U(1)) * M2)


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each segment data[start:end]; segments are ascending and do not overlap."""
    if not len(starts):
        return np.zeros(0, U)
    length = ends - starts
    base = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=base[1:])
    total = int(length.sum())
    if total == 0:
        return mix(length.astype(U))
    place = np.arange(total, dtype=np.int64)
    inner = place - np.repeat(base, length)
    if total != len(data):
        place += np.repeat(starts - base, length)
        value = values[data[place]]
    else:
        value = values[data]
    value *= powers(int(length.max()))[inner]
    full = length > 0
    out = np.zeros(len(starts), U)
    out[full] = np.add.reduceat(value, base[full])
    return mix(out + length.astype(U) * M1)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and the text of each. A text with fewer words, but some, has its whole sequence as one."""
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    n = len(hashes) - size + 1
    if n > 0:
        value = hashes[:n].copy()
        for k in range(1, size):
            value = mix(value * STEP + hashes[k : n + k])
        ok = text[:n] == text[size - 1 :]
        value, owner = mix(value)[ok], text[:n][ok]
    else:
        value, owner = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([_sequence(hashes[first[d] : first[d + 1]]) for d in short], U)
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def _sequence(h: np.ndarray) -> np.uint64:
    total = np.array([(h * powers(len(h))).sum(), len(h)], U)
    return mix(total[:1] + total[1:] * M2)[0]


def distinct_by_text(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text, sorted and distinct, in a row, with n + 1 offsets. owner ascends."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(n)]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), offsets


def binary(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())
