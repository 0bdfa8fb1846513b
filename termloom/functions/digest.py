"""MD5 of many short texts at once, over the bytes of an Arrow column."""

from __future__ import annotations

import hashlib

import numpy as np

#: Texts that are hashed at once; the longest that is one block of the digest, whose other bytes hold its length.
AT_ONCE, ONE_BLOCK = 1 << 13, 55
FACTORS = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
WORDS = [(k, (5 * k + 1) % 16, (3 * k + 5) % 16, 7 * k % 16)[k // 16] for k in range(64)]
#: By length: which bytes of a block are the text's, and what follows it there.
INSIDE = np.where(np.arange(64) < np.arange(ONE_BLOCK + 1)[:, None], 255, 0).astype(np.uint8)
CLOSED = np.zeros((ONE_BLOCK + 1, 64), np.uint8)
CLOSED[np.arange(ONE_BLOCK + 1), np.arange(ONE_BLOCK + 1)] = 0x80
CLOSED.view("<u4")[:, 14] = np.arange(ONE_BLOCK + 1) * 8
BEGIN = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def md5_head(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number that the first eight hexadecimal digits of the MD5 of each data[start:end] are."""
    out, length = np.empty(len(starts), np.int64), ends - starts
    short = np.flatnonzero(length <= ONE_BLOCK)
    padded = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(64, np.uint8)]), 64)
    for i in range(0, len(short), AT_ONCE):
        own = short[i : i + AT_ONCE]
        block, n = padded[starts[own]], length[own]
        block &= INSIDE[n]
        block |= CLOSED[n]
        words = np.ascontiguousarray(block.view("<u4").T)
        out[own] = _first_word(words).byteswap()
    for i in np.flatnonzero(length > ONE_BLOCK).tolist():
        out[i] = int.from_bytes(hashlib.md5(data[starts[i] : ends[i]], usedforsecurity=False).digest()[:4], "big")
    return out


def _first_word(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(words.shape[1], x) for x in BEGIN)
    for k in range(64):
        mixed = _mixed(k // 16, b, c, d)
        mixed += a
        mixed += words[WORDS[k]]
        mixed += FACTORS[k]
        turned = mixed << TURNS[k]
        mixed >>= 32 - TURNS[k]
        turned |= mixed
        turned += b
        a, b, c, d = d, turned, b, c
    return a + BEGIN[0]


def _mixed(quarter: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if quarter == 0:
        return d ^ (b & (c ^ d))
    if quarter == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if quarter == 2 else c ^ (b | ~d)
