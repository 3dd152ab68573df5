"""The first 32 bits of the MD5 digests of many short strings, computed side by side.

A string of up to 55 bytes is one block of MD5, whose 64 steps run over whole arrays of strings.
"""

from __future__ import annotations

import hashlib

import numpy as np

ONE_BLOCK = 55      # bytes of a string that is one block
CHUNK = 1 << 14     # strings that go through the steps together

_K = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2**32).astype(np.uint32)
_S = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_G = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF, 0], dtype=np.uint32)
_STOP = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0, 0], dtype=np.uint32)


def _blocks(words: list, count: int) -> np.ndarray:
    """The digests' first 32 bits; ``words`` are the 16 of the blocks, None where all are 0."""
    a, b, c, d = (np.full(count, x, dtype=np.uint32) for x in _START)
    f, e = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f); f &= b; f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f); f &= d; f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f); f ^= d
        else:
            np.invert(d, out=f); f |= b; f ^= c
        f += a
        f += _K[i]
        if words[_G[i]] is not None:
            f += words[_G[i]]
        np.left_shift(f, np.uint32(_S[i]), out=e)
        f >>= np.uint32(32 - _S[i])
        f |= e
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap()


def first_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The digests' first 32 bits, as a number, of the strings ``data[start:start + size]`` (``data``: uint8)."""
    out = np.empty(len(start), dtype=np.uint32)
    wide = np.concatenate([data, np.zeros(64, np.uint8)]).astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    short = np.flatnonzero(size <= ONE_BLOCK)
    for at in range(0, len(short), CHUNK):
        i = short[at:at + CHUNK]
        s, n = start[i], size[i].astype(np.int32)
        words: list = [None] * 16
        for j in range(int(n.max()) // 4 + 1):
            rest = np.clip(n - 4 * j, -1, 4)  # at -1 the last entries of the tables: no byte is left, nor the mark of the end
            words[j] = four[s + 4 * j]
            words[j] &= _KEEP[rest]
            words[j] |= _STOP[rest]
        words[14] = (n * 8).astype(np.uint32)
        out[i] = _blocks(words, len(i))
    for i in np.flatnonzero(size > ONE_BLOCK):
        x = data[start[i]:start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[:4], "big")
    return out
