"""Draws by hash for whole arrays of counters: what stats.hashed() gives row by row."""

from __future__ import annotations

import hashlib

import numpy as np

#: Counters that are hashed together, so that the rounds' arrays stay in a core's cache.
PART = 16_384
#: How far each of four steps in turn rotates, round by round.
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).tolist()
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def heads(words: list, size: int) -> np.ndarray:
    """The first 64 bits of the MD5 digests of size messages of one block each: its sixteen words, arrays or, where all have the same, single numbers."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in START)
    f, high = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + SINES[i]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(SINES[i])
        turn = TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=high)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a  # what a was is written over in the next step
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap().astype(np.uint64)


def hashed(seed: int, *counters, digits: int = 8) -> np.ndarray:
    """Of each row of counters (arrays of one length, or single values), the first hex digits (at most 15) of the MD5 of seed|counter|..., as whole numbers."""
    size = max((len(c) for c in counters if isinstance(c, np.ndarray)), default=1)
    columns = [c if isinstance(c, np.ndarray) and len(c) == size else np.asarray(c) for c in counters]
    whole = all(c.dtype.kind in "iu" and c.min(initial=0) >= 0 for c in columns)
    if not whole or sum(1 + len(str(c.max(initial=0))) for c in columns) + len(str(seed)) > 55:
        rows = zip(*(np.broadcast_to(c, size).tolist() for c in columns), strict=True)
        out = np.fromiter((int.from_bytes(hashlib.md5("|".join([str(seed), *map(str, row)]).encode()).digest()[:8], "big") for row in rows), np.uint64)
    else:
        out = by_shape(str(seed).encode(), columns, size)
    return (out >> np.uint64(64 - 4 * digits)).astype(np.int64)


def by_shape(seed: bytes, columns: list[np.ndarray], size: int) -> np.ndarray:
    """Messages of whole numbers with the same numbers of digits have their digits in the same places; a column of one value has the same digits in all."""
    out = np.empty(size, np.uint64)
    if not size:
        return out
    lengths = []
    for c in columns:
        low, high = len(str(c.min())), len(str(c.max()))
        lengths.append(low if low == high else np.searchsorted(10 ** np.arange(1, 19), c, "right") + 1)
    shape = sum(np.asarray(n, np.int64) * 20**k for k, n in enumerate(lengths))
    for one in np.unique(shape):
        every = np.flatnonzero(shape == one) if shape.ndim else None
        own = [int(one) // 20**k % 20 for k in range(len(columns))]
        for at in range(0, size if every is None else len(every), PART):
            rows = slice(at, min(size, at + PART)) if every is None else every[at : at + PART]
            parts = [c[rows] if c.ndim and c.size == size else c.reshape(-1)[:1] for c in columns]
            out[rows] = heads(message(seed, parts, own), rows.stop - at if every is None else len(rows))
    return out


def message(seed: bytes, columns: list[np.ndarray], lengths: list[int]) -> list:
    """The words of the block that seed|number|... is padded to, for each row of columns."""
    same, words, at = bytearray(64), {}, len(seed)
    same[:at] = seed
    for value, n in zip(columns, lengths, strict=True):
        same[at] = ord("|")
        if len(value) == 1:
            same[at + 1 : at + 1 + n] = b"%d" % value[0]
        else:
            value = value.astype(np.uint32) if n < 10 else value
            for k in range(at + n, at, -1):
                left = value // value.dtype.type(10)
                digit = (value - left * value.dtype.type(10)).astype(np.uint32) + np.uint32(ord("0"))
                digit <<= np.uint32(8 * (k % 4))
                words[k // 4] = words[k // 4] | digit if k // 4 in words else digit
                value = left
        at += n + 1
    same[at] = 0x80
    same[56:58] = (8 * at).to_bytes(2, "little")
    fixed = np.frombuffer(same, "<u4").tolist()
    return [words[k] | np.uint32(fixed[k]) if k in words else fixed[k] for k in range(16)]
