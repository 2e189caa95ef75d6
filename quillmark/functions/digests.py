"""MD5 of many short texts at once, as matrices of 32-bit words."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Texts of up to so many bytes are one block of MD5.
_ONE_BLOCK = 55
#: The step (of 64) that ends the first word.
_FIRST_DONE = 60
#: Digests that are made at once.
TILE = 65_536


def _words(texts: list[bytes], before: int, after: bytes = b"") -> np.ndarray:
    """16 words a text that stands ``before`` bytes into a block; the other bytes are 0."""
    return np.frombuffer(b"".join((bytes(before) + t + after).ljust(64, b"\0") for t in texts), "<u4").reshape(-1, 16)


def _compressed(x: np.ndarray, y: np.ndarray, whole: bool = True) -> list[np.ndarray]:
    """The four words of the MD5 of each block x[i] + y[j], big end first; or the first word only, which takes three steps less."""
    shape = (len(x), len(y))
    px = [x[:, k, None] if x[:, k].any() else None for k in range(16)]
    py = [y[None, :, k] if (y[:, k] != y[0, k]).any() else int(y[0, k]) for k in range(16)]  # words that all have are numbers
    a, b, c, d = (np.full(shape, s) for s in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i, (shift, sine, k) in enumerate(zip(_SHIFTS, _SINES, _WORDS, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(py[k], int):
            more = np.uint32((py[k] + sine) % 2**32)
            np.add(f, more if px[k] is None else px[k] + more, out=f)
        else:
            np.add(f, py[k] + np.uint32(sine), out=f)
            if px[k] is not None:
                np.add(f, px[k], out=f)
        np.left_shift(f, np.uint32(shift), out=t)
        np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        if i == _FIRST_DONE and not whole:
            np.add(f, _START[0], out=f)
            return [f.byteswap(inplace=True)]
        a, d, c, b, f = d, c, b, f, a
    for w, s in zip((a, b, c, d), _START, strict=True):
        np.add(w, s, out=w)
        w.byteswap(inplace=True)
    return [a, b, c, d]


def md5_of_products(firsts: list[bytes], seconds: list[bytes], whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(i, j, words) until all texts firsts[i] + seconds[j] are met: rows, columns and the four words of their MD5, whose order is that of its text.

    Without ``whole`` there is only the first word.
    """
    by_length: list[dict[int, list[int]]] = [{}, {}]
    for side, texts in zip(by_length, (firsts, seconds), strict=True):
        for k, t in enumerate(texts):
            side.setdefault(len(t), []).append(k)
    for n, rows in by_length[0].items():
        for m, columns in by_length[1].items():
            step = min(len(columns), 4096)
            for at in range(0, len(columns), step):
                j = np.array(columns[at : at + step])
                if n + m <= _ONE_BLOCK:
                    y = _words([seconds[k] for k in j], n, b"\x80").copy()
                    y[:, 14] = 8 * (n + m)
                for up in range(0, len(rows), max(1, TILE // len(j))):
                    i = np.array(rows[up : up + max(1, TILE // len(j))])
                    if n + m <= _ONE_BLOCK:
                        yield i, j, _compressed(_words([firsts[k] for k in i], 0), y, whole)
                    else:
                        long_ = b"".join(hashlib.md5(firsts[p] + seconds[q]).digest() for p in i for q in j)
                        words = list(np.frombuffer(long_, ">u4").astype(np.uint32).reshape(len(i), len(j), 4).transpose(2, 0, 1))
                        yield i, j, words if whole else words[:1]
