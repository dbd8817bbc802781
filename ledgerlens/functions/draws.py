"""Draws that are a function of their numbers, many at a time: md5 over short texts in NumPy."""

from __future__ import annotations

import math

import numpy as np

AT_ONCE = 32_768  # few calls for many draws, in arrays that stay near the processor
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF


def _round(i: int) -> tuple[int, int]:
    """Word and shift of a step."""
    return (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, _SHIFTS[i // 16][i % 4]


def _mixed(i: int, b, c, d):
    """The function of a step over whole numbers."""
    if i < 16:
        return d ^ b & (c ^ d)
    return c ^ d & (b ^ c) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | d ^ _MASK)


def _mixed_into(out: np.ndarray, i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    """The same over arrays."""
    if i < 16:
        np.bitwise_xor(c, d, out=out)
        np.bitwise_and(b, out, out=out)
        np.bitwise_xor(d, out, out=out)
    elif i < 32:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_and(d, out, out=out)
        np.bitwise_xor(c, out, out=out)
    elif i < 48:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_xor(d, out, out=out)
    else:
        np.invert(d, out=out)
        np.bitwise_or(b, out, out=out)
        np.bitwise_xor(c, out, out=out)


def _md5_front(fixed: list[int], varying: dict[int, np.ndarray], size: int) -> np.ndarray:
    """First eight digest bytes, as a big-endian number, of ``size`` texts of one block: word w is ``fixed[w]`` plus, where it has
    one, the array ``varying[w]``.  Steps before the first varying word are done once."""
    a, b, c, d = _START
    i = 0
    while (at := _round(i))[0] not in varying:
        t = (a + _mixed(i, b, c, d) + _SINES[i] + fixed[at[0]]) & _MASK
        a, d, c, b, i = d, c, b, (b + (t << at[1] | t >> 32 - at[1])) & _MASK, i + 1
    a, b, c, d = (np.full(size, x, dtype=np.uint32) for x in (a, b, c, d))
    t, high = np.empty(size, dtype=np.uint32), np.empty(size, dtype=np.uint32)
    for i in range(i, 64):
        word, shift = _round(i)
        _mixed_into(t, i, b, c, d)
        t += a
        t += np.uint32((_SINES[i] + fixed[word]) & _MASK)
        if word in varying:
            t += varying[word]
        np.left_shift(t, np.uint32(shift), out=high)
        np.right_shift(t, np.uint32(32 - shift), out=t)
        t |= high
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


class _Texts:
    """Texts of one length, laid out byte by byte in one block."""

    def __init__(self, size: int) -> None:
        self.size, self.length, self.fixed, self.varying = size, 0, [0] * 16, {}

    def add(self, text: bytes) -> None:
        if self.length + len(text) > 56:
            raise ValueError("texts of more than 55 bytes do not fit one block")
        for x in text:
            self.fixed[self.length // 4] += x << self.length % 4 * 8
            self.length += 1

    def add_numbers(self, numbers: np.ndarray, digits: int) -> None:
        """Numbers of ``digits`` decimal digits, one for each text."""
        if (numbers == numbers[0]).all():
            self.add(str(int(numbers[0])).encode())
            return
        rest = numbers.astype(np.uint32 if digits < 10 else np.uint64)
        for p in range(self.length + digits - 1, self.length - 1, -1):
            up = rest // 10
            digit = (rest - up * 10).astype(np.uint32) << np.uint32(p % 4 * 8)
            self.varying[p // 4] = self.varying[p // 4] + digit if p // 4 in self.varying else digit
            rest = up
        self.add(b"0" * digits)

    def md5_front(self) -> np.ndarray:
        bits = self.length * 8
        self.add(b"\x80")
        self.fixed[14] = bits
        return _md5_front(self.fixed, self.varying or {0: np.zeros(self.size, dtype=np.uint32)}, self.size)


def md5_numbers(seed: int, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first 15 hexadecimal digits of md5(``seed:b:j``) as a number, for every pair of (b, j), whole numbers from 0."""
    out = np.empty(len(b), dtype=np.uint64)
    tens = 10 ** np.arange(1, 19, dtype=np.int64)
    layout = np.searchsorted(tens, b, side="right") * 32 + np.searchsorted(tens, j, side="right")
    for both in np.unique(layout).tolist():
        part = layout == both if (layout != both).any() else slice(None)
        texts = _Texts(len(out[part]))
        texts.add(f"{seed}:".encode())
        texts.add_numbers(b[part], both // 32 + 1)
        texts.add(b":")
        texts.add_numbers(j[part], both % 32 + 1)
        out[part] = texts.md5_front() >> np.uint64(4)
    return out
