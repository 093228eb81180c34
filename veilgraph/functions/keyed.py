"""The keyed draws of functions.noise for blocks of keys, in numpy.

A step that needs a draw for every pair of two blocks, or for every edge in
every trial, spends its time on md5.  Here all keys of a block that share a
prefix go through the digest's steps together, as arrays of 32-bit words; the
words that only the prefix fills are plain numbers.  The bits are those of
noise.key_bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_SHIFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
#: Keys that go through the digest together: their words stay in a core's cache.
CHUNK = 8192


def _plain_step(i: int, a: int, b: int, c: int, d: int, word: int) -> int:
    f = d ^ (b & (c ^ d))  # words before the first varying one only count in the first 16 steps
    t = (a + f + _K[i] + word) & _MASK
    return (b + (t << _SHIFT[i] | t >> (32 - _SHIFT[i]))) & _MASK


def _digest_bits(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first 52 bits of the md5 of n one-block messages."""
    a, b, c, d = _START
    begin = next(i for i, w in enumerate(words) if not isinstance(w, int))
    for i in range(begin):
        a, b, c, d = d, _plain_step(i, a, b, c, d, words[i]), b, c
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    t = np.empty(n, np.uint32)
    for i in range(begin, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(a, np.uint32((_K[i] + word) & _MASK), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.uint32(_K[i]), out=a)
        np.left_shift(a, np.uint32(_SHIFT[i]), out=t)
        np.right_shift(a, np.uint32(32 - _SHIFT[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(a, np.uint32(_START[0]), out=a)
    np.add(b, np.uint32(_START[1]), out=b)
    return a.byteswap().astype(np.uint64) << np.uint64(20) | (b.byteswap() >> np.uint32(12)).astype(np.uint64)


class Keys:
    """Rows of one or more whole numbers, whose draws are asked for under one
    prefix after the other."""

    def __init__(self, *columns: np.ndarray) -> None:
        texts = [np.asarray(c, np.int64).astype("S20") for c in columns]
        self.size = len(texts[0])
        joined = texts[0]
        for more in texts[1:]:
            joined = np.char.add(np.char.add(joined, b"|"), more)
        lengths = np.char.str_len(joined) if self.size else np.zeros(0, np.int64)
        raw = joined.view(np.uint8).reshape(self.size, -1) if self.size else np.zeros((0, 1), np.uint8)
        self.groups = []  # keys of one length: where they are and their text, a chunk each
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            for k in range(0, len(at), CHUNK):
                chunk = at[k : k + CHUNK]
                self.groups.append((chunk, length, raw[chunk, :length], {}))

    def _packed(self, text: np.ndarray, length: int, off: int) -> list[np.ndarray]:
        """The words of text and its end mark when it begins off bytes into a word."""
        padded = np.zeros((len(text), (off + length + 4) // 4 * 4), np.uint8)
        padded[:, off : off + length] = text
        padded[:, off + length] = 0x80
        return [np.ascontiguousarray(w) for w in padded.view("<u4").T]

    def bits(self, prefix: str) -> np.ndarray:
        """noise.key_bits of the key made of prefix and of each row's numbers."""
        head = prefix.encode() + b"|"
        out = np.empty(self.size, np.uint64)
        first, off = divmod(len(head), 4)
        for at, length, text, packed in self.groups:
            total = len(head) + length
            if total > 55:  # more than one block of the digest
                out[at] = [int(hashlib.md5(head + t.tobytes()).hexdigest()[:13], 16) for t in text]
                continue
            if off not in packed:
                packed[off] = self._packed(text, length, off)
            own = packed[off]
            words: list = [int.from_bytes(head[4 * k : 4 * k + 4], "little") for k in range(first)]
            words += [own[0] | np.uint32(int.from_bytes(head[4 * first :], "little")), *own[1:]]
            words += [0] * (14 - len(words)) + [8 * total, 0]
            out[at] = _digest_bits(words, len(at))
        return out

    def uniform(self, prefix: str) -> np.ndarray:
        """noise.uniform of the same keys."""
        return (self.bits(prefix).astype(np.float64) + 0.5) / float(1 << 52)
