"""64-bit hashes of a text's words, all in a few passes over arrays instead of one by one.

A word's hash is a sum of numbers that stand for its bytes, each times a power of a base by its
place, mixed at the end. Sums of whole words are differences of running sums over the text.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text whose words are hashed together.
BLOCK_BYTES = 1 << 20
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


class Powers:
    """Powers of the hash base and of its inverse, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = U64(len(self.up))
            self.up = np.concatenate([self.up, self.up * _power(BASE, int(k))])
            self.down = np.concatenate([self.down, self.down * _power(BASE_INVERSE, int(k))])
        return self.up[:n], self.down[:n]


def _power(base: np.uint64, k: int) -> np.uint64:
    return U64(pow(int(base), k, 1 << 64))


_powers = Powers()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A number for each byte, of which a word's hash is made.
BYTES = mix(np.arange(1, 257, dtype=U64) * GOLDEN)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space in their order; lower: with A-Z taken in lower case."""
    out, begin = [], 0
    while begin < len(text):
        end = begin + BLOCK_BYTES
        if end < len(text):  # to the next white space: a block ends with a word
            ahead = text[end : end + BLOCK_BYTES]
            gaps = np.flatnonzero(SPACE[np.frombuffer(ahead, np.uint8)])
            while not len(gaps) and end < len(text):
                end += len(ahead)
                ahead = text[end : end + BLOCK_BYTES]
                gaps = np.flatnonzero(SPACE[np.frombuffer(ahead, np.uint8)])
            end += int(gaps[0]) if len(gaps) else 0
        data = np.frombuffer(text[begin:end].lower() if lower else text[begin:end], np.uint8)
        gap = np.concatenate([[True], SPACE[data], [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(BYTES[data] * up[:-1])])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def first_bytes(text: bytes) -> np.ndarray:
    """Where words begin."""
    gap = SPACE[np.frombuffer(text, np.uint8)]
    return ~gap & np.concatenate([[True], gap[:-1]])
