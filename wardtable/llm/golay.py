"""The binary Golay code of 23 bits: every word is within three bits of exactly one code word.

The decoder and the keys are tables of 2 ** 23 and 2 ** 11 entries made from the generator
polynomial. Two words that differ in at most two bits share a key: a word between them, one step
from either, has one nearest code word, and the keys of a word are the code words nearest to it or
to a word one step away. That is one key if the word is within two bits of its code word, six if not.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LENGTH, DATA = 23, 12
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@lru_cache(1)
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 12-bit head and each 11-bit tail: the remainder by the generator."""
    remainder = np.zeros(LENGTH, dtype="i8")
    for bit in range(LENGTH):
        value = 1 << bit
        for high in range(bit, DATA - 2, -1):
            if value >> high & 1:
                value ^= GENERATOR << (high - (DATA - 1))
        remainder[bit] = value
    out = []
    for low, count in ((DATA - 1, DATA), (0, DATA - 1)):
        words = np.arange(1 << count)
        out.append(np.bitwise_xor.reduce([np.where(words >> i & 1, remainder[low + i], 0) for i in range(count)]))
    return out[0], out[1]


def syndrome(words: np.ndarray) -> np.ndarray:
    head, tail = syndromes()
    return head[words >> (DATA - 1)] ^ tail[words & ((1 << (DATA - 1)) - 1)]


@lru_cache(1)
def errors() -> np.ndarray:
    """The error of at most three bits behind each of the 2048 syndromes."""
    out = np.zeros(1 << (LENGTH - DATA), dtype="i8")
    single = 1 << np.arange(LENGTH)
    for a in range(LENGTH):
        for b in range(a, LENGTH):
            for c in range(b, LENGTH):
                word = np.bitwise_or.reduce(single[[a, b, c]])
                out[syndrome(np.array([word]))[0]] = word
    out[0] = 0
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """Number (0 to 4095) of the code word nearest to each 23-bit word: its 12 leading bits."""
    return (words ^ errors()[syndrome(words)]) >> (DATA - 1)


@lru_cache(1)
def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: changes of the leading bits that lead to its keys, padded with the first, and their number."""
    table = np.zeros((1 << (LENGTH - DATA), 6), dtype="i8")
    count = np.zeros(1 << (LENGTH - DATA), dtype="i8")
    fix, steps = errors(), 1 << np.arange(LENGTH)
    for s in range(len(table)):
        # The word with this syndrome stands for all: code words shift everything alike.
        around = np.concatenate([[fix[s]], fix[s] ^ steps])
        keys = list(dict.fromkeys((nearest(around) ^ (fix[s] >> (DATA - 1))).tolist()))
        table[s, : len(keys)], table[s, len(keys) :], count[s] = keys, keys[0], len(keys)
    return table, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each 23-bit word as (row, key) arrays, a row for each different key."""
    table, count = _flips()
    s = syndrome(words)
    n = count[s]
    rows = np.repeat(np.arange(len(words)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, (words[rows] >> (DATA - 1)) ^ table[s[rows], nth]
