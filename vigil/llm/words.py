"""Words of a text as bytes, and 64-bit hashes of them as NumPy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. ``bytes.split()`` splits at exactly those six
characters and ``bytes.lower()`` changes exactly those 26 letters, so UTF-8 bytes need no regex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words whose hashes a worker remembers; it forgets them all and starts anew beyond that.
REMEMBERED = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered within a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mixed(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; a shorter text is one run; no words, none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    span = min(width, n)
    out = np.full(n - span + 1, np.uint64(span), np.uint64)
    for k in range(span):
        out = mixed(out * _ODD + hashes[k : n - span + 1 + k])
    return out
