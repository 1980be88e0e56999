"""Hashed character n-grams of many words at once."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(1099511628211)
_BASE = np.uint64(14695981039346656037)


def grams(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram of `<word>` and of the whole word; buckets is a power of two.

    The words lie end to end in one buffer of code points; an n-gram is hashed for all positions in a few numpy
    operations and those that cross the end of a word are left out. Each word owns at least its own whole hash.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(starts + lens, lens) - np.arange(len(codes))  # code points from here to the end of the word
    mask = np.uint64(buckets - 1)
    owners, ids = [], []
    with np.errstate(over="ignore"):
        h = np.full(len(codes), _BASE, np.uint64)
        for n in range(1, min(max(orders), len(codes)) + 1):
            h[: len(codes) - n + 1] = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _PRIME
            if n in orders:
                at = np.flatnonzero(left >= n)
                x = h[at] ^ np.uint64(n * 0x9E3779B9)
                owners.append(owner[at])
                ids.append(((x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(43))) & mask).astype(np.int64))
        step = np.arange(len(codes)) - np.repeat(starts, lens)
        powers = np.cumprod(np.full(int(lens.max()), _PRIME, np.uint64))
        x = np.add.reduceat(codes * powers[step], starts) * _PRIME
        owners.append(np.arange(len(words)))
        ids.append(((x ^ (x >> np.uint64(31))) & mask).astype(np.int64))
    return np.concatenate(owners), np.concatenate(ids)
