"""Character shingles as vectors of hashes, shared by signatures and verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_letters(text: Column) -> Column:
    """Lower-cased letters and digits of a text, nothing else."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k code points of each text, and the text each belongs to."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], np.int64)
    if len(codes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        value = value * _MUL + mix(codes[i : len(codes) - k + 1 + i] + np.uint64(1)) if i == 0 else value * _MUL + codes[i : len(codes) - k + 1 + i]
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(value)]
    left = np.repeat(np.cumsum(lengths), lengths)[: len(value)] - np.arange(len(value))
    inside = left >= k
    return mix(value[inside]), owner[inside]
