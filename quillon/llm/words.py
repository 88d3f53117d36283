"""Sums over the words of a text where a word's value does not depend on its neighbours.

Scores of linear models are computed once for each distinct word of a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common

U64 = np.uint64


def byte_ngrams(words: pa.Array, sizes: tuple[int, ...], buckets: int, edge: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every byte n-gram of every word, the word's edges marked.

    The hash of a window is a polynomial in its bytes, so all windows of one size
    are hashed together.
    """
    data, offsets = common.flat_bytes(words)
    n = len(offsets) - 1
    pad = 1 if edge else 0
    length = np.diff(offsets) + 2 * pad
    start = np.concatenate([[0], np.cumsum(length)])
    wide = np.full(start[-1], 1, U64)
    owner = np.repeat(np.arange(n), length)
    if len(data):
        inner = np.repeat(start[:-1] + pad - offsets[:-1], np.diff(offsets)) + np.arange(len(data))
        wide[inner] = data.astype(U64) + U64(2)
    owners, found = [], []
    rest = np.repeat(start[1:], length) - np.arange(start[-1])  # bytes from here to the word's end
    window = np.zeros(len(wide), U64)
    for size in range(1, max(sizes) + 1):
        shifted = np.zeros(len(wide), U64)
        shifted[: len(wide) - size + 1] = wide[size - 1 :]
        window = window * U64(0x100000001B3) + shifted
        if size in sizes:
            ok = rest >= size
            owners.append(owner[ok])
            found.append((common.mix(window[ok] + U64(size << 56)) % U64(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def whole_words(words: pa.Array, buckets: int, seed: int = 1) -> np.ndarray:
    return (common.hash_words(words.to_pylist(), seed) % U64(buckets)).astype(np.int64)


def word_scores(words: pa.Array, weight: np.ndarray, features) -> np.ndarray:
    """Sum of the weights of each word's features."""
    owner, bucket = features(words)
    out = np.zeros((len(words), *weight.shape[1:]))
    if weight.ndim == 1:
        return np.bincount(owner, weight[bucket], minlength=len(words))
    for k in range(weight.shape[1]):
        out[:, k] = np.bincount(owner, weight[bucket, k], minlength=len(words))
    return out
