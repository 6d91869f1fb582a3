"""Byte n-grams of words, hashed in numpy for many words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def pieces(words: Sequence[str], shortest: int, longest: int, buckets: int, at_once: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between boundary marks.

    Returns the buckets of all words one after the other and where each word begins.
    A word that is too short for any n-gram has one piece that such words share.
    """
    parts = [_pieces(words[i : i + at_once], shortest, longest, buckets) for i in range(0, len(words), at_once)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    before = np.cumsum([0] + [len(found) for found, _ in parts])
    return np.concatenate([found for found, _ in parts]), np.concatenate([starts + n for (_, starts), n in zip(parts, before, strict=False)])


def _pieces(words: Sequence[str], shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(marked)), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes of the word from here on
    found, owner = [], []
    rolling = np.zeros(len(data), np.uint64)
    for n in range(1, longest + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: max(0, len(data) - n + 1)] = data[n - 1 :]
        rolling = rolling * _ODD + shifted
        if n >= shortest:
            whole = left >= n
            found.append(_mixed(rolling[whole] + np.uint64(n)))
            owner.append(word[whole])
    short = np.flatnonzero(sizes < shortest)  # too short for any: one piece of their own
    found.append(np.full(len(short), _mixed(np.array([77], np.uint64))[0]))
    owner.append(short)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(marked))
    starts = np.cumsum(counts) - counts
    return (np.concatenate(found)[order] % np.uint64(buckets)).astype(np.int32), starts


def means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of each word's stretch of ``values``."""
    sizes = np.diff(np.append(starts, len(values)))
    return np.add.reduceat(values, starts) / sizes if len(starts) else np.zeros(0)
