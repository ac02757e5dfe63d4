"""Matched characters of many pairs of words at once: the longest common block, then what is left and right of it."""

from __future__ import annotations

import numpy as np

CELLS = 1 << 20


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, flat, and where each word begins."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return flat, np.r_[0, np.cumsum([len(w) for w in words])]


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of two padded matrices the longest common run: length, where it begins in ``a`` and in ``b``; ties go to the earliest.

    Runs grow along the diagonals: one step for each column of ``a`` serves all rows at once.
    """
    rows = len(a)
    best, at_a, at_b = (np.zeros(rows, dtype=np.int64) for _ in range(3))
    run = np.zeros((rows, b.shape[1] + 1), dtype=np.int64)
    every = np.arange(rows)
    for k in range(a.shape[1]):
        grown = np.zeros_like(run)
        grown[:, 1:] = np.where(b == a[:, k : k + 1], run[:, :-1] + 1, 0)
        end = grown.argmax(axis=1)
        size = grown[every, end]
        better = size > best
        best[better], at_a[better], at_b[better] = size[better], k + 1 - size[better], end[better] - size[better]
        run = grown
    return best, at_a, at_b


def _padded(flat: np.ndarray, low: np.ndarray, high: np.ndarray, filler: int) -> np.ndarray:
    width = int((high - low).max(initial=0))
    at = low[:, None] + np.arange(width)
    inside = at < high[:, None]
    return np.where(inside, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, filler)


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair how many characters the blocks match."""
    (flat_a, ends_a), (flat_b, ends_b) = _codes(a), _codes(b)
    total = np.zeros(len(a), dtype=np.int64)
    # Open blocks: their pair, and their bounds in both words.
    open_ = np.stack([np.arange(len(a)), ends_a[:-1], ends_a[1:], ends_b[:-1], ends_b[1:]], axis=1)
    while len(open_ := open_[(open_[:, 2] > open_[:, 1]) & (open_[:, 4] > open_[:, 3])]):
        open_ = open_[np.argsort(np.maximum(open_[:, 2] - open_[:, 1], open_[:, 4] - open_[:, 3]), kind="stable")]
        left, low = [], 0
        while low < len(open_):
            # Blocks of like size together, as many as fit.
            width = np.maximum.accumulate((open_[low:, 4] - open_[low:, 3]) + 1)
            high = low + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, side="right")))
            part = open_[low:high]
            size, at_a, at_b = _longest(_padded(flat_a, part[:, 1], part[:, 2], -1), _padded(flat_b, part[:, 3], part[:, 4], -2))
            part, size, at_a, at_b = (x[size > 0] for x in (part, size, at_a, at_b))
            total += np.bincount(part[:, 0], weights=size, minlength=len(a)).astype(np.int64)
            begin_a, begin_b = part[:, 1] + at_a, part[:, 3] + at_b
            left += [np.stack([part[:, 0], part[:, 1], begin_a, part[:, 3], begin_b], axis=1), np.stack([part[:, 0], begin_a + size, part[:, 2], begin_b + size, part[:, 4]], axis=1)]
            low = high
        open_ = np.concatenate(left)
    return total


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters; 1 for two empty words."""
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    return np.where(sizes > 0, 2.0 * matched(a, b) / np.maximum(sizes, 1), 1.0)
