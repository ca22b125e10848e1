"""Hashed character n-grams of whole texts, and linear scores over them, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def code_points(texts: Sequence[str | None], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as numbers, and the n + 1 bounds between texts.

    With `fold` in lower case. White space and control characters are a space; every text has a space at both ends,
    so that word starts and ends at the ends of a text look as elsewhere. A null text is empty.
    """
    ready = [f" {(t.lower() if fold else t) if t else ''} " for t in texts]
    whole = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(whole < 32, np.uint32(32), whole), np.cumsum([0, *map(len, ready)])


def buckets(
    points: np.ndarray, bounds: np.ndarray, orders: Sequence[int], bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order n: (start, bucket) of all n-grams that lie within one text."""
    whole = points.astype(np.uint64) + np.uint64(1)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(points))  # characters to the end of the text
    hashes = whole
    for n in range(1, max(orders) + 1):
        if n > 1:
            hashes = hashes[:-1] * _STEP + whole[n - 1 :]
        if n in orders:
            spread = ((hashes ^ (hashes >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - bits)
            inside = left[: len(hashes)] >= n
            yield np.flatnonzero(inside), spread[inside].astype(np.int64)


def presence(
    points: np.ndarray,
    bounds: np.ndarray,
    orders: Sequence[int],
    bits: int,
    wanted: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all distinct buckets of each text, in order; only those marked in `wanted`, if given."""
    keys = []
    for start, bucket in buckets(points, bounds, orders, bits):
        if wanted is not None:
            some = np.flatnonzero(wanted[bucket])
            start, bucket = start[some], bucket[some]
        text = np.searchsorted(bounds, start, side="right") - 1
        keys.append((text << bits) | bucket)
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> bits, found & ((1 << bits) - 1)


class Rows:
    """A sparse matrix of bounded size: for each row the columns that are set."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
        self.rows, self.columns, self.n_rows, self.n_columns = rows, columns, n_rows, n_columns

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.columns], minlength=self.n_rows)

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=values[self.rows], minlength=self.n_columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
