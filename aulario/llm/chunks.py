"""Chunks of texts whose ids stand next to each other unchanged, each distinct one encoded once, for use inside tasks.

A tokenizer tells at which bytes a text may be cut without any effect on its ids. Prose repeats most of the chunks that
are left, so only distinct ones are encoded, and the ids are laid out in the order of the chunks by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aulario.llm.texts import text_bytes, word_hashes

#: Bytes in which cuts are looked for at once; chunks that are distinct among them are encoded once.
WINDOW = 16 << 20

#: Of distinct texts: all their ids, and where those of each begin and how many they are.
Ids = tuple[np.ndarray, np.ndarray, np.ndarray]


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `first`, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(first.max(initial=0)) < 1 << 31 else np.int64  # half the memory
    places = np.repeat((first - (ends - sizes)).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays, the shorter one filled up with zeros."""
    total = np.zeros(max(len(a), len(b)), dtype=np.int64)
    total[: len(a)] += a
    total[: len(b)] += b
    return total


def windows(
    data: np.ndarray, at: np.ndarray, cuts: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int | None = None
) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """(first bytes, chunks) of consecutive windows of the bytes of texts with the bounds `at`.

    `cuts` marks the bytes at which a chunk begins, given bytes and the places in them, 0 left out, where a text begins.
    A window grows until it has a cut.
    """
    edges = at[(at > 0) & (at < len(data))]
    low = 0
    while low < len(data):
        length, high = size or WINDOW, 0
        while not high:
            end = min(len(data), low + length)
            seen = min(len(data), end + 1)
            begins = cuts(data[low:seen], edges[(edges > low) & (edges < seen)] - low)[: end - low]
            begins[0] = False
            found = np.flatnonzero(begins)
            high = len(data) if end == len(data) else low + int(found[-1]) if len(found) else 0
            length *= 2
        del begins
        bounds = np.concatenate([[0], found[found < high - low], [high - low]])
        del found
        part = pa.py_buffer(data[low:high])
        chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), part).dictionary_encode()
        yield bounds[:-1] + low, chunks
        low = high


class Remembered:
    """Ids of distinct texts; those of the first `most` that have at most `longest` bytes are kept. It saves work only."""

    def __init__(self, encode: Callable[[pa.Array], Ids], most: int, longest: int = 48):
        self.encode, self.most, self.longest = encode, most, longest
        self.known = pa.array([], pa.large_string())
        self.hashes, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # ascending by hash
        self.ids = np.zeros(0, dtype=np.uint32)
        self.first, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _found(self, texts: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where each text is kept, or -1: found by its hash, and the same text."""
        place = np.full(len(texts), -1, dtype=np.int64)
        if len(self.known):
            at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            kept = self.places[at[hit]]
            same = pc.equal(self.known.take(pa.array(kept)), texts.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            place[hit[same]] = kept[same]
        return place

    def _keep(self, texts: pa.Array, hashes: np.ndarray) -> None:
        places = len(self.known) + np.arange(len(texts), dtype=np.int32)
        self.known = pa.concat_arrays([self.known, texts])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, places[order])

    def __call__(self, texts: pa.Array) -> Ids:
        data, at = text_bytes(texts)
        hashes = word_hashes(data, at[:-1], at[1:])
        place = self._found(texts, hashes)
        missing = np.flatnonzero(place < 0)
        new = texts.take(pa.array(missing))
        ids, new_first, new_sizes = self.encode(new)
        new_first = new_first + len(self.ids)
        ids = np.concatenate([self.ids, ids])
        first, sizes = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
        old = place >= 0
        first[old], sizes[old] = self.first[place[old]], self.sizes[place[old]]
        first[missing], sizes[missing] = new_first, new_sizes
        if len(self.known) < self.most:
            kept = pc.binary_length(new).to_numpy() <= self.longest
            held = new_sizes[kept]
            own = ids[runs(new_first[kept], held)]
            self._keep(new.filter(pa.array(kept)), hashes[missing[kept]])
            self.first = np.concatenate([self.first, (len(self.ids) + np.cumsum(held) - held).astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, held.astype(np.int32)])
            self.ids = np.concatenate([self.ids, own])
        return ids, first, sizes
