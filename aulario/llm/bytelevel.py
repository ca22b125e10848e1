"""Token ids of whole texts with a tokenizer of the tokenizers library, many texts at once inside a task.

A byte-level tokenizer first cuts a text by a fixed pattern and merges inside the pieces. Some places are cuts of that
pattern whatever stands around them:

* before a space or line feed that a character other than white space follows, and after such a line feed;
* after a letter of Latin-1 that an ASCII character other than a letter follows.

Texts are cut there, each distinct chunk is encoded by the library, and the ids are laid out in the order of the
chunks. Prose repeats most of its chunks, so the library sees a small part of the text. A tokenizer of another kind is
given whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from aulario.llm.chunks import Ids, Remembered, added, runs, windows
from aulario.llm.texts import text_bytes

#: Chunks whose ids are remembered.
REMEMBERED = 1_500_000
#: Chunks that are given to the library at once.
AT_ONCE = 8_000
#: Bytes that are looked at for cuts at once.
BLOCK = 1 << 18
#: Bytes whose distinct chunks are looked up at once.
WINDOW = 4 << 20
#: Chunks without white space but for a space in front: a line feed between two of them is a piece of its own.
_LINE = r"^ ?[^\s\x0b\x1c-\x1f\x{85}\pZ]+$"

_FOLLOWED, _LETTER, _OTHER, _SPACE, _FEED, _LEAD, _TAIL = (np.uint8(1 << k) for k in range(7))


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    solid = np.zeros(256, dtype=bool)  # a byte that begins no white space
    solid[0x21:] = True
    solid[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # first bytes of white space beyond ASCII, among others
    kinds[solid] |= _FOLLOWED
    letters = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
    kinds[:0x80] |= _OTHER
    kinds[letters] = (kinds[letters] & ~_OTHER) | _LETTER
    kinds[0x20] |= _SPACE
    kinds[0x0A] |= _FEED
    # À to ÿ in UTF-8 are 0xC3 and one more byte; × and ÷ among them are no letters
    kinds[0xC3] |= _LEAD
    kinds[0x80:0xC0] |= _TAIL
    kinds[[0x97, 0xB7]] &= ~_TAIL
    return kinds


_KINDS = _kinds()


def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    begins = np.zeros(len(data), dtype=bool)
    if len(data) < 2:
        return begins
    kinds = _KINDS[data]
    here, after = kinds[:-1], kinds[1:].copy()
    after[edges - 1] = 0  # nothing follows the last byte of a text
    solid = (after & _FOLLOWED) != 0
    begins[:-1] = ((here & (_SPACE | _FEED)) != 0) & solid
    begins[1:] |= ((here & _FEED) != 0) & solid
    letter = (here & _LETTER) != 0
    letter[1:] |= ((here[1:] & _TAIL) != 0) & ((here[:-1] & _LEAD) != 0)
    begins[1:] |= letter & ((after & _OTHER) != 0)
    begins[edges] = True
    return begins


def cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte for certain; `edges` are the bytes at which a text begins, 0 left out.

    Bytes are looked at in blocks, so the arrays in between stay small; two bytes before and one behind decide.
    """
    begins = np.empty(len(data), dtype=bool)
    for low in range(0, len(data), BLOCK):
        high, first, last = min(len(data), low + BLOCK), max(0, low - 2), min(len(data), low + BLOCK + 1)
        own = edges[np.searchsorted(edges, first, side="right") : np.searchsorted(edges, last)] - first
        begins[low:high] = _cuts(data[first:last], own)[low - first : high - first]
    return begins


def cuttable(config: dict) -> bool:
    """Whether the tokenizer's own cuts are those described above."""
    before = config.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and config.get("normalizer") is None
        and config.get("truncation") is None
        and config["model"]["type"] == "BPE"
        and config["model"].get("dropout") is None
        and all(token["special"] for token in config.get("added_tokens", []))
    )


class Encoder:
    """Ids as the library gives them without special tokens; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.cut = cuttable(json.load(file))
        self.distinct = Remembered(self._encoded, REMEMBERED)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _as_lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that match `_LINE`, encoded as the lines of one text."""
        feed = self.library.encode("\n", add_special_tokens=False).ids
        if len(feed) != 1 or not texts:
            return self._one_by_one(texts)
        (found,) = self.library.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        ends = np.append(np.flatnonzero(ids == feed[0]), len(ids))
        if len(ends) != len(texts):
            return self._one_by_one(texts)
        return ids[ids != feed[0]], np.diff(ends, prepend=-1) - 1

    def _encoded(self, texts: pa.Array) -> Ids:
        lines = pc.match_substring_regex(texts, _LINE).to_numpy(zero_copy_only=False)
        first, sizes = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        flat, held = [np.zeros(0, dtype=np.uint32)], 0
        for which, encode in ((np.flatnonzero(lines), self._as_lines), (np.flatnonzero(~lines), self._one_by_one)):
            for low in range(0, len(which), AT_ONCE):
                some = which[low : low + AT_ONCE]
                ids, count = encode(texts.take(pa.array(some)).to_pylist())
                first[some], sizes[some] = held + np.cumsum(count) - count, count
                flat.append(ids)
                held += len(ids)
        return np.concatenate(flat), first, sizes

    def count(self, column: pa.Array) -> np.ndarray:
        """How often each id comes up in all texts, by id."""
        counts = np.zeros(0, dtype=np.int64)
        if not self.cut:
            return np.bincount(self.encode(column)[0]).astype(np.int64)
        for _, chunks in windows(*text_bytes(column), cuts, WINDOW):
            ids, first, sizes = self.distinct(chunks.dictionary)
            times = np.bincount(chunks.indices.to_numpy(), minlength=len(sizes))
            own = np.bincount(ids[runs(first, sizes)], weights=np.repeat(times, sizes)).astype(np.int64)
            counts = added(counts, own)
        return counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n + 1 bounds between texts; null and '' have none."""
        data, at = text_bytes(column)
        if not self.cut:
            ids, sizes = self._one_by_one([data[s:e].tobytes().decode() for s, e in zip(at, at[1:])])
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        found, starts, counts = [], [], []
        for begins, chunks in windows(data, at, cuts, WINDOW):
            ids, first, sizes = self.distinct(chunks.dictionary)
            order = chunks.indices.to_numpy()
            found.append(ids[runs(first[order], sizes[order])])
            starts.append(begins)
            counts.append(sizes[order])
        if not found:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(found), before[np.searchsorted(np.concatenate(starts), at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the tasks of a worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
