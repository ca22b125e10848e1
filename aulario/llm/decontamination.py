"""Benchmark items found in training documents with a stored positional inverted index.

The index is partitioned by documents: a row holds the posting lists of one document, term by term with the word
positions of each, so one key's postings are never gathered in one place. A search sends the test windows to the index
rows. In a group of rows the window's rarest term gives the candidates: its positions, shifted by the term's place in
the window, are starts; they are intersected with the shifted lists of the window's other terms, the rarer ones first.
What is left are the exact occurrences of the window. With `slack`, windows whose terms stand close together in any
order are found likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.texts import LOWER, WORD_BYTES, slices, text_bytes, tidy, word_hashes, words
from aulario.llm.work import written

#: Bytes of test items that are sent to the tasks at once; more items are searched for block by block.
ITEM_BYTES = 8 << 20
#: Words of index rows that are searched together inside a task.
_WORDS_AT_ONCE = 1 << 19

_INDEX = "n_words int, terms binary, sizes binary, positions binary"
_FOUND = "n_words long, spans array<struct<first:int,until:int>>, items array<string>"


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (A-Z lower-cased), and the bounds between texts."""
    data, at = text_bytes(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, at, WORD_BYTES)
    return word_hashes(data, starts, ends), bounds


def _parts(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    whole, at = values.tobytes(), (bounds * values.itemsize).tolist()
    return [whole[s:e] for s, e in zip(at, at[1:])]


def positional_index(docs: DataFrame) -> DataFrame:
    """A row of posting lists for every row of `docs` (doc_id, text), stored in the shared folder.

    `terms` are 64-bit word hashes in ascending order, `sizes` how often each occurs, `positions` the word positions
    from 0, term by term. Null and empty texts have no terms.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                terms, bounds = term_hashes(part.column(1))
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((terms, doc))
                terms, doc = terms[order], doc[order]
                opens = np.flatnonzero(
                    np.append(True, (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])) if len(terms) else []
                )
                lists = np.searchsorted(opens, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(bounds).astype(np.int32)),
                        pa.array(_parts(terms[opens], lists), pa.binary()),
                        pa.array(_parts(np.diff(np.append(opens, len(terms))).astype(np.int32), lists), pa.binary()),
                        pa.array(_parts((order - bounds[doc]).astype(np.int32), bounds), pa.binary()),
                    ],
                    ["doc_id", "n_words", "terms", "sizes", "positions"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(tidy(build), f"doc_id {kind}, {_INDEX}"))


@dataclass
class Windows:
    """Distinct windows of one length: term numbers of each, and the items that hold each."""

    terms: np.ndarray
    items: list[list[str]]


def test_windows(ids: list[str], texts: list[str | None], length: int) -> tuple[np.ndarray, list[Windows]]:
    """The sorted term hashes of some items, and their windows: `length` consecutive words, or a whole shorter item."""
    hashes, bounds = term_hashes(pa.array(texts, pa.string()))
    terms, numbers = np.unique(hashes, return_inverse=True)
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, first, last in zip(ids, bounds, bounds[1:]):
        size = min(length, int(last - first))
        for at in range(first, last - size + 1) if size else ():
            found.setdefault(size, {}).setdefault(tuple(numbers[at : at + size].tolist()), set()).add(item)
    return terms, [
        Windows(np.array(list(own), dtype=np.int64), [sorted(x) for x in own.values()]) for own in found.values()
    ]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count times."""
    until = np.cumsum(counts)
    return np.repeat(starts - (until - counts), counts) + np.arange(int(until[-1]) if len(until) else 0)


class Lists:
    """Posting lists of some index rows for the terms of a test block.

    Positions run on from document to document with a gap wider than a window's reach, so no occurrence crosses.
    """

    def __init__(self, rows: pa.RecordBatch, vocabulary: np.ndarray, gap: int):
        self.n_words = rows.column("n_words").to_numpy().astype(np.int64)
        raw = [b"".join(rows.column(c).to_pylist()) for c in ("terms", "sizes", "positions")]
        terms, sizes, at = (np.frombuffer(x, k) for x, k in zip(raw, ("<u8", "<i4", "<i4"), strict=True))
        self.base = gap + np.cumsum(self.n_words + gap) - (self.n_words + gap)
        self.total = int(self.n_words.sum()) + gap * (len(self.n_words) + 1)
        number = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
        asked = np.flatnonzero(vocabulary[number] == terms)
        lists = [len(x) // 8 for x in rows.column("terms").to_pylist()]
        doc = np.repeat(np.arange(len(lists)), lists)[asked]
        size = sizes[asked].astype(np.int64)
        begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[asked]
        order = np.argsort(number[asked], kind="stable")
        size, begin, doc, number = size[order], begin[order], doc[order], number[asked][order]
        #: positions of term t: at[first[t] : first[t + 1]], ascending
        self.at = at[_expand(begin, size)] + np.repeat(self.base[doc], size)
        self.counts = np.bincount(number, weights=size, minlength=len(vocabulary)).astype(np.int64)
        self.first = np.append(0, np.cumsum(self.counts))
        self.holds = np.full(self.total, -1, dtype=np.int64)  # the lists, turned round for membership tests
        self.holds[self.at] = np.repeat(number, size)

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, position of its rarest term) for windows all of whose terms occur, and the places by rarity."""
        counts = self.counts[windows]
        alive = np.flatnonzero(counts.min(axis=1) > 0)
        places = np.argsort(counts[alive], axis=1, kind="stable")
        rarest = windows[alive, places[:, 0]]
        many = self.counts[rarest]
        return np.repeat(alive, many), self.at[_expand(self.first[rarest], many)], np.repeat(places, many, axis=0)

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence."""
        window, at, places = self.candidates(windows)
        start = at - places[:, 0]
        for step in range(1, windows.shape[1]):
            place = places[:, step]
            same = self.holds[start + place] == windows[window, place]
            window, start, places = window[same], start[same], places[same]
        return window, start

    def near(self, windows: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of runs of length + slack words that hold all terms of the window in any order."""
        reach = windows.shape[1] + slack
        window, at, _ = self.candidates(windows)
        window, start = np.repeat(window, reach), (at[:, None] - np.arange(reach)).reshape(-1)
        for place in range(windows.shape[1]):
            term = windows[window, place]
            # the term's first position from the start on: positions of a term ascend, terms follow one another
            key, keys = term * self.total + start, np.repeat(np.arange(len(self.counts)), self.counts) * self.total
            after = np.searchsorted(keys + self.at, key)
            ends = after < self.first[term + 1]
            close = ends & (self.at[np.minimum(after, len(self.at) - 1)] < start + reach)
            window, start = window[close], start[close]
        return window, start


def _search(rows: pa.RecordBatch, vocabulary: np.ndarray, tests: list[Windows], slack: int) -> pa.RecordBatch:
    longest = max((w.terms.shape[1] for w in tests), default=1)
    spans: list[list[dict]] = rows.column("spans").to_pylist()
    items: list[list[str]] = rows.column("items").to_pylist()
    if len(vocabulary):
        lists = Lists(rows, vocabulary, gap=longest + slack)
        depth, pairs = np.zeros(lists.total + 1, dtype=np.int64), set()
        for own in tests:
            found, reach = lists.exact(own.terms), own.terms.shape[1]
            if slack:
                found, reach = lists.near(own.terms, slack), reach + slack
            window, start = found
            if not len(window):
                continue
            np.add.at(depth, start, 1)
            np.add.at(depth, start + reach, -1)
            doc = np.searchsorted(lists.base, start + (reach - 1 if slack else 0), side="right") - 1
            for w, d in {*zip(window.tolist(), doc.tolist(), strict=True)}:
                pairs.update((d, item) for item in own.items[w])
        covered = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0)
        for first, until in zip(np.flatnonzero(covered == 1), np.flatnonzero(covered == -1), strict=True):
            d = int(np.searchsorted(lists.base, until - 1, side="right")) - 1
            at, end = int(first - lists.base[d]), int(until - lists.base[d])
            spans[d].append({"first": max(0, at), "until": min(end, int(lists.n_words[d]))})
        for d, item in pairs:
            items[d].append(item)
    columns = dict(zip(rows.schema.names, rows.columns, strict=True))
    kinds = {name: rows.schema.field(name).type for name in ("spans", "items")}
    columns |= {"spans": pa.array(spans, kinds["spans"]), "items": pa.array(items, kinds["items"])}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    total = np.cumsum(batch.column("n_words").to_numpy(), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + _WORDS_AT_ONCE, side="right")))
        yield batch.slice(first, last - first)
        first = last


def find_items(index: DataFrame, items: DataFrame, window: int = 10, slack: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row of a positional index.

    `items` (item_id, text; other columns are not read) has the test items. A window is `window` consecutive words of
    an item, or all words of a shorter one. `spans` are the word ranges inside occurrences of windows, ascending and
    apart from each other; `n_hit` their words; `items` the ids (as text, sorted) of items with occurring windows.
    With `slack`, an occurrence is any run of `slack` more words than the window that holds all terms of the window.

    Items are sent to the tasks in blocks of about ITEM_BYTES; the rows of the index pass through one search per
    block, whose finds add up. Items without words or without id find nothing. Repeated items and repeated rows
    change nothing and get equal rows. With no items, or an empty index, nothing is found.
    """
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    kind = index.schema["doc_id"].dataType.simpleString()
    kept = f"doc_id {kind}, {_INDEX}, spans array<struct<first:int,until:int>>, items array<string>"
    found = index.select(
        "*",
        F.array().cast("array<struct<first:int,until:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary, tests = test_windows([r[0] for r in own], [r[1] for r in own], window)

        def search(
            batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray = vocabulary, tests: list[Windows] = tests
        ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _groups(batch):
                    yield _search(rows, vocabulary, tests, slack)

        found = found.mapInArrow(tidy(search), kept)
    ordered = F.array_sort("spans")
    # overlapping finds of different blocks become one span
    apart = F.aggregate(
        ordered,
        F.array().cast("array<struct<first:int,until:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["until"] >= s["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["until"], s["until"]).alias("until"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    spans = ordered if blocks == 1 else apart
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        spans.alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    ).select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["first"]).alias("n_hit"),
        "spans",
        "items",
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no window of any item.

    doc_id names a document: rows with one doc_id stay or go together. Rows without doc_id stay.
    """
    found = find_items(positional_index(docs), items, window).where("n_hit > 0")
    hit = written(found.select(F.col("doc_id").alias("hit_id")))
    return docs.join(hit, docs["doc_id"] == hit["hit_id"], "left_anti")
