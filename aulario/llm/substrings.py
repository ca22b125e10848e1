"""Removal of passages that occur in an earlier document, by a join of window hashes dealt by minimiser.

The words of a document are covered by windows of `window` words, and each window is looked up by its hash among the
windows of documents with smaller ids. These are too many for one place, so they are dealt into blocks by content: the
anchor of a window is the run of `ANCHOR` words in it with the least hash, and a block holds the windows of some anchors.
Equal windows have equal anchors, so everything that a window can match lies in one block. Consecutive windows with one
anchor form a stretch; found windows in a row are one factor, and the union of the factors is what windows of equal
words cover. A task sends its stretches of one block as one row, column by column, which takes less than a row for each.
This is no relative Lempel-Ziv parsing: neighbouring windows may come from different documents, and no longest match in
one reference is grown, as the union does not need it.

An anchor that very many places share would be a block without a bound. So the documents of a sample are cut first to
find crowded anchors; the sample decides only which way an anchor goes, never a result. Windows of crowded anchors are rows
of their own, dealt by their hash, and equal ones of a task are one row with their places: the least document of each is
found by aggregation, and windows that more than one document has are joined back to the rows with their places. What is
found is gathered by groups of documents, where places in a row become one span.

A block knows a window by 30 bits of its anchor and a 64-bit hash of all its words, which settles the anchor's place. Words
are not compared: with n distinct windows of one anchor, about n^2 / 2^65 are found falsely (2.4e-7 for 3 million).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.chunks import runs
from aulario.llm.texts import NOT_SPACE, mix, run_hashes, slices, text_bytes, word_hashes, words
from aulario.llm.work import written

#: Words of an anchor.
ANCHOR = 5
#: Stretches of a task that are gathered before equal ones are sent as one row; bounds memory.
_AT_ONCE = 1 << 20

#: One document in so many is cut to find crowded anchors.
_SAMPLED = 16
#: An anchor is crowded with this share of all stretches, but not below the first and always from the second bound on.
_CROWDED_SHARE, _CROWDED = 1 / 1024, (1 << 10, 1 << 18)

#: Bits of an anchor that name its block, and stretches of whole blocks that are looked at together.
_BLOCK_BITS, _TOGETHER = 14, 1 << 16
#: Places of equal windows in one row, and groups of documents for the places found.
_PLACES, _GROUPS = 256, 1 << 10

#: The stretches that a task has of a block: upper parts that all share, and for each what is left.
_STRETCHES = (
    "block int, doc_high int, first_high int, "
    "anchors binary, docs binary, firsts binary, sizes binary, prints binary, others binary"
)
_COUNT = "anchor int, n long"
_WINDOW = "anchor int, print long, least long, greatest long, places binary"
_FOUND = "block int, places binary"
_SPAN = "doc_id long, first int, until int"
_ENTRY = np.dtype([("doc", "<i8"), ("first", "<i4")])
_OTHER = np.dtype([("owner", "<u4"), ("doc", "<i8"), ("first", "<i4")])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of `values` between consecutive bounds (in values)."""
    at = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(values)])


class _Stretches:
    """Stretches of some documents, of all anchors, or with `crowded` (ascending) of those in it or not in it."""

    def __init__(self, window: int, crowded: np.ndarray | None = None, inside: bool = False):
        self.window, self.crowded, self.inside = window, crowded, inside
        self.parts, self.held = [], 0

    def add(self, ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        starts, ends, bounds = words(data, at, NOT_SPACE)
        span = self.window - ANCHOR + 1
        count = len(starts) - self.window + 1
        if count <= 0:
            return
        hashes = word_hashes(data, starts, ends)
        anchors, whole = run_hashes(hashes, ANCHOR), run_hashes(hashes, self.window)
        least, place = anchors[:count].copy(), np.arange(count)
        for step in range(1, span):
            near = anchors[step : step + count]
            lower = np.flatnonzero(near < least)
            least[lower] = near[lower]
            place[lower] = lower + step
        sizes = np.diff(bounds)
        left = np.repeat(bounds[1:], sizes)[:count] - np.arange(count)  # words from here to the end of the text
        begin = np.flatnonzero(left >= self.window)
        if not len(begin):
            return
        place = place[begin]
        opens = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        content = np.add.reduceat(mix(whole[begin]), opens)
        text = np.repeat(np.arange(len(sizes)), sizes)[begin[opens]]
        part = (
            (anchors[place[opens]] >> np.uint64(32)).astype(np.uint32).view(np.int32),
            ids[text],
            (begin[opens] - bounds[text]).astype(np.int32),
            content,
            np.diff(np.append(opens, len(begin))),
        )
        prints = whole[begin].view(np.int64)
        if self.crowded is not None:
            at = np.searchsorted(self.crowded, part[0]).clip(max=max(len(self.crowded) - 1, 0))
            member = self.crowded[at] == part[0] if len(self.crowded) else np.zeros(len(opens), dtype=bool)
            taken = member == self.inside
            prints = prints[np.repeat(taken, part[4])]
            part = tuple(x[taken] for x in part)
        if len(prints):
            self.parts.append((*part, prints))
            self.held += len(part[0])

    def _taken(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        return columns

    def counts(self) -> pa.RecordBatch:
        """Stretches of each anchor."""
        anchor, n = np.unique(self._taken()[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    def windows(self) -> pa.RecordBatch:
        """Windows with their places; equal ones become one row, or several if they have many places."""
        anchor, doc, first, _, sizes, prints = self._taken()
        anchor, row = np.repeat(anchor, sizes), np.repeat(np.arange(len(doc)), sizes)
        places = np.empty(len(prints), dtype=_ENTRY)
        places["doc"], places["first"] = doc[row], first[row] + np.arange(len(prints)) - (np.cumsum(sizes) - sizes)[row]
        order = np.lexsort((prints, anchor))
        anchor, prints, places = anchor[order], prints[order], places[order]
        change = np.append(True, (prints[1:] != prints[:-1]) | (anchor[1:] != anchor[:-1]))
        opens = np.flatnonzero(change)
        nth = np.arange(len(prints)) - np.repeat(opens, np.diff(np.append(opens, len(prints))))
        opens = np.flatnonzero(nth % _PLACES == 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor[opens]),
                pa.array(prints[opens]),
                pa.array(np.minimum.reduceat(places["doc"], opens)),
                pa.array(np.maximum.reduceat(places["doc"], opens)),
                _binary(places, np.append(opens, len(prints))),
            ],
            ["anchor", "print", "least", "greatest", "places"],
        )

    def rows(self) -> pa.RecordBatch:
        """Stretches by block; equal ones are one with all places."""
        anchor, doc, first, content, sizes, prints = self._taken()
        order = np.lexsort((first, doc, content))
        change = np.append(True, content[order][1:] != content[order][:-1])
        for also in (anchor[order], sizes[order]):
            change[1:] |= also[1:] != also[:-1]
        opens = np.flatnonzero(change)
        more = np.diff(np.append(opens, len(order))) - 1
        head = order[opens]  # of equal stretches the one in the smallest document

        key = (doc[head] >> 32 << 32) | (first[head].astype(np.int64) >> 16 << _BLOCK_BITS)
        key |= anchor[head] & ((1 << _BLOCK_BITS) - 1)
        by = np.argsort(key, kind="stable")
        key, head, more, opens = key[by], head[by], more[by], opens[by]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        edges = np.append(starts, len(key))

        others = np.empty(int(more.sum()), dtype=_OTHER)
        rest = order[runs(opens + 1, more)]
        others["doc"], others["first"] = doc[rest], first[rest]
        others["owner"] = np.repeat(np.arange(len(key)) - np.repeat(starts, np.diff(edges)), more)
        bounds = np.append(0, np.cumsum(more))[edges]
        alone = pa.array(bounds[1:] == bounds[:-1])
        held = sizes[head]
        return pa.RecordBatch.from_arrays(
            [
                pa.array((key[starts] & ((1 << _BLOCK_BITS) - 1)).astype(np.int32)),
                pa.array((key[starts] >> 32).astype(np.int32)),
                pa.array(((key[starts] & 0xFFFFFFFF) >> _BLOCK_BITS).astype(np.int32)),
                _binary((anchor[head].view(np.uint32) >> np.uint32(16)).astype("<u2"), edges),
                _binary((doc[head] & 0xFFFFFFFF).astype("<u4"), edges),
                _binary((first[head] & 0xFFFF).astype("<u2"), edges),
                _binary((held - 1).astype("<u1"), edges),
                _binary(prints[runs((np.cumsum(sizes) - sizes)[head], held)], np.append(0, np.cumsum(held))[edges]),
                pc.if_else(alone, pa.scalar(None, pa.binary()), _binary(others, bounds)),
            ],
            ["block", "doc_high", "first_high", "anchors", "docs", "firsts", "sizes", "prints", "others"],
        )


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), dtype=kind), np.diff(at) // kind.itemsize


def _whole_blocks(batches: Iterator[pa.RecordBatch], measure: str, most: int) -> Iterator[pa.Table]:
    """The rows, which come ordered by block, in parts of whole blocks: of one, or with at most so many bytes in a column."""
    held: list[pa.RecordBatch] = []  # of the last block so far
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        if held and held[-1].column("block")[0].as_py() != block[0]:
            yield pa.Table.from_batches(held)
            held = []
        ends = np.flatnonzero(block[1:] != block[:-1]) + 1
        until = np.append(0, np.cumsum(pc.binary_length(batch.column(measure)).to_numpy(), dtype=np.int64))
        low = 0
        while len(ends):
            last = max(1, int(np.searchsorted(until[ends], until[low] + most, side="right")))
            yield pa.Table.from_batches([*held, batch.slice(low, int(ends[last - 1]) - low)])
            held, low, ends = [], int(ends[last - 1]), ends[last:]
        held.append(batch.slice(low))
    if held:
        yield pa.Table.from_batches(held)


def _factors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Duplicate spans of the stretches of some blocks, which come ordered by block."""
    for part in _whole_blocks(batches, "sizes", _TOGETHER):
        columns = [c.combine_chunks() for c in part.columns]
        block, doc_high, first_high = (c.to_numpy().astype(np.int64) for c in columns[:3])
        kinds = ("<u2", "<u4", "<u2", "<u1", "<i8")
        anchor, doc, first, sizes, prints = (_values(c, np.dtype(k))[0] for c, k in zip(columns[3:8], kinds, strict=True))
        others, more = _values(columns[8], _OTHER)
        held = pc.binary_length(columns[6]).to_numpy()  # stretches of each row
        owner = others["owner"] + np.repeat(np.cumsum(held) - held, more)
        sizes = sizes.astype(np.int64) + 1
        doc = doc + np.repeat(doc_high << 32, held)
        by = np.argsort(doc, kind="stable")
        prints = prints[runs((np.cumsum(sizes) - sizes)[by], sizes[by])]
        group = (anchor + np.repeat(block << 16, held))[by]
        doc, first, sizes = doc[by], (first + np.repeat(first_high << 16, held))[by], sizes[by]
        place = np.empty(len(by), dtype=np.int64)
        place[by] = np.arange(len(by))
        owner = place[owner]

        row = np.repeat(np.arange(len(doc)), sizes)
        step = np.arange(len(prints)) - (np.cumsum(sizes) - sizes)[row]
        groups = group[row]
        order = np.lexsort((prints, groups))  # stable, and rows ascend by document: of equal windows the least comes first
        known, of = prints[order], groups[order]
        heads = np.append(True, (known[1:] != known[:-1]) | (of[1:] != of[:-1]))
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(heads) - 1
        found = doc[row][order[heads]][back] < doc[row]

        # a factor is a run of windows that the block holds
        opens = found.copy()
        opens[1:] &= ~(found[:-1] & (row[1:] == row[:-1]))
        closes = found.copy()
        closes[:-1] &= ~(found[1:] & (row[1:] == row[:-1]))
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
        out = [(doc[row[opens]], first[row[opens]] + step[opens], first[row[opens]] + step[closes] + window)]
        if len(others):
            later = others["doc"] > doc[owner]  # the row's own document holds the whole stretch
            begin = others["first"][later]
            out.append((others["doc"][later], begin, begin + sizes[owner[later]] - 1 + window))
            # further places in the row's own document have the row's own factors
            same = np.flatnonzero(~later)
            factors = np.bincount(row[opens], minlength=len(doc))
            if len(same) and len(opens):
                times = factors[owner[same]]
                base = (np.cumsum(factors) - factors)[owner[same]]
                which = np.repeat(base - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                begin = np.repeat(others["first"][same], times)
                out.append(
                    (np.repeat(others["doc"][same], times), begin + step[opens[which]], begin + step[closes[which]] + window)
                )
        arrays = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(arrays[0]), pa.array(arrays[1].astype(np.int32)), pa.array(arrays[2].astype(np.int32))],
            ["doc_id", "first", "until"],
        )


def duplicate_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, first, until): word ranges of `docs` (doc_id long, text) covered by windows that also start in a
    document with a smaller id. Ranges may overlap and repeat; words are runs without ASCII white space.

    Rows of one doc_id are one document's. Rows without doc_id and null texts have no windows.
    """
    if window < ANCHOR or window - ANCHOR > 255:
        raise ValueError(f"a window has from {ANCHOR} to {ANCHOR + 255} words")

    def cut(made: Callable[[_Stretches], pa.RecordBatch], crowded: np.ndarray | None = None, inside: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Stretches(window, crowded, inside)
            for batch in batches:
                for part in slices(batch):
                    held.add(part.column(0).to_numpy(), *text_bytes(part.column(1)))
                    if held.held >= at_once:
                        yield made(held)
            if held.held:
                yield made(held)

        return run

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _factors(batches, window)

    at_once = _AT_ONCE
    read = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    sample = read.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLED)) == 0)
    crowded = _crowded_anchors(sample.mapInArrow(cut(_Stretches.counts), _COUNT))
    blocks = (
        read.mapInArrow(cut(_Stretches.rows, crowded), _STRETCHES)
        .repartition("block")
        .sortWithinPartitions("block")
    )
    spans = blocks.mapInArrow(factor, _SPAN)
    if not len(crowded):
        return spans
    places = written(read.mapInArrow(cut(_Stretches.windows, crowded, True), _WINDOW))
    return spans.union(_crowded_spans(places, window))


def _crowded_anchors(counted: DataFrame) -> np.ndarray:
    """The anchors with too many stretches for one block, from counts in the sample; ascending."""
    counts = written(counted.groupBy("anchor").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least, most = (bound / _SAMPLED for bound in _CROWDED)
    found = counts.where(F.col("n") >= min(most, max(least, total * _CROWDED_SHARE))).select("anchor").toPandas()
    return np.sort(found["anchor"].to_numpy(np.int32))


def _crowded_spans(places: DataFrame, window: int) -> DataFrame:
    """Spans of the windows in `places` that a smaller document has too."""
    shared = written(
        places.groupBy("anchor", "print")
        .agg(F.min("least").alias("smallest"), F.max("greatest").alias("largest"))
        .where("smallest < largest")
        .select(F.col("anchor").alias("a"), F.col("print").alias("p"), "smallest")
    )
    again = (F.col("anchor") == F.col("a")) & (F.col("print") == F.col("p")) & (F.col("greatest") > F.col("smallest"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in batches:
            found, sizes = _values(batch.column(0), _ENTRY)
            parts.append(found[found["doc"] > np.repeat(batch.column(1).to_numpy(), sizes)])
            if sum(map(len, parts)) >= _AT_ONCE:
                yield _by_document(np.concatenate(parts))
                parts = []
        if parts:
            yield _by_document(np.concatenate(parts))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches, "places", _TOGETHER * _ENTRY.itemsize):
            yield _spans_of(_values(part.column("places").combine_chunks(), _ENTRY)[0], window)

    found = places.join(shared, again).select("places", "smallest").mapInArrow(spread, _FOUND)
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(merged, _SPAN)


def _by_document(found: np.ndarray) -> pa.RecordBatch:
    """Places by the group of their document."""
    group = (mix(found["doc"].astype(np.uint64)) & np.uint64(_GROUPS - 1)).astype(np.int32)
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    return pa.RecordBatch.from_arrays(
        [pa.array(group[starts]), _binary(found[order], np.append(starts, len(group)))], ["block", "places"]
    )


def _spans_of(found: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans of the windows that begin at some places; windows that touch are one span."""
    found = found[np.lexsort((found["first"], found["doc"]))]
    doc, first = found["doc"].astype(np.int64), found["first"].astype(np.int32)
    opens = np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + window))[: len(doc)]
    closes = np.append(opens[1:], True)[: len(doc)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[opens]), pa.array(first[opens]), pa.array(first[closes] + np.int32(window))],
        ["doc_id", "first", "until"],
    )


def _keep(texts: list[str | None], spans: list[list[dict] | None]) -> Iterator[tuple[int, int, str]]:
    for text, ranges in zip(texts, spans, strict=True):
        own = (text or "").encode().split()
        if not ranges:
            yield len(own), 0, b" ".join(own).decode()
            continue
        depth = np.zeros(len(own) + 1, dtype=np.int64)
        np.add.at(depth, [r["first"] for r in ranges], 1)
        np.add.at(depth, [r["until"] for r in ranges], -1)
        covered = np.cumsum(depth)[:-1] > 0
        kept = b" ".join([own[i] for i in np.flatnonzero(~covered).tolist()])
        yield len(own), int(covered.sum()), kept.decode()


def remove_repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of `docs` (doc_id, text; other columns are not read).

    Words covered by a window whose words also start in a document with a smaller id are removed; `kept` is the rest,
    joined by one space. Windows are judged on the input. Null and empty texts have no words and keep the empty text.
    Repeated rows are one document and get equal rows; a row without doc_id keeps all its words. An empty table
    gives an empty table.
    """
    per_doc = (
        duplicate_spans(docs, window)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("first", "until")).alias("spans"))
        .withColumnRenamed("doc_id", "owner")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = list(_keep(part.column(1).to_pylist(), part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int64()),
                        pa.array([x[2] for x in found], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = own.join(per_doc, own["doc_id"] == per_doc["owner"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
