"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits. It is cut into segments, and each segment has a table from its value to the fingerprints
that hold it. Two fingerprints within the greatest distance differ so little in at least one segment that the value of
one lies in a small Hamming ball around the value of the other: with radii r_1..r_m and sum(r_i + 1) > distance, more
than r_i differing bits in every segment would exceed the distance. So every ball is enumerated, looked up by an
equi-join, and the whole distance of what was found is verified. Equal fingerprints are one node from the start, so
copies are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulario.llm.components import components
from aulario.llm.texts import slices, text_bytes, tidy
from aulario.llm.work import written

BITS = 64
SEED = 42

_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Hashes whose bits are counted at once; longer texts are counted in parts.
_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of one whole text, as a signed 64-bit value; 0 for a text without words."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    if count == 1:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[: count - 1]]]
        hashes = np.fromiter(
            [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)],
            dtype=np.uint64,
            count=count,
        )
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, _AT_ONCE):
        part = hashes[at : at + _AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint long) of every row of `docs`; null, empty and blank texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = text_bytes(part.column(1))
                whole, at = data.tobytes(), at.tolist()
                found = [fingerprint(whole[s:e], shingle) for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, fingerprint long")


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, with sum(radius + 1) one above the distance where that is possible."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    shares = [(distance + 1) // segments + (i < (distance + 1) % segments) for i in range(segments)]
    plan, shift = [], 0
    for width, share in zip(widths, shares, strict=True):
        if share:
            plan.append((shift, width, share - 1))
        shift += width
    return plan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of the given distinct fingerprints that differ in at most `distance` bits.

    `segments` defaults to 64 / log2(number of fingerprints), from 2 to `distance + 1`, so that a table has about
    one fingerprint per value. It changes the work, never the pairs.
    """
    if segments is None:
        count = max(2, distinct.count())
        segments = min(distance + 1, max(2, round(BITS / math.log2(count))))
    own, balls = [], []
    for number, (shift, width, radius) in enumerate(segment_plan(distance, segments)):
        mask = F.lit(_signed(((1 << width) - 1) << shift))
        own.append(F.struct(F.lit(number).alias("segment"), F.lit(0).cast("long").alias("flip"), mask.alias("mask")))
        for size in range(radius + 1):
            for bits in combinations(range(shift, shift + width), size):
                flip = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
                balls.append(F.struct(F.lit(number).alias("segment"), flip.alias("flip"), mask.alias("mask")))

    def keyed(structs: list, name: str) -> DataFrame:
        rows = distinct.select(F.col("fingerprint").alias(name), F.explode(F.array(*structs)).alias("s"))
        value = F.col(name).bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip"))
        return rows.select(name, F.col("s.segment").alias("segment"), value.alias("value"))

    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    probes, table = keyed(balls, "a"), keyed(own, "b")
    same = (probes["segment"] == table["segment"]) & (probes["value"] == table["value"])
    return probes.join(table, same & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row of `docs` (doc_id, text; other columns are not read).

    Documents are linked if their fingerprints differ in at most `distance` bits; `component_id` is the smallest
    doc_id that can be reached over links, the document's own included. Texts without words have fingerprint 0 and
    are linked like any other. Repeated rows get equal rows. A row without doc_id is linked too but names no
    component: where no other row is reached, component_id is null. An empty table gives an empty table.
    """
    marked = written(fingerprints(docs, shingle))
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    place = written(components(near_links(nodes.select("fingerprint"), distance, segments)))
    rooted = nodes.join(place, nodes["fingerprint"] == place["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = written(rooted.join(least, "root").select(F.col("fingerprint").alias("mark"), "component_id"))
    return marked.join(named, marked["fingerprint"] == named["mark"], "left").select(
        "doc_id", "fingerprint", "component_id"
    )
