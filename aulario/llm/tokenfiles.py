"""Token ids of documents in compact files.

Ids are replaced by their rank of frequency in the corpus, so the commonest 256 take one byte and the next 65,280 two.
Ranks are written in byte-aligned variable-length coding with the control bytes apart from the data: two bits a value
say how many bytes it has (1 to 4), four values share a control byte, and the data bytes follow each other without any
marks. A reader looks each control byte up in tables of lengths and offsets and takes the data bytes by place, without a
loop over values.

The files below a folder:

* `ranks`: Parquet rows (rank int, id long, n long), the commonest id first;
* `blocks`: Parquet files of rows (shard int, block int, start long, n long, doc_ids, sizes, control, data), each with
  whole documents of about BLOCK_IDS ids. Documents stand in ascending doc_id: shards by number, blocks by number inside
  a shard, documents by place inside a block. `start` counts the ids of the shard before the block.

The text is encoded twice: once to count ids, once to write them. Keeping the ids of the first pass would take more disk
than the files themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aulario.llm.bytelevel import encoder
from aulario.llm.chunks import added
from aulario.llm.texts import slices, tidy
from aulario.llm.work import shared_folder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Text that is encoded at once inside a task, in bytes; a longer text alone.
TEXT_BYTES = 4 << 20

# By control byte: bytes of each of its four values, bytes of the values before each, bytes of all four.
_LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.int8)
_OFFSETS = (np.cumsum(_LENGTHS, axis=1) - _LENGTHS).astype(np.int32)
_TOTALS = _LENGTHS.sum(axis=1, dtype=np.int32)

_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("n", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of 32-bit unsigned values; values that fill up the last control byte have no data."""
    width = 2 if not len(values) or int(values.max()) <= 0xFFFF else 4  # bytes that have to be looked at
    values = values.astype(f"<u{width}")
    extra = (values > 0xFF).astype(np.uint8)
    if width == 4:
        extra += values > 0xFFFF
        extra += values > 0xFFFFFF
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(width, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, width)[kept].tobytes()


def unpack(control, data, n: int) -> np.ndarray:
    """The first `n` values of what `pack` gave, from bytes or buffers."""
    codes = np.frombuffer(control, dtype=np.uint8)
    total = _TOTALS[codes]
    before = np.cumsum(total, dtype=np.int32 if len(data) < 1 << 30 else np.int64) - total
    places = (before[:, None] + _OFFSETS[codes]).reshape(-1)[:n]
    lengths = _LENGTHS[codes].reshape(-1)[:n]
    room = np.frombuffer(data, dtype=np.uint8)
    values = room[places].astype(np.uint32)
    longer = np.flatnonzero(lengths > 1)
    for k in range(1, 4):
        if not len(longer):
            break
        values[longer] |= room[places[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        longer = longer[lengths[longer] > k + 1]
    return values


def count_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(rank int, id long, n long) of every id of all texts and their ends; of equal counts the smaller id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                counts = added(counts, encoder(tokenizer).count(part.column(0)))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])

    ends = docs.agg(F.lit(end_id).cast("long").alias("id"), F.count("*").alias("n"))
    counts = docs.select("text").mapInArrow(tidy(run), "id long, n long").union(ends).where("n > 0")
    # as many rows as the tokenizer has ids
    total = counts.groupBy("id").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return total.select(place.cast("int").alias("rank"), "id", "n")


def _block_writer(tokenizer: str, rank_of: np.ndarray, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        ranks: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal number, start
            control, data = pack(np.concatenate(ranks))
            row = [shard, number, start, sum(sizes), [*doc_ids], [*sizes], control, data]
            number, start = number + 1, start + row[3]
            for part in (doc_ids, sizes, ranks):
                part.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], field.type) for x, field in zip(row, _BLOCK, strict=True)], schema=_BLOCK
            )

        held = 0
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, at = encoder(tokenizer).encode(part.column(1))
                own = rank_of[ids]
                for doc_id, low, high in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    doc_ids.append(doc_id)
                    sizes.append(high - low + 1)
                    ranks.append(np.append(own[low:high], rank_of[end_id]))
                    held += high - low + 1
                    if held >= BLOCK_IDS:
                        yield closed()
                        held = 0
        if sizes:
            yield closed()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Write the ids of all documents (doc_id long, text), each closed by `end_id`, in ascending doc_id.

    `tokenizer` is a file of the tokenizers library that tasks can open; special tokens are not added, and their strings
    in a text are ordinary text. A null or empty text has the end id alone. Rows without a doc_id come first, rows of
    one doc_id in the order of a hash of their texts. Other columns are ignored. An empty table gives empty files.
    A range of documents is one task's; one doc_id with many rows is divided among tasks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count_ids(docs, tokenizer, end_id).write.parquet(f"{path}/ranks")
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy()
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 0, dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = docs.repartitionByRange(*keys).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ranged.mapInArrow(
        tidy(_block_writer(tokenizer, rank_of, end_id)),
        "shard int, block int, start long, n long, doc_ids array<long>, sizes array<long>, control binary, data binary",
    )
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark, path: str, ids_type: str = "ids array<long>", digest: Callable | None = None) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids array<long>) of every document of the files.

    `start` counts the ids of all documents before it. With `digest`, a function of an array of unsigned 32-bit ids, the
    column that `ids_type` names holds what it makes of a document's ids instead.
    """
    # as many rows as the tokenizer has ids
    order = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy().astype("<u4")
    name, kind = ids_type.split(" ", 1)
    own = digest or (lambda ids: ids.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, start, n, doc_ids, sizes, control, data = (c[row] for c in batch.columns)
                shard, start, n, doc_ids = shard.as_py(), start.as_py(), n.as_py(), doc_ids.values
                ids = order[unpack(control.as_buffer(), data.as_buffer(), n)]
                sizes = sizes.values.to_numpy()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                found = [own(ids[s:e]) for s, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array([shard] * len(sizes), pa.int32()),
                        pa.array(begins + start),
                        pa.array(sizes, pa.int64()),
                        pa.array(found),
                    ],
                    ["doc_id", "shard", "place", "n_tokens", name],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    columns = ["shard", "start", "n", "doc_ids", "sizes", "control", "data"]
    found = blocks.select(*columns).mapInArrow(tidy(run), f"doc_id long, shard int, place long, n_tokens long, {name} {kind}")
    # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = found.join(shards, "shard")
    return joined.select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", name)


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long) of all documents, read back from files in the shared folder."""
    path = shared_folder(docs.sparkSession)
    write_token_files(docs, tokenizer, end_id, path)
    return read_token_files(docs.sparkSession, path, "ids_crc32 long", ids_crc32)
