"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (hash of the text, doc_id), so equal texts stand together. Splitters between shards are found
by counting: in each round the bytes of all documents are added up between candidate boundaries, and around each
splitter's target the boundaries are drawn closer, until one lies within the tolerance. Boundaries fall between hashes
first, which leaves equal texts in one shard; only where a group of equal texts is itself too large for the tolerance is
it divided, by doc_id. Then every row knows its shard from the splitters alone, and rows are exchanged once.

Only DataFrame functions are used; the driver sees at most 4096 sums for each splitter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aulario.llm.work import unused, written

#: Bits by which a round draws the boundaries closer.
STEP = 12
#: Rows that are numbered together; a shard has as many cells as it takes.
ROWS_PER_CELL = 16384

_TOP = -(1 << 63)
_ALL = 1 << 64


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _ascending(column: Column) -> Column:
    """A long whose bits, read without sign, stand in the order of the values."""
    return column.bitwiseXOR(F.lit(_TOP))


def _unsigned(x: int) -> int:
    return (x ^ _TOP) % _ALL


def _value(u: int) -> int:
    """The long that `_ascending` makes these unsigned bits of."""
    return (u - _ALL if u >> 63 else u) ^ _TOP


def _long(u: int) -> int:
    return u - _ALL if u >> 63 else u


@dataclass(frozen=True)
class _Range:
    """Keys whose leading bits are known: of the hash alone, or of the doc_id within one hash."""

    shift: int  # bits that are still open
    prefix: int
    hash: int | None = None  # of the group that is divided

    def step(self) -> int:
        return max(0, self.shift - STEP)

    def column(self) -> Column:
        return _ascending(F.col("h") if self.hash is None else F.col("d"))

    def holds(self) -> Column:
        inside = F.lit(True)
        if self.shift < 64:
            inside = F.shiftrightunsigned(self.column(), self.shift) == F.lit(_long(self.prefix))
        return inside if self.hash is None else inside & (F.col("h") == self.hash)

    def bin(self) -> Column:
        mask = (1 << (self.shift - self.step())) - 1
        return F.shiftrightunsigned(self.column(), self.step()).bitwiseAND(F.lit(mask))

    def part(self, bin_: int) -> _Range:
        return _Range(self.step(), (self.prefix << (self.shift - self.step())) | bin_, self.hash)

    def boundary(self, after: bool) -> tuple[int, int] | None:
        """The first key (h, d) of the range, or the first after it; None: after all keys."""
        u = (self.prefix + after) << self.shift
        if self.hash is None:
            return None if u >= _ALL else (_value(u), _TOP)
        if u < _ALL:
            return self.hash, _value(u)
        up = _unsigned(self.hash) + 1
        return None if up >= _ALL else (_value(up), _TOP)


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int] | None]:
    """The first key (h, d) of each shard but the first, for rows (h, d, size) of `keys`; None: no row reaches it.

    Bytes before a splitter differ from its share by at most `tolerance` of a mean shard, or by half of one row's.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    found: list[tuple[int, int] | None] = [None] * (shards - 1)
    open_ = {i: (_Range(64, 0), 0) for i in range(shards - 1)} if total else {}
    while open_:
        ranges = list(dict.fromkeys(r for r, _ in open_.values()))
        number, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
        for i, r in enumerate(ranges):
            number = F.when(r.holds(), F.lit(i)).otherwise(number)
            bin_ = F.when(r.holds(), r.bin()).otherwise(bin_)
        sums = (
            keys.select(number.alias("range"), bin_.alias("bin"), "h", "d", "size")
            .where("range is not null")
            .groupBy("range", "bin")
            .agg(F.sum("size").alias("size"), F.min("h"), F.max("h"), F.min("d"), F.max("d"))
            .orderBy("range", "bin")
            .collect()
        )
        still: dict[int, tuple[_Range, int]] = {}
        for i, (whole, below) in open_.items():
            target, share = total * (i + 1) / shards, total / shards * tolerance
            for r in (r for r in sums if ranges[r["range"]] == whole):
                _, b, size, h, h_most, d, d_most = r
                if below + size < target:
                    below += size
                    continue
                part = whole.part(b)
                short, over = target - below, below + size - target
                if h == h_most and whole.hash is None:
                    bits = (_unsigned(d) ^ _unsigned(d_most)).bit_length()
                    finer = _Range(bits, _unsigned(d) >> bits, h) if bits else None
                else:
                    finer = part if part.shift and not (h == h_most and d == d_most) else None
                if min(short, over) > share and finer is not None:
                    still[i] = finer, below
                else:
                    found[i] = part.boundary(after=over < short)
                break
        open_ = still
    return found


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.005) -> DataFrame:
    """The rows of `docs` (doc_id long, text, any further columns) with `size`, `shard` and `slot`.

    `size` is the UTF-8 length of the text plus 1, and 1 for null. Shards 0 to shards - 1 have nearly equal sums of
    sizes: each bound is off by at most `tolerance` of a mean shard, or half of one row. Equal texts share a shard as
    far as that allows. `slot` numbers the rows of a shard from 0 without gaps. Columns of these names are replaced.
    Repeated rows have equal keys and share a shard, with slots of their own; a row without doc_id sorts first among
    equal texts. With fewer rows than shards some shards are empty; an empty table gives an empty table.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    h, d = text_hash(), F.coalesce(F.col("doc_id").cast("long"), F.lit(_TOP))
    keys = written(docs.select(h.alias("h"), d.alias("d"), size.alias("size")))
    shard = F.lit(0)
    for split in splitters(keys, shards, tolerance):
        if split is not None:
            reached = (h > split[0]) | ((h == split[0]) & (d >= split[1]))
            shard = shard + F.when(reached, 1).otherwise(0)
    cells = keys.count() // (ROWS_PER_CELL * shards) + 1
    cell = F.pmod(F.xxhash64("doc_id", h), F.lit(cells))
    names = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    own = unused([*names, "size", "shard", "slot"], "_cell", "_hash", "_place", "_of", "_at", "_n", "_before")
    cell_, hash_, place, of, at, n, before_ = own
    rows = docs.select(
        *[f"`{c}`" for c in names], size.alias("size"), shard.alias("shard"), cell.alias(cell_), h.alias(hash_)
    )
    # rows before each cell of a shard; there are shards * cells sums
    counts = written(rows.groupBy("shard", cell_).agg(F.count("*").alias(n)))
    earlier = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("shard").alias(of), F.col(cell_).alias(at), n)
    before = before.withColumn(before_, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    inside = Window.partitionBy("shard", cell_).orderBy(hash_, "doc_id")
    numbered = rows.withColumn(place, F.row_number().over(inside))
    joined = numbered.join(before, (F.col("shard") == F.col(of)) & (F.col(cell_) == F.col(at)))
    slot = (F.col(before_) + F.col(place) - 1).cast("long")
    return joined.select(*[f"`{c}`" for c in names], "size", "shard", slot.alias("slot"))
