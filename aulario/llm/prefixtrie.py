"""The trie of conversation prefixes: one node for each distinct sequence of first turns.

A turn is identified by a digest of its role and text. Blocks of BLOCK consecutive turns are rows with one column a
position, and a Spark SQL ROLLUP over these columns gathers all prefixes at once; grouping_id tells the depth. Turns
beyond a block continue in a row of the next block, and the key of that row is the node in which the block before it
ends: rows of one block only meet if all earlier turns are the same too. These keys are found for all blocks together by
doubling: a block's digest takes in the 1, 2, 4, ... blocks before it, in as many rounds as the number of blocks has
bits.

What a node says of the nodes below it follows from its members. Let a conversation own the nodes whose smallest member
it is; they are the deepest ones of its path, from some depth o on. Then a node at depth d has

* as many children as members that own a node at depth d + 1 of their path,
* as many leaves below it as members that own a leaf,
* as characters saved below it, those that its members share with smaller members from depth d on.

A first ROLLUP finds the owners and a second one adds these up, so no level of the trie waits for another. All groups
are combined inside map tasks, a long conversation is many rows, and no list of members is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.llm.work import written

#: Turns of a block, and so positional columns.
BLOCK = 8
#: Members whose ids are joined before they are hashed.
PIECE = 1 << 16


def _digest(*parts: Column) -> Column:
    """16 bytes of SHA-256 of binary columns."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _root() -> Column:
    return F.lit(b"")


def turn_id(role: str = "role", text: str = "text") -> Column:
    """A digest of role and text; their lengths keep them apart."""
    size = F.concat(F.octet_length(role).cast("string"), F.lit(":"))
    return _digest(F.concat(size, F.col(role), F.col(text)).cast("binary"))


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation of a sorted partition, from 0."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(ids)))
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        if last == ids[0]:
            place[: sizes[0]] += count
        last, count = ids[-1], int(place[-1]) + 1
        parts = pa.array(np.full(len(ids), part, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(place)], [*batch.schema.names, "part", "place"])


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, place, turn_id, chars), and conversations as (conv_id, n_turns).

    `turns`: conv_id long, turn, role, text. Places count from 0 by turn, null first; equal turns stand by role and
    text, and repeated rows are turns of their own. A null role or text is empty; rows without a conv_id are left out.
    Turns are sorted in ranges, so a conversation with a third of all rows lies in many tasks.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    short = ranged.select("conv_id", turn_id().alias("turn_id"), F.char_length("text").cast("long").alias("chars"))
    placed = written(
        short.mapInArrow(_local_places, "conv_id long, turn_id binary, chars long, part int, place long")
    )
    runs = written(placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.count("*").alias("parts"))
    convs = written(convs)
    # at most one conversation reaches over each bound between two partitions
    over = runs.join(convs.where("parts > 1").select("conv_id"), "conv_id", "left_semi")
    earlier = over.alias("a").join(
        over.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.part") > F.col("b.part"))
    )
    moved = earlier.groupBy("a.conv_id", "a.part").agg(F.sum("b.n").alias("before"))
    place = F.col("place") + F.coalesce("before", F.lit(0))
    found = placed.join(written(moved), ["conv_id", "part"], "left")
    return found.select("conv_id", place.alias("place"), "turn_id", "chars"), convs.select("conv_id", "n_turns")


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, t array, c array): the turn ids and characters of each block of a conversation.

    A conversation without turns has an empty first block.
    """
    cell = F.struct("place", "turn_id", "chars")
    own = (
        turns.groupBy("conv_id", F.call_function("div", F.col("place"), F.lit(BLOCK)).alias("block"))
        .agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # at most BLOCK of them
        .select("conv_id", "block", F.col("cells.turn_id").alias("t"), F.col("cells.chars").alias("c"))
    )
    empty = convs.where("n_turns = 0").select(
        "conv_id",
        F.lit(0).cast("long").alias("block"),
        F.array().cast("array<binary>").alias("t"),
        F.array().cast("array<bigint>").alias("c"),
    )
    return own.unionByName(empty)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _keyed(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """Blocks with `prior`, the node before them, `full`, the node a whole block ends in, and `before`, characters."""
    joined = F.concat(*[F.get("t", F.lit(i)) for i in range(BLOCK)])  # null unless the block is whole
    blocks = blocks.withColumn("own", _digest(joined))
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    if longest <= BLOCK:
        return blocks.select(
            "*", _root().alias("prior"), F.col("own").alias("full"), F.lit(0).cast("long").alias("before")
        ).drop("own")
    long_ones = written(convs.where(F.col("n_turns") > BLOCK).select("conv_id"))
    reach = blocks.where("own is not null").join(long_ones, "conv_id", "left_semi")
    reach = written(reach.select("conv_id", "block", F.col("own").alias("node"), _sum(F.col("c")).alias("sum")))
    step = 1
    while step * BLOCK < longest:
        back = reach.select(
            "conv_id", (F.col("block") + step).alias("block"), F.col("node").alias("node_"), F.col("sum").alias("sum_")
        )
        wider = F.when(F.col("node_").isNull(), F.col("node")).otherwise(_digest(F.col("node_"), F.col("node")))
        total = F.col("sum") + F.coalesce("sum_", F.lit(0))
        reach = reach.join(back, ["conv_id", "block"], "left")
        reach = written(reach.select("conv_id", "block", wider.alias("node"), total.alias("sum")))
        step *= 2
    prior = reach.select("conv_id", (F.col("block") + 1).alias("block"), F.col("node").alias("prior"), "sum")
    full = reach.select("conv_id", "block", F.col("node").alias("full"))
    found = blocks.join(prior, ["conv_id", "block"], "left").join(full, ["conv_id", "block"], "left")
    return found.select(
        "conv_id",
        "block",
        "t",
        "c",
        F.coalesce("prior", _root()).alias("prior"),
        F.coalesce("full", "own").alias("full"),
        F.coalesce("sum", F.lit(0)).alias("before"),
    )


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """Every prefix (block, prior, t0, ..., full, depth, in_block) with the aggregates `sums`."""
    turns = [f"t{i}" for i in range(BLOCK)]
    wide = blocks.select("*", *[F.get("t", F.lit(i)).alias(name) for i, name in enumerate(turns)])
    # `full` follows from the columns before it
    levels = ", ".join([*turns[:-1], f"({turns[-1]}, full)"])
    found = blocks.sparkSession.sql(
        f"SELECT block, prior, {', '.join(turns)}, full, bit_count(grouping_id()) AS rolled, {sums} "
        f"FROM {{wide}} GROUP BY block, prior, ROLLUP({levels})",
        wide=wide,
    )
    depth = F.when(F.col("rolled") == 0, BLOCK).otherwise(BLOCK + 1 - F.col("rolled"))
    last = F.element_at(F.array(*turns), F.greatest(depth, F.lit(1)))
    # a prefix that ends before its last column is that of a shorter conversation; a block's start is a node of the last
    inside = ((depth > 0) & last.isNotNull()) | ((depth == 0) & (F.col("block") == 0))
    return found.withColumn("in_block", depth).where(inside).withColumn("depth", F.col("block") * BLOCK + F.col("in_block"))


def _node(prior: Column, turns: list[Column], length: Column, full: Column) -> Column:
    """The key of the node after so many turns of a block."""
    key = F.when(length == 0, prior).when(length == BLOCK, full)
    for n in range(1, BLOCK):
        key = key.when(length == n, _digest(F.lit(b"/"), prior, *turns[:n]))
    return key


@dataclass(frozen=True)
class Trie:
    """`nodes`: (node binary, parent binary, conv_id, depth, n_convs, n_children, n_leaves, saved_chars), conv_id being
    the smallest member; `ends`: (node, conv_id), the node in which each conversation ends."""

    nodes: DataFrame
    ends: DataFrame

    def with_parents(self) -> DataFrame:
        """Nodes with `parent_conv_id`, the smallest member of the parent; null for the root."""
        above = self.nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        return self.nodes.join(above, "parent", "left")


def build_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of turns (conv_id, place, turn_id, chars) of the conversations (conv_id, n_turns).

    Each conv_id stands once in `convs`, and its places are 0 to n_turns - 1; one without turns is a member of the root
    alone. Without conversations there are no nodes.
    """
    blocks = written(_keyed(_blocks(turns, convs), convs).join(convs, "conv_id"))
    first = _rolled(blocks, "min(conv_id) AS owner, max(n_turns) AS longest")
    owned = first.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("owns_from"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf")
    )
    owned = written(owned)
    blocks = blocks.join(owned, "conv_id", "left").withColumn(
        "owns_from", F.coalesce("owns_from", F.col("n_turns") + 1)
    )
    # characters of the turns before the first node it owns: at most those of a block that lies wholly after it
    shared = F.greatest(F.lit(0), F.least(F.lit(BLOCK), F.col("owns_from") - 1 - F.col("block") * BLOCK)).cast("int")
    blocks = written(blocks.withColumn("shared", F.col("before") + _sum(F.slice("c", 1, shared))))
    reached = F.when(F.col("block") * BLOCK <= F.col("owns_from") - 1, F.col("shared")).otherwise(0)
    by_conv = written(blocks.groupBy("conv_id").agg(F.max(reached).alias("shared")))
    blocks = blocks.drop("shared").join(by_conv, "conv_id")

    def own(depth: int) -> Column:
        """Whether a node at this depth of the block is on the path of the conversation, which owns it."""
        at = F.col("block") * BLOCK + depth
        return ((F.col("owns_from") <= at) & (at <= F.col("n_turns"))).cast("long")

    rows = blocks.select(
        "conv_id",
        "block",
        "prior",
        "full",
        "t",
        F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        F.col("shared").alias("saved0"),
        own(1).alias("next0"),
        *[
            F.greatest(
                F.lit(0).cast("long"), F.col("shared") - F.col("before") - _sum(F.slice("c", 1, d - 1))
            ).alias(f"saved{d}")
            for d in range(1, BLOCK + 1)
        ],
        *[own(d + 1).alias(f"next{d}") for d in range(1, BLOCK + 1)],
    )
    sums = ["count(*) AS n_convs", "min(conv_id) AS conv_id", "sum(leaf) AS n_leaves"]
    sums += [f"sum({name}{d}) AS {name}{d}" for name in ("saved", "next") for d in range(BLOCK + 1)]
    found = _rolled(rows, ", ".join(sums))
    turns_ = [F.col(f"t{i}") for i in range(BLOCK)]
    at = F.col("in_block")

    def chosen(name: str) -> Column:
        return F.element_at(F.array(*[f"{name}{d}" for d in range(BLOCK + 1)]), at + 1)

    nodes = written(
        found.select(
            _node(F.col("prior"), turns_, at, F.col("full")).alias("node"),
            F.when(F.col("depth") > 0, _node(F.col("prior"), turns_, at - 1, F.col("full"))).alias("parent"),
            "conv_id",
            "depth",
            "n_convs",
            chosen("next").alias("n_children"),
            "n_leaves",
            chosen("saved").alias("saved_chars"),
        )
    )
    last = F.col("block") == F.greatest(F.lit(0), F.call_function("div", F.col("n_turns") - 1, F.lit(BLOCK)))
    cells = [F.get("t", F.lit(i)) for i in range(BLOCK)]
    ends = blocks.where(last).select(
        _node(F.col("prior"), cells, F.size("t"), F.col("full")).alias("node"), "conv_id"
    )
    return Trie(nodes, ends)


def prefix_trie(turns: DataFrame) -> Trie:
    """The trie of all conversations of `turns` (conv_id, turn, role, text), as `numbered_turns` reads them."""
    return build_trie(*numbered_turns(turns))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members of a node as text, at most PIECE ids each."""
    part, number = TaskContext.get().partitionId(), 0
    held_node, held = None, []

    def piece() -> pa.RecordBatch:
        nonlocal number
        number += 1
        row = [[held_node], [part], [number], [",".join(map(str, held))]]
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(row, kinds)], ["node", "part", "number", "ids"]
        )

    for batch in batches:
        for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (node != held_node or len(held) == PIECE):
                yield piece()
                held.clear()
            held_node = node
            held.append(conv_id)
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, one after the other."""

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())],
            ["node", "ends_sha256"],
        )

    open_node, state = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == open_node:
                state.update(b",")
            else:
                if state is not None:
                    done.append((open_node, state.hexdigest()))
                open_node, state = node, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield rows(done)
    if state is not None:
        yield rows([(open_node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids that end in each node.

    Members are sorted in ranges, those of a crowded node in many tasks; what meets in one task for each node is text in
    pieces, hashed as it is read.
    """
    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "node binary, part int, number long, ids string")
    together = pieces.repartition("node").sortWithinPartitions("node", "part", "number")
    return together.select("node", "ids").mapInArrow(_hashes, "node binary, ends_sha256 string")


def with_shared_starts(turns: DataFrame, convs: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that neighbours share their first turns.

    Conversation c takes the first h turns of conversation c - c % every (all if it has fewer, none if it is absent) and
    then its own turns after its first h; h is the unsigned CRC-32 of c in decimals, modulo `most`. Takes and returns
    the tables of `numbered_turns`.
    """
    own = F.col("conv_id")
    start = F.crc32(own.cast("string").cast("binary")) % most
    first = F.sort_array(F.collect_list(F.struct("place", "turn_id", "chars")))  # fewer than `most` turns
    heads = turns.where((own % every == 0) & (F.col("place") < most - 1)).groupBy(own.alias("base")).agg(first.alias("head"))
    joined = convs.select("conv_id", "n_turns", (own - own % every).alias("base"), start.alias("h")).join(
        written(heads), "base", "left"
    )
    taken = F.when(F.col("head").isNull(), 0).otherwise(F.least(F.col("h"), F.size("head"))).cast("int")
    joined = written(joined.select("conv_id", "n_turns", "h", "head", taken.alias("taken")))
    left = F.greatest(F.lit(0).cast("long"), F.col("n_turns") - F.col("h"))
    rebuilt = joined.select("conv_id", (F.col("taken") + left).alias("n_turns"))
    copied = joined.where("taken > 0").select("conv_id", F.inline(F.slice("head", 1, F.col("taken"))))
    rest = turns.join(joined.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id", "chars")
    return copied.unionByName(rest), rebuilt
