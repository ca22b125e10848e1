r"""Chat formatting of conversations whose turns have typed content parts.

A part is text or an attachment (image, audio, document). A visitor flattens the parts of a turn in order: a text is
escaped, an attachment becomes a placeholder, and its reference, its place and the number of tokens that it expands to
are recorded. A turn is written as

    <turn>role<|says|>content</turn>

and a line feed. Control strings are <turn>, </turn> and whatever begins with <|. In roles and texts a backslash is
doubled and the < of a control string becomes \l, so no control string is left inside, a formatted conversation can be
cut at control strings alone, and the escape is undone exactly.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "<turn>", "<|says|>", "</turn>\n"
CONTROLS = ("<turn>", "</turn>", "<|")
#: Placeholders, and tokens for each unit of an attachment: patches of an image, seconds of audio, pages of a document.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TOKENS_PER_UNIT = {"image": 1, "audio": 25, "document": 600}

PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("\\l" + c[1:])), CONTROLS, text)


def unescape(text: Column) -> Column:
    """Undo `escape`: pairs of backslashes are found from the left, what lies between them has only marks \\l."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def text_parts(text: Column) -> Column:
    """A single text part."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("ref"), null.alias("units"))
    return F.array(part).cast(PARTS)


def _by_type(kind: Column, values: dict, other: Column) -> Column:
    return reduce(lambda c, v: F.when(kind == v, F.lit(values[v])).otherwise(c), values, other)


def _joined_texts(parts: Column) -> Column:
    """Neighbouring text parts as one, so that a control string that lies across them is seen as a whole."""
    is_text = lambda p: F.coalesce(~p["type"].isin(*PLACEHOLDERS), F.lit(True))
    text = lambda p: F.coalesce(p["text"], F.lit(""))

    def added(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.array(last.withField("text", F.concat(text(last), text(part)))).cast(PARTS)
        follows = F.coalesce((F.size(done) > 0) & is_text(last) & is_text(part), F.lit(False))
        return F.when(follows, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), both)).otherwise(
            F.concat(done, F.array(part).cast(PARTS))
        )

    return F.aggregate(parts, F.array().cast(PARTS), added)


def visited(parts: Column) -> tuple[Column, Column]:
    """The flattened content of a turn, and its attachments (type, ref, at: place in the content, tokens) in order."""
    parts = _joined_texts(F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(PARTS)))
    pieces = F.transform(parts, lambda p: _by_type(p["type"], PLACEHOLDERS, escape(p["text"])))
    attached = F.transform(
        parts,
        lambda p, i: F.struct(
            p["type"].alias("type"),
            p["ref"].alias("ref"),
            F.char_length(F.array_join(F.slice(pieces, F.lit(1), i), "")).cast("long").alias("at"),
            (F.coalesce(p["units"], F.lit(0)) * _by_type(p["type"], TOKENS_PER_UNIT, F.lit(0)))
            .cast("long")
            .alias("tokens"),
        ),
    )
    return F.array_join(pieces, ""), F.filter(attached, lambda a: a["type"].isin(*PLACEHOLDERS))


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens) of every conversation.

    `turns` has conv_id, turn, role and parts (as PARTS); other columns are not read. Turns are in the order of
    `turn`, then role and content; repeated rows are turns of their own. `loss_spans` are (start, length) in characters
    of `formatted`, from 0: the contents of the trained role's turns. `attachments` are (turn: number from 0,
    type, ref, at: place in `formatted`, tokens), with the sum of their tokens in `attachment_tokens`.

    A null role or text is empty; null parts have no content; a part of unknown type counts as text. Rows without conv_id
    belong to no conversation; a null turn comes first. An empty table gives an empty table. A conversation is one
    value, so its turns meet in one task; different conversations do not.
    """
    content, attached = visited(F.col("parts"))
    role = escape(F.col("role"))
    rows = turns.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        content.alias("content"),
        attached.alias("attached"),
        (F.coalesce("role", F.lit("")) == trained_role).alias("trained"),
    )
    piece = F.concat(F.lit(OPEN), F.col("role"), F.lit(SAYS), F.col("content"), F.lit(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    lead = F.coalesce(
        F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = (
        rows.withColumn("piece", piece)
        .withColumn("number", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("start", (lead + F.char_length("role") + len(OPEN) + len(SAYS)).cast("long"))
    )
    span = F.struct("start", F.char_length("content").cast("long").alias("length"))
    found = F.transform(
        "attached",
        lambda a: F.struct(
            F.col("number").alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"),
            (F.col("start") + a["at"]).alias("at"), a["tokens"].alias("tokens"),
        ),
    )
    whole = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
        F.flatten(F.collect_list(found)).alias("found"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join("pieces.piece", "").alias("formatted"),
        "loss_spans",
        F.array_sort("found", lambda a, b: _compared(a, b)).alias("attachments"),
        F.aggregate("found", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def _compared(a: Column, b: Column) -> Column:
    return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, content as written)."""
    pieces = F.split(formatted, CLOSE)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, SAYS, 1).substr(len(OPEN) + 1, 1 << 30)).alias("role"),
            t.substr(F.instr(t, SAYS) + len(SAYS), F.lit(1 << 30)).alias("content"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )
