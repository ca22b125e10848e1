"""Removal of boilerplate lines that are spread over many sites.

The spread of a line is the number of distinct sites it occurs on. Each line hash gets a HyperLogLog sketch of its sites;
sketches are built inside map tasks and merged by aggregation, so a line that occurs everywhere reaches its reducer as
one sketch per task. Lines whose estimate lies near the threshold get an exact distinct count. Of a line that is spread
enough, the first occurrence stays and all others go, so no content is lost altogether.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aulario.llm.work import unused, written

#: Binary logarithm of the number of registers of a sketch.
SKETCH_BITS = 10
#: An estimate is off by less than this share of the true count (three standard errors).
MARGIN = 3 * 1.04 / (1 << SKETCH_BITS) ** 0.5


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """(owner, pos, site, h1, h2) of every line that is not blank; h1 and h2 are independent hashes of the trimmed line."""
    lines = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("owner"), F.col(site).alias("site"), F.posexplode(split_lines(F.col("text")))
    )
    line = F.trim("col")
    return lines.where(line != "").select("owner", "pos", "site", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of the lines on at least `min_sites` distinct sites; `first` is the first (owner, pos).

    Null sites do not count. The result is exact: sketches only spare the exact count of lines far from the threshold.
    """
    spread = written(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"),
            F.min(F.struct("owner", "pos")).alias("first"),
        )
        .where(F.col("sites") >= min_sites * (1 - MARGIN) - 1)
    )
    clear = spread.where(F.col("sites") > min_sites * (1 + MARGIN) + 1)
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN) + 1)
    asked = near.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    exact = (
        lines.join(asked, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count_distinct("site").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    return clear.select("h1", "h2", "first").union(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def _cleaned(docs: DataFrame, min_sites: int, site: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """`docs` with the marks of its lines, and of them the marks, the new text, the number of lines and of those left."""
    owner_, flags_ = unused(docs.columns, "_owner", "_flags")
    lines = written(line_table(docs.select("doc_id", "text", site), site))
    spread = written(widespread(lines, min_sites))
    repeated = spread.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), "first")
    marked = lines.join(repeated, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).where(
        F.struct("owner", "pos") != F.col("first")
    )
    # positions of a document as text flags, so that a line finds its flag by place
    gone = marked.groupBy("owner").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    ends = F.transform("gone", lambda p, i: p - F.when(i > 0, F.element_at("gone", i)).otherwise(-1))
    flags = F.array_join(F.transform(ends, lambda gap: F.concat(F.repeat(F.lit("k"), gap - 1), F.lit("g"))), "")
    flagged = gone.select(F.col("owner").alias(owner_), F.encode(flags, "US-ASCII").alias(flags_))
    all_lines = split_lines(docs["text"])
    kept = F.filter(all_lines, lambda _, i: F.coalesce(F.substring(flags_, i + 1, 1) != F.lit(b"g"), F.lit(True)))
    both = docs.join(flagged, docs["doc_id"] == F.col(owner_), "left")
    marks = F.col(flags_)
    text = F.when(marks.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    size = F.greatest(F.size(all_lines), F.lit(0)).cast("long")
    left = F.when(marks.isNull(), size).otherwise(F.size(kept).cast("long"))
    return both, marks, text, size, left


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """The rows of `docs` (doc_id, text, a site column, any others) with boilerplate lines taken out of the text.

    Adds `n_lines` and `n_removed` (long); columns of these names are replaced. A line is boilerplate if the same line,
    but for spaces at its ends, is on at least `min_sites` distinct sites; its first occurrence (least doc_id, then
    position) stays. Blank lines are never boilerplate. Other lines and their order are unchanged.

    A null text has no lines and stays null; an empty text has one blank line. doc_id names a document: of rows with
    one doc_id all lose a line that any of them is to lose at that position. Rows without doc_id stay as they are and
    do not count. An empty table gives an empty table.
    """
    both, _, text, size, left = _cleaned(docs, min_sites, site)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [text.alias("text") if c == "text" else docs[f"`{c}`"] for c in kept]
    return both.select(*columns, size.alias("n_lines"), (size - left).alias("n_removed"))


def without_boilerplate(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """As `remove_boilerplate`, with just the columns of `docs`; `n_chars`, if there, follows the text."""
    both, marks, text, _, _ = _cleaned(docs, min_sites, site)
    chars = F.char_length(text).cast("long")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(marks.isNull(), docs["n_chars"]).otherwise(chars)
    return both.select(*[new[c].alias(c) if c in new else docs[f"`{c}`"] for c in docs.columns])
