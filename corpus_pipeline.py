"""A corpus pipeline: from raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.llm import decontamination, lines, sentencepiece, simhash, toxicity
from aulario.llm.queries import learned_labels, table
from aulario.llm.work import written

TOXIC_FROM = 0.7
BOILERPLATE_SITES = 10
SHINGLE_WORDS, MOST_BITS = 4, 4
BENCHMARK_WINDOW = 10


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; the classifier learns from the labels of these documents.

    A null or empty text scores like a text without features. Repeated rows score alike and stay or go together. Without
    labels of both classes every score is the share of toxic labels; an empty table stays empty.
    """
    model = toxicity.train(docs, learned_labels(table(spark, sf_dir, "labels"), "toxic", 1, 3))
    return toxicity.without_toxic(docs, model, TOXIC_FROM)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that BOILERPLATE_SITES sources share, but for a line's first occurrence.

    A null text stays null, an empty one empty; null sources do not count; rows without an id stay as they are. Repeated
    rows lose the same lines. `n_chars` follows the text. An empty table stays empty.
    """
    return lines.without_boilerplate(docs, min_sites=BOILERPLATE_SITES)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Null, empty and blank texts have one fingerprint and are copies of each other. Rows without an id stay; repeated rows
    are one document and stay or go together. An empty table stays empty.
    """
    found = simhash.near_duplicates(docs, shingle=SHINGLE_WORDS, distance=MOST_BITS)
    copies = written(found.where("component_id < doc_id").select(F.col("doc_id").alias("copy_id")))
    return docs.join(copies, docs["doc_id"] == copies["copy_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    A null or empty text has no words and stays, and so do all documents where the benchmark is empty. Repeated rows
    stay or go together.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), BENCHMARK_WINDOW)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; a null or empty text has the end id alone."""
    import public_tokenizers

    found = sentencepiece.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL expresses neither the trained classifier, nor fingerprints, nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
