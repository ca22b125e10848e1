"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aulario.llm import (
    chat,
    decontamination,
    filteraudit,
    lines,
    prefixtrie,
    quality,
    sentencepiece,
    sharding,
    simhash,
    substrings,
    tokenfiles,
    topk,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), scale=1024)
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated_passages(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def held_out(rest: int, by: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by == rest


def learned_labels(labels: DataFrame, column: str, rest: int, by: int) -> DataFrame:
    return labels.where(~held_out(rest, by)).select("doc_id", F.col(column).alias("label"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, learned_labels(table(spark, sf_dir, "labels"), "toxic", 1, 3))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    found = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    read = chat.read_turns(F.col("formatted"))
    texts = F.array_join(
        F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), chat.unescape(t["content"]), F.lit("\n"))), ""
    )
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return found.select(
        "conv_id",
        F.size(read).cast("long").alias("n_turns"),
        digest(texts).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    found = sharding.shard_documents(docs.withColumn("text_crc32", checksum), shards=8)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.positional_index(table(spark, sf_dir, "documents"))
    found = decontamination.find_items(index, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = lines.remove_boilerplate(docs, min_sites=10)
    return found.select("doc_id", "n_lines", "n_removed", digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepiece.round_trip(table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, learned_labels(table(spark, sf_dir, "labels"), "quality", 0, 5))
    return quality.score(docs, model).select(
        "doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefixtrie.numbered_turns(table(spark, sf_dir, "conversations"))
    trie = prefixtrie.build_trie(*prefixtrie.with_shared_starts(turns, convs))
    found = trie.with_parents().join(prefixtrie.end_digests(trie.ends), "node", "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved_chars").alias("saved_tokens"),
        F.coalesce("ends_sha256", digest(F.lit(""))).alias("ends_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_exact_top_k,
        op2_substring_dedup,
        op3_toxicity,
        op4_chat_formatting,
        op5_simhash_near_dedup,
        op6_sharding,
        op7_benchmark_decontamination,
        op8_line_dedup,
        op9_sentencepiece,
        op10_quality_classifier,
        op11_prefix_trie,
        op12_filter_audit,
        op13_token_files,
    ]
    return {f.__name__: f for f in found}
