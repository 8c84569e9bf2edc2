"""The registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm import alignment, decontaminate, embeddings, packing, prefix_trie, quality, repeats, secrets, sentence_pieces, sharding, simhash, token_counts, toxicity
from tallyline.llm.common import read

TOKEN_LIMIT = 1024
SHARDS = 16
SEQUENCE_TOKENS = 2048


def vocabulary(name: str) -> str:
    """The folder of vocabulary files is a setting; the installed package is the default."""
    folder = os.environ.get("TALLYLINE_TOKENIZERS")
    return f"{folder}/{name}" if folder else str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_prefixes(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_bytes")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(n).alias(f"n_{kind}") for n, kind in enumerate(secrets.KINDS)],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Hosts are sources; the sections of a source are its languages.
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"), borrowed=True)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), SEQUENCE_TOKENS)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.scored(aligned.withColumn("groups_sha256", digest).drop("groups"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_secret_scans,
        op3_embedding_duplicates,
        op4_toxicity,
        op5_decontamination,
        op6_repeats,
        op7_sentence_pieces,
        op8_simhash,
        op9_quality,
        op10_sharding,
        op11_prefix_trie,
        op12_packing,
        op13_alignment,
    )
}

ORACLE_SQL: dict[str, str] = {}
