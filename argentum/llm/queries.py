"""Queries over the driver's tables: one thin function for each operator of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from argentum.llm import alignment, audio, byte_bpe, conversations, fm_dedup, lbl, neardup, oracles, packing, repair, suffix_dedup, syncmers, token_counts, toxicity
from argentum.llm.session import documents, ship


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without those covered by a 100-byte string that starts earlier."""
    return suffix_dedup.suffix_array_dedup(documents(spark, sf_dir), length=100, digest=True)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as Re-Pair shards and read back."""
    path = repair.target(spark)
    repair.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return repair.read_ids(spark, path)


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a log-bilinear model learned from nine tenths of them."""
    return lbl.score_documents(documents(spark, sf_dir))


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without those in 13-word windows of an earlier document."""
    return fm_dedup.fm_dedup(documents(spark, sf_dir), window=13, digest=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and the texts decoded from them."""
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all documents."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as audio, read back, with digests and features."""
    return audio.audio_features(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for all documents."""
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.with_edited(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits of all conversations after damage."""
    rows = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.repair(conversations.damage(rows), live="live", copies="copies")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens of all documents."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by two tokenizers, aligned by their bytes, with corpus-wide counts of linked pairs."""
    return alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_ids, op3_log_bilinear, op4_fm_index, op5_byte_bpe, op6_best_fit, op7_near_duplicates, op8_audio_features, op9_toxicity, op10_syncmers, op11_conversation_repair, op12_token_counts, op13_token_alignment)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": oracles.SUFFIX_DEDUP, "op4_fm_index": oracles.FM_DEDUP, "op7_near_duplicates": oracles.NEAR_DUPLICATES, "op11_conversation_repair": oracles.REPAIR}
