"""Operators as stages of a pipeline: (spark, docs, sf_dir) -> DataFrame, columns of documents kept.

Null and empty texts pass the filters: an empty text's score is the intercept's, it is nobody's copy, it has no
bytes to cut, and its packed piece is the end id alone. Rows without doc_id are kept by the near-duplicate stage
and come first in the order of the others. Rows that share a doc_id are one document to the near-duplicate stage
(they stay or go together) and follow each other by text in the suffix stage. Very long texts are handled whole.
Without labels nothing is rejected. Empty tables give empty tables. Extra columns are carried by all stages but
the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import neardup, packing, suffix_dedup, toxicity
from argentum.llm.session import ship

SCORE = "_argentum_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject (score under 0.5), all columns."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), column=SCORE)
    return scored.filter(F.col(SCORE) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates, all columns."""
    ship(spark)
    gone = neardup.near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that a 100-byte string of an earlier place covers; n_chars follows the text."""
    ship(spark)
    out = suffix_dedup.suffix_array_dedup(docs, length=100)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
