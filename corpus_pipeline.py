"""A training corpus from raw documents: toxic ones go, near-duplicates go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argentum.llm import stages
from argentum.llm.session import cut

#: (name, function); a function takes (spark, docs, sf_dir), its result is the next one's docs.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("suffix_array_dedup", stages.drop_repeats),
    ("best_fit_packing", stages.pack),
]

#: SQL can't express a learned classifier; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
