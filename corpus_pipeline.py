"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pitchloom.llm import pipeline_stages as stages
from pitchloom.runtime import staged

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("simhash_near_dedup", stages.near_dedup),
    ("personal_data", stages.redact_personal_data),
    ("mix_sources", stages.mix_sources),
    ("pack_sequences", stages.pack_sequences),
]

# Fitted models and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage works on all rows that the one before it kept, read back from Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
