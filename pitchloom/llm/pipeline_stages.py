"""Stages of the corpus pipeline; all but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table.
Null texts count as empty and stay null. Repeated rows stay repeated, but for those with an id of their
own in a group of near-duplicates, of which the smallest id stays. Columns beside those of documents are carried,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom.llm import mixing, packing, pii_bootstrap, simhash, toxicity
from pitchloom.llm.common import table

# Words whose ids a packing worker of the pipeline keeps, about 25 MB.
CACHE_WORDS = 150_000


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model, fitted on labels that are not held out, does not reject."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    # A name that no column has.
    name = "_" + max(docs.columns, key=len)
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.representatives(docs)


def redact_personal_data(spark, docs, sf_dir):
    """All documents, with personal data replaced by its kind."""
    return pii_bootstrap.redact(docs)


def mix_sources(spark, docs, sf_dir):
    """All documents in the order of the mixture, small sources once for each of their passes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of all documents in training sequences. Workers that served the other stages keep few words."""
    return packing.pack(docs, cache_words=CACHE_WORDS)
