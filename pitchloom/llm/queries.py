"""The registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pitchloom.llm import (
    byte_bpe, fill_in_middle, filter_audit, maxent_lm, mixing, packing, pii_bootstrap, repetition, secret_scan,
    simhash, subspace_join, toxicity, warc,
)
from pitchloom.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.scored_documents(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_maxent_lm(spark, sf_dir):
    return maxent_lm.scored_documents(table(spark, sf_dir, "documents"))


@query
def op6_warc_archives(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query
def op7_pack_sequences(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_repetition_rules(spark, sf_dir):
    return repetition.quality(table(spark, sf_dir, "documents"))


@query
def op9_embedding_near_dedup(spark, sf_dir):
    return subspace_join.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op10_pii_bootstrap(spark, sf_dir):
    return pii_bootstrap.report(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.AUDIT_SQL


@query
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


ORACLES["op12_fill_in_middle"] = fill_in_middle.REPORT_SQL


@query
def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.report(table(spark, sf_dir, "documents"))
