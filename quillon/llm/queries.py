"""The queries of these operators, and their SQL."""

from __future__ import annotations

import uuid

from . import decontam, htmltext, langid, licenses, linededup, ngramjoin, packing, quality, tokencount, tokenids
from .common import shared_folder, table


def op1_line_dedup(spark, sf_dir):
    """Every document without the lines that occur before."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_ngram_jaccard_join(spark, sf_dir):
    """Every document with its class and its links: documents whose word 3-grams have a Jaccard similarity of 0.5 or more."""
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    """Every document's language, its posterior, and whether it is accepted."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    """The documents within the thresholds of their language and source."""
    return quality.kept(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    """The pieces of every packed sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    """Every candidate block with the template that compresses it best, and how it differs."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_token_ids(spark, sf_dir):
    """Every sequence's slot and record, shard by shard; shards and manifest stay in a new folder ``op7_token_ids/*`` of the shared one."""
    return tokenids.shards(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/op7_token_ids/{uuid.uuid4().hex}")


def op8_html_extraction(spark, sf_dir):
    """Every page's text without its site's repeated branches."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    """Every document's tokens."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark, sf_dir):
    """Every (document, benchmark item) with the item contained in the document."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_token_ids": op7_token_ids,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLE = {
    "op1_line_dedup": linededup.SQL,
    "op2_ngram_jaccard_join": ngramjoin.SQL,
    "op4_quality_rules": quality.SQL,
    "op10_benchmark_decontamination": decontam.SQL,
}
