"""The corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the shared
folder and reads it again as the next one's documents.  All stages but the last return the columns of ``docs``,
whatever they are and whatever their names; a text that changes takes its ``n_chars`` with it.  Every stage takes texts whole, however long,
and gives an empty table, with the columns it would have, for an empty one.

Line dedup comes before the n-gram join, as the order is given: it takes the lines that near copies share out of all but the first, so
some pairs that were similar before no longer are when the join reads them.  What they shared is gone all the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, linededup, ngramjoin, packing
from quillon.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it is fitted on the labels of ``docs`` themselves.

    Null and empty texts, and texts without a letter, go; null labels don't train; repeated rows are judged alike; of equal scores the language that
    sorts first wins; without any label all documents go.
    """
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; those left with no line, copies of others, go.

    The first occurrence is that of the lowest doc_id, null ids last, then of the lowest line; rows equal in id and text are the same occurrence and
    keep the same lines.  Blank lines stay; null and empty texts stay as they are.
    """
    out = linededup.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the lowest doc_id, of each group that similar pairs connect.

    Rows without doc_id, without text or without a word stay; of rows equal in id and text one stays; rows of one doc_id whose texts differ are
    documents of their own, and of equal ids the lower hash of the text stays.
    """
    return ngramjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts, and null ids, stay; repeated rows are judged alike; items without a word are in no document.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are documents of the end mark alone; ties on the curve go by id (nulls first), length and a hash of the text, and rows equal in all of
    these lie side by side.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Naive Bayes over hashed n-grams and the Hilbert order have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
