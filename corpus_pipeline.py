"""Corpus pipeline: quality classifier, near duplicates, benchmark decontamination, personal data, packing.

In every stage null text counts as empty, rows of null doc_id are rows like others (near duplicates: always kept), an empty
table gives an empty table, texts are taken whole however long, and other columns pass through whatever their names. Rows that
repeat a doc_id are judged each on its own text, but by the second stage, where a doc_id is one document: its rows stay or go
together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import near_dups, packing, pii, quality, tiling
from emberfield.llm.common import materialize, table
from emberfield.llm.queries import BPE, digest_pieces


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble rejects; null text counts as empty."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8 or more); texts without words stay."""
    return near_dups.drop_near_duplicates(docs, pct=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; ties at the coverage go; null items match nothing."""
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; null text stays null."""
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; null or empty text is its closing id."""
    return digest_pieces(packing.pack(docs, public_tokenizers.path(BPE)))


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: No SQL expresses the trained classifier, the field or the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
