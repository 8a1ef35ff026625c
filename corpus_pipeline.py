"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, benchmark decontamination and packing.

Each stage takes what its predecessor kept, as a table. All but the last return the columns of documents, with texts as the
stages before have left them; the last returns the pieces and bins of the training sequences. Near-duplicates are told by
shingles of five words at a similarity of 0.8. Nulls, repeated rows and empty tables are defined in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vireo.llm import decontaminate, linededup, neardup, packing, quality
from vireo.llm.common import materialize, read_table

SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; a document that loses all its lines goes."""
    return linededup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs, SHINGLE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, bin and bin_offset of what is left."""
    return packing.pack(materialize(packing.packable(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the table documents, each result a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Signatures, random walks and bin search have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None
