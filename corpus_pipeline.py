"""A training corpus from raw documents: toxicity, exact dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame with the columns of documents; the last returns the packed
pieces. The driver writes a stage's rows as Parquet and hands the next stage what it reads back; run() does the same
in the shared folder. No stage can be put as SQL (a learned score, fingerprints and a packing plan), so ORACLE_SQL is
None and tests/llm hold the stages against brute force.

Every stage reads whole texts and takes rows as they come: null and empty texts are texts without words, null ids come
after all others, null languages and sources are names of their own, repeated rows are rows of their own until a dedup
stage drops them, no rows give no rows, and further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import exact_dedup, mixing, packing, shingle_dedup, toxicity
from meridian.llm.common import stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; the model is fitted on the labelled rows among docs. Without evidence every row stays."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row of the smallest id."""
    return exact_dedup.keep_first(docs)


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of similarity 0.8 or more join, five words to a shingle, the row of the smallest id. Candidates are
    the links of operator 7's tree over five-word fingerprints and, for those that lie further apart, bands of MinHashes."""
    return shingle_dedup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the budgets of a domain-language-source tree; a row appears once for each epoch it is taken."""
    return mixing.keep_mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its place in a sequence; documents without text have one end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
