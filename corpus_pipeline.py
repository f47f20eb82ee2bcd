"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next
one's documents. Every stage but the last returns the columns of documents. Nulls, empty texts, repeated
rows and empty tables are treated as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verso.llm import exact_dedup, mixing, packing, quality_rules, simhash
from verso.llm.common import documents, scratch, staged


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, that with the smallest doc_id."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", drop_poor),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the robust estimates, tokens or plans of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; the result of the last."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as used:
            docs = staged(stage(spark, docs, sf_dir), name)
            after = used.pop()  # the stage's own output stays until the next one is written
            used += [before] if before else []
            before = after
    return docs
