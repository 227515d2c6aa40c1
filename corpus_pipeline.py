"""Corpus cleaning in stages; each is written as Parquet and read again as the next one's documents.

Each stage keeps all columns of its documents, null ones too, and judges whole texts. Null and empty texts fail the quality rules,
as texts of too few words do; rows without an id pass the two stages that compare documents, which key their work by id. Of
equal or nearly equal documents the smallest id stays, repeated rows of one id count as one document. Without labels
nothing is toxic; an empty table gives no rows. Columns beside those of documents may have any names and pass until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import jaccard, quality, queries, substrings, toxicity
from vigil.llm.session import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity grammar rejects."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep."""
    return quality.kept(docs, quality.references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier leave the text; every document stays."""
    return substrings.removed_from(docs, n_chars="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens in the sources' own proportions."""
    return queries.packed_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack),
]

#: The stages learn weights and walk text, which SQL cannot express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
