"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

    language         documents without a letter (null and empty ones, too) go, whether or not a language could be learned
    near_duplicates  of each group of near copies the document with the smallest id stays
    decontamination  documents in which a benchmark window occurs go
    secrets          secrets are masked in the texts; every document stays
    mixing           documents that the mix leaves out go; the others carry the number of times it takes them (copies)

All stages but the last return the columns of documents, whatever these are; the last one adds size, source_size, target,
copies and taken, each with as many _ behind its name as it takes to be no column of documents. Empty tables pass through
all stages. Rows that share a doc_id stay or go together; rows with a null id are never near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, language_id, mixing, parity_join, secrets
from strandline.llm.common import free_name, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = language_id.train(docs)
    if not trees.languages:  # no labels to learn from: only texts without a letter go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = free_name(docs.columns, "found")
    return docs.withColumn(found, language_id.identify(docs, trees)).where(F.col(f"{found}.lang") != language_id.UNKNOWN).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = free_name(docs.columns, "gone")
    gone = parity_join.linked_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(own))
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and the mix's own. Texts stay where they are while the mix is worked out."""
    row = free_name(docs.columns, "mixed_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(rows.select("doc_id", "text", "source", row), keep=(row,)).where("copies > 0")
    added = [F.col(c).alias(free_name(docs.columns, c)) for c in ("size", "source_size", "target", "copies", "taken")]
    return rows.join(taken.select(row, *added), row).drop(row)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("secrets", masked), ("mixing", mixed)]

#: The language model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
