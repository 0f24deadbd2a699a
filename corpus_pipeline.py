"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept. The first four return the
columns of ``documents``, whatever their names; the last returns the placed pieces.
Of what the first three write on the way, only ids and verdicts stay.

Cases: null and empty texts have no words, so the quality rules reject them; where a later
stage meets them they count as empty. A row without doc_id is judged as any other by its text.
Repeated rows get equal verdicts, and rows that share a doc_id stay or go together in the
classifier and near-duplicate stages. Very long texts are worked on whole. An empty table
gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import packing, partenum, quality, rules, secrets
from corpuslens.llm.common import materialise, read, settled, unused


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``; texts stream past a hash table of ids."""
    keep = unused("__keep", docs.columns)
    own = ids.select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(own.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(own[keep])).drop(keep)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without lines that are frequent in their host.

    Near duplicates count as one document there: else a family of copies would make its own
    lines frequent and be rejected whole before a later stage can keep one of it.
    """
    return rules.apply(docs, families=settled(lambda: partenum.link(docs).select("doc_id", "component_id"), "families"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return _only(docs, settled(lambda: quality.classify(docs, read(spark, sf_dir, "labels")).filter("predicted = 1").select("doc_id"), "good"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return _only(docs, settled(lambda: partenum.link(docs).filter("doc_id <=> component_id").select("doc_id"), "firsts"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", sequence_packing),
]

#: A trained classifier has no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
