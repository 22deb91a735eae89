"""Corpus preparation as a chain of stages; each stage is written as Parquet and read again.

Defined results, at every stage: null texts are empty texts, which the classifier scores at
the label's share and the rules reject; columns beyond those of documents are carried
along; of rows that repeat an id the deduplication keeps one, rows with a null id all stay;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import jaccard_join, packing, quality_classifier, quality_rules, secret_scan
from lattica.llm.common import materialize, read_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts."""
    voter = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, voter, keep_columns=True)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_rules(docs, keep_columns=True)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked ones."""
    found = jaccard_join.jaccard_components(docs)
    first = materialize(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows")), "first")
    kept = docs.join(first.where("rows = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = first.where("rows > 1").select("doc_id")
    if not repeated.isEmpty():  # only their texts are shuffled again
        kept = kept.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("jaccard_join", deduplicate),
    ("secret_scan", redact),
    ("packing", pack),
]

#: No stage but the base of the rules can be told in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
