"""Corpus pipeline: toxicity, language ID, near-dedup, decontamination, packing.

Each stage works on all documents its predecessor kept.  ``run`` writes every
stage to the shared folder and reads it again, so a lost executor never costs
more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapline.llm import containment, language_mixture, lsh_forest, packing, toxic_segments
from tapline.llm.queries import vocabulary
from tapline.llm.scratch import documents, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxic_segments.accepted(docs, toxic_segments.train(docs, documents(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language has three tenths, go."""
    train = docs.where(language_mixture.fold_of(docs["doc_id"], 4) != 2)
    return language_mixture.accepted(docs, language_mixture.train(train))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return lsh_forest.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.clean(docs, documents(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
