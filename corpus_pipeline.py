"""The corpus pipeline: each stage reads what the one before it wrote and returns a DataFrame.

``STAGES`` lists (name, function of (spark, docs, sf_dir)).  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm import classifier, decontaminate, mixing, near_dup, substring_dedup
from selvage.session import cut
from selvage.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose probability of the best grade is below one half go."""
    return classifier.accepted(docs, classifier.trained(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near-duplicates one row stays, that of the smallest id; documents without words stay."""
    return near_dup.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages of 20 words or more stay where they come first; texts that lose every word go."""
    out = substring_dedup.deduplicated(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that leak a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents of the mix, with how often each is taken; those not taken go."""
    found = mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))
    added = ("size", *mixing.ADDED)
    return found.select(*(c for c in docs.columns if c not in added), *added)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mix", mix),
]

#: Several stages (hashed regression, sampling) have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
