"""Queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm import chat, classifier, decontaminate, mixing, near_dup, quality_rules, substring_dedup, suffix_tree, token_counts, url_filter
from selvage.llm.oracles import ORACLES
from selvage.tables import table

__all__ = ["ORACLES", "QUERIES"]

#: Rules of the URL query (fixed values).
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Conversation -1 says this in both turns (fixed value).
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items that they leak."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets reach Jaccard 0.8."""
    return near_dup.near_duplicates(table(spark, sf, "documents"))


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is taken when sources weigh 5, 2, 1; labelled quality weighs the draw."""
    sized = mixing.sized_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op4_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    """Base and suffix-tree log10 probability of every document."""
    return suffix_tree.scored(table(spark, sf, "documents"))


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measures, base rules and the weakly supervised verdict of every document."""
    found = quality_rules.judged(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every page by rules and by redirect equivalence."""
    return url_filter.judged(table(spark, sf, "pages"), URL_RULES)


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words left of each document when repeats of 20 words or more go."""
    return substring_dedup.repeated_spans(table(spark, sf, "documents"))


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation formatted to tokens and read back, and conversation -1, which is made of control strings."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    made = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(turns.unionByName(made))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of encoded lengths with the answers for every context limit."""
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf, "documents")))


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = table(spark, sf, "documents")
    return classifier.rated(docs, classifier.trained(docs, table(spark, sf, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_ngram_jaccard, op3_mixing, op4_lm_score, op5_quality_rules, op6_url_filter, op7_substring_dedup, op8_chat_format, op9_token_counts, op10_quality_classifier)
}
