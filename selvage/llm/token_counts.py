"""Operator 9: exact histogram of encoded lengths.

Documents are encoded whole; only (length, count) pairs leave a batch, so any context limit,
quantile or truncated total is answered from one row per distinct length, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import running_before
from selvage.llm.tokenizer import DEFAULT_VOCABULARY, encoding
from selvage.session import cut

#: Lengths that share a task of the suffix sum.
SPAN = 1024


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs), written, so that readers do not encode again.

    Null and empty texts have length 0; very long texts are encoded whole; repeated rows count as often
    as they occur; other columns, whatever their names, are ignored; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for t in batches:
            n, c = np.unique([len(enc.encode_ordinary(x)) if x else 0 for x in t.column(0).to_pylist()], return_counts=True)
            yield pa.record_batch({"n_tokens": pa.array(n, pa.int64()), "n": pa.array(c, pa.int64())})

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "n_tokens bigint, n bigint")
    return cut(found.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Answers for every context limit ``n_tokens`` that occurs as a length.

    docs_at_least, tokens_at_least: documents of that length or more and their tokens;
    truncated_total: tokens when each document is cut there; docs_up_to: rank for quantiles.
    """
    rows = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("__b", -F.floor(F.col("n_tokens") / SPAN))
    rows = running_before(rows.withColumn("__k", F.lit(0)), ["__k"], "__b", [F.col("n_tokens").desc()], "n_docs", "longer_docs")
    rows = running_before(rows, ["__k"], "__b", [F.col("n_tokens").desc()], "tokens", "longer_tokens")
    total = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    more = F.col("longer_docs") + F.col("n_docs")
    return rows.select(
        "n_tokens", "n_docs", more.alias("docs_at_least"), (F.col("longer_tokens") + F.col("tokens")).alias("tokens_at_least"),
        (F.col("docs") - F.col("longer_docs")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("longer_tokens") + F.col("longer_docs") * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, total: tokens when each document is cut at ``limit``, which need not occur as a length."""
    kept = F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_tokens") * F.col("n_docs")).otherwise(F.lit(limit) * F.col("n_docs")))
    return sums.agg(F.coalesce(kept, F.lit(0)).cast("long").alias("total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that ``q`` of the documents do not exceed."""
    most = sums.agg(F.max("docs_up_to").alias("m"))
    return sums.crossJoin(F.broadcast(most)).where(F.col("docs_up_to") >= F.greatest(F.ceil(F.col("m") * q), F.lit(1))).agg(F.min("n_tokens").alias("n_tokens"))
