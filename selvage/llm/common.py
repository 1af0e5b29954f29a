"""Expressions and small helpers of several training-data operators (all native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, as a Java regular expression.
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; null and wordless texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_ids(df: DataFrame, col: str) -> Column:
    """An id column as long.  Ids are whole numbers or null throughout; another type is refused at once, as a cast would lose ids."""
    kind = df.select(F.col(f"`{col}`")).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{col}: ids are whole numbers, not {kind.simpleString()}")
    return F.col(f"`{col}`").cast("long")


def text_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns, never null, that tell the rows of (id, text) apart: the id, whether there is none, and a hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    id_ = whole_ids(docs, id_col)
    return [F.coalesce(id_, F.lit(0)).alias("key_id"), id_.isNull().alias("key_none"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("key_text")]


def unit(*cols: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in every engine and run."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))


def running_before(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same keys that come before, added as ``out``.

    ``bucket`` must rise with the order.  Only its sums, one row a bucket, are summed in one task per
    key; rows are summed inside their bucket, so a key that holds a third of all rows is spread.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    right = sums.select(*(F.col(c).alias(f"__{c}") for c in (*keys, bucket)), "__before")
    on = F.lit(True)
    for c in (*keys, bucket):
        on &= df[c].eqNullSafe(right[f"__{c}"])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(right, on).drop(*(f"__{c}" for c in (*keys, bucket)))
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__before")
