"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality weight`` from a hash of its id, so heavier
documents tend to come first and every run draws the same.  Within a source documents are taken in
key order up to the source's token budget: whole epochs first, then the fraction that is left, found
by a prefix sum in two levels (:func:`selvage.llm.common.running_before`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.llm.common import running_before, text_key, unit, whole_ids, word_count
from selvage.session import cut

#: Rows of a source that share a task of the prefix sum, at least.
SPAN = 256


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, rows, target) from (source, size) rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; no
    target exceeds ``most`` times its source, the excess going to the others by weight until none is
    above.  That fixes a level with ``target = min(most * size, level * weight)``: sources are sorted
    by ``most * size / weight`` and the level is read off prefix sums over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    choice = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", choice).withColumn("cap", (F.col("source_size") * most).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(all_)
    return per.withColumn("target", F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "rows", "target")


#: What :func:`mixed` adds; columns of these names in its input are replaced.
ADDED = ("source_size", "target", "repeats", "taken")


def mixed(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """Adds source_size, target, repeats and taken to rows of (doc_id, source, size, quality, ...).

    ``quality`` weighs the draw (null: 1; not positive: after all others).  A document is taken
    ``repeats`` times, at most ``most``: the complete epochs of its source, and once more if most of it
    lies before the rest of the budget in key order.  So a source misses its target by half a document
    at most.  Ties in the key fall to doc_id, then size; equal rows are interchangeable.  Null ids draw
    by their whole row.  Null sources are a source of their own.  Further columns, whatever their names,
    are kept, but for those of ``ADDED``, which are replaced.  An empty table gives no rows.
    """
    keep = [c for c in sized.columns if c not in ADDED]
    row = F.struct(*(F.col(f"`{c}`") for c in keep))
    weight = F.coalesce(F.col("quality").cast("double"), F.lit(1.0))
    draw = unit(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(row).cast("string")), F.lit(seed))
    rows = sized.select(
        row.alias("row"), F.col("doc_id").alias("id"), "source", "size", (weight <= 0).alias("last"),
        F.when(weight > 0, -F.log(draw) / weight).otherwise(-F.log(draw)).alias("key"), F.when(weight > 0, weight).alias("weight"),
    )
    rows = cut(rows, "mix")
    per = targets(rows, weights, most)
    typical = rows.groupBy("source").agg(F.coalesce(F.avg("weight"), F.lit(1.0)).alias("typical"))
    per = per.join(typical.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "its_source")
    per = cut(per, "targets")  # a row a source; both sides of the prefix sum read it, and neither plans or runs it again
    rows = rows.drop("weight").join(per, rows.source.eqNullSafe(F.col("its_source"))).drop("its_source")
    # slices that rise with the key, of about equal numbers of rows; those of no weight follow
    slices = F.ceil(F.col("rows") / F.greatest(F.lit(float(SPAN)), F.sqrt("rows")))
    slice_ = F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.when(F.col("last"), 1.0).otherwise(F.col("typical")))) * slices)
    rows = rows.withColumn("slice", (slice_ + F.when(F.col("last"), slices + 1).otherwise(0)).cast("long")).drop("rows", "typical")
    rows = running_before(rows, ["source"], "slice", ["last", "key", "id", "size"], "size", "start")
    again = (F.col("size") > 0) & (2 * F.col("start") + F.col("size") <= 2 * F.col("rest"))
    repeats = F.col("epochs") + again.cast("long")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in keep), "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 for documents labelled good and not toxic, 0.5 for the others that are labelled."""
    good: Column = (F.coalesce("quality", F.lit(0)) >= 1) & (F.coalesce("toxic", F.lit(0)) < 1)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.when(F.min(good.cast("int")) == 1, 2.0).otherwise(0.5).alias("quality"))


def sized_documents(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, quality, *keep): size is the number of words, null text has none."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    return rows.join(label_quality(labels), "doc_id", "left").select("doc_id", "source", "size", F.coalesce("quality", F.lit(1.0)).alias("quality"), *keep)


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The documents of the mix: the rows and columns of ``docs`` (doc_id, text, source, ...) that are taken,
    with size, source_size, target, repeats and taken (:func:`mixed`), which replace columns of these names.

    Sums run over sizes only; the text is attached to what is taken by one join.
    """
    added = ("size", *ADDED)
    keep = [c for c in docs.columns if c not in added]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    narrow = docs.select(whole_ids(docs, "doc_id").alias("doc_id"), "source", "text", *text_key(docs))
    names = narrow.columns[3:]
    taken = mixed(sized_documents(narrow, labels, names), weights, most).where("repeats > 0").select(*names, *added)
    one = docs.select(*text_key(docs), row).groupBy(*names).agg(F.first("row").alias("row"))  # repeated rows are alike
    return taken.join(one, names).select(*(F.col("row").getField(c).alias(c) for c in keep), *added)
