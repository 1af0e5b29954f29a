"""Packing of consecutive items into bounded groups.

A group closes by what it already holds, so the state resets along the way: one fold per key over an
ordered array, evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_groups(sizes: Column, most: int, count: int | None = None) -> Column:
    """Group number of each size: a group closes before the count or ``most`` would be passed; an oversize item is alone."""
    full = (lambda a: a.n >= count) if count else (lambda a: F.lit(False))

    def step(a: Column, z: Column) -> Column:
        close = (a.n > 0) & (full(a) | (a.z + z > most) | (a.z > most))
        g = a.g + close.cast("int")
        return F.struct(g.alias("g"), F.when(close, 1).otherwise(a.n + 1).alias("n"), F.when(close, z).otherwise(a.z + z).alias("z"), F.array_append(a.out, g).alias("out"))

    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("z"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), zero, step)["out"]


def packed(items: DataFrame, keys: list[str], order: str, size: str, most: int = 60_000, count: int | None = 4, extra: int = 0) -> DataFrame:
    """(keys, order, size, group) of consecutive items of each key; ``extra`` is added to each size."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), (F.col(size).cast("long") + extra).alias("z"))))
    per = items.groupBy(*keys).agg(rows.alias("rows"))
    per = per.withColumn("g", packed_groups(F.transform("rows", lambda r: r.z), most, count))
    out = per.select(*keys, F.explode(F.arrays_zip("rows", "g")).alias("x"))
    return out.select(*keys, F.col("x.rows.o").alias(order), (F.col("x.rows.z") - extra).alias(size), F.col("x.g").alias("group"))


def fixed_batches(items: DataFrame, keys: list[str], order: str, each: int) -> DataFrame:
    """Batches of ``each`` consecutive items."""
    w = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn("batch", F.floor((F.row_number().over(w) - 1) / each).cast("long"))


def numbered(rows: DataFrame, bucket: Column, order: str | Column, out: str) -> DataFrame:
    """Row numbers from 1 in order; ``bucket`` must rise with it.  One row a bucket is summed in one task, rows are numbered inside their bucket."""
    rows = rows.withColumn("__b", bucket)
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(order))
    return rows.join(sizes, F.col("__b").eqNullSafe(F.col("__c"))).withColumn(out, F.col("__before") + inside).drop("__b", "__c", "__before")


#: Positions that share a task when intervals are laid side by side.
SPAN = 1024


def islands(rows: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Adds ``island``: the least ``first`` of the run of transitively overlapping intervals [first, last].

    A running maximum in two levels: one row for each ``SPAN`` positions meets in one task.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__b", F.floor(F.col(first) / SPAN))
    inside = Window.partitionBy("__b").orderBy(first, last)

    def reach(rows: DataFrame, value: Column, out: str, own: bool) -> DataFrame:
        """Maximum of ``value`` over the rows before (``own``: and this one)."""
        rows = rows.withColumn("__v", value)
        tops = rows.groupBy(F.col("__b").alias("__c")).agg(F.max("__v").alias("__m"))
        tops = tops.select("__c", F.max("__m").over(before(Window.orderBy("__c"))).alias("__top"))
        here = inside.rowsBetween(Window.unboundedPreceding, 0) if own else before(inside)
        return rows.withColumn("__in", F.max("__v").over(here)).join(tops, F.col("__b") == F.col("__c")).withColumn(out, F.greatest("__in", "__top")).drop("__v", "__in", "__c", "__top")

    rows = reach(rows, F.col(last), "__reached", False)
    starts = F.when(F.col("__reached").isNull() | (F.col(first) > F.col("__reached")), F.col(first))
    return reach(rows, starts, "island", True).drop("__b", "__reached")


def kept_groups(items: DataFrame, previous: DataFrame, most: int = 60_000, count: int = 4) -> DataFrame:
    """(grp, first, last, n, z) of previous groups that stay: members known, contiguous in the same order, within the limits.

    ``items``: (id, pos, size); ``previous``: (grp, ord, id), grp a number.  In the order of grp a group stays if no
    member belongs to one that stays already; rejected groups claim nothing.  Groups that overlap, directly or
    through others, are decided together, by a fold over the few of their run.
    """
    m = previous.join(items, "id", "left")
    w = Window.partitionBy("grp").orderBy("ord")
    m = m.withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    g = m.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("known"), F.sum("size").alias("z"), F.min(F.coalesce("gap", F.lit(1))).alias("lo"), F.max(F.coalesce("gap", F.lit(1))).alias("hi"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    fit = (F.col("known") == F.col("n")) & (F.col("n") <= count) & (F.col("lo") == 1) & (F.col("hi") == 1) & ((F.col("n") == 1) | (F.col("z") <= most))
    g = islands(g.where(fit).select("grp", "first", "last", "n", "z"))
    run = g.groupBy("island").agg(F.sort_array(F.collect_list(F.struct("grp", "first", "last", "n", "z"))).alias("run"))
    none = F.slice("run", 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["first"] <= x["last"]) & (x["first"] <= k["last"]))
    kept = F.aggregate("run", none, lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    return run.select(F.inline(kept))


def chunk_cuts(starts: Column, duration: Column, pauses: Column, low: float = 360, high: float = 660, aim: float = 540, radius: float = 60) -> Column:
    """Cut times of a recording.

    From the last cut, while more than ``high`` is left: the section start in [last + low, min(last + high,
    duration - radius)] nearest to last + aim, the earlier on ties; without one the start behind the
    longest pause within ``radius`` of the aim (``pauses``: array of struct(gap, start)), or the aim itself.
    """

    def cut(last: Column) -> Column:
        goal = last + aim
        near = F.filter(starts, lambda s: (s >= last + low) & (s <= F.least(last + high, duration - radius)))
        best = F.element_at(F.array_sort(F.transform(near, lambda s: F.struct(F.abs(s - goal).alias("d"), s.alias("s")))), 1)["s"]
        quiet = F.filter(pauses, lambda p: F.abs(p.start - goal) <= radius)
        longest = F.element_at(F.array_sort(F.transform(quiet, lambda p: F.struct((-p.gap).alias("d"), p.start.alias("s")))), 1)["s"]
        return F.coalesce(F.when(F.size(near) > 0, best), F.when(F.size(quiet) > 0, longest), goal)

    def step(a: Column, _: Column) -> Column:
        nxt = cut(a.last)
        go = ~a.done & (duration - a.last > high) & (nxt > a.last + 1)
        return F.struct(F.when(go, nxt).otherwise(a.last).alias("last"), (~go).alias("done"), F.when(go, F.array_append(a.out, nxt)).otherwise(a.out).alias("out"))

    zero = F.struct(F.lit(0.0).alias("last"), F.lit(False).alias("done"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.greatest(duration, F.lit(1)) / low).cast("int")), zero, step)["out"]
