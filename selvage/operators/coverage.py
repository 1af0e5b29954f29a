"""Coverage of blocks by citations, verdicts, outline checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.text import percent, src_ids


def citations(sections: DataFrame, section: str = "section", md: str = "md") -> DataFrame:
    """Distinct (section, block) cited in src comments."""
    return sections.select(section, F.explode(src_ids(F.col(md))).alias("block")).distinct()


#: Bytes of blocks that are broadcast at a time.
SHARD_BYTES = 32 << 20


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """J1 over running text: distinct ids of items (id, item) that occur in some row of texts (text).

    The texts stream past a broadcast of the items; items beyond ``SHARD_BYTES`` by the optimizer's
    estimate go in several shards, one pass each, so what is broadcast stays bounded.
    """
    size = int(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(1, -(-min(size, 1 << 40) // SHARD_BYTES))
    out = None
    for s in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == s)
        hit = texts.join(F.broadcast(part), F.contains("text", "item")).select("id").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


def flagged(blocks: DataFrame, cited: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Blocks that count (no admin), with ``covered``, ``verdict`` and ``note``.

    A block is covered if any citation names it, or if its verdict is duplicate or admin; uncovered
    blocks without a verdict are 'unknown'.  The last verdict of a block wins (W20).
    """
    hit = cited.select(F.col("block").alias("id")).distinct().withColumn("cited", F.lit(True))
    rows = blocks.where("type <> 'admin'").join(hit, "id", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    if verdicts is None:
        return rows.withColumns({"covered": F.col("cited"), "verdict": F.when(~F.col("cited"), "unknown"), "note": F.when(~F.col("cited"), "")}).drop("cited")
    last = verdicts.groupBy("block").agg(F.max_by(F.struct("verdict", "note"), "ord").alias("v")).select(F.col("block").alias("id"), "v")
    rows = rows.join(last, "id", "left").withColumn("verdict", F.when(~F.col("cited"), F.coalesce("v.verdict", F.lit("unknown"))))
    return rows.withColumns({"covered": F.col("cited") | F.coalesce(F.col("verdict").isin("duplicate", "admin"), F.lit(False)), "note": F.when(~F.col("cited"), F.coalesce("v.note", F.lit("")))}).drop("cited", "v")


def report(blocks: DataFrame, rows: DataFrame, source: str = "source") -> DataFrame:
    """Total, covered, ratio and percent per source, and a grand total with a null source.

    Sources that have only admin blocks appear with zeros; an empty total has ratio 1.
    """
    all_ = blocks.select(source).distinct()
    n = all_.join(rows.select(source, "id", "covered"), source, "left")
    total, covered = F.count("id"), F.count_if(F.col("covered"))
    agg = n.rollup(source).agg(total.alias("total"), covered.alias("covered"))
    return agg.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("covered") / F.col("total"), 4))).withColumn("percent", percent(F.col("covered"), F.col("total")))


def uncovered(rows: DataFrame, most: int = 500) -> DataFrame:
    """L2: listed blocks by verdict rank (missing, unknown, duplicate, admin), source and number; a top-k report."""
    rank = F.when(F.col("verdict") == "missing", 0).when(F.col("verdict") == "duplicate", 2).when(F.col("verdict") == "admin", 3).otherwise(1)
    number = F.regexp_extract("id", r"b(\d+)$", 1).cast("long")
    return rows.where(F.col("verdict").isNotNull()).select("id", "source", "verdict", "note", rank.alias("rank"), number.alias("n")).orderBy("rank", "source", "n", "id").limit(most)


def histogram(rows: DataFrame) -> DataFrame:
    """Listed blocks by verdict, and whether they still need work."""
    need = F.col("verdict").isin("unknown", "missing")
    return rows.where(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(need).alias("open"))


def problems(blocks: DataFrame, assignments: DataFrame, unassigned: DataFrame) -> DataFrame:
    """(kind, item) of placement rules: unknown, duplicate, missing, both, reason."""
    ids, placed, left = blocks.select(F.col("id").alias("block")), assignments.select("block", "section"), unassigned.select("block", "reason")
    every = placed.select("block").union(left.select("block"))
    kind = lambda d, k: d.select(F.lit(k).alias("kind"), F.col("block").alias("item"))
    out = kind(every.distinct().join(ids, "block", "left_anti"), "unknown")
    out = out.union(kind(placed.groupBy("block").count().where("count > 1"), "duplicate"))
    out = out.union(kind(blocks.where("type <> 'admin'").select(F.col("id").alias("block")).join(every, "block", "left_anti"), "missing"))
    out = out.union(kind(left.select("block").distinct().join(placed, "block", "left_semi"), "both"))
    return out.union(kind(left.where("trim(coalesce(reason, '')) = ''").distinct(), "reason"))


def structure_problems(sections: DataFrame, assignments: DataFrame) -> DataFrame:
    """A5: (rule, id) of outline structure: ids, titles, levels, parents, and blocks only at leaves."""
    s, top = sections, sections.where("level = 1").select(F.col("id").alias("parent")).distinct()
    rule = lambda d, r: d.select(F.lit(r).alias("rule"), "id")
    out = rule(s.groupBy("id").count().where("count > 1"), "repeated id")
    out = out.union(rule(s.where(~F.rlike("id", F.lit(r"^s[0-9]{2,}(-[0-9]{2,})?$"))), "bad id"))
    out = out.union(rule(s.where("trim(coalesce(title, '')) = ''"), "empty title"))
    out = out.union(rule(s.where("level = 1 AND (contains(id, '-') OR parent IS NOT NULL)"), "chapter form"))
    second = s.where("level = 2")
    out = out.union(rule(second.where("parent IS NULL"), "no parent")).union(rule(second.where("parent IS NOT NULL").join(top, "parent", "left_anti"), "unknown parent"))
    out = out.union(rule(second.where("parent IS NOT NULL AND NOT startswith(id, concat(parent, '-'))"), "parent prefix"))
    out = out.union(rule(s.where("level NOT IN (1, 2)"), "level"))
    busy = second.select(F.col("parent").alias("id")).distinct().join(assignments.select(F.col("section").alias("id")), "id", "left_semi")
    return out.union(rule(busy, "blocks above leaves"))


def normalised(sections: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sections without empty leaves and then without empty chapters; two passes suffice on two levels."""
    full = assignments.select(F.col("section").alias("id")).distinct()
    leaves = sections.where("level = 2").join(full, "id", "left_semi")
    parents = leaves.select(F.col("parent").alias("id")).distinct()
    chapters = sections.where("level = 1").join(full.union(parents).distinct(), "id", "left_semi")
    order = Window.orderBy("chapter", "level", "ord")
    both = chapters.withColumn("chapter", F.col("id")).unionByName(leaves.withColumn("chapter", F.col("parent")))
    return both.withColumn("place", F.row_number().over(order)).drop("chapter")


def repaired(blocks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments to known blocks, the first of each block."""
    known = assignments.join(blocks.select(F.col("id").alias("block")), "block", "left_semi")
    return known.groupBy("block").agg(F.min_by("section", "ord").alias("section"), F.min("ord").alias("ord"))


def autofill_limit(n: str | Column) -> Column:
    """max(5, ceil(3 %)), the product rounded to 6 digits first."""
    return F.greatest(F.lit(5), F.ceil(F.round(F.lit(0.03) * (F.col(n) if isinstance(n, str) else n), 6))).cast("long")


def autofill(blocks: DataFrame) -> DataFrame:
    """Places missing blocks beside their nearest placed neighbour, in order, each placement visible to the next.

    ``blocks``: (source, pos, id, section, missing).  Sequential by nature: one fold over the array of
    a source, in the JVM.  Ties go to the previous neighbour; a source without placements stays null.
    """
    rows = F.sort_array(F.collect_list(F.struct("pos", "id", "section", "missing")))
    per = blocks.groupBy("source").agg(rows.alias("rows"))
    # nearest section behind each row among the original placements
    back = F.expr("""aggregate(reverse(rows), cast(array() AS array<struct<p:int,s:string>>),
        (a, r) -> concat(array(CASE WHEN r.section IS NOT NULL THEN named_struct('p', r.pos, 's', r.section)
                                    WHEN size(a) > 0 THEN a[0] ELSE named_struct('p', cast(NULL AS int), 's', cast(NULL AS string)) END), a))""")
    fold = F.expr("""aggregate(arrays_zip(rows, next), named_struct('p', cast(NULL AS int), 's', cast(NULL AS string), 'out', cast(array() AS array<struct<id:string,section:string>>)),
        (a, z) -> CASE
          WHEN z.rows.section IS NOT NULL THEN named_struct('p', z.rows.pos, 's', z.rows.section, 'out', a.out)
          WHEN NOT z.rows.missing THEN a
          WHEN a.s IS NOT NULL AND (z.next.s IS NULL OR z.rows.pos - a.p <= z.next.p - z.rows.pos)
            THEN named_struct('p', z.rows.pos, 's', a.s, 'out', array_append(a.out, named_struct('id', z.rows.id, 'section', a.s)))
          WHEN z.next.s IS NOT NULL
            THEN named_struct('p', z.rows.pos, 's', z.next.s, 'out', array_append(a.out, named_struct('id', z.rows.id, 'section', z.next.s)))
          ELSE a END)""")
    return per.withColumn("next", back).select("source", F.explode(fold["out"]).alias("x")).select("source", "x.id", "x.section")


def neighbours(blocks: DataFrame, inside: DataFrame, most: int = 24) -> DataFrame:
    """The blocks just before and after each run of a section, not inside it, ``most`` a section."""
    w = Window.partitionBy("source").orderBy("pos")
    rows = blocks.withColumns({"before": F.lag("id").over(w), "after": F.lead("id").over(w)})
    own = inside.select("section", F.col("block").alias("id"))
    near = rows.join(own, "id").select("section", "pos", F.explode(F.array("before", "after")).alias("id")).where("id IS NOT NULL")
    near = near.join(own, ["section", "id"], "left_anti").groupBy("section", "id").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy("pos", "id"))
    return near.withColumn("n", rank).where(F.col("n") <= most).select("section", "id", "n")


def targets(rows: DataFrame) -> DataFrame:
    """Coalesce of the candidates in order: verdict's section, its first child, own assignment, nearest, last."""
    return rows.withColumn("target", F.coalesce("verdict_section", "child_section", "own_section", "nearest_section", "last_section"))


def lost(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Keys that were there and are not any more."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def same_set(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """One row: keys only before, only after, in both, and whether the sets are equal."""
    one = before.select(key).distinct().withColumn("a", F.lit(1)).join(after.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    agg = one.agg(F.count_if(F.col("b").isNull()).alias("only_before"), F.count_if(F.col("a").isNull()).alias("only_after"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    return agg.withColumn("equal", (F.col("only_before") == 0) & (F.col("only_after") == 0))


def preserved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, problem) of sections between outlines (id, ord, title, level, parent): removed, changed, moved."""
    o, n = (d.select("id", F.struct("title", "level", "parent").alias(a), F.col("ord").alias(f"{a}_ord")) for d, a in ((old, "o"), (new, "n")))
    j = o.join(n, "id", "full")
    common = j.where("o IS NOT NULL AND n IS NOT NULL")
    rank = common.withColumns({"r1": F.row_number().over(Window.orderBy("o_ord")), "r2": F.row_number().over(Window.orderBy("n_ord"))})
    out = j.where("n IS NULL").select("id", F.lit("removed").alias("problem"))
    out = out.union(common.where("NOT o <=> n").select("id", F.lit("changed")))
    return out.union(rank.where("r1 <> r2").select("id", F.lit("moved")))


def without_admin(blocks: DataFrame) -> DataFrame:
    """Blocks that count: all but those of type 'admin'; a block without a type counts."""
    return blocks.where(F.coalesce(F.col("type") != "admin", F.lit(True)))


def section_sizes(assigned: DataFrame, blocks: DataFrame, text: str = "text") -> DataFrame:
    """(section, size): characters of the blocks (id, text) of each section (section, block)."""
    return assigned.join(blocks.select(F.col("id").alias("block"), text), "block").groupBy("section").agg(F.sum(F.length(text)).alias("size"))
