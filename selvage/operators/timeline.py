"""Speech segments on a time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions.text import srt_time

#: Fixed pattern: credits that a recogniser makes up.
JUNK = r"(?iu)(субтитры|редактор субтитров|корректор|subtitles by|thanks for watching|amara\.org)"


def normal(c: Column) -> Column:
    """Lower case, runs of what is neither letter nor digit as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " "))


def delooped(segments: DataFrame, key: str, order: str, text: str, junk: str = JUNK) -> DataFrame:
    """Without empty segments, short credits, and the third and later of equal neighbours.

    Empty and junk segments do not break a run.
    """
    rows = segments.withColumn("__n", normal(F.col(text)))
    rows = rows.where((F.col("__n") != "") & ~((F.length(text) < 90) & F.rlike(text, F.lit(junk))))
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("__new", F.when(F.col("__n") == F.lag("__n").over(w), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)))
    return rows.where("__k <= 2").drop("__n", "__new", "__run", "__k")


def paragraphs(segments: DataFrame, key: str, gap: float = 2.0, chars: int = 600) -> DataFrame:
    """(key, start, text): a new paragraph after a gap, or after ``chars`` characters that end a sentence.

    The count resets with each paragraph, so each recording is one fold in the JVM.
    """
    seg = F.sort_array(F.collect_list(F.struct("start", "end", "text")))

    def step(a: Column, s: Column) -> Column:
        new = (F.size(a.out) == 0) | (s.start - a.end >= gap) | ((a.n >= chars) & F.rlike(F.element_at(a.out, -1)["text"], F.lit(r"[.?!…]\s*$")))
        last = F.element_at(a.out, -1)
        joined = F.struct(last["start"].alias("start"), F.concat(last["text"], F.lit(" "), s.text).alias("text"))
        grown = F.concat(F.slice(a.out, 1, F.greatest(F.size(a.out) - 1, F.lit(0))), F.array(joined))
        out = F.when(new, F.array_append(a.out, F.struct(s.start.alias("start"), s.text.alias("text")))).otherwise(grown)
        return F.struct(s.end.alias("end"), F.when(new, F.length(s.text)).otherwise(a.n + F.length(s.text)).alias("n"), out.alias("out"))

    zero = F.struct(F.lit(0.0).alias("end"), F.lit(0).alias("n"), F.array().cast("array<struct<start:double,text:string>>").alias("out"))
    per = segments.groupBy(key).agg(seg.alias("s")).withColumn("p", F.aggregate("s", zero, step)["out"])
    return per.select(key, F.posexplode("p").alias("n", "x")).select(key, "n", "x.start", "x.text")


def with_ends(starts: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Intervals [start, next start), the last up to ``end``."""
    w = Window.partitionBy(key).orderBy(start)
    return starts.withColumn("end", F.coalesce(F.lead(start).over(w), end))


def sections_by_time(recordings: DataFrame, key: str, duration: str, step: float = 300.0) -> DataFrame:
    """Sections of ``step`` seconds."""
    n = F.greatest(F.ceil(F.col(duration) / step).cast("int"), F.lit(1))
    rows = recordings.select(key, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    return rows.select(key, "n", (F.col("n") * step).alias("start"), F.least((F.col("n") + 1) * step, F.greatest(F.col(duration), F.lit(0.0))).alias("end"))


def asof(rows: DataFrame, marks: DataFrame, key: str, at: str, start: str, value: str, slack: float = 1e-6) -> DataFrame:
    """Each row takes the mark of greatest start at or before it (within ``slack``), else the first mark.

    Union and one window: a sort by key and time instead of a range join, so its size is the sum of
    both sides, not their product.
    """
    m = marks.select(key, F.col(start).cast("double").alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != key))
    r = rows.select(key, (F.col(at) + slack).cast("double").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"), *(c for c in rows.columns if c != key))
    w = Window.partitionBy(key).orderBy("__t", "__side")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = m.unionByName(r)
    out = both.withColumn(value, F.coalesce(F.last("__v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("__v", True).over(whole)))
    return out.where("__side = 1").select(*rows.columns, value)


def overlapping(a: DataFrame, b: DataFrame, key: str, width: float = 300.0) -> DataFrame:
    """Pairs of intervals of a key that overlap, as (key, a_id, b_id).

    Both sides are cut into cells of ``width`` and joined on (key, cell); a pair is kept in the cell
    where the later of both starts, so each comes once.
    """
    cells = lambda d: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest("start", F.col("end") - 1e-9) / width)))
    x = a.select(key, F.col("id").alias("a_id"), F.col("start").alias("a0"), F.col("end").alias("a1"), cells(a).alias("cell"))
    y = b.select(key, F.col("id").alias("b_id"), F.col("start").alias("b0"), F.col("end").alias("b1"), cells(b).alias("cell"))
    j = x.join(y, [key, "cell"]).where("b1 > a0 AND b0 < a1").where(F.floor(F.greatest("a0", "b0") / width) == F.col("cell"))
    return j.select(key, "a_id", "b_id")


def split_words(words: DataFrame, boundaries: DataFrame, key: str, edge: float = 0.5) -> DataFrame:
    """Segments cut at boundaries that lie inside them by ``edge``; a word goes by its start.

    ``words``: (key, seg, seg_start, seg_end, start, end, text); ``boundaries``: (key, t).
    """
    seg = words.select(key, "seg", "seg_start", "seg_end").distinct()
    cut = seg.join(boundaries, key).where(f"t > seg_start + {edge} AND t < seg_end - {edge}").groupBy(key, "seg").agg(F.sort_array(F.collect_set("t")).alias("cuts"))
    rows = words.join(cut, [key, "seg"], "left").withColumn("part", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda t: t <= F.col("start"))))
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "text")))
    g = rows.groupBy(key, "seg", "part").agg(parts.alias("w"))
    return g.select(key, "seg", "part", F.col("w")[0]["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), F.array_join(F.transform("w", lambda x: x.text), " ").alias("text"), F.size("w").alias("words"))


def longest_pause(segments: DataFrame, key: str, target: float, radius: float = 60.0) -> DataFrame:
    """Start of the segment behind the longest pause within ``radius`` of the target; the first on ties.  Pauses are compared in microseconds."""
    w = Window.partitionBy(key).orderBy("start")
    rows = segments.withColumn("gap", F.round(F.col("start") - F.lag("end").over(w), 6)).where(F.col("gap").isNotNull() & (F.abs(F.col("start") - target) <= radius))
    return rows.groupBy(key).agg(F.max_by("start", F.struct("gap", (-F.col("start")).alias("s"))).alias("cut"), F.max("gap").alias("gap"))


def srt(segments: DataFrame, key: str) -> DataFrame:
    """Subtitles of each recording, cues numbered from 1."""
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "text")))
    cue = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s.start), F.lit(" --> "), srt_time(s.end), F.lit("\n"), s.text, F.lit("\n"))
    return segments.groupBy(key).agg(rows.alias("r")).select(key, F.array_join(F.transform("r", cue), "\n").alias("srt"))
