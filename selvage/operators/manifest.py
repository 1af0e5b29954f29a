"""Build manifest: what is stale, what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drifted(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Ids whose stored key is not the current one; a missing side counts as null."""
    j = stored.select("id", F.col("key").alias("old")).join(current.select("id", F.col("key").alias("new")), "id", "full")
    return j.where("NOT old <=> new")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) of sources between builds: added, removed, changed."""
    return drifted(old, new).select("id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def duplicate_sources(sources: DataFrame) -> DataFrame:
    """(id, of) of sources equal to an earlier one by content hash or by URL key; two equi-joins, no OR join."""
    def same(key: str) -> DataFrame:
        first = sources.where(f"{key} IS NOT NULL").groupBy(key).agg(F.min_by("id", "seq").alias("of"))
        return sources.join(first, key).where("id <> of").select("id", "seq", "of")

    both = same("sha256").union(same("url_key"))
    return both.groupBy("id").agg(F.min("of").alias("of"))


def stale_stages(runs: DataFrame, current: DataFrame) -> DataFrame:
    """(stage, state): error, stale if a recorded upstream key is known to differ or the output is gone, else fresh.

    ``runs``: (stage, ok, output, upstream map); ``current``: (stage, key).
    """
    up = runs.select("stage", F.explode("upstream").alias("of", "recorded")).join(current.select(F.col("stage").alias("of"), "key"), "of", "left")
    bad = up.groupBy("stage").agg(F.bool_or(F.col("recorded").isNotNull() & F.col("key").isNotNull() & (F.col("recorded") != F.col("key"))).alias("moved"))
    j = runs.join(bad, "stage", "left")
    state = F.when(~F.col("ok"), "error").when(~F.coalesce("output", F.lit(True)) | F.coalesce("moved", F.lit(False)), "stale").otherwise("fresh")
    return j.select("stage", state.alias("state"))


def to_run(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Stages without a successful run under the current key."""
    return current.join(runs.where("ok").select("stage", "key"), ["stage", "key"], "left_anti")


def stale_variants(variants: DataFrame, master: DataFrame) -> DataFrame:
    """Variants, newest first, and whether their master changed or is gone."""
    one = master.agg(F.max("sha").alias("now"))
    out = variants.crossJoin(F.broadcast(one))  # one row
    return out.select("slug", "created", (~F.col("master_sha").eqNullSafe(F.col("now")) | F.col("now").isNull()).alias("stale")).orderBy(F.desc("created"), F.desc("slug"))


def issued_ids(used: DataFrame, new: DataFrame) -> DataFrame:
    """Ids for new sources: letter and the numbers after the greatest ever used."""
    top = used.groupBy("letter").agg(F.max("n").alias("top"))
    w = Window.partitionBy("letter").orderBy("seq")
    rows = new.join(top, "letter", "left").withColumn("n", F.coalesce("top", F.lit(0)) + F.row_number().over(w))
    return rows.withColumn("id", F.concat("letter", F.col("n").cast("string"))).drop("top")


def review_gate(stored: DataFrame, current: DataFrame, approved: bool, override: bool | None, default: bool) -> DataFrame:
    """One row: whether the gate is on, and whether it is open."""
    n = drifted(stored, current).agg(F.count(F.lit(1)).alias("changed"))
    on = default if override is None else override
    return n.select(F.lit(on).alias("gate"), "changed", (F.lit(not on) | (F.lit(approved) & (F.col("changed") == 0))).alias("open"))


def thresholds(given: DataFrame, known: DataFrame) -> DataFrame:
    """A10: (name, value, state) of settings: used, invalid (no number) or unknown; defaults fill the rest."""
    j = known.join(given, "name", "full")
    number = F.expr("try_cast(given AS double)")
    state = F.when(F.col("default").isNull(), "unknown").when(F.col("given").isNull(), "default").when(number.isNull(), "invalid").otherwise("used")
    return j.select("name", F.when(state == "used", number).otherwise(F.col("default")).alias("value"), state.alias("state"))


def classify_pages() -> F.Column:
    """Class of a page profile, an ordered decision list.

    Columns: chars, visible_chars, garbled, all_pictures, visual, full_image, repeated, pictures,
    small_pictures, vectors, invisible, ocr_font, math_font, math_glyphs, slides.
    """
    c = F.col
    background = (c("visible_chars") >= 20) & (c("repeated") | (c("visible_chars") >= 200))
    full = (c("full_image") > 0) & ~background
    visual = F.when(full, F.greatest("visual", "full_image")).otherwise(c("visual"))
    few = c("chars") < 20
    return (
        F.when(few & ((c("all_pictures") >= 0.5) | (c("vectors") >= 300)), "scan").when(few & (visual >= 0.02), "graphic")
        .when(few & ((c("small_pictures") >= 3) | (c("slides") & (c("pictures") > 0))), "graphic").when(few, "text")
        .when(c("invisible") | (c("ocr_font") & (c("all_pictures") >= 0.85)), "scan").when(c("garbled") >= 0.3 * c("chars"), "scan")
        .when(full, F.when(c("slides"), "graphic").otherwise("scan")).when((c("math_font") >= 3) | (c("math_glyphs") >= 8), "math")
        .when(c("slides") & ((visual >= 0.1) | (c("pictures") > 0)), "graphic")
        .when(~c("slides") & (((visual >= 0.35) & (c("chars") < 400)) | (visual >= 0.6)), "graphic").when(c("small_pictures") >= 3, "graphic").otherwise("text")
    )


def classify_pdf() -> F.Column:
    """Kind of a PDF by its profile (made_by_slides, aspect_median, text_layer, chars)."""
    c = F.col
    wide = (c("aspect_median") >= 1.3) & (c("text_layer") >= 0.2) & (c("chars") <= 1200)
    return F.when(c("made_by_slides") | wide, "slides").when(c("chars") < 40, "scan").otherwise("text")


def quality_level(name: F.Column, value: F.Column) -> F.Column:
    """Ok, warn or bad of a quality signal."""
    return (
        F.when(value.isNull(), None).when(name == "text_layer", F.when(value >= 0.9, "ok").when(value >= 0.5, "warn").otherwise("bad"))
        .when(name == "scan_dpi", F.when(value < 150, "warn").otherwise("ok")).when(name == "pages_failed", F.when(value > 0, "bad").otherwise("ok")).otherwise("ok")
    )


def accepted_edit(kind: str) -> F.Column:
    """Whether an edit is taken, over before/after columns size0, size1, lost_ids, lost_anchors, gained, missing0, missing1."""
    c = F.col
    kept = (c("lost_ids") == 0) & (c("lost_anchors") == 0)
    rules = {
        "section": kept & (c("size1") >= 0.9 * c("size0")) & (c("gained") >= 1),
        "retry": (c("missing1") <= c("missing0")) & (c("size1") >= 0.85 * c("size0")),
        "transcript": c("size1") >= 0.5 * c("size0"),
        "latex": kept & (F.abs(c("size1") - c("size0")) <= 0.03 * c("size0")),
    }
    return rules[kind]
