"""Queries of rules, merges and stages (P14, P16, A1, A3, A10, A12, F*, G10, G12, G18-G20, U6-U8, L1, L5, L7, Q*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import markdown as M
from selvage.functions import text as T
from selvage.operators import blocks as B
from selvage.operators import coverage as C
from selvage.operators import manifest as N
from selvage.operators import matching as X
from selvage.operators import packing as P
from selvage.plans import base
from selvage.plans.base import BLOCKS, USAGE
from selvage.plans.registry import query
from selvage.sources import files as S
from selvage.tables import table


@query("expectation_failures", """SELECT doc_id::VARCHAR AS name, unnest(list_filter([CASE WHEN NOT coalesce(length(text) >= 400, false) THEN 'min_chars' END, CASE WHEN NOT coalesce(contains(text, chr(10)), false) THEN 'lines' END,
 CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'declared_size' END], lambda x: x IS NOT NULL)) AS rule FROM documents""")  # fmt: skip
def expectation_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that break a contract's rules."""
    d = table(spark, sf, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return S.failures(d, [("min_chars", F.length("text") >= 400), ("lines", F.contains("text", F.lit("\n"))), ("declared_size", F.col("n_chars") == F.length("text"))])


@query("accepted_edits", f"""WITH {BLOCKS}, e AS (SELECT id, length(text) AS size0, length(text) - pos % 20 AS size1, (pos % 7 = 0)::INT AS lost_ids, (pos % 2)::INT AS gained FROM blocks)
 SELECT id, lost_ids = 0 AND size1 >= 0.9 * size0 AND gained >= 1 AS section, size1 >= 0.5 * size0 AS transcript, lost_ids = 0 AND abs(size1 - size0) <= 0.03 * size0 AS latex FROM e""")  # fmt: skip
def accepted_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Which edits are taken."""
    e = base.blocks(spark, sf).select("id", F.length("text").alias("size0"), (F.length("text") - F.col("pos") % 20).alias("size1"), (F.col("pos") % 7 == 0).cast("int").alias("lost_ids"), F.lit(0).alias("lost_anchors"), (F.col("pos") % 2).alias("gained"), F.lit(0).alias("missing0"), F.lit(0).alias("missing1"))
    return e.select("id", *(N.accepted_edit(k).alias(k) for k in ("section", "transcript", "latex")))


@query("quality_levels", "SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value >= 0.9 THEN 'ok' WHEN value >= 0.5 THEN 'warn' ELSE 'bad' END AS level FROM events")
def quality_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level of a quality signal."""
    return table(spark, sf, "events").select("event_id", N.quality_level(F.lit("text_layer"), F.col("value")).alias("level"))


@query("page_classes", """WITH p AS (SELECT event_id, event_id % 900 AS chars, event_id % 13 AS glyphs, event_id % 5 AS small, value AS visual FROM events)
 SELECT event_id, CASE WHEN chars < 20 AND visual >= 0.02 THEN 'graphic' WHEN chars < 20 AND small >= 3 THEN 'graphic' WHEN chars < 20 THEN 'text' WHEN glyphs >= 8 THEN 'math'
 WHEN (visual >= 0.35 AND chars < 400) OR visual >= 0.6 THEN 'graphic' WHEN small >= 3 THEN 'graphic' ELSE 'text' END AS kind FROM p""")  # fmt: skip
def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of page profiles."""
    c = lambda e, n: e.alias(n)
    no, zero, i = F.lit(False), F.lit(0), F.col("event_id")
    p = table(spark, sf, "events").select("event_id", c(i % 900, "chars"), c(i % 900, "visible_chars"), c(zero - 0, "garbled"), c(F.lit(0.0), "all_pictures"), c(F.col("value"), "visual"), c(F.lit(0.0), "full_image"), c(no, "repeated"), c(i % 5, "pictures"), c(i % 5, "small_pictures"), c(zero, "vectors"), c(no, "invisible"), c(no, "ocr_font"), c(zero, "math_font"), c(i % 13, "math_glyphs"), c(no, "slides"))
    return p.withColumn("garbled", F.lit(-1)).select("event_id", N.classify_pages().alias("kind"))


@query("pdf_kinds", "SELECT event_id, CASE WHEN event_type = 'click' OR (value * 2 >= 1.3 AND event_id % 10 >= 2 AND event_id % 2000 <= 1200) THEN 'slides' WHEN event_id % 2000 < 40 THEN 'scan' ELSE 'text' END AS kind FROM events")
def pdf_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of PDF profiles."""
    p = table(spark, sf, "events").select("event_id", (F.col("event_type") == "click").alias("made_by_slides"), (F.col("value") * 2).alias("aspect_median"), (F.col("event_id") % 10 / 10).alias("text_layer"), (F.col("event_id") % 2000).alias("chars"))
    return p.select("event_id", N.classify_pdf().alias("kind"))


@query("page_quality", """SELECT source AS doc, coalesce(median(length(text)), 0)::DOUBLE AS chars_per_page, avg((length(text) >= 20)::INT) AS text_layer, count(*) FILTER (WHERE doc_id % 5 = 0) AS pages_math, count(*) FILTER (WHERE doc_id % 5 = 1) AS pages_scan,
 count(*) FILTER (WHERE doc_id % 5 = 2) AS pages_graphic, median(doc_id % 300)::DOUBLE AS scan_dpi FROM documents GROUP BY source""")  # fmt: skip
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each source (documents as its pages)."""
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "math").when(k == 1, "scan").when(k == 2, "graphic").otherwise("text")
    return X.page_quality(table(spark, sf, "documents").select(F.col("source").alias("doc"), F.length("text").alias("chars"), kind.alias("kind"), (F.col("doc_id") % 300).alias("dpi")))


@query("merged_quality", f"WITH {USAGE} SELECT backend AS source, stage AS name, max_by(duration_s, seq) AS value FROM usage GROUP BY ALL")
def merged_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Last value of each name."""
    u = base.usage(spark, sf)
    return X.merged_quality(u.select(F.col("backend").alias("source"), F.col("seq").alias("ord"), F.col("stage").alias("name"), F.col("duration_s").alias("value")))


@query("distinct_notes", "SELECT kind, text, min(ord) AS ord, min_by(section, ord) AS section FROM (SELECT lang AS kind, substr(text, 1, 12) AS text, doc_id AS ord, source AS section FROM documents) GROUP BY kind, text")
def distinct_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of equal content once."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("kind"), F.substring("text", 1, 12).alias("text"), F.col("doc_id").alias("ord"), F.col("source").alias("section"))
    return X.distinct_notes(d)


@query("update_plan", f"WITH {BLOCKS} SELECT count(*) FILTER (WHERE pos % 9 = 0 AND type <> 'admin') AS new, 0 AS gone, count(*) FILTER (WHERE pos % 9 = 0 AND type <> 'admin') > 0 AS possible FROM blocks")
def update_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the outline can be updated."""
    b = base.blocks(spark, sf)
    return X.update_plan(b.where("pos % 9 <> 0"), b)


@query("anchor_problems", f"WITH {BLOCKS} SELECT id AS anchor, CASE WHEN pos % 13 = 0 THEN 'lost' ELSE 'level' END AS problem FROM blocks WHERE pos % 13 = 0 OR pos % 17 = 0")
def anchor_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors lost or moved to another level."""
    b = base.blocks(spark, sf).select(F.col("id").alias("anchor"), "pos")
    return X.anchor_problems(b.select("anchor", F.lit(2).alias("level")), b.where("pos % 13 <> 0").select("anchor", F.when(F.col("pos") % 17 == 0, 3).otherwise(2).alias("level")))


@query("vision_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS text, doc_id % 3 = 0 AS by_vision FROM documents")
def vision_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """U8: text by vision, else the text layer."""
    d = table(spark, sf, "documents")
    return X.with_fallback(d.select("doc_id"), d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("text")), d.select("doc_id", F.col("source").alias("text")), ["doc_id"])


@query("foreign_citations", f"WITH {BLOCKS} SELECT doc_id AS section, id AS block FROM blocks WHERE {base.CITED} AND pos % 6 = 0")
def foreign_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of blocks that the outline put elsewhere."""
    placed = base.blocks(spark, sf).select(F.when(F.col("pos") % 6 == 0, -1).otherwise(F.col("doc_id")).alias("section"), F.col("id").alias("block"))
    return X.foreign_citations(C.citations(base.sections(spark, sf)), placed)


@query("glossary_scope", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def glossary_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a group's sources."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return X.glossary_of(d, d.where("doc_id % 97 = 0"))


@query("natural_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """L1: names in natural order ('c2' before 'c10')."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"))
    c = c.withColumn("key", S.natural_key(F.col("name")))
    # a prefix rises with the key: 'c' and nine of twelve digits
    return P.numbered(c, F.substring("key", 1, 10), "key", "place").select("c_custkey", "place")


@query("capped_lists", "SELECT n_regionkey, array_to_string(list_sort(list(n_name))[1:3], ', ') || ', +' || (count(*) - 3) || ' more' AS names FROM nation GROUP BY n_regionkey")
def capped_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Three names of each region and how many more."""
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(S.capped(F.collect_list("n_name"), 3).alias("names"))


@query("section_terms", "WITH t AS (SELECT source, min(doc_id) AS doc_id, lower(trim(substr(text, 1, 9))) AS k FROM documents WHERE trim(substr(text, 1, 9)) <> '' GROUP BY source, k) SELECT source, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def section_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten distinct titles of each source."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.substring("text", 1, 9).alias("title"))
    return B.terms(d, "source", "doc_id", "title", 10).select("source", "doc_id")


@query("headings_contents", f"WITH {BLOCKS}, h AS (SELECT doc_id, pos, id, pos % 5 AS level FROM blocks WHERE pos % 5 IN (1, 2, 4)), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY level) AS depth FROM h) SELECT doc_id, pos, CASE WHEN depth = 2 THEN '  - ' ELSE '- ' END || id AS entry FROM r WHERE depth <= 2")
def headings_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Table of contents of the two top levels."""
    b = base.blocks(spark, sf).where("pos % 5 IN (1, 2, 4)").withColumn("level", F.col("pos") % 5)
    return B.contents(b, "doc_id", "pos", "level", "id")


@query("last_verdicts", "SELECT doc_id, arg_max_null(quality, r) AS quality, arg_max_null(toxic, r) AS toxic FROM (SELECT *, row_number() OVER () AS r FROM labels) GROUP BY doc_id")
def last_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The last label of a document, by file and row of the table."""
    x = table(spark, sf, "labels").withColumn("ord", F.struct("_metadata.file_name", "_metadata.row_index"))
    return B.last_wins(x, ["doc_id"], "ord").select("doc_id", "quality", "toxic")


#: Texts of errors, by the number of the event.
ERROR_TEXTS = {"HTTP 429": "rate_limit", "401": "auth", "Overloaded": "rate_limit", "please log in": "auth", "disk full": None, "usage limit; not logged in": "auth", "port 4290": None, "Quota used up, check credentials": "rate_limit"}
_KINDS = " ".join(f"WHEN {i} THEN {repr(k) if k else 'NULL'}" for i, k in enumerate(ERROR_TEXTS.values()))


@query("error_kinds", f"SELECT event_id, CASE event_id % {len(ERROR_TEXTS)} {_KINDS} END AS kind FROM events")
def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each event's error text (eight texts in turn)."""
    text = F.element_at(F.array(*map(F.lit, ERROR_TEXTS)), (F.col("event_id") % len(ERROR_TEXTS) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", T.error_kind(text).alias("kind"))


@query("clean_pages")
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of each page normalised and given its own heading (tests hold the rules)."""
    p = table(spark, sf, "pages").select("page_id", "html", T.html_title(F.col("html")).alias("title"))
    md = M.balanced_divs(M.clean_markdown(M.normal_page(M.strip_title(F.col("markdown"), F.col("title")))))
    return S.web_markdown(p).select("page_id", M.fixed_heading(md, F.col("title"), F.lit(2), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("md"))


@query("paragraph_index")
def paragraph_index(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each document's text in order."""
    return X.master_index(B.lines(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "doc"))


@query("error_places")
def error_places(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs that hold most of a benchmark item's words."""
    p = base.blocks(spark, sf).select(F.col("id").alias("par"), "text")
    return X.best_overlap(table(spark, sf, "benchmark").select(F.col("item_id").alias("err"), "text"), p)
