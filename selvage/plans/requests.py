"""Queries of requests, notes, queues, glyphs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import glyphs as Y
from selvage.functions import images as I
from selvage.operators import coverage as C
from selvage.operators import queues as Q
from selvage.operators import requests as R
from selvage.plans import base
from selvage.plans.base import BLOCKS
from selvage.plans.registry import query
from selvage.tables import table

STAGES = ("extract", "outline", "sections", "global", "coverage", "assemble", "render")
BACKENDS = ("b0", "b1")


@query("section_sizes", f"WITH {BLOCKS} SELECT doc_id AS section, sum(length(text)) AS size FROM blocks WHERE {base.CITED} AND type <> 'admin' GROUP BY doc_id")
def section_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Characters that each section cites, administrative blocks aside."""
    return C.section_sizes(C.citations(base.sections(spark, sf)), C.without_admin(base.blocks(spark, sf)))


#: Letters that become an operator, a sign of prose, a private character and a Greek letter.
PLANTED = ("eaou", "∑№β")
_COUNT = "length(t) - length(regexp_replace(t, '{}', '', 'g'))"


@query("glyph_counts", f"SELECT doc_id, {_COUNT.format(Y.MATH_GLYPH)} AS math, {_COUNT.format(Y.GARBLED)} AS garbled FROM (SELECT doc_id, translate(text, '{PLANTED[0]}', '{PLANTED[1]}') AS t FROM documents)")
def glyph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """P5: signs of formulas and broken characters of each document, with planted ones."""
    t = F.translate("text", *PLANTED)
    return table(spark, sf, "documents").select("doc_id", Y.math_glyphs(t).alias("math"), Y.garbled(t).alias("garbled"))


@query("math_fonts", "SELECT event_id, event_id % 5 IN (0, 1, 3) AS is_math FROM events")
def math_fonts(spark: SparkSession, sf: str) -> DataFrame:
    """P5: fonts of formulas by name."""
    fonts = ["ABCDEF+CMMI10", "Symbol", "SegoeUISymbol", "cambria-math", "TimesNewRoman"]
    return table(spark, sf, "events").select("event_id", Y.is_math_font(F.element_at(F.array(*map(F.lit, fonts)), (F.col("event_id") % 5 + 1).cast("int"))).alias("is_math"))


@query("informative_locations", "SELECT doc_id FROM documents WHERE doc_id % 4 >= 2")
def informative_locations(spark: SparkSession, sf: str) -> DataFrame:
    """P20: documents whose location heading tells more than a number."""
    k, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    title = F.when(k == 0, F.concat(F.lit("SLIDE  "), n, F.lit("."))).when(k == 1, F.concat(F.lit("Страница "), n)).when(k == 2, F.concat(F.lit("Slide "), n, F.lit(": plan"))).otherwise("Page")
    return table(spark, sf, "documents").where(~Y.trivial_location(title)).select("doc_id")


@query("wide_codecs", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' OR doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'utf-16-le' WHEN doc_id % 4 = 2 THEN 'utf-16-be' ELSE 'utf-16' END AS codec FROM documents")
def wide_codecs(spark: SparkSession, sf: str) -> DataFrame:
    """Codec of each document's bytes, which are written in four ways."""
    k = F.col("doc_id") % 4
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "UTF-16LE")).when(k == 2, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-16"))
    return table(spark, sf, "documents").select("doc_id", Y.wide_codec(data).alias("codec"))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, section, json): one note a document; every third names no section, every fifth is no JSON."""
    i = F.col("doc_id")
    body = F.to_json(
        F.struct(
            F.when(i % 3 > 0, F.concat(F.lit("s"), (i % 7).cast("string"))).alias("section"), F.concat(F.lit(" [["), i.cast("string"), F.lit(":p1]] ")).alias("anchor"), i.alias("block"),
            F.col("text").alias("as_written"), F.lit(" x ").alias("reason"), F.when(i % 2 == 0, "answer").otherwise("odd").alias("kind"), F.col("text").alias("text"),
        )
    )
    return table(spark, sf, "documents").select("doc_id", F.lit("own").alias("section"), F.when(i % 5 == 0, "{").otherwise(body).alias("json"))


_BARE = r"regexp_replace(coalesce(CASE WHEN doc_id % 5 > 0 THEN text END, ''), '^\s+|\s+$', '', 'g')"
_SECTION = "CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN 's' || (doc_id % 7) ELSE 'own' END AS section"


@query("corrections", f"SELECT doc_id, {_SECTION}, CASE WHEN doc_id % 5 > 0 THEN doc_id || ':p1' ELSE '' END AS anchor, CASE WHEN doc_id % 5 > 0 THEN doc_id::VARCHAR ELSE '' END AS block, {_BARE} AS as_written, '' AS corrected, CASE WHEN doc_id % 5 > 0 THEN 'x' ELSE '' END AS reason FROM documents")
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """A4: corrections in one form."""
    return R.corrections(_notes(spark, sf), "doc_id")


@query("editorial_notes", f"SELECT doc_id, {_SECTION}, CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 'answer' ELSE 'clarification' END AS kind, '' AS refers_to, {_BARE} AS text FROM documents")
def editorial_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A4: editorial notes in one form."""
    return R.editorial_notes(_notes(spark, sf), "doc_id")


@query("conflicts", "SELECT item_id, 'own' AS section, 't' AS topic, item_id || ':p1' AS v_anchor, 'a' AS v_text, 'b' || item_id AS v_plain, 2 AS n, CASE WHEN item_id % 2 = 0 THEN 'r' END AS resolution, '' AS reason FROM benchmark")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """A4: conflicts, whose variants are objects or texts."""
    n = F.col("item_id").cast("string")
    json = F.concat(F.lit('{"topic": " t ", "variants": [{"anchor": "[['), n, F.lit(':p1]]", "text": " a "}, " b'), n, F.lit('", "", null], "resolution": "'), F.when(F.col("item_id") % 2 == 0, " r ").otherwise(" "), F.lit('"}'))
    found = R.conflicts(table(spark, sf, "benchmark").select("item_id", F.lit("own").alias("section"), json.alias("json")), "item_id")
    v = F.col("variants")
    return found.select("item_id", "section", "topic", v[0]["anchor"].alias("v_anchor"), v[0]["text"].alias("v_text"), v[1]["text"].alias("v_plain"), F.size(v).alias("n"), "resolution", "reason")


@query(
    "queue_params",
    """SELECT event_id, CASE WHEN event_type NOT IN ('build', 'extract', 'variant') AND event_id % 4 = 0 THEN 'action' WHEN event_id % 3 = 2 THEN 'backend' WHEN event_id % 4 = 1 AND event_id % 2 = 1 AND event_id % 5 = 0 THEN 'stage' END AS problem,
 CASE WHEN problem IS NULL THEN 'b' || (event_id % 3) END AS backend, CASE WHEN problem IS NULL AND event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'nowhere' ELSE 'global' END END AS from_stage,
 CASE WHEN problem IS NULL AND event_id % 4 = 1 THEN event_id % 2 = 0 END AS review, CASE WHEN problem IS NULL AND event_id % 7 = 0 THEN true END AS force, CASE WHEN problem IS NULL AND event_id % 4 = 2 THEN true END AS use_vision, CASE WHEN problem IS NULL AND event_id % 4 = 3 THEN event_type END AS preset FROM events""",
)
def queue_params(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of queue items, checked."""
    i = F.col("event_id")
    action = F.when(i % 4 == 1, "build").when(i % 4 == 2, "extract").when(i % 4 == 3, "variant").otherwise(F.col("event_type"))
    stage = F.when(i % 5 == 0, "nowhere").otherwise("global")
    params = F.to_json(F.struct(F.concat(F.lit("b"), (i % 3).cast("string")).alias("backend"), stage.alias("from_stage"), (i % 2 == 0).alias("review"), (i % 7 == 0).alias("force"), F.lit(True).alias("use_vision"), F.col("event_type").alias("preset"), F.lit("").alias("prompt")))
    p = table(spark, sf, "events").select("event_id", R.queue_params(action, params, STAGES, BACKENDS).alias("p"))
    return p.select("event_id", *(f"p.{c}" for c in ("problem", "backend", "from_stage", "review", "force", "use_vision", "preset")))


#: Requests in turn: preset, prompt, template.
REQUESTS = ((" Brief ", None, None), ("", " make it ", None), (None, None, "a4"), ("template: Wide", None, " "), (None, " ", ""), ("poster", None, None), ("custom", None, "a4"), ("study", "why", None), ("template", None, None), ("template:x", None, "y"))
_ANSWERS = (("brief", None, None, None), ("custom", "make it", None, None), ("template", None, "a4", None), ("template", None, "wide", None), ("", None, None, "no preset"), ("poster", None, None, "unknown preset"),
            ("custom", None, "a4", "no prompt"), ("study", "why", None, "unused prompt"), ("template", None, None, "no template"), ("template", None, "y", None))
_VALUES = ", ".join("(%d, %s)" % (k, ", ".join("NULL::VARCHAR" if x is None else f"'{x}'" for x in a)) for k, a in enumerate(_ANSWERS))


@query("variant_requests", f"SELECT event_id, preset, prompt, template, problem FROM events JOIN (VALUES {_VALUES}) a(k, preset, prompt, template, problem) ON event_id % {len(REQUESTS)} = k")
def variant_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in one form, or what is wrong with them."""
    at = lambda j: F.element_at(F.array(*(F.lit(r[j]).cast("string") for r in REQUESTS)), (F.col("event_id") % len(REQUESTS) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", R.variant_request(at(0), at(1), at(2)).alias("r")).select("event_id", "r.*")


@query("repaired_refs", f"""WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id)
 SELECT doc_id, 'See ' || CASE WHEN n >= 2 THEN '[[D' || doc_id || ':p2]]' ELSE '[[D' || doc_id || ':b2]]' END || ' and ' || CASE WHEN n >= 1 THEN '[[D' || doc_id || ':p1]]' ELSE '[[D' || doc_id || '.b001]]' END || ', [[X1:b9]]: ' || coalesce(source, '') AS text FROM documents LEFT JOIN n USING (doc_id)""")  # fmt: skip
def repaired_refs(spark: SparkSession, sf: str) -> DataFrame:
    """references to blocks become those to their places."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit(" See [[D"), n, F.lit(":b2]] and [[D"), n, F.lit(".b001]], [[X1:b9]]: "), F.coalesce("source", F.lit("")))
    blocks = base.blocks(spark, sf).select("id", F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":p"), F.col("pos").cast("string")).alias("anchor"))
    return R.repaired_refs(table(spark, sf, "documents").select("doc_id", text.alias("text")), blocks, "doc_id")


@query("cooling_backends", "SELECT 'u' || user_id AS backend, arg_max_null(CASE WHEN event_type IN ('error', 'view') THEN event_type END, event_id) AS reason FROM events GROUP BY user_id HAVING reason IS NOT NULL")
def cooling_backends(spark: SparkSession, sf: str) -> DataFrame:
    """Backends, one a user, whose last attempt failed."""
    marks = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("backend"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("error", "view"), F.col("event_type")).alias("reason"))
    return Q.cooling(marks)


@query("fastest_ways", "SELECT o_custkey, arg_min(o_orderpriority, (o_totalprice, o_orderpriority)) AS way, min(o_totalprice) AS seconds FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def fastest_ways(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest order that is not pending, in the role of the fastest way."""
    o = table(spark, sf, "orders")
    return Q.fastest(o.select("o_custkey", F.col("o_orderpriority").alias("way"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderstatus") != "P").alias("available")), "o_custkey")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs: (queue, seq, at, topic, seconds, five, week), a queue for each user."""
    s = F.floor(F.col("value") * 10).cast("long")
    return table(spark, sf, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), F.col("event_type").alias("topic"), F.coalesce(s, F.lit(0)).alias("seconds"),
                                             ((F.col("event_id") % 4) / 8.0).alias("five"), ((F.col("event_id") % 3) / 64.0).alias("week"))


@query("scheduled_jobs")
def scheduled_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of each user, two at a time and one a topic (a plain model in the tests)."""
    return Q.scheduled(jobs(spark, sf))


@query("paced_runs")
def paced_runs(spark: SparkSession, sf: str) -> DataFrame:
    """T4, Q12: runs of each user's queue under limits (a plain model in the tests)."""
    return Q.paced_run(jobs(spark, sf))


@query("perceptual_hashes")
def perceptual_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """H2: hash of a thumbnail that repeats each vector (a plain model in the tests)."""
    e = F.col("embedding")
    cell = F.transform(F.sequence(F.lit(0), F.lit(I.SIDE * I.SIDE - 1)), lambda i: F.get(e, (i % F.size(e)).cast("int")) * F.floor(i / F.size(e)))
    return table(spark, sf, "embeddings").select("vec_id", I.perceptual_hash(F.transform(cell, lambda x: x.cast("double"))).alias("hash"))


@query("map_crops", "SELECT vec_id, list_concat(embedding[10:12], embedding[18:20])::DOUBLE[] AS part FROM embeddings")
def map_crops(spark: SparkSession, sf: str) -> DataFrame:
    """H6: rows two and three, columns two to four, of each vector as a map eight cells wide."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", I.cropped(d, (8, 8), (0.125, 0.125, 0.45, 0.375)).alias("part"))
