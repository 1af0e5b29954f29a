"""Queries of records, settings and plans of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators import coverage as C
from selvage.operators import manifest as N
from selvage.plans.registry import query
from selvage.sources import files as S
from selvage.tables import table


@query("json_messages", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN NULL ELSE props END AS json FROM events""")
def json_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the JSON object of each message: in a fence, between words, broken, or alone."""
    k = F.col("event_id") % 4
    c = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nand {more}"))).when(k == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).when(k == 2, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", S.json_message(c).alias("json"))


@query("limit_rows", """SELECT event_id, name, u AS utilization, make_timestamp((1700000000 + event_id) * 1000000) AS resets_at FROM (SELECT event_id, 'five_hour' AS name, (event_id % 8) / 8.0::DOUBLE AS u FROM events UNION ALL SELECT event_id, 'seven_day', NULL FROM events WHERE event_id % 3 = 0)""")
def limit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A3: limit windows read from their payload."""
    i = F.col("event_id")
    one = lambda u: F.struct(u.cast("double").alias("utilization"), (i + 1700000000).alias("resetsAt"))
    five = F.create_map(F.lit("five_hour"), one(i % 8 / 8.0))
    both = F.when(i % 3 == 0, F.map_concat(five, F.create_map(F.lit("seven_day"), one(F.lit(None))))).otherwise(five)
    return S.limit_rows(table(spark, sf, "events").select("event_id", F.to_json(F.struct(both.alias("windows"))).alias("payload")), "event_id", "payload")


@query("autofill_limits", "SELECT event_id, greatest(5, ceil(round(0.03::DOUBLE * event_id, 6)))::BIGINT AS most FROM events")
def autofill_limits(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks may be placed without asking."""
    return table(spark, sf, "events").select("event_id", C.autofill_limit("event_id").alias("most"))


@query("settings", """SELECT item_id::VARCHAR AS name, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 3 = 0 THEN item_id + 0.5 ELSE item_id END::DOUBLE AS value, CASE WHEN item_id % 5 = 0 THEN 'unknown' WHEN item_id % 3 = 0 THEN 'used' WHEN item_id % 3 = 1 THEN 'invalid' ELSE 'default' END AS state
 FROM benchmark WHERE item_id % 5 > 0 OR item_id % 3 < 2""")  # fmt: skip
def settings(spark: SparkSession, sf: str) -> DataFrame:
    """A10: settings given and known: used, invalid, unknown or by default."""
    i, b = F.col("item_id"), table(spark, sf, "benchmark")
    given = b.where("item_id % 3 < 2").select(i.cast("string").alias("name"), F.when(i % 3 == 0, (i + 0.5).cast("string")).otherwise("x").alias("given"))
    return N.thresholds(given, b.where("item_id % 5 > 0").select(i.cast("string").alias("name"), i.cast("double").alias("default")))


@query("source_units", "SELECT doc_id, list_filter([CASE WHEN doc_id % 3 > 0 AND doc_id % 2 = 1 THEN 'pages' END, CASE WHEN doc_id % 5 > 0 THEN 'minutes' END], lambda x: x IS NOT NULL) AS units, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END AS minutes FROM documents")
def source_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of sources that are worth showing; slides hide pages."""
    i = F.col("doc_id")
    units = F.create_map(F.lit("pages"), i % 3, F.lit("minutes"), i % 5, F.lit("odd"), i)
    shown = S.source_units(units, i % 2 == 0)
    return table(spark, sf, "documents").select("doc_id", F.map_keys(shown).alias("units"), F.try_element_at(shown, F.lit("minutes")).alias("minutes"))


@query("spoken_words", """WITH w AS (SELECT conv_id, turn, k, CASE WHEN k = 0 THEN coalesce(role, '') ELSE 'b' END AS text, CASE WHEN k = 0 THEN 0.5 END::DOUBLE AS prob FROM conversations, (VALUES (0), (1)) v(k))
 SELECT conv_id, turn, k AS n, (turn + k)::DOUBLE AS start, (turn + k + 0.25)::DOUBLE AS "end", text, prob FROM w""")  # fmt: skip
def spoken_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns read from their JSON tuples."""
    t = F.col("turn")
    json = F.concat(F.lit("[["), t.cast("string"), F.lit(","), t.cast("string"), F.lit('.25,"'), F.coalesce("role", F.lit("")), F.lit('",0.5],['), (t + 1).cast("string"), F.lit(","), (t + 1).cast("string"), F.lit('.25,"b"]]'))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(S.words_of(json)).alias("n", "w"))
    return rows.select("conv_id", "turn", "n", "w.start", "w.end", "w.text", "w.prob")


@query("targets", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'verdict' WHEN doc_id % 3 = 0 THEN 'child' WHEN doc_id % 5 = 0 THEN 'own' WHEN doc_id % 7 = 0 THEN 'nearest' ELSE 'last' END AS target FROM documents")
def targets(spark: SparkSession, sf: str) -> DataFrame:
    """The section that a missing block goes to."""
    some = lambda n, k: F.when(F.col("doc_id") % n == 0, k).alias(f"{k}_section")
    rows = table(spark, sf, "documents").select("doc_id", some(2, "verdict"), some(3, "child"), some(5, "own"), some(7, "nearest"), F.lit("last").alias("last_section"))
    return C.targets(rows).select("doc_id", "target")


@query("stale_variants", "SELECT doc_id AS slug, doc_id % 13 AS created, coalesce(source <> (SELECT max(source) FROM documents), true) AS stale FROM documents")
def stale_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants whose master changed (the last source is the master)."""
    d = table(spark, sf, "documents")
    return N.stale_variants(d.select(F.col("doc_id").alias("slug"), (F.col("doc_id") % 13).alias("created"), F.col("source").alias("master_sha")), d.select(F.col("source").alias("sha")))


@query("stages_to_run", "SELECT doc_id AS stage, coalesce(source, '') || lang AS key FROM documents WHERE doc_id % 6 > 0")
def stages_to_run(spark: SparkSession, sf: str) -> DataFrame:
    """Stages without a good run under the current key."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("stage"), F.concat(F.coalesce("source", F.lit("")), "lang").alias("key"))
    runs = d.select("stage", F.when(F.col("stage") % 3 == 0, F.col("key")).otherwise("old").alias("key"), (F.col("stage") % 2 == 0).alias("ok"))
    return N.to_run(runs, d)


@query("review_gate", "SELECT true AS gate, count(*) AS changed, count(*) = 0 AS open FROM documents WHERE doc_id % 9 = 0")
def review_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an approved review still holds."""
    d = table(spark, sf, "documents")
    key = lambda c: d.select(F.col("doc_id").alias("id"), c.alias("key"))
    return N.review_gate(key(F.lit("a")), key(F.when(F.col("doc_id") % 9 == 0, "b").otherwise("a")), True, None, True)


@query("newest_prompts", "SELECT item_id % 7 AS name, 'p/' || max(item_id) AS path FROM benchmark GROUP BY item_id % 7")
def newest_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of the greatest version, by number and not by letter."""
    i = F.col("item_id")
    rows = table(spark, sf, "benchmark").select((i % 7).alias("name"), F.concat(F.lit("v1."), i.cast("string")).alias("version"), F.concat(F.lit("p/"), i.cast("string")).alias("path"))
    return S.versions(rows)
