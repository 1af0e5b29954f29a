"""The driver's tables in the roles of the data model, as DataFrames and as SQL for the twins.

A non-empty line of a document is a block; blocks under 20 characters are 'admin'.  A document is a
section that cites four of five of its blocks in a src comment; of the rest some have verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.operators import blocks as B
from selvage.tables import table

BLOCKS = """
ln AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
br AS (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS pos FROM ln),
blocks AS (SELECT doc_id, source, pos, 'D' || doc_id || '.b' || CASE WHEN pos < 1000 THEN lpad(pos::VARCHAR, 3, '0') ELSE pos::VARCHAR END AS id,
                  l[pos] AS text, CASE WHEN length(l[pos]) < 20 THEN 'admin' ELSE 'paragraph' END AS type FROM br)"""
CITED = "(doc_id * 7 + pos) % 5 <> 0"
FLAGGED = f"""{BLOCKS},
verdicts AS (SELECT id, CASE (doc_id + pos) % 4 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'missing' WHEN 2 THEN 'admin' END AS v FROM blocks WHERE NOT {CITED}),
flagged AS (SELECT b.*, {CITED} OR coalesce(v IN ('duplicate', 'admin'), false) AS covered,
                   CASE WHEN NOT ({CITED}) THEN coalesce(v, 'unknown') END AS verdict
            FROM blocks b LEFT JOIN verdicts USING (id) WHERE type <> 'admin')"""


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.of_documents(table(spark, sf, "documents"))
    return rows.withColumn("type", F.when(F.length("text") < 20, "admin").otherwise("paragraph"))


def cited() -> F.Column:
    return (F.col("doc_id") * 7 + F.col("pos")) % 5 != 0


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """(section, md): each document's citations as one src comment."""
    rows = B.of_documents(table(spark, sf, "documents")).where(cited())
    md = F.concat(F.lit("Text. <!-- src: "), F.array_join(F.array_sort(F.collect_list("id")), ", "), F.lit(" --> End."))
    return rows.groupBy(F.col("doc_id").alias("section")).agg(md.alias("md"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks(spark, sf).where(~cited())
    k = (F.col("doc_id") + F.col("pos")) % 4
    v = F.when(k == 0, "duplicate").when(k == 1, "missing").when(k == 2, "admin")
    return rows.select(F.col("id").alias("block"), F.col("pos").alias("ord"), v.alias("verdict"), F.lit("").alias("note")).where("verdict IS NOT NULL")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """(rec, pos, start, end, text): conversations as recordings; 15 characters are a second, each turn ends a second early."""
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    upto = Window.partitionBy("rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.length("text") + 30).over(upto)
    return t.select("rec", "pos", ((chars - F.length("text") - 30) / 15).alias("start"), ((chars - 15) / 15).alias("end"), "text")


SEGMENTS = """segments AS (SELECT conv_id AS rec, turn AS pos, coalesce(text, '') AS text,
  (sum(length(coalesce(text, '')) + 30) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(coalesce(text, '')) - 30) / 15 AS start,
  (sum(length(coalesce(text, '')) + 30) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 15) / 15 AS "end" FROM conversations)"""


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, ts, stage, backend, ok, duration_s, input_tokens, output_tokens, tokens, cost_usd) from the events table."""
    e = table(spark, sf, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("backend"), (F.col("event_type") != "error").alias("ok"),
                    F.col("value").alias("duration_s"), n.alias("input_tokens"), (n * 2).alias("output_tokens"), (n * 3).alias("tokens"), F.when(F.col("user_id") % 3 == 0, F.col("event_id") % 10 / F.lit(4.0)).alias("cost_usd"))


USAGE = """usage AS (SELECT event_id AS seq, ts, event_type AS stage, 'b' || (user_id % 3) AS backend, event_type <> 'error' AS ok, value AS duration_s,
  (props->>'$.k')::BIGINT AS input_tokens, 2 * (props->>'$.k')::BIGINT AS output_tokens, 3 * (props->>'$.k')::BIGINT AS tokens,
  CASE WHEN user_id % 3 = 0 THEN (event_id % 10) / 4.0::DOUBLE END AS cost_usd FROM events)"""
