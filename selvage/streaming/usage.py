"""Streaming twins of the ledger (T1, T3-T5, S5): Structured Streaming over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 100) -> DataFrame:
    """Follow a log of files; the query's checkpoint is the resume offset."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def windowed(events: DataFrame, width: str = "5 hours", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """T5: counts and sums by event-time window with a watermark; batch frames ignore the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    agg = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """T5: sessions of a key that end after a gap."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events once each, remembering keys only as long as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Kinds of lines of an agent's event stream, in their order of precedence.
FINAL = ("result", "error", "rate_limit", "message")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(session, seq, kind, model, text, limits) of JSON lines; lines that are no JSON object are dropped.  ``seq`` numbers a session's lines."""
    j = F.from_json(column, "session string, seq bigint, type string, model string, text string, limits map<string,double>")
    return lines.select(j.alias("j")).where("j.type IS NOT NULL").select("j.session", "j.seq", F.col("j.type").alias("kind"), "j.model", "j.text", "j.limits")


def stream_state(rows: DataFrame) -> DataFrame:
    """Per session the lines seen, retries, whether a fatal line came, and the last model and limits that a line names;
    the same aggregation in batch and stream.  Lines without a number count as earliest; of equal numbers the greatest name is taken."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.coalesce("seq", F.lit(-1)).alias("s"), (F.to_json(c) if c == "limits" else F.col(c)).alias("v"))))["v"]
    return rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == "rate_limit").alias("retries"), F.bool_or(F.col("kind") == "error").alias("fatal"),
        last("model").alias("model"), F.from_json(last("limits"), "map<string,double>").alias("limits"),
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once by checkpoint and the Parquet sink's log."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
