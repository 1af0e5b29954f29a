"""Usage ledger, limits, estimates, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_totals(usage: DataFrame, by: str = "backend") -> DataFrame:
    """Attempts, successes, tokens and cost per backend with a grand total (null); cost is null unless any is known."""
    tokens = F.coalesce(F.sum("input_tokens"), F.lit(0)) + F.coalesce(F.sum("output_tokens"), F.lit(0))
    return usage.rollup(by).agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("ok"), tokens.alias("tokens"), F.sum("cost_usd").alias("cost_usd"))


def period_totals(usage: DataFrame, now: Column) -> DataFrame:
    """Attempts and tokens of the last 5 hours, day and 7 days (``ts >= now - length``), in one pass."""
    periods = {"five_hours": "INTERVAL 5 HOURS", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}
    since = lambda i: F.col("ts") >= now - F.expr(i)
    agg = [F.count_if(since(i)).alias(f"{k}_n") for k, i in periods.items()] + [F.coalesce(F.sum(F.when(since(i), F.col("tokens"))), F.lit(0)).alias(f"{k}_tokens") for k, i in periods.items()]
    return usage.agg(*agg)


def stage_means(usage: DataFrame) -> DataFrame:
    """Mean and number of successful, positive durations per stage."""
    return usage.where("ok AND duration_s > 0").groupBy("stage").agg(F.avg("duration_s").alias("mean_s"), F.count(F.lit(1)).alias("n"))


def pooled_mean(means: DataFrame, default: float) -> DataFrame:
    """Mean over stages weighted by their counts; the default when there is none."""
    return means.agg(F.coalesce(F.try_divide(F.sum(F.col("mean_s") * F.col("n")), F.sum("n")), F.lit(default)).alias("mean_s"), (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("measured"))


def calibration(runs: DataFrame) -> DataFrame:
    """Seconds per audio minute by device and model, weighted by minutes; audio under 20 s and walls of no time are ignored."""
    rows = runs.where("audio_seconds >= 20 AND wall_seconds > 0")
    return rows.groupBy("device", "model").agg((F.sum("wall_seconds") / (F.sum("audio_seconds") / 60)).alias("seconds_per_minute"), F.count(F.lit(1)).alias("runs"), (F.sum("audio_seconds") / 60).alias("minutes"))


def latest_windows(records: DataFrame, seq: str = "seq") -> DataFrame:
    """(name, utilization, resets_at, seen_at): the newest numeric value of each limit window.

    ``records``: (seq, ts, limits struct<status, type, using_overage, windows map>).  If the newest
    record with limits is rejected and not on overage, its window counts as full at least.
    """
    rows = records.where("limits IS NOT NULL")
    each = rows.select(seq, "ts", F.explode("limits.windows").alias("name", "w")).where("w.utilization IS NOT NULL")
    last = each.groupBy("name").agg(F.max_by(F.struct("w.utilization", "w.resets_at", F.col("ts").alias("seen_at")), seq).alias("v"))
    newest = rows.agg(F.max_by(F.struct("limits.status", "limits.type", "limits.using_overage"), seq).alias("l"))
    out = last.crossJoin(F.broadcast(newest))  # one row
    full = (F.col("l.status") == "rejected") & ~F.coalesce("l.using_overage", F.lit(False)) & (F.col("name") == F.col("l.type"))
    return out.select("name", F.when(full, F.greatest("v.utilization", F.lit(1.0))).otherwise(F.col("v.utilization")).alias("utilization"), "v.resets_at", "v.seen_at")


#: P10: lengths of the limit windows in seconds.
LENGTHS = {"five_hour": 5 * 3600, "seven_day": 7 * 86400}


def active(now: Column) -> Column:
    """P10: a window counts until it resets, or for its length after it was seen."""
    length = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LENGTHS.items() for x in kv)), F.col("name")), F.lit(0))
    ends = F.coalesce(F.col("resets_at"), F.timestamp_seconds(F.unix_timestamp("seen_at") + length))
    return now < ends


def pace(windows: DataFrame, now: Column, stop_at: float = 0.95, wait_at: float = 0.9) -> DataFrame:
    """One row: 'stop' at the weekly limit, else 'wait' until min(reset + 60 s, now + 5 h 10 min), else 'go'."""
    rows = windows.withColumn("ends", F.coalesce(F.col("resets_at"), F.timestamp_seconds(F.unix_timestamp("seen_at") + F.lit(LENGTHS["five_hour"])))).where(active(now))
    of = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    one = rows.agg(of("seven_day", "utilization").alias("week"), of("five_hour", "utilization").alias("five"), of("five_hour", "ends").alias("ends"))
    action = F.when(F.col("week") >= stop_at, "stop").when(F.col("five") >= wait_at, "wait").otherwise("go")
    until = F.least(F.col("ends") + F.expr("INTERVAL 60 SECONDS"), now + F.expr("INTERVAL 18600 SECONDS"))
    return one.select(action.alias("action"), F.when(action == "wait", until).alias("until"), "five", "week")


def next_item(queue: DataFrame, attempted: DataFrame) -> DataFrame:
    """The first queued or paused item that this run has not tried."""
    return queue.where("status IN ('queued', 'paused')").join(attempted, "id", "left_anti").orderBy("seq").limit(1)


def added_items(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New (topic, action) pairs that are not waiting already, the first of each."""
    busy = queue.where("status IN ('queued', 'running', 'paused')").select("topic", "action")
    return new.groupBy("topic", "action").agg(F.min("seq").alias("seq")).join(busy, ["topic", "action"], "left_anti")


def ring(rows: DataFrame, key: str, order: str, most: int = 5000) -> DataFrame:
    """The last ``most`` events of each key with their absolute offsets (a ring buffer's content)."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("offset", F.row_number().over(w.orderBy(order)) - 1)
    return rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("__n") <= most).drop("__n")


def source_chars() -> Column:
    """Characters of a source: measured, else minutes x 800, else pages x 1800, else bytes / 3."""
    return F.coalesce("chars", F.col("minutes") * 800, F.col("pages") * 1800, F.col("size") / 3).cast("long")


def synthesis_runs(chars: Column) -> dict[str, Column]:
    """Agent runs by stage."""
    from selvage.functions.text import runs

    return {"sections": runs(chars, 10_500), "global_runs": runs(chars, 350_000), "coverage_runs": runs(chars, 400_000)}


def estimate(topics: DataFrame, parallel: int = 2, low_s: float = 180, high_s: float = 360) -> DataFrame:
    """Runs, waves and seconds per topic of (topic, chars) rows."""
    per = topics.groupBy("topic").agg(F.sum("chars").alias("chars"))
    n = synthesis_runs(F.col("chars"))
    waves = F.ceil(n["sections"] / parallel)
    per = per.withColumns(n | {"waves": waves})
    rounds = F.col("waves") + F.col("global_runs") + F.col("coverage_runs")
    return per.withColumns({"low_s": rounds * low_s, "high_s": rounds * high_s})
