"""Queries over the usage ledger, the manifest and the web."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import text as T
from selvage.operators import ledger as L
from selvage.operators import manifest as M
from selvage.plans import base
from selvage.plans.base import USAGE
from selvage.plans.registry import query
from selvage.sources import files as S
from selvage.streaming import usage as U
from selvage.tables import table


@query("usage_totals", f"WITH {USAGE} SELECT backend, count(*) AS attempts, count(*) FILTER (WHERE ok) AS ok, coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) AS tokens, sum(cost_usd) AS cost_usd FROM usage GROUP BY ROLLUP (backend)")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts, tokens and cost per backend, and the grand total."""
    return L.usage_totals(base.usage(spark, sf))


@query("period_totals", f"""WITH {USAGE}, n AS (SELECT max(ts) AS now FROM usage) SELECT count(*) FILTER (WHERE ts >= now - INTERVAL 5 HOURS) AS five_hours_n, count(*) FILTER (WHERE ts >= now - INTERVAL 1 DAY) AS day_n,
 count(*) FILTER (WHERE ts >= now - INTERVAL 7 DAYS) AS week_n, coalesce(sum(tokens) FILTER (WHERE ts >= now - INTERVAL 5 HOURS), 0) AS five_hours_tokens, coalesce(sum(tokens) FILTER (WHERE ts >= now - INTERVAL 1 DAY), 0) AS day_tokens,
 coalesce(sum(tokens) FILTER (WHERE ts >= now - INTERVAL 7 DAYS), 0) AS week_tokens FROM usage, n""")  # fmt: skip
def period_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the last periods before the newest record."""
    u = base.usage(spark, sf)
    now = u.agg(F.max("ts").alias("now"))
    return L.period_totals(u.crossJoin(F.broadcast(now)), F.col("now"))


@query("stage_means", f"WITH {USAGE} SELECT stage, avg(duration_s) AS mean_s, count(*) AS n FROM usage WHERE ok AND duration_s > 0 GROUP BY stage")
def stage_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean duration per stage."""
    return L.stage_means(base.usage(spark, sf))


@query("pooled_mean", f"WITH {USAGE} SELECT round(coalesce(sum(duration_s) / count(*), 60.0), 9) AS mean_s, count(*) > 0 AS measured FROM usage WHERE ok AND duration_s > 0")
def pooled_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled mean over stages."""
    return L.pooled_mean(L.stage_means(base.usage(spark, sf)), 60.0).withColumn("mean_s", F.round("mean_s", 9))


@query("calibration", "SELECT 'd' || (user_id % 2) AS device, event_type AS model, sum(value) / (sum(event_id % 100) / 60) AS seconds_per_minute, count(*) AS runs, sum(event_id % 100) / 60 AS minutes FROM events WHERE event_id % 100 >= 20 AND value > 0 GROUP BY ALL")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds per audio minute."""
    e = table(spark, sf, "events")
    return L.calibration(e.select(F.concat(F.lit("d"), (F.col("user_id") % 2).cast("string")).alias("device"), F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("audio_seconds"), F.col("value").alias("wall_seconds")))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = lambda u, r: F.struct(u.cast("double").alias("utilization"), r.alias("resets_at"))
    none = F.lit(None).cast("timestamp")
    windows = F.create_map(F.lit("five_hour"), w(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 100 / 100), none), F.lit("seven_day"), w(F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 50 / 100), none))
    limits = F.struct(F.lit("allowed").alias("status"), F.lit("five_hour").alias("type"), F.lit(False).alias("using_overage"), windows.alias("windows"))
    return e.select(F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") != "error", limits).alias("limits"))


_LATEST = """l AS (SELECT 'five_hour' AS name, max_by(event_id % 100 / 100, event_id) AS utilization, max_by(ts, event_id) AS seen_at FROM events WHERE event_type <> 'error' AND event_id % 3 <> 0
 UNION ALL SELECT 'seven_day', max_by(event_id % 50 / 100, event_id), max_by(ts, event_id) FROM events WHERE event_type <> 'error' AND event_id % 5 = 0)"""


@query("latest_windows", f"WITH {_LATEST} SELECT name, utilization, NULL::TIMESTAMP AS resets_at, seen_at FROM l")
def latest_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Newest value of each limit window."""
    return L.latest_windows(_records(spark, sf))


@query("pace", f"""WITH {_LATEST}, n AS (SELECT max(ts) AS now FROM events), a AS (SELECT max(utilization) FILTER (WHERE name = 'seven_day') AS week, max(utilization) FILTER (WHERE name = 'five_hour') AS five FROM l, n WHERE now < seen_at + CASE name WHEN 'five_hour' THEN INTERVAL 5 HOURS ELSE INTERVAL 7 DAYS END)
 SELECT CASE WHEN week >= 0.95 THEN 'stop' WHEN five >= 0.9 THEN 'wait' ELSE 'go' END AS action, five, week FROM a""")  # fmt: skip
def pace(spark: SparkSession, sf: str) -> DataFrame:
    """The pace decision at the newest record."""
    now = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    return L.pace(L.latest_windows(_records(spark, sf)), F.lit(now)).drop("until")


@query("next_item", "SELECT o_orderkey AS id, o_orderkey AS seq, 'queued' AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 ORDER BY seq LIMIT 1")
def next_item(spark: SparkSession, sf: str) -> DataFrame:
    """The first runnable item that this run has not tried."""
    o = table(spark, sf, "orders")
    q = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return L.next_item(q, o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id")))


@query("queue_added", "SELECT o_custkey AS topic, o_orderpriority AS action, min(o_orderkey) AS seq FROM orders o WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderkey % 2 = 1 AND p.o_orderstatus = 'O') GROUP BY ALL")
def queue_added(spark: SparkSession, sf: str) -> DataFrame:
    """New (topic, action) pairs that do not wait already."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderpriority").alias("action"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return L.added_items(o.where("seq % 2 = 1"), o.where("seq % 2 = 0"))


@query("queue_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Items by status."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("event_ring", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS \"offset\" FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def event_ring(spark: SparkSession, sf: str) -> DataFrame:
    """The last five events of each user with absolute offsets."""
    return L.ring(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query("estimates", """WITH c AS (SELECT source AS topic, sum(n_chars) AS chars FROM documents GROUP BY source), r AS (SELECT topic, chars, greatest(1, ceil(chars / 10500))::BIGINT AS sections, greatest(1, ceil(chars / 350000))::BIGINT AS global_runs, greatest(1, ceil(chars / 400000))::BIGINT AS coverage_runs FROM c)
 SELECT *, ceil(sections / 2)::BIGINT AS waves, (ceil(sections / 2) + global_runs + coverage_runs) * 180 AS low_s, (ceil(sections / 2) + global_runs + coverage_runs) * 360 AS high_s FROM r""")  # fmt: skip
def estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, waves and time per topic."""
    return L.estimate(table(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("n_chars").alias("chars")))


def _keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("key"))
    new = c.where("id % 7 <> 0").withColumn("key", F.when(F.col("id") % 5 == 0, F.concat("key", F.lit("!"))).otherwise(F.col("key")))
    return c.where("id % 11 <> 0"), new


@query("source_changes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE (c_custkey % 11 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0)")
def source_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Sources added, removed or changed between two builds."""
    return M.changes(*_keys(spark, sf))


@query("issued_ids", "SELECT o_orderkey AS seq, o_orderstatus AS letter, (SELECT max(o_orderkey) FROM orders u WHERE u.o_orderstatus = o.o_orderstatus AND u.o_orderkey % 10 = 1) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, o_orderstatus || ((SELECT max(o_orderkey) FROM orders u WHERE u.o_orderstatus = o.o_orderstatus AND u.o_orderkey % 10 = 1) + row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)) AS id FROM orders o WHERE o_orderkey % 10 = 2")
def issued_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that were never used."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("letter"), F.col("o_orderkey").alias("n"))
    return M.issued_ids(o.where("n % 10 = 1"), o.where("n % 10 = 2").select("letter", F.col("n").alias("seq")))


@query("stale_stages", """WITH r AS (SELECT n_nationkey AS k, n_nationkey % 4 <> 0 AS ok, n_nationkey % 6 <> 0 AS output, CASE WHEN n_nationkey % 3 = 0 THEN 'old' ELSE 'x' END AS up FROM nation)
 SELECT 's' || k AS stage, CASE WHEN NOT ok THEN 'error' WHEN NOT output OR (k > 0 AND up <> 'x') THEN 'stale' ELSE 'fresh' END AS state FROM r""")  # fmt: skip
def stale_stages(spark: SparkSession, sf: str) -> DataFrame:
    """State of each stage (a nation in that role)."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    runs = n.select(name(F.col("k")).alias("stage"), (F.col("k") % 4 != 0).alias("ok"), (F.col("k") % 6 != 0).alias("output"), F.create_map(name(F.col("k") - 1), F.when(F.col("k") % 3 == 0, "old").otherwise("x")).alias("upstream"))
    return M.stale_stages(runs, n.select(name(F.col("k")).alias("stage"), F.lit("x").alias("key")))


@query("page_titles", "SELECT page_id, nullif(substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 300), '') AS title, nullif(lower(regexp_extract(html, '(?i)<meta[^>]*charset\\s*=\\s*[\"'']?([A-Za-z0-9_-]+)', 1)), '') AS charset FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title and declared charset of each page."""
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_charset(F.col("html")).alias("charset"))


@query("page_links", "WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, unnest(range(len(l))) AS n, unnest(l) AS href FROM l")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of each page in order."""
    return S.links(table(spark, sf, "pages"))


@query("page_main_text")
def page_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of each page."""
    return S.web_markdown(table(spark, sf, "pages").select("page_id", "html"))


@query("url_keys", "SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', '') || regexp_replace(regexp_replace(u, '^[^/?]*', ''), '/(\\?|$)', '\\1') AS key, CASE WHEN regexp_matches(url, '\\.(mp4|mkv|webm|avi|mov)$') THEN 'video' ELSE 'web' END AS kind FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^(?i)www\\.', '') AS u FROM pages)")
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison key and kind of each URL."""
    return table(spark, sf, "pages").select("page_id", T.url_key(F.col("url")).alias("key"), T.url_kind(F.col("url")).alias("kind"))


@query("slugs")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Slug, title and display form of names (tests hold the expected slugs)."""
    p = table(spark, sf, "pages")
    return p.select("page_id", T.slugify(T.html_title(F.col("html"))).alias("slug"), T.human_title(T.file_name(F.col("url"))).alias("name"), T.url_display(F.col("url")).alias("display"), T.url_problem(F.col("url")).alias("problem"))


@query("human_numbers", "SELECT p_partkey, CASE WHEN p_retailprice::BIGINT < 1024 THEN printf('%d B', p_retailprice::BIGINT) ELSE printf('%.1f KB', round_even(p_retailprice::BIGINT / 1024, 1)) END AS size FROM part")
def human_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes for readers."""
    return table(spark, sf, "part").select("p_partkey", T.human_size(F.bround("p_retailprice").cast("long")).alias("size"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 5 HOURS, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 5 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 5 HOURS AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    """T5: event-time windows of five hours; the stream gives the same rows."""
    return U.windowed(table(spark, sf, "events"), by=("event_type",)).withColumn("total", F.round("total", 6))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", count(*) AS n FROM r GROUP BY user_id, run""")  # fmt: skip
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """T5: sessions that end after two hours."""
    return U.sessions(table(spark, sf, "events"))
