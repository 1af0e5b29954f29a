"""The stream gives the rows of the batch."""

from selvage.streaming import usage as U
from selvage.tables import table

SF = "/root/testdata/sf0.001"


def test_windows_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(4)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    events.write.parquet(src)
    stream = U.follow(spark, src, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", "parquet", 1)
    q = U.windowed(stream, "5 hours", late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, U.windowed(events, "5 hours").collect()))


def test_exactly_once_and_resume(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = spark.range(20).selectExpr("id AS event_id", "timestamp_seconds(1000000 + id) AS ts")
    for _ in range(2):
        rows.write.mode("append").parquet(src)
        U.run_available(U.deduplicated(U.follow(spark, src, "event_id bigint, ts timestamp", "parquet")), out, cp)
    assert spark.read.parquet(out).count() == 20


def test_stream_state(spark):
    """The last line that names a model, or limits, decides, not the greatest name."""
    lines = [
        '{"session": "a", "seq": 1, "type": "message", "model": "z"}', "broken", '{"session": "a", "seq": 4, "type": "rate_limit", "limits": {"five_hour": 0.9}}',
        '{"session": "a", "seq": 3, "type": "message", "model": "m", "limits": {"five_hour": 0.5}}', '{"session": "b", "type": "error"}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.session: (r.lines, r.retries, r.fatal, r.model, r.limits) for r in U.stream_state(U.parsed(df)).collect()}
    assert got == {"a": (3, 1, False, "m", {"five_hour": 0.9}), "b": (1, 0, True, None, None)}
