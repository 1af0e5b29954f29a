"""Queries over recordings, signals and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import text as T
from selvage.operators import packing as P
from selvage.operators import signals as S
from selvage.operators import timeline as L
from selvage.plans import base
from selvage.plans.base import SEGMENTS
from selvage.plans.registry import query
from selvage.tables import table


@query("segments", f"WITH {SEGMENTS} SELECT rec, pos, start, \"end\", length(text) AS chars FROM segments")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in the role of transcripts."""
    return base.segments(spark, sf).select("rec", "pos", "start", "end", F.length("text").alias("chars"))


@query("srt_times", f"""WITH {SEGMENTS}, m AS (SELECT rec, pos, round(start * 1000)::BIGINT AS ms FROM segments)
 SELECT rec, pos, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS t,
 CASE WHEN ms // 3600000 > 0 THEN printf('%d:%02d:%02d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60) ELSE printf('%02d:%02d', ms // 60000, (ms // 1000) % 60) END AS clock FROM m""")  # fmt: skip
def srt_times(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle and clock times."""
    return base.segments(spark, sf).select("rec", "pos", T.srt_time(F.col("start")).alias("t"), T.clock(F.round(F.col("start") * 1000) / 1000).alias("clock"))


@query("subtitles")
def subtitles(spark: SparkSession, sf: str) -> DataFrame:
    """The subtitle file of each recording."""
    return L.srt(base.segments(spark, sf), "rec")


_SECTIONS = f"""{SEGMENTS}, dur AS (SELECT rec, max("end") AS d FROM segments GROUP BY rec),
 sec AS (SELECT rec, n, n * 20.0 AS start, least((n + 1) * 20.0, d) AS "end" FROM (SELECT rec, d, unnest(range(0, greatest(ceil(d / 20.0), 1)::BIGINT)) AS n FROM dur))"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return L.sections_by_time(base.segments(spark, sf).groupBy("rec").agg(F.max("end").alias("d")), "rec", "d", 20.0)


@query("sections_by_time", f"WITH {_SECTIONS} SELECT rec, n, start, \"end\" FROM sec")
def sections_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of fixed length."""
    return _sections(spark, sf)


@query("paragraph_asof_section", f"WITH {_SECTIONS} SELECT s.rec, s.pos, (SELECT max(n) FROM sec WHERE sec.rec = s.rec AND sec.start <= s.start + 0.000001) AS n FROM segments s")
def paragraph_asof_section(spark: SparkSession, sf: str) -> DataFrame:
    """Each segment's section by an as-of join."""
    return L.asof(base.segments(spark, sf).select("rec", "pos", "start"), _sections(spark, sf), "rec", "start", "start", "n").select("rec", "pos", "n")


@query("interval_overlaps", f"WITH {_SECTIONS} SELECT s.rec, s.pos AS a_id, c.n AS b_id FROM segments s JOIN sec c ON s.rec = c.rec AND c.\"end\" > s.start AND c.start < s.\"end\"")
def interval_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Segments and sections that overlap."""
    a = base.segments(spark, sf).select("rec", F.col("pos").alias("id"), "start", "end")
    return L.overlapping(a, _sections(spark, sf).withColumnRenamed("n", "id"), "rec", 20.0)


@query("longest_pauses", f"""WITH {SEGMENTS}, g AS (SELECT rec, start, round(start - lag("end") OVER (PARTITION BY rec ORDER BY start), 6) AS gap FROM segments)
 SELECT rec, max_by(start, gap * 1000 - start / 1000) AS cut, max(gap) AS gap FROM g WHERE gap IS NOT NULL AND abs(start - 30) <= 25 GROUP BY rec""")  # fmt: skip
def longest_pauses(spark: SparkSession, sf: str) -> DataFrame:
    """Where a recording is cut nearest to 30 s."""
    return L.longest_pause(base.segments(spark, sf), "rec", 30.0, 25.0)


@query("spoken_paragraphs")
def spoken_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs by a resetting fold (tests compare with a plain model)."""
    s = base.segments(spark, sf).select("rec", "start", "end", "text")
    return L.paragraphs(s, "rec", 2.0, 300)


@query("gaps_and_islands", "WITH d AS (SELECT DISTINCT user_id, event_id // 50 AS n FROM events), g AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY user_id ORDER BY n) <= 1 THEN 0 ELSE 1 END AS new FROM d), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(n) AS first, max(n) AS last, count(*) AS size FROM r GROUP BY user_id, run")
def gaps_and_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive fiftieths of the log in which a user is seen."""
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 50).alias("n"))
    return S.islands(e, ["user_id"], "n")


@query("page_lists", "WITH d AS (SELECT DISTINCT user_id, event_id // 50 AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM d), r AS (SELECT user_id, min(n) AS a, max(n) AS b FROM g GROUP BY user_id, run) SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY user_id")
def page_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Runs written as a list of spans."""
    return S.pages_list(gaps_and_islands(spark, sf), ["user_id"])


@query("hash63", """WITH e AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_aggregate(v, 'median') AS m FROM e)
 SELECT vec_id, list_sum([CASE WHEN v[i + 1] > m THEN (1::BIGINT << i::INT) ELSE 0 END for i in range(63)])::BIGINT AS hash FROM m""")  # fmt: skip
def hash63(spark: SparkSession, sf: str) -> DataFrame:
    """H2: 63-bit median hash of each vector."""
    return table(spark, sf, "embeddings").select("vec_id", S.median_hash(S.doubles(F.col("embedding"))).alias("hash"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = S.doubles(F.col("embedding"))
    return e.select(F.col("vec_id").alias("id"), "label", F.transform(v, lambda x: F.abs(x)).alias("ink"), S.zscores(v).alias("z"), S.median_hash(v).alias("hash"))


_INK = """i AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS ink FROM embeddings)"""


@query("ink_distances", f"""WITH {_INK} SELECT a.vec_id AS a, b.vec_id AS b,
 round(list_sum([abs(a.ink[k] - b.ink[k]) for k in range(1, 65)]) / greatest(list_sum(a.ink) + list_sum(b.ink), 1e-6), 6) AS d FROM i a JOIN i b ON b.vec_id = a.vec_id + 1""")  # fmt: skip
def ink_distances(spark: SparkSession, sf: str) -> DataFrame:
    """H4: ink distance of neighbouring frames."""
    f = _frames(spark, sf).select("id", "ink")
    g = f.select((F.col("id") - 1).alias("id"), F.col("ink").alias("next"))
    return f.join(g, "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.round(S.ink_distance(F.col("ink"), F.col("next")), 6).alias("d"))


@query("slide_matches")
def slide_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's best slide among every 50th vector, the stated references."""
    f = _frames(spark, sf)
    return S.slide_matches(f, f.where("id % 50 = 0"), ink=0.9, corr=0.1, bits=28)


@query("hamming_pairs", """WITH e AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, list_aggregate(v, 'median') AS m FROM e),
 h AS (SELECT vec_id, list_sum([CASE WHEN v[i + 1] > m THEN (1::BIGINT << i::INT) ELSE 0 END for i in range(63)])::BIGINT AS hash FROM m)
 SELECT r.vec_id AS ref, count(*) FILTER (WHERE bit_count(xor(h.hash, r.hash)) <= 24) AS near, min(bit_count(xor(h.hash, r.hash))) FILTER (WHERE h.vec_id <> r.vec_id) AS nearest FROM h, h r WHERE r.vec_id % 100 = 0 GROUP BY r.vec_id""")  # fmt: skip
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """H3: neighbours by hash of every 100th vector, a stated query set against all rows."""
    h = hash63(spark, sf)
    r = h.where("vec_id % 100 = 0").select(F.col("vec_id").alias("ref"), F.col("hash").alias("rh"))
    j = h.join(r, F.lit(True)).select("ref", "vec_id", S.hamming(F.col("hash"), F.col("rh")).alias("d"))
    return j.groupBy("ref").agg(F.count_if(F.col("d") <= 24).alias("near"), F.min(F.when(F.col("vec_id") != F.col("ref"), F.col("d"))).alias("nearest"))


@query("board_duplicates")
def board_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier near-equal boards of other epochs within recordings of 100 frames."""
    f = _frames(spark, sf)
    b = f.select(F.floor(F.col("id") / 100).alias("rec"), F.col("id").alias("ord"), F.floor(F.col("id") / 5).alias("epoch"), "ink")
    return S.earlier_duplicates(b, 0.45)


@query("sliding_extremes", """SELECT event_id, min(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trail_min, min(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS centred_min,
 max(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS lead_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""".replace("(w ROWS", "(PARTITION BY user_id ORDER BY event_id ROWS").replace(" WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", ""))  # fmt: skip
def sliding_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing and centred minima and leading maxima."""
    return S.sliding(table(spark, sf, "events"), "user_id", "event_id", "value", 5).select("event_id", "trail_min", "centred_min", "lead_max")


@query("local_maxima", "SELECT event_id, value FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM events) WHERE value >= 0.35 AND value >= m")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary candidates."""
    return S.candidates(table(spark, sf, "events"), "user_id", "event_id", "value", 3).select("event_id", "value")


@query("signal_percentiles", "SELECT event_type, quantile_cont(value, 0.2) AS p20, median(value) AS med FROM events GROUP BY event_type")
def signal_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The template share (20th percentile) and the median."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", 0.2).alias("p20"), F.median("value").alias("med"))


@query("key_frames")
def key_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Key frame of each epoch of 20 events of a user (tests compare with a plain model)."""
    e = table(spark, sf, "events").select(F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 500)).alias("epoch"), F.col("event_id").alias("t"), F.col("value").alias("ink"), (F.col("event_id") % 7 / 10.0).alias("occlusion"))
    return S.key_frames(e, "epoch")


@query("erased_boards")
def erased_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Erasures of each user's ink, those close together merged."""
    e = table(spark, sf, "events")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x.value)
    per = e.groupBy("user_id").agg(rows.alias("ink")).withColumn("at", S.erasures(F.col("ink")))
    marks = F.transform("at", lambda t: F.struct(t.alias("t"), F.get("ink", t).alias("s")))
    return per.select("user_id", F.size("at").alias("erasures"), F.size(S.merged(marks, 3)).alias("kept"))


@query("fixed_batches", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders")
def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of four orders of a customer."""
    return P.fixed_batches(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 4)


@query("packed_orders", """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, floor(o_totalprice / 1000)::BIGINT AS z, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
 f AS (SELECT c, k, z AS size, i, 0 AS g, 1 AS n, z AS t FROM o WHERE i = 1
  UNION ALL SELECT o.c, o.k, o.z, o.i, CASE WHEN f.n >= 4 OR f.t + o.z > 300 OR f.t > 300 THEN f.g + 1 ELSE f.g END, CASE WHEN f.n >= 4 OR f.t + o.z > 300 OR f.t > 300 THEN 1 ELSE f.n + 1 END,
   CASE WHEN f.n >= 4 OR f.t + o.z > 300 OR f.t > 300 THEN o.z ELSE f.t + o.z END FROM f JOIN o ON o.c = f.c AND o.i = f.i + 1)
 SELECT c AS o_custkey, k AS o_orderkey, size, g AS "group" FROM f""")  # fmt: skip
def packed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive orders of a customer packed by size and number."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("size"))
    return P.packed(o, ["o_custkey"], "o_orderkey", "size", 300, 4)


@query("kept_groups", """WITH i AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS pos, floor(o_totalprice / 1000) AS size FROM orders),
 p AS (SELECT pos // 3 AS grp, pos AS ord, CASE WHEN pos % 17 = 0 THEN -1 ELSE id END AS id FROM i
       UNION ALL SELECT 1000000000000 + (pos + 1) // 3, pos, id FROM i),
 m AS (SELECT grp, count(*) AS n, count(i.id) AS known, sum(size) AS z, min(i.pos) AS first, max(i.pos) AS last FROM p LEFT JOIN i USING (id) GROUP BY grp),
 v AS (SELECT grp, first, last, n, z::BIGINT AS z FROM m WHERE known = n AND n <= 4 AND (n = 1 OR z <= 400)),
 a AS (SELECT * FROM v WHERE grp < 1000000000000), b AS (SELECT * FROM v WHERE grp >= 1000000000000),
 taken AS (SELECT unnest(range(first, last + 1)) AS pos FROM a), free AS (SELECT *, unnest(range(first, last + 1)) AS pos FROM b)
 SELECT * FROM a UNION ALL SELECT grp, first, last, n, z FROM free f LEFT JOIN taken t ON f.pos = t.pos GROUP BY ALL HAVING count(t.pos) = 0""")  # fmt: skip
def kept_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Previous groups of three that are still valid (every 17th member vanished), then groups of three one place on where these left room."""
    o = P.numbered(table(spark, sf, "orders"), F.floor(F.col("o_orderkey") / 4096), "o_orderkey", "pos")
    items = o.select(F.col("o_orderkey").alias("id"), "pos", F.floor(F.col("o_totalprice") / 1000).alias("size"))
    prev = items.select(F.floor(F.col("pos") / 3).alias("grp"), F.col("pos").alias("ord"), F.when(F.col("pos") % 17 == 0, -1).otherwise(F.col("id")).alias("id"))
    later = items.select((F.lit(10**12) + F.floor((F.col("pos") + 1) / 3)).alias("grp"), F.col("pos").alias("ord"), "id")
    return P.kept_groups(items, prev.unionByName(later), 400, 4)


@query("chunk_cuts")
def chunk_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts of each recording into chunks (its times stretched sixtyfold)."""
    s = base.segments(spark, sf).select("rec", (F.col("start") * 60).alias("start"), (F.col("end") * 60).alias("end"))
    per = s.groupBy("rec").agg(F.max("end").alias("d"), F.array_sort(F.collect_list("start")).alias("starts"))
    cuts = P.chunk_cuts(F.filter("starts", lambda x: F.pmod(F.floor(x), F.lit(2)) == 0), F.col("d"), F.transform("starts", lambda x: F.struct(F.pmod(x, F.lit(7.0)).alias("gap"), x.alias("start"))))
    return per.select("rec", "d", cuts.alias("cuts"))
