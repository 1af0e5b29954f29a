"""Requests, notes, queues, glyphs and images against plain models."""

import math
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from selvage.functions import glyphs, images
from selvage.operators import queues, requests


def _events(n, seed):
    rng = random.Random(seed)
    at = 0
    for seq in range(n):
        at += rng.randrange(4)
        yield {"queue": rng.choice([1, 1, 1, 2, None]), "seq": seq, "at": at, "topic": rng.choice(["a", "b", "c", None]), "seconds": rng.randrange(9), "five": rng.choice([0.0, 0.25, 0.5]), "week": rng.choice([0.0, 0.01])}


SCHEMA = "queue long, seq long, at long, topic string, seconds long, five double, week double"


def test_scheduled(spark):
    jobs = list(_events(300, 1))
    want, by_queue = {}, defaultdict(list)
    for j in jobs:
        by_queue[j["queue"]].append(j)
    for q in by_queue.values():
        ran = []  # (topic, start, end)
        for j in q:
            if any(t == j["topic"] and end > j["at"] for t, _, end in ran):
                want[j["seq"]] = ("busy", None)
                continue
            begin = j["at"]
            begin = max([begin] + [s for _, s, _ in ran])  # first come, first served
            while sum(s <= begin < e for _, s, e in ran) >= 2:
                begin += 1
            ran.append((j["topic"], begin, begin + j["seconds"]))
            want[j["seq"]] = ("done", begin)
    rows = spark.createDataFrame([tuple(j.values()) for j in jobs], SCHEMA).repartition(5)
    assert {r.seq: (r.status, r.start) for r in queues.scheduled(rows).collect()} == want
    assert queues.scheduled(rows.limit(0)).count() == 0


def test_paced_run(spark):
    items = [dict(i, seconds=i["seconds"] * 600) for i in _events(200, 2)]
    state, want = {}, {}
    for i in items:
        s = state.setdefault(i["queue"], [0, 0.0, 0.0, None])
        came = s[0]
        if s[3] is not None and s[0] >= s[3]:
            s[1], s[3] = 0.0, None
        if s[2] >= 0.95:
            want[i["seq"]] = ("paused", None, 0)
            continue
        if s[1] >= 0.9:  # a window is shorter than the longest wait
            s[0], s[1], s[3] = s[3] + 60, 0.0, None
        want[i["seq"]] = ("done", s[0], s[0] - came)
        s[3] = s[0] + 18000 if s[3] is None else s[3]
        s[0], s[1], s[2] = s[0] + i["seconds"], s[1] + i["five"], s[2] + i["week"]
    rows = spark.createDataFrame([tuple(i.values()) for i in items], SCHEMA).repartition(5)
    got = {r.seq: (r.status, r.start, r.waited) for r in queues.paced_run(rows).collect()}
    assert got == want and any(w > 0 for _, _, w in got.values())


def test_cooling_ends(spark):
    marks = spark.createDataFrame([("a", 1, "limit"), ("a", 2, None), ("b", 1, None), ("b", 2, "auth"), ("c", 1, None)], "backend string, seq int, reason string")
    assert [tuple(r) for r in queues.cooling(marks).collect()] == [("b", "auth")]


def test_conflicts(spark):
    docs = ['{"variants": ["  x ", {"text": "{y}", "anchor": " [[S1:p2]] "}, "", null, "{z}", 7], "resolution": " "}', '{"variants": "no list", "section": " s2 "}', "no json", None, "[]"]
    rows = spark.createDataFrame(list(enumerate(docs)), "k int, json string").withColumn("section", F.lit("s1"))
    got = {r.k: r for r in requests.conflicts(rows, "k").collect()}
    assert [tuple(v) for v in got[0].variants] == [("", "x"), ("S1:p2", "{y}"), ("", "{z}"), ("", "7")] and got[0].resolution is None
    assert got[1].section == "s2" and all(got[k].variants == [] for k in (1, 2, 3, 4))
    assert {r.k: (r.section, r.block) for r in requests.corrections(rows, "k").collect()}[2] == ("s1", "")


def test_repaired_refs(spark):
    blocks = spark.createDataFrame([("P1.b007", "P1:x"), ("P1.b007", "P1:z"), ("P1.b1234", "P1:y")], "id string, anchor string")
    texts = [(1, "[[P1:b7]][[P1.b007]] [[P1:b1234]]"), (1, "[[P2:b1]] "), (None, " [[P1.b0007]] $1 \\"), (2, None), (3, ""), (4, "[[p1:b7]] [[P1:b123456]]")]
    got = requests.repaired_refs(spark.createDataFrame(texts, "k int, text string"), blocks, "k").collect()
    want = [(1, "[[P1:x]][[P1:x]] [[P1:y]]"), (1, "[[P2:b1]]"), (None, "[[P1:x]] $1 \\"), (2, None), (3, ""), (4, "[[p1:b7]] [[P1:b123456]]")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_wide_codec(spark):
    data = [b"plain", "Wide text, 12".encode("utf-16-le"), "Wide text, 12".encode("utf-16-be"), "x".encode("utf-32"), "é".encode("utf-16"), bytes(range(256)) * 4, b"\0", b"", None, ("ab c" + "😀").encode("utf-16-le")[:-2], b"\0" * 40]
    got = spark.createDataFrame(list(enumerate(data)), "i int, b binary").select("i", glyphs.wide_codec(F.col("b")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [None, "utf-16-le", "utf-16-be", "utf-32", "utf-16", "", "", None, None, "utf-16-le", ""]


def test_images(spark):
    rng = random.Random(3)
    small = [rng.random() for _ in range(35)]
    big = [rng.randrange(256) * 1.0 for _ in range(4096)]
    df = spark.createDataFrame([(small, big)], "m array<double>, t array<double>").unionAll(spark.createDataFrame([(None, [1.0])], "m array<double>, t array<double>"))
    soft, mean, crop, bits = (images.softened(F.col("m"), (5, 7)), images.area_mean(F.col("m"), (5, 7), (2, 3)), images.cropped(F.col("m"), (5, 7), (0.3, 0.0, 0.31, 0.5)), images.perceptual_hash(F.col("t")))
    got = df.select(soft.alias("soft"), mean.alias("mean"), crop.alias("crop"), bits.alias("hash")).collect()
    assert list(got[1]) == [None] * 4
    at = lambda r, c: small[min(max(r, 0), 4) * 7 + min(max(c, 0), 6)]
    want = [sum(at(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9 for r in range(5) for c in range(7)]
    assert max(abs(a - b) for a, b in zip(got[0].soft, want, strict=True)) < 1e-9
    assert got[0].crop == [at(r, 2) for r in range(3)]
    # by area: every cell split into 2 x 3 parts
    part = lambda y, x: at(y // 2, x // 3)
    want = [sum(part(y, x) for y in range(5 * i, 5 * i + 5) for x in range(7 * j, 7 * j + 7)) / 35 for i in range(2) for j in range(3)]
    assert max(abs(a - b) for a, b in zip(got[0]["mean"], want, strict=True)) < 1e-9
    half = [[sum(big[(2 * y + a) * 64 + 2 * x + b] for a in (0, 1) for b in (0, 1)) / 4 for x in range(32)] for y in range(32)]
    wave = [[math.cos(math.pi * k * (2 * i + 1) / 64) * math.sqrt((1 if k == 0 else 2) / 32) for i in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * half[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)][1:]
    assert got[0].hash == sum(1 << i for i, z in enumerate(low) if z > statistics.median(low))
