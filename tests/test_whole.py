"""Queries over whole tables against plain models: no subset of ids, no rows left out."""

import math
import re

from pyspark.sql import functions as F

from selvage.plans import registry
from selvage.tables import table

SF = "/root/testdata/sf0.01"


def test_kept_groups_and_natural_order(spark):
    orders = sorted(table(spark, SF, "orders").select("o_orderkey", "o_totalprice").collect())
    size = {pos: math.floor(price / 1000) for pos, (_, price) in enumerate(orders, 1)}
    groups, late = {}, {}
    for pos in size:
        groups.setdefault(pos // 3, []).append(pos)
        late.setdefault(10**12 + (pos + 1) // 3, []).append(pos)
    fits = lambda m: len(m) == 1 or sum(size[p] for p in m) <= 400
    want, taken = [], set()
    for g, m in [(g, m) for g, m in groups.items() if all(p % 17 for p in m)] + list(late.items()):
        if fits(m) and not taken & set(m):
            taken |= set(m)
            want.append((g, m[0], m[-1], len(m), sum(size[p] for p in m)))
    got = registry.QUERIES["kept_groups"](spark, SF).collect()
    assert sorted((r.grp, r["first"], r["last"], r.n, r.z) for r in got) == sorted(want)
    keys = sorted(r[0] for r in table(spark, SF, "customer").select("c_custkey").collect())
    assert sorted(map(tuple, registry.QUERIES["natural_order"](spark, SF).collect())) == list(zip(keys, range(1, len(keys) + 1), strict=True))


def test_formulas_comments_percents_and_nulls_stay(spark, tmp_path):
    texts = {1: "Prix élevé $à^2$ fin", 2: None, 3: "a <!-- src: S1.b001 --> b $$x + y$$ c", 4: "é" * 100, 5: "$5 sans fin", 6: "12"}
    docs = [(i, t, "s") for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    math_ = r"(?s)\$\$.*?\$\$|\$[^$\n]*\$"
    want = {}
    for i, t in texts.items():
        s = re.sub(math_, " ", t or "")
        letters = [c for c in s if c.isalpha()]
        want[i] = round(sum("à" <= c <= "ÿ" for c in letters) / len(letters), 3) if letters else None
    assert {r.doc_id: r.share for r in run("letter_shares")} == want
    size = {i: len(re.sub(r"\s", "", re.sub(r"(?s)<!--.*?-->", "", t))) for i, t in texts.items() if t}
    got = {int(r.id[1:].split(".")[0]): (r["size"], r.snippet) for r in run("text_measures")}
    assert {i: z for i, (z, _) in got.items()} == size
    assert [got[1][1], got[4][1], got[5][1]] == ["Prix élevé … fin", "é" * 79 + "…", "$5 sans fin"]
    pages = [(1, "http://www.E.org/a%20b/"), (2, None), (3, "https://e.org:443/%C3%A9?q=%26"), (4, "http://e.org/50%/x"), (5, "http://e.org/a+b")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.key for r in run("url_keys")} == {1: "e.org/a b", 2: None, 3: "e.org/é?q=&", 4: "e.org/50%/x", 5: "e.org/a+b"}


def test_srt_times_keep_every_segment(spark, monkeypatch):
    from selvage.plans import base

    at = [0.0, 1.999, 5.9993, 5.9997, 3599.9994, 3599.9996, 7.0665]
    data = spark.createDataFrame(list(enumerate(at)), "pos int, start double").selectExpr("1 AS rec", "pos", "start")
    monkeypatch.setattr(base, "segments", lambda *_: data)
    got = {r.pos: (r.t, r.clock) for r in registry.QUERIES["srt_times"](spark, "").collect()}
    for i, s in enumerate(at):
        ms = math.floor(s * 1000 + 0.5)
        h, m, x = ms // 3600000, ms // 60000 % 60, ms // 1000 % 60
        assert got[i] == (f"{h:02d}:{m:02d}:{x:02d},{ms % 1000:03d}", f"{h}:{m:02d}:{x:02d}" if h else f"{m:02d}:{x:02d}")


def test_last_of_several_labels_wins(spark, tmp_path):
    data = [(1, 0, 0), (2, 1, 0), (1, 1, 1), (3, None, 1), (1, 0, 1), (3, 1, None)]
    spark.createDataFrame(data, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, registry.QUERIES["last_verdicts"](spark, str(tmp_path)).collect())) == [(1, 0, 1), (2, 1, 0), (3, 1, None)]


def test_rejected_groups_claim_nothing(spark):
    """Overlapping groups in turn: what was rejected or comes later takes no place."""
    from selvage.operators import packing

    items = spark.createDataFrame([(i, i, 1) for i in range(1, 3000)], "id int, pos int, size int")
    groups = [(2, 4), (4, 6), (5, 8), (12, 13), (9, 11), (1, 1), (1020, 1030), (1025, 1026), (1023, 1024), (2500, 2510), (2511, 2512)]
    prev = spark.createDataFrame([(g, k, p) for g, (a, b) in enumerate(groups) for k, p in enumerate(range(a, b + 1))], "grp int, ord int, id int")
    want, taken = [], set()
    for g, (a, b) in enumerate(groups):
        if not taken & set(range(a, b + 1)):
            taken |= set(range(a, b + 1))
            want.append(g)
    assert sorted(r.grp for r in packing.kept_groups(items, prev, 100, 20).collect()) == want


def test_roots_of_duplicates_are_transitive(spark):
    """A chain of boards, each like the one before only, has one root."""
    from selvage.operators import signals

    frames = spark.createDataFrame([(1, i, i) for i in range(9)], "rec int, ord int, epoch int")
    near = frames.alias("a")
    assert near.count() == 9
    monkey = signals.ink_distance
    try:
        signals.ink_distance = lambda a, b: F.abs(a - b).cast("double") / 10
        boards = frames.withColumn("ink", F.col("ord"))
        got = {r.ord: (r.dup, r.root) for r in signals.earlier_duplicates(boards, 0.1).collect()}
    finally:
        signals.ink_distance = monkey
    assert got == {i: (i - 1, 0) for i in range(1, 9)}


def test_slide_matches_compare_every_pair_in_blocks(spark, monkeypatch):
    """Several blocks of both sides against the pairs one by one; ties, nulls, odd lengths and values that are no numbers."""
    from selvage.operators import signals

    f = spark.createDataFrame(
        [(i, [abs(math.sin(i * 7 + k)) for k in range(5)], [math.cos(i * 5 + k * k) for k in range(5)], (i * 2654435761) % 2**16) for i in range(120)]
        + [(200, None, [1.0], 1), (201, [1.0, None], [1.0, 2.0], 1), (202, [1.0], [None], 1), (203, [math.nan], [1.0], 1), (204, [2.0], [1.0], None), (205, [2.0], [1.0], 3), (206, [2.0], [1.0], 3), (207, [math.inf], [1.0], 3), (None, [2.0], [1.0], 3)],
        "id bigint, ink array<double>, z array<double>, hash bigint",
    )
    refs = f.where("id % 3 = 0 OR id > 200")
    r = refs.select(F.col("id").alias("slide"), *(F.col(c).alias(f"r_{c}") for c in ("ink", "z", "hash")))
    pairs = f.join(r, signals.hamming(F.col("hash"), F.col("r_hash")) <= 9)
    pairs = pairs.withColumns({"d": signals.ink_distance(F.col("ink"), F.col("r_ink")), "c": signals.correlation(F.col("z"), F.col("r_z"))}).where("d <= 0.6 AND c >= 0.1").withColumn("cost", F.expr("d + 1 - c"))
    want = pairs.groupBy("id").agg(F.min_by("slide", F.struct("cost", "slide")), F.min("cost")).collect()
    for name, size in (("FRAMES", 16), ("SLIDES", 8), ("ROWS", 3), ("PAIRS", 7)):
        monkeypatch.setattr(signals, name, size)
    got = signals.slide_matches(f, refs, ink=0.6, corr=0.1, bits=9)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want))) and len(want) > 50
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
