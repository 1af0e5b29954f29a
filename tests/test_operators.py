"""Relational operators: fixtures as data, and plain Python models for the folds."""

import random

from pyspark.sql import functions as F

from selvage.operators import blocks, coverage, ledger, manifest, packing, signals, timeline
from selvage.sources import files


def test_coverage_fixture(spark):
    ids = [f"S1.b00{i}" for i in range(1, 7)] + [f"P1.b00{i}" for i in range(1, 5)]
    rows = [(i.split(".")[0], i, "paragraph") for i in ids] + [("S1", "S1.b007", "admin"), ("Z1", "Z1.b001", "admin")]
    b = spark.createDataFrame(rows, "source string, id string, type string")
    s = spark.createDataFrame([("s1", "<!-- src: S1.b001, S1.b002 S1.b004 -->"), ("g", "<!-- src: S1.b005 S1.b006, P1.b002 P1.b003 -->")], "section string, md string")
    flags = coverage.flagged(b, coverage.citations(s))
    got = {r.source: (r.total, r.covered, r.ratio) for r in coverage.report(b, flags).collect()}
    assert got == {None: (10, 7, 0.7), "S1": (6, 5, 0.8333), "P1": (4, 2, 0.5), "Z1": (0, 0, 1.0)}
    assert [r.id for r in coverage.uncovered(flags).collect()] == ["P1.b001", "P1.b004", "S1.b003"]
    v = spark.createDataFrame([("S1.b003", 1, "missing", ""), ("S1.b003", 2, "duplicate", "n")], "block string, ord int, verdict string, note string")
    again = {r.source: r.covered for r in coverage.report(b, coverage.flagged(b, coverage.citations(s), v)).collect()}
    assert again[None] == 8


def test_packing_fixture(spark):
    def groups(sizes, most, count):
        df = spark.createDataFrame([(1, i, z) for i, z in enumerate(sizes)], "k int, i int, z bigint")
        rows = packing.packed(df, ["k"], "i", "z", most, count).orderBy("i").collect()
        out = {}
        for r in rows:
            out.setdefault(r.group, []).append(r.i)
        return [len(v) for _, v in sorted(out.items())]

    assert groups([5] * 10, 60_000, 4) == [4, 4, 2]
    assert groups([5] * 3, 60_000, 1) == [1, 1, 1]
    assert groups([30] * 5, 60, 4) == [2, 2, 1]
    assert groups([30] * 5, 59, 4) == [1] * 5
    assert groups([10, 100, 10, 10], 60, 4) == [1, 1, 2]


def test_deloop_fixture(spark):
    rows = [(0, "Продолжаем лекцию."), (1, "Субтитры сделал DimaTorzok"), (2, "   "), (3, "Да да да"), (4, "Да да да"), (5, "Да да да"), (6, "Да да да!"), (7, "Редактор субтитров А.Семкин Корректор А.Егорова"), (8, "Метод ближайших соседей.")]
    df = spark.createDataFrame([("r", *x) for x in rows], "k string, i int, t string")
    assert [r.i for r in timeline.delooped(df, "k", "i", "t").orderBy("i").collect()] == [0, 3, 4, 8]


def test_paragraph_fixture(spark):
    rows = [(0.0, 2.0, "Раз."), (2.5, 4.0, "Два."), (8.0, 9.0, "После паузы."), (9.2, 10.0, "Ещё.")]
    df = spark.createDataFrame([("r", *x) for x in rows], "k string, start double, end double, text string")
    got = [(r.start, r.text) for r in timeline.paragraphs(df, "k").orderBy("n").collect()]
    assert got == [(0.0, "Раз. Два."), (8.0, "После паузы. Ещё.")]


def test_paragraphs_against_model(spark):
    rng = random.Random(3)
    data = []
    for rec in range(5):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.1, 0.5, 2.5])
            text = "x" * rng.randint(1, 90) + rng.choice(["", ".", "!"])
            data.append((rec, round(t, 3), round(t + 1, 3), text))
            t += 1
    model = []
    for rec in range(5):
        now, chars, end = None, 0, 0.0
        for _, s, e, x in [r for r in data if r[0] == rec]:
            if now is None or s - end >= 2.0 or (chars >= 600 and now[2].rstrip().endswith((".", "?", "!", "…"))):
                now = [rec, s, x]
                model.append(now)
                chars = 0
            else:
                now[2] += " " + x
            chars, end = chars + len(x), e
    df = spark.createDataFrame(data, "k int, start double, end double, text string")
    got = [[r.k, r.start, r.text] for r in timeline.paragraphs(df, "k").orderBy("k", "n").collect()]
    assert got == model


def test_asof_and_overlap(spark):
    marks = spark.createDataFrame([("r", 1.0, "a"), ("r", 5.0, "b"), ("r", 9.0, "c")], "k string, start double, v string")
    rows = spark.createDataFrame([("r", 0.0), ("r", 1.0), ("r", 4.9999999), ("r", 100.0)], "k string, t double")
    assert {r.t: r.v for r in timeline.asof(rows, marks, "k", "t", "start", "v").collect()} == {0.0: "a", 1.0: "a", 4.9999999: "b", 100.0: "c"}
    rng = random.Random(1)
    mk = lambda n: [("r", i, s := rng.uniform(0, 900), s + rng.uniform(0.1, 400)) for i in range(n)]
    x, y = mk(30), mk(30)
    f = lambda d: spark.createDataFrame(d, "k string, id int, start double, end double")
    got = sorted((r.a_id, r.b_id) for r in timeline.overlapping(f(x), f(y), "k", 100.0).collect())
    assert got == sorted((i, j) for _, i, a, b in x for _, j, c, d in y if d > a and c < b)


def test_split_words(spark):
    w = [("r", 1, 10.0, 20.0, 10.0 + i, 10.9 + i, f"w{i}") for i in range(10)]
    df = spark.createDataFrame(w, "k string, seg int, seg_start double, seg_end double, start double, end double, text string")
    cut = lambda *t: timeline.split_words(df, spark.createDataFrame([("r", x) for x in t], "k string, t double"), "k").orderBy("part").collect()
    assert [r.words for r in cut(15.0)] == [5, 5]
    assert [r.words for r in cut(10.2, 19.9)] == [10]


def _autofill(rows):
    place, out = {p: s for p, _, s, _ in rows if s}, []
    order = [(p, i, m) for p, i, s, m in rows if m]
    for p, i, _ in order:
        prev = max((q for q in place if q < p), default=None)
        nxt = min((q for q in place if q > p), default=None)
        if prev is None and nxt is None:
            continue
        s = place[prev] if prev is not None and (nxt is None or p - prev <= nxt - p) else place[nxt]
        place[p] = s
        out.append((i, s))
    return out


def test_autofill_against_model(spark):
    rng = random.Random(7)
    data, model = [], []
    for src in range(8):
        rows = []
        for p in range(1, 40):
            kind = rng.choice(["placed", "missing", "admin", "missing"])
            rows.append((p, f"{src}.{p}", f"s{p}" if kind == "placed" and src else None, kind == "missing"))
        data += [(src, *r) for r in rows]
        model += _autofill(rows)
    df = spark.createDataFrame(data, "source int, pos int, id string, section string, missing boolean")
    assert sorted((r.id, r.section) for r in coverage.autofill(df).collect()) == sorted(model)
    n = spark.createDataFrame([(10,), (1000,)], "n int").select(coverage.autofill_limit("n").alias("m")).collect()
    assert [r.m for r in n] == [5, 30]


def test_structure_problems(spark):
    s = [(1, "s01", "A", 1, None), (2, "s01-01", "B", 2, "s01"), (3, "s02-01", "", 2, "s01"), (4, "x", "C", 1, None), (5, "s03", "D", 3, None), (6, "s04-01", "E", 2, None)]
    sec = spark.createDataFrame(s, "ord int, id string, title string, level int, parent string")
    a = spark.createDataFrame([("s01", "b1")], "section string, block string")
    got = {(r.rule, r.id) for r in coverage.structure_problems(sec, a).collect()}
    assert got == {("bad id", "x"), ("empty title", "s02-01"), ("parent prefix", "s02-01"), ("level", "s03"), ("no parent", "s04-01"), ("blocks above leaves", "s01")}


def test_ledger_fixture(spark):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1, 12)
    w = lambda **k: {n: (u, r) for n, (u, r) in k.items()}
    schema = "seq int, ts timestamp, limits struct<status:string,type:string,using_overage:boolean,windows:map<string,struct<utilization:double,resets_at:timestamp>>>"
    rows = [(1, t0 - dt.timedelta(hours=1), ("allowed", "five_hour", False, w(five_hour=(0.2, None), seven_day=(0.5, None)))), (2, t0, ("allowed", "five_hour", False, w(five_hour=(0.6, None)))), (3, t0, None)]
    last = ledger.latest_windows(spark.createDataFrame(rows, schema))
    assert {r.name: (r.utilization, r.seen_at) for r in last.collect()} == {"five_hour": (0.6, t0), "seven_day": (0.5, t0 - dt.timedelta(hours=1))}

    def pace(five, week, reset=None, status="allowed", now=t0):
        df = spark.createDataFrame([(1, t0, (status, "five_hour", False, w(five_hour=(five, reset), seven_day=(week, None))))], schema)
        r = ledger.pace(ledger.latest_windows(df), F.lit(now)).first()
        return r.action, r.until

    assert pace(0.89, 0.5)[0] == "go"
    assert pace(0.9, 0.5, t0 + dt.timedelta(minutes=30)) == ("wait", t0 + dt.timedelta(minutes=31))
    assert pace(0.99, 0.95)[0] == "stop"
    assert pace(0.97, 0.5, None, now=t0 + dt.timedelta(hours=5, minutes=2))[0] == "go"
    assert pace(0.5, 0.5, t0 + dt.timedelta(hours=1), "rejected")[0] == "wait"


def test_means_and_calibration(spark):
    u = [("outline", True, 100.0), ("outline", True, 200.0), ("outline", False, 9999.0), ("summary", True, 20.0), ("summary", True, 40.0)]
    m = ledger.stage_means(spark.createDataFrame(u, "stage string, ok boolean, duration_s double"))
    assert {r.stage: (r.mean_s, r.n) for r in m.collect()} == {"outline": (150.0, 2), "summary": (30.0, 2)}
    assert ledger.pooled_mean(m, 60.0).first().mean_s == 90.0
    none = ledger.pooled_mean(m.where("n > 99"), 60.0).first()
    assert (none.mean_s, none.measured) == (60.0, False)
    c = spark.createDataFrame([("g", "l", 1200.0, 60.0), ("g", "l", 1200.0, 180.0), ("g", "l", 19.0, 5.0)], "device string, model string, audio_seconds double, wall_seconds double")
    r = ledger.calibration(c).first()
    assert (r.seconds_per_minute, r.runs) == (6.0, 2)
    e = spark.createDataFrame([("a", 0), ("b", 115_466), ("c", 1_000_000)], "topic string, chars bigint")
    assert {r.topic: (r.sections, r.global_runs, r.coverage_runs) for r in ledger.estimate(e).collect()} == {"a": (1, 1, 1), "b": (11, 1, 1), "c": (96, 3, 3)}


def test_signals(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.0, 0.0, 5.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(signals.ink_distance(F.col("a"), F.col("b")).alias("same"), signals.correlation(signals.zscores(F.col("a")), signals.zscores(F.col("b"))).alias("corr"), signals.median_hash(F.col("a")).alias("h"), signals.hamming(F.lit(5), F.lit(6)).alias("d")).first()
    assert r.same == 0.0 and abs(r.corr - 1) < 1e-4 and r.h == 4 and r.d == 2
    ink = spark.createDataFrame([([0.1, 0.5, 0.9, 0.3, 0.31, 0.05],)], "v array<double>").select(signals.erasures(F.col("v")).alias("e")).first().e
    assert ink == [3, 5]
    rows = spark.createDataFrame([(1, n) for n in (3, 4, 5, 9, 12, 13)], "k int, n int")
    assert signals.pages_list(signals.islands(rows, ["k"], "n"), ["k"]).first().pages == "3–5, 9, 12–13"


def test_key_frame_model(spark):
    rng = random.Random(5)
    data = [(e, t, round(rng.random(), 3), round(rng.random() / 10, 3)) for e in range(6) for t in range(rng.randint(1, 30))]
    want = {}
    for e in range(6):
        tail = [r for r in data if r[0] == e][-15:]
        if len(tail) < 3:
            want[e] = tail[-1][1]
            continue
        peak = max(r[2] for r in tail)
        near = [r for r in tail if r[2] >= 0.9 * peak]
        low = min(r[3] for r in near)
        want[e] = max((r for r in near if r[3] <= low + 0.01), key=lambda r: (r[2], r[1]))[1]
    df = spark.createDataFrame(data, "k int, t int, ink double, occlusion double")
    assert {r.k: r.t for r in signals.key_frames(df, "k").collect()} == want


def test_chunks(spark):
    starts = [float(x) for x in range(0, 1800, 150)]
    df = spark.createDataFrame([(starts, 1800.0, [(1.0, s) for s in starts])], "s array<double>, d double, p array<struct<gap:double,start:double>>")
    assert df.select(packing.chunk_cuts(F.col("s"), F.col("d"), F.col("p")).alias("c")).first().c == [600.0, 1200.0]


def test_manifest(spark):
    k = lambda rows: spark.createDataFrame(rows, "id string, key string")
    old, new = k([("a", "1"), ("b", "2"), ("c", "3")]), k([("a", "1"), ("b", "9"), ("d", "4")])
    assert {r.id: r.change for r in manifest.changes(old, new).collect()} == {"b": "changed", "c": "removed", "d": "added"}
    assert manifest.review_gate(old, new, True, None, True).first().open is False
    assert manifest.review_gate(old, old, True, None, True).first().open is True
    s = spark.createDataFrame([("A1", 1, "x", "u"), ("A2", 2, "x", "v"), ("A3", 3, "y", "u"), ("A4", 4, None, None)], "id string, seq int, sha256 string, url_key string")
    assert {r.id: r["of"] for r in manifest.duplicate_sources(s).collect()} == {"A2": "A1", "A3": "A1"}


def test_page_classes(spark):
    base = dict(chars=800, visible_chars=800, garbled=0, all_pictures=0.0, visual=0.0, full_image=0.0, repeated=False, pictures=0, small_pictures=0, vectors=0, invisible=False, ocr_font=False, math_font=0, math_glyphs=0, slides=False)  # noqa: C408

    def kind(**k):
        return spark.createDataFrame([base | k]).select(manifest.classify_pages().alias("k")).first().k

    assert [kind(), kind(chars=0, visible_chars=0), kind(math_glyphs=7), kind(math_glyphs=8), kind(math_font=2), kind(math_font=3)] == ["text", "text", "text", "math", "text", "math"]
    assert [kind(garbled=400), kind(small_pictures=2), kind(small_pictures=3), kind(visual=0.4, chars=200), kind(visual=0.12, slides=True), kind(visual=0.08, slides=True)] == ["scan", "text", "graphic", "graphic", "graphic", "text"]


def test_fences_and_headings(spark):
    lines = ["# A {#a}", "```", "# not {#b}", "```", "## C {#c}", "### A2 {#a}"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "k string, i int, line string")
    assert {r.anchor: r.level for r in blocks.heading_anchors(df, "k", "i").collect()} == {"a": 3, "c": 2}
    assert [r.title for r in blocks.ancestors(df, "k", "i", "line").collect()] == ["C {#c}"]


def test_files(spark, tmp_path):
    p = str(tmp_path / "blocks")
    b = spark.createDataFrame([("S1", 1, "S1.b001", "paragraph", None, "é", "é", None), ("S1", 2, "S1.b001", "paragraph", None, "later", "", None)], files.BLOCK)
    files.write_blocks(b, p)
    assert [r.text for r in files.read_blocks(spark, p).collect()] == ["later"]
    log = tmp_path / "usage.jsonl"
    log.write_text('{"stage": "a", "ok": true, "duration_s": 2.0}\nbroken\n')
    assert [r.stage for r in files.read_usage(spark, str(log)).collect()] == ["a"]
    assert files.broken_lines(spark, str(log)).count() == 1
    df = spark.createDataFrame([("x ```json\n{\"a\": 1}\n``` y",), ("no",)], "x string")
    assert [r.y for r in df.select(files.json_message(F.col("x")).alias("y")).collect()] == ['{"a": 1}', None]
    names = spark.createDataFrame([("a10",), ("a2",), ("A1",)], "n string").orderBy(files.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["A1", "a2", "a10"]
    assert files.main_text("<title>t</title><nav>x</nav><h1>H</h1><p>a <b>b</b><br>c</p><script>1</script>") == "# H\na b\nc"


def test_expectations(spark):
    df = spark.createDataFrame([("a", "text", 5), ("b", None, 1)], "name string, t string, n int")
    got = {(r.name, r.rule) for r in files.failures(df, [("present", F.col("t").isNotNull()), ("size", F.col("n") >= 3)]).collect()}
    assert got == {("b", "present"), ("b", "size")}
