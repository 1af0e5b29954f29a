"""Scalar functions against the expected values of the fixtures."""

import pytest
from pyspark.sql import functions as F

from selvage.functions import text as T


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("name", "slug"),
    [
        ("Ряды Фурье: часть 2", "ryady-fure-chast-2"), ("Цепь и щётка", "tsep-i-shchetka"), ("Їжак, Ґрунт", "yizhak-grunt"), ("Año señor über", "ano-senor-uber"),
        ("Þing œuvre", "thing-oeuvre"), ("rock ’n’ roll", "rock-n-roll"), ("x__y!!z", "x-y-z"), ("  ", "untitled"), ("…", "untitled"), ("ЪЬ", "untitled"),
        ("αβγ", "alphabetagamma"), ("ϕ-поле", "phi-pole"), ("ά", "alpha"), ("йод", "yod"), ("ﬁn ²", "fin-2"), ("日本", "untitled"),
    ],
)
def test_slugs(spark, name, slug):
    assert one(spark, T.slugify, name) == slug


@pytest.mark.parametrize(("limit", "slug"), [(17, "lineynaya-algebra"), (20, "lineynaya-algebra"), (16, "lineynaya"), (5, "liney")])
def test_slug_cut(spark, limit, slug):
    assert one(spark, lambda c: T.slugify(c, limit), "Линейная алгебра, том") == slug


def test_page_numbers(spark):
    yes = ["7", "118", "– 9 –", "—2041—", "6 / 40", "6 of 40", "17 из 90", "стр. 8", "Стр 8", "p. 5", "pg. 5 of 6", "Slide 11", "слайд 2/30", "xc", "XIV", "lix", "ccc"]
    no = ["1999", "8.", "p 5", "page five", "ill", "iiii", "civil", "12 apples", "6 of them", "стр. 12345", "", "[4]"]
    rows = spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", T.is_page_number(F.col("x")).alias("y")).collect()
    assert {r.x for r in rows if r.y} == set(yes)


def test_running_keys(spark):
    key = lambda x: one(spark, T.running_key, x)
    assert key("Slide 3") == key("slide 44") == "slide #"
    assert key("5 of 30") == key("6 of 30") == "# of #"
    assert key("Оптика, с. 7") == key("Оптика, с. 81") == "оптика, с. #"
    assert key("Оптика — 7") == key("Оптика — 81") == "оптика — #"
    assert key("31 · Notes") == key("7 · Notes") == "# · notes"
    assert key("Example 1") != key("Example 2")
    assert key("— Notes 2 |.") == "notes 2"
    assert key("Homepage 4") == "homepage 4"


def test_error_kinds(spark):
    kinds = {"got HTTP 401": "auth", "status 529": "rate_limit", "You hit your limit": "rate_limit", "server overloaded": "rate_limit", "bad credentials": "auth", "please log in, rate-limit": "rate_limit", "OAuth token revoked; quota": "auth", "code 14290": None, "": None, "blogging": None}
    assert {k: one(spark, T.error_kind, k) for k in kinds} == kinds


def test_video_urls(spark):
    kinds = {
        "https://vk.com/video-7_8": "video", "https://m.vk.com/Clips/x": "video", "http://vk.ru/feed?z=clip-3_4": "video", "https://vk.com/wall?z=photo1": "web", "https://vk.com/im": "web",
        "https://www.youtube-nocookie.com/embed/1": "video", "https://vkvideo.ru./a": "video", "https://notvk.com/video1": "web", "http://e.org/a.mp3?x": "audio", "http://e.org/b.WEBM": "video",
    }
    assert {k: one(spark, T.url_kind, k) for k in kinds} == kinds


def test_percent_never_rounds_up(spark):
    rows = spark.createDataFrame([(0, 0), (7, 10), (9999, 10000), (10, 10), (1, 3)], "a int, b int").select(T.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == ["—", "70%", "99,9%", "100%", "33,3%"]


def test_citations(spark):
    md = "a <!-- src: S1.b001, S1.b002 --> b <!-- src: P1.b010 S1.b001 --> P1.b999 <!-- other P1.b998 -->"
    assert one(spark, T.src_ids, md) == ["S1.b001", "S1.b002", "P1.b010"]
    assert one(spark, T.src_ids, None) is None


def test_times(spark):
    rows = spark.createDataFrame([(0.0,), (2.5,), (3725.5,), (-1.0,)], "x double").select(T.srt_time(F.col("x")).alias("s"), T.clock(F.col("x")).alias("c")).collect()
    assert [r.s for r in rows] == ["00:00:00,000", "00:00:02,500", "01:02:05,500", "00:00:00,000"]
    assert [r.c for r in rows] == ["00:00", "00:02", "1:02:05", "00:00"]
    assert one(spark, T.parse_clock, "1:02:34") == 3754


def test_sizes_and_snippets(spark):
    assert one(spark, T.text_size, "a b <!-- x\ny -->\nc") == 3
    assert len(one(spark, T.snippet, "word " * 40)) <= 80
    assert one(spark, T.snippet, "see $x^2$ now") == "see … now"
    assert one(spark, T.first_sentence, "One. Two.") == "One."


def test_tex(spark):
    assert one(spark, T.wrap_bare_math, r"\frac{1}{2}") == r"$\frac{1}{2}$"
    assert one(spark, T.wrap_bare_math, r"\frac}1{") == r"`\frac}1{`"
    assert one(spark, T.tex_delimiters, r"a \(x\) b") == "a $x$ b"


def test_urls(spark):
    key = lambda x: one(spark, T.url_key, x)
    assert key("https://www.Example.com:443/a%20b/#top") == key("http://example.com/a b")
    assert key("http://e.org/?utm_source=x") != key("http://e.org/")
    assert one(spark, T.url_kind, "https://m.youtube.com/watch?v=1") == "video"
    assert one(spark, T.url_kind, "https://notyoutube.com/x") == "web"
    assert one(spark, T.url_problem, "http://a b") == "space"
    assert one(spark, T.url_problem, "http://e.org:99999/") == "port"
    assert one(spark, T.url_problem, "http://e.org/") is None


def test_types_and_formats(spark):
    kinds = {"$$x$$.": "formula", "![a](b.png)": "figure", "## T": "heading", "- a": "list", "| a |": "table", "> q": "quote", "text": "paragraph", "<!-- c -->": None, "  ": None}
    assert {k: one(spark, T.line_type, k) for k in kinds} == kinds
    assert one(spark, T.file_format, "a.PPTX") == "pptx"
    assert one(spark, lambda c: T.kind_of(T.file_format(c)), "a.pptx") == "slides"
    assert one(spark, lambda c: T.file_format(c, F.lit("%PDF-1.7").cast("binary")), "noname") == "pdf"
    assert one(spark, T.error_kind, "429 Too Many Requests") == "rate_limit"
    assert one(spark, T.safe_path, "../x") is False and one(spark, T.safe_path, "a/b.md") is True


def test_hyphens(spark):
    def join(left, right, known, habit):
        df = spark.createDataFrame([(left, right, known, habit)], "a string, b string, k array<string>, h boolean")
        return df.select(T.join_hyphenated(F.col("a"), F.col("b"), F.col("k"), F.col("h")).alias("y")).first().y

    assert join("infor-", "mation", ["information"], False) == "information"
    assert join("well-", "known", ["well-known"], True) == "well-known"
    assert join("exam-", "ple", [], True) == "example"
    assert join("end.", "next", [], True) is None


def test_letter_share(spark):
    assert one(spark, T.letter_share, "Привет abc $мат$") == round(6 / 9, 3)
    assert one(spark, T.letter_share, "123") is None


def test_running_lines_mask_each_line_once(spark):
    """Same keys as the patterns over every line; neither a filter nor the second use of a line computes its key again."""
    import re

    from selvage.operators import blocks as B

    ws, ends = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000", " .·|-–—"
    odd = [a + w + b for w in [*ws, "  ", " \t", "\xa0 ", "\r\n", ""] for a, b in (("x", "y"), ("", "3 | Kopf"), ("Стр.", "7 из 9"), ("PAGE", "12"), ("-", "–"), ("12", "- z"), ("xii", ""), ("ẞ.", "4"))]
    odd += ["", " ", ".·|", "٣ page", "\x1c", "A  B  C", "Kopf | 12", "page ten", "x" * 30 + " 5 of 6", None]

    def key(s):
        s = re.sub(f"[{ws}]+", " ", s).strip(" ").lower()
        if re.search(r"(?<!\w)(стр|страница|page|pg|слайд|slide)(?!\w)|(?<!\w)[сp]\.\s*[0-9]|[0-9]\s*(из|of|/)\s*[0-9]", s):
            return re.sub("[0-9]+", "#", s).strip(ends)
        return re.sub(r"([|·•—–-]\s*)[0-9]{1,4}$", r"\1#", re.sub(r"^[0-9]{1,4}(?=\s*[|·•—–-]\s)", "#", s)).strip(ends)

    df = spark.createDataFrame(list(enumerate(odd)), "i int, s string").select("i", T.running_key(F.col("s")).alias("key"), T.has_running_key(F.col("s")).alias("has"), T.running_marks(F.col("s")).alias("m"), T.is_page_number(F.col("s")).alias("number"))
    for r in df.collect():
        if odd[r.i] is None:
            assert (r.key, r.has) == (None, None)
        else:
            assert (r.key, r.has, r.m.key, r.m.number) == (key(odd[r.i]), key(odd[r.i]) != "", r.key, r.number), repr(odd[r.i])
    docs = spark.createDataFrame([(d, p, "Kopf | %d" % p) for d in (1, 2) for p in range(5)] + [(1, 0, " – ")], "d int, p int, s string")
    got = B.running_lines(docs, "d", "p", "s")
    assert sorted(map(tuple, got.collect())) == [(1, "kopf | #", 5), (2, "kopf | #", 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("стр|страница|page|pg|слайд|slide") == 1
