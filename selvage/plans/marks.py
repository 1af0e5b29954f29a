"""Queries of scalar rules over whole texts and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import markdown as M
from selvage.functions import text as T
from selvage.operators import blocks as B
from selvage.operators import ledger as G
from selvage.operators import matching as X
from selvage.plans.registry import query
from selvage.tables import table

_WS = r"[\s\x{0b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _in_turn(key: str, values: tuple) -> Column:
    """One of ``values`` by a number, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _case(key: str, values: tuple) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + " END"


#: Marks that are put in front of each whole text.
MARKS = ("# Head ", "\n- **", "** ![i](http://x/a.png) [to](http://x/", ") `c` $a_", "$ [[S1:p", "]](note) <!-- src: S1.b001 --> \\(x\\) \\[y\\] \"q\" [see](#S1:p2) ")
_M = "m AS (SELECT doc_id, '" + "' || doc_id || '".join(MARKS) + "' || coalesce(text, '') AS m FROM documents)"


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    parts = [F.lit(MARKS[0])] + [x for k in MARKS[1:] for x in (n, F.lit(k))]
    return table(spark, sf, "documents").select("doc_id", F.concat(*parts, F.coalesce("text", F.lit(""))).alias("m"))


@query("plain_texts", rf"""WITH {_M} SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*(#{{1,6}}|[-*+]|[0-9]+[.)]|>)\s+', '', 'g'), '(\*\*|__|`)', '', 'g')) AS plain,
 regexp_replace(m, '(?s)\$\$.*?\$\$|\$[^$\n]*\$', ' ', 'g') AS no_math FROM m""")  # fmt: skip
def plain_texts(spark: SparkSession, sf: str) -> DataFrame:
    """texts without marks, and without formulas."""
    return _marked(spark, sf).select("doc_id", M.plain_text(F.col("m")).alias("plain"), T.strip_math(F.col("m")).alias("no_math"))


@query("escaped_texts", rf"""WITH {_M} SELECT doc_id, regexp_replace(m, '([\\`*_{{}}\[\]<>#|$^~])', '\\\1', 'g') AS inline, {_clean("regexp_replace(m, '[" + chr(34) + r"\\]', ' ', 'g')")} AS attr,
 regexp_replace(regexp_replace(m, '\\\((.*?)\\\)', '$\1$', 'g'), '(?s)\\\[(.*?)\\\]', '$$\1$$', 'g') AS tex, regexp_replace(m, '(\[\[[^\]\n]+\]\])\(', '\1\\(', 'g') AS anchors FROM m""")  # fmt: skip
def escaped_texts(spark: SparkSession, sf: str) -> DataFrame:
    """texts escaped for their places."""
    m = F.col("m")
    return _marked(spark, sf).select("doc_id", T.escape_inline(m).alias("inline"), T.attr_value(m).alias("attr"), T.tex_delimiters(m).alias("tex"), T.escape_anchors(m).alias("anchors"))


@query("variant_texts", rf"""WITH {_M} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(m, '(?s)<!--.*?-->', '', 'g'), '\[\[[A-Z][0-9]*:[^\]\n]+\]\]', '', 'g'), '\[([^\]]+)\]\(#[^)\s]*:[^)\s]*\)', '\1', 'g') AS variant,
 regexp_replace(m, '!\[([^\]]*)\]\((https?://[^)\s]+)[^)]*\)', '[\1](\2)', 'g') AS linked, '::: notes' || chr(10) || trim(m) || chr(10) || ':::' AS notes FROM m""")  # fmt: skip
def variant_texts(spark: SparkSession, sf: str) -> DataFrame:
    """texts as a variant takes them, with links for remote images, and as notes."""
    m = F.col("m")
    return _marked(spark, sf).select("doc_id", T.clean_variant(m).alias("variant"), M.local_images(m).alias("linked"), M.notes_block(m).alias("notes"))


_S = f"s AS (SELECT doc_id, {_clean('text')} AS t FROM documents), h AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?…]\\s') THEN regexp_extract(t, '^(.*?[.!?…])\\s', 1) ELSE t END AS s FROM s)"


@query("first_sentences", rf"WITH {_S} SELECT doc_id, CASE WHEN length(s) > 60 THEN regexp_replace(substr(s, 1, 60), '\s+\S*$', '') || ' …' ELSE s END AS head FROM h")
def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """the first sentence of each document, 60 characters at most."""
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text"), 60).alias("head"))


@query("location_anchors", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'S' || doc_id || ':p1' END AS anchor, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, '') END AS rest FROM documents")
def location_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """the place in front of a heading."""
    n, rest = F.col("doc_id").cast("string"), F.coalesce("source", F.lit(""))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" [[S"), n, F.lit(":p1]] "), rest)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("[[s1:p1]] "), rest)).otherwise(rest)
    return table(spark, sf, "documents").select("doc_id", T.location_anchor(head).alias("a")).select("doc_id", "a.anchor", "a.rest")


@query("plain_letters", "SELECT doc_id, text FROM documents")
def plain_letters(spark: SparkSession, sf: str) -> DataFrame:
    """texts set in mathematical letters and digits read as before."""
    return table(spark, sf, "documents").select("doc_id", M.plain_math_letters(F.translate("text", "aekzATZ079", "𝐚𝑒𝓀𝗓𝔸𝕋𝚉𝟎𝟟𝟵")).alias("text"))


#: Formulas in turn, and as they are without labels; in displays, and between lines.
FORMULAS = (r"x \label{a}= 1 \nonumber", r"\begin{align*}a\\b\end{align*}", r"\begin{multline}a\tag{2}\end{multline}", " y ")
_DISPLAY = ("x = 1", r"\begin{aligned}a\\b\end{aligned}", r"\begin{gathered}a\end{gathered}", "y")
_INLINE = ("x = 1", FORMULAS[1], r"\begin{multline}a\end{multline}", "y")


@query("tex_formulas", f"SELECT event_id, {_case('event_id', _DISPLAY)} AS display, {_case('event_id', _INLINE)} AS inline FROM events")
def tex_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """formulas as a page can set them."""
    f = _in_turn("event_id", FORMULAS)
    return table(spark, sf, "events").select("event_id", M.tex_math(f, True).alias("display"), M.tex_math(f, False).alias("inline"))


#: Paths in turn, and whether they are safe; links, and what is left of them.
PATHS = (("a/b.md", True), ("../b.md", False), ("/etc/x", False), ("a/.git/b", False), ("c:\\x", False), ("dir/", False), ("a.b/c-d.pdf", True))
LINKS = (("https://e.org/x", "https://e.org/x"), ("javascript:run()", "#"), ("mailto:a@e.org", "mailto:a@e.org"), ("#s1", "#s1"), ("data:text/html,x", "#"), ("img/a.png", "img/a.png"))


@query("safe_paths", f"SELECT event_id, {_case('event_id', tuple(v for _, v in PATHS))} AS safe, {_case('event_id', tuple(v for _, v in LINKS))} AS link FROM events")
def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and links that may be followed."""
    path, link = (_in_turn("event_id", tuple(k for k, _ in rows)) for rows in (PATHS, LINKS))
    return table(spark, sf, "events").select("event_id", T.safe_path(path).alias("safe"), M.safe_link(link).alias("link"))


#: File names in turn, with format and kind.
FILES = (("a.PDF", "pdf", "pdf"), ("b.c.pptx", "pptx", "slides"), ("x.jpeg", "image", "handwritten"), ("n.htm", "html", "web"), ("t.xyz", None, None), ("lecture.mkv", "video", "video"), ("noext", None, None))


@query("file_kinds", f"SELECT event_id, {_case('event_id', tuple(f for _, f, _ in FILES))} AS format, {_case('event_id', tuple(k for _, _, k in FILES))} AS kind FROM events")
def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Format and kind of files by name."""
    fmt = T.file_format(_in_turn("event_id", tuple(n for n, _, _ in FILES)))
    return table(spark, sf, "events").select("event_id", fmt.alias("format"), T.kind_of(fmt).alias("kind"))


@query("url_problems", r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS r FROM pages)
 SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE CASE page_id % 6 WHEN 1 THEN 'space' WHEN 2 THEN 'scheme' WHEN 3 THEN 'host' WHEN 4 THEN 'port' WHEN 5 THEN 'ipv6' END END AS problem,
 regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(url_decode(replace(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '+', ' ')), '/$', '') AS display FROM u""")  # fmt: skip
def url_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each page's URL after it was spoilt in turn, and how the good one is shown."""
    k, rest = F.col("page_id") % 6, F.regexp_replace("url", "^https?://", "")
    bad = F.when(k == 1, F.concat("url", F.lit(" x"))).when(k == 2, F.concat(F.lit("ftp://"), rest)).when(k == 3, F.concat(F.lit("http:///"), rest)).when(k == 4, F.concat(F.lit("http://e.org:99999/"), rest)).when(k == 5, F.concat(F.lit("http://[::1/"), rest)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.url_problem(bad).alias("problem"), T.url_display(F.col("url")).alias("display"))


@query("percents", """WITH e AS (SELECT event_id, event_id % 1000 AS part, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 1000 + event_id % 7 END AS total FROM events)
 SELECT event_id, CASE WHEN total = 0 THEN '—' ELSE replace(regexp_replace(CASE WHEN part < total THEN printf('%.1f', floor(least(100 * part / total, 99.9) * 10 + 1e-9) / 10) ELSE '100' END, '\\.0$', ''), '.', ',') || '%' END AS shown FROM e""".replace("\\\\", "\\"))  # fmt: skip
def percents(spark: SparkSession, sf: str) -> DataFrame:
    """Shares as they are shown."""
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", T.percent(i % 1000, F.when(i % 11 == 0, 0).otherwise(i % 1000 + i % 7)).alias("shown"))


@query("source_chars", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN (event_id % 60) * 800 WHEN 2 THEN (event_id % 30) * 1800 ELSE floor(event_id / 3) END::BIGINT AS chars FROM events")
def source_chars(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of sources, measured or guessed."""
    i = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", F.when(i % 4 == 0, i).alias("chars"), F.when(i % 4 == 1, i % 60).alias("minutes"), F.when(i % 4 == 2, i % 30).alias("pages"), i.alias("size"))
    return rows.select("event_id", G.source_chars().alias("chars"))


@query("fenced_lines", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM l),
 y AS (SELECT doc_id, i, CASE WHEN i % 4 = 1 THEN '  ```' ELSE l[i + 1] END AS line FROM x), z AS (SELECT *, regexp_matches(line, '^ *(```|~~~)') AS f FROM y)
 SELECT doc_id, i, f OR sum(f::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM z""")  # fmt: skip
def fenced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines inside fences, which every fourth line opens or closes."""
    rows = B.lines(table(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.when(F.col("i") % 4 == 1, "  ```").otherwise(F.col("line")))
    return B.outside_fences(rows, "doc_id", "i").select("doc_id", "i", "fenced")


@query("looked_up_labels", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def looked_up_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their label, null where there is none."""
    return X.looked_up(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"], "quality")


@query("longest_texts", "SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC NULLS LAST, doc_id LIMIT 10")
def longest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the ten longest documents."""
    d = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return X.top(d, [F.desc_nulls_last("n"), "doc_id"], 10)
