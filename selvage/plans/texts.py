"""Queries of Markdown rules, lookups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import markdown as M
from selvage.functions import text as T
from selvage.operators import blocks as B
from selvage.operators import matching as X
from selvage.operators import signals as G
from selvage.plans.marks import _case, _in_turn
from selvage.plans.registry import query
from selvage.tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n, text, source, lang): documents with their number as text and no nulls."""
    some = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("n"), some("text"), some("source"), some("lang"))


_D = "d AS (SELECT doc_id, doc_id::VARCHAR AS n, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)"


@query("front_matters", f"WITH {_D} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T ' || n END AS title, text AS body, true AS same FROM d")
def front_matters(spark: SparkSession, sf: str) -> DataFrame:
    """Front matter taken off and put on again."""
    head = F.concat(F.lit("---\ntitle: \"T "), F.col("n"), F.lit("\"\nlang: "), F.col("lang"), F.lit("\n---\n"))
    d = _docs(spark, sf).withColumn("md", F.when(F.col("doc_id") % 2 == 0, F.concat(head, "text")).otherwise(F.col("text")))
    p = d.withColumn("p", M.front_matter(F.col("md")))
    return p.select("doc_id", M.meta_value(F.col("p.meta"), "title").alias("title"), "p.body", (M.compose_source(F.col("p.meta"), F.col("p.body")) == F.col("md")).alias("same"))


@query("reading_marks", rf"""WITH {_D}, m AS (SELECT doc_id, '[?] x [' || n || '?] ' || CASE WHEN doc_id % 2 = 0 THEN '`\(a\)` ' ELSE '' END || text AS m FROM d)
 SELECT doc_id, len(regexp_extract_all(m, '\[\?\]')) AS unreadable, len(regexp_extract_all(m, '\[[^\]?]+\?\]')) AS uncertain, regexp_matches(regexp_replace(m, '`[^`\n]*`', '', 'g'), '\\[(\[]') AS math FROM m""")  # fmt: skip
def reading_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of doubtful readings, and TeX delimiters outside code."""
    m = F.concat(F.lit("[?] x ["), "n", F.lit("?] "), F.when(F.col("doc_id") % 2 == 0, "`\\(a\\)` ").otherwise(""), "text")
    d = _docs(spark, sf).withColumn("m", m)
    return d.select("doc_id", M.uncertain_counts(F.col("m")).alias("u"), T.backslash_math(F.col("m")).alias("math")).select("doc_id", "u.*", "math")


#: Texts in turn with what becomes of them: bare TeX, page numbers and running keys, words set apart, times.
BARE = ((r"\alpha + 1", r"$\alpha + 1$"), (r"\frac{a}{b", r"`\frac{a}{b`"), ("plain {x", "plain {x"), (r"$\beta$", r"$\beta$"), (r"}\x{", r"`}\x{`"))
NUMBERS = (("7", True, "7"), ("— 12 —", True, "12"), ("12 из 90", True, "# из #"), ("Page 31", True, "page #"), ("XLV", True, "xlv"), ("1234", False, "1234"), ("Algebra | 17", False, "algebra | #"), ("Group 4", False, "group 4"), ("civil", False, "civil"))
SPACED = (("T I T L E", "TITLE"), ("a plain line", "a plain line"), ("see A B here", "see A B here"))
TIMES = (("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T05:04:05+02:00", 1704164645), ("soon", None), ("2024-02-30T00:00:00Z", None))


@query("turned_lines", f"""SELECT event_id, {_case('event_id', tuple(b for _, b in BARE))} AS math, {_case('event_id', tuple(b for _, b, _ in NUMBERS))} AS is_number, {_case('event_id', tuple(k for *_, k in NUMBERS))} AS key,
 {_case('event_id', tuple(b for _, b in SPACED))} AS word, ({_case('event_id', tuple(b for _, b in TIMES))})::BIGINT AS at FROM events""")  # fmt: skip
def turned_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of single lines."""
    line = _in_turn("event_id", tuple(a for a, *_ in NUMBERS))
    return table(spark, sf, "events").select(
        "event_id", T.wrap_bare_math(_in_turn("event_id", tuple(a for a, _ in BARE))).alias("math"), T.is_page_number(line).alias("is_number"), T.running_key(line).alias("key"),
        M.despaced(_in_turn("event_id", tuple(a for a, _ in SPACED))).alias("word"), F.unix_timestamp(T.iso_time(_in_turn("event_id", tuple(a for a, _ in TIMES)))).alias("at"),
    )


@query("theorem_labels", rf"WITH {_D} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'theorem' WHEN 1 THEN 'remark' END AS type, CASE WHEN doc_id % 3 = 0 THEN nullif(source, '') END AS title, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(text, '^\s+', '') END AS rest FROM d")
def theorem_labels(spark: SparkSession, sf: str) -> DataFrame:
    """paragraphs that a known label opens."""
    k = F.col("doc_id") % 3
    c = F.when(k == 0, F.concat(F.lit("Theorem 1."), "n", F.lit(" ("), "source", F.lit("). "), "text")).when(k == 1, F.concat(F.lit("**Замечание "), "n", F.lit(": "), "text")).otherwise(F.concat(F.lit("Idea 1. "), "text"))
    return _docs(spark, sf).select("doc_id", M.theorem_label(c).alias("l")).select("doc_id", "l.*")


@query("text_pieces", f"""WITH {_D} SELECT doc_id, 'see ' || n || '|$$x' || n || '$$,|and|$$y$$' AS display, 'A|B ' || n AS title, 'Term ' || n || '|alpha' || n AS terms, 'T' || n || ', Term ' || n || ', alpha' || n AS prompt,
 '0:0' || doc_id % 10 || '=a ' || n || '|1:02:03=c' AS lines FROM d""")  # fmt: skip
def text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs, titles, glossaries and transcripts in pieces."""
    n = F.col("n")
    display = F.concat(F.lit("see "), n, F.lit(" $$x"), n, F.lit("$$, and $$y$$"))
    terms = M.glossary_terms(F.concat(F.lit("- **Term "), n, F.lit("** — one\n* alpha"), n, F.lit(" - two\n- $x$ - no\n- none")))
    lines = M.fixed_lines(F.concat(F.lit("[0:0"), (F.col("doc_id") % 10).cast("string"), F.lit("] a\n"), n, F.lit("\n[1:02:03]  c ")))
    shown = F.transform(lines, lambda x: F.concat(x["at"], F.lit("="), x["text"]))
    return _docs(spark, sf).select(
        "doc_id", F.array_join(M.split_display(display), "|").alias("display"), F.array_join(M.title_fragments(F.concat(F.lit("A $x$ «B "), n, F.lit("» ..."))), "|").alias("title"),
        F.array_join(terms, "|").alias("terms"), M.prompt(F.concat(F.lit("T"), n), terms).alias("prompt"), F.array_join(shown, "|").alias("lines"),
    )


def _outline(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, i, line): a short text with headings of two levels for each document."""
    n = F.col("n")
    lines = F.array(F.lit("intro"), F.concat(F.lit("## T"), n, F.lit(" {#t"), n, F.lit("}")), F.col("source"), F.lit("```"), F.lit("# no {#x}"), F.lit("```"), F.lit("### U {#u .unnumbered}"), F.lit("## V {#u}"), F.col("lang"))
    return _docs(spark, sf).select("doc_id", F.posexplode(lines).alias("i", "line"))


@query("heading_anchors", f"WITH {_D} SELECT doc_id, 't' || n AS anchor, 2 AS level FROM d UNION ALL SELECT doc_id, 'u', 2 FROM d")
def heading_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """F16: anchors of headings outside code, the last of each."""
    return B.heading_anchors(_outline(spark, sf), "doc_id", "i")


@query("ancestors", f"WITH {_D} SELECT doc_id, 'T' || n || ' {{#t' || n || '}}' AS title, concat_ws(chr(10), source, '```', '# no {{#x}}', '```', '### U {{#u .unnumbered}}') AS body FROM d UNION ALL SELECT doc_id, 'V {{#u}}', lang FROM d".replace("{{", "{").replace("}}", "}"))
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """texts under headings of the second level."""
    return B.ancestors(_outline(spark, sf), "doc_id", "i", "line")


@query("hyphenates", "SELECT event_type AS doc, count_if(event_id % 50 % 3 = 0) > count_if(event_id % 50 % 3 = 1 AND event_type <> 'view') AS hyphenates FROM events GROUP BY event_type")
def hyphenates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether words broken at line ends are glued, by kind of event."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("doc"), (F.col("event_id") % 50).alias("k"))
    left, right = F.lit("W"), F.col("k").cast("string")
    word = F.when(F.col("k") % 3 == 0, F.concat(F.lit("w"), right)).when((F.col("k") % 3 == 1) & (F.col("doc") != "view"), F.concat(F.lit("w-"), right))
    return X.hyphenates(e.select("doc", left.alias("left"), right.alias("right")), e.select("doc", word.alias("word")).where("word IS NOT NULL"))


#: Lines of a typesetter's log in turn, with kind and text.
LOG = (("! Undefined control sequence.", "error", "! Undefined control sequence."), ("Missing character: There is no x in font y!", "missing", ""), ("LaTeX Warning: Reference `eq:1' on page 3 undefined", "undefined", "eq:1"),
       ("Package p Warning: old. ", "warning", "Package p Warning: old."), ("[12]", None, None))


@query("log_summary", f"SELECT kind, text, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, {_case('event_id', tuple(k for _, k, _ in LOG))} AS kind, {_case('event_id', tuple(t for *_, t in LOG))} AS text FROM events) WHERE kind IS NOT NULL GROUP BY kind, text")
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a log says, and how often."""
    return X.log_summary(table(spark, sf, "events").select(F.col("event_id").alias("i"), _in_turn("event_id", tuple(a for a, *_ in LOG)).alias("line")))


@query("heaviest_runs", """WITH f AS (SELECT user_id, event_id AS n, floor(value)::BIGINT AS mass FROM events WHERE floor(value) >= 2), g AS (SELECT *, CASE WHEN n - lag(n) OVER w <= 300 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY user_id ORDER BY n)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY n) AS run FROM g), s AS (SELECT user_id, min(n) AS first, max(n) AS last, sum(mass)::BIGINT AS mass FROM r GROUP BY user_id, run)
 SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mass DESC, first) = 1""")  # fmt: skip
def heaviest_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's run of events of most value."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("n"), F.floor("value").alias("mass"))
    return X.heaviest_run(e, "user_id", "n", "mass", 2, 300)


@query("milestones", """WITH h AS (SELECT user_id, event_id AS t, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m, max(value) OVER (PARTITION BY user_id) AS peak FROM events)
 SELECT user_id, level::DOUBLE AS level, min(t) AS t FROM h, (VALUES (0.25), (0.5), (0.75)) l(level) WHERE m >= level::DOUBLE * peak GROUP BY ALL""")  # fmt: skip
def milestones(spark: SparkSession, sf: str) -> DataFrame:
    """When three events in a row first reach each share of a user's peak."""
    return G.milestones(table(spark, sf, "events").select("user_id", F.col("event_id").alias("t"), "value"), "user_id", "t", "value")


@query("best_attempt", "SELECT arg_min(event_id, (event_id * 7 % 11, event_id * 5 % 13, event_id)) AS attempt FROM events")
def best_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """The attempt with the fewest problems."""
    i = F.col("event_id")
    return X.best_attempt(table(spark, sf, "events").select(i.alias("attempt"), (i * 7 % 11).alias("structural"), (i * 5 % 13).alias("blocks")))


@query("stabilised_sections", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, 'new') ELSE 'new' END AS title, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, text) ELSE text END AS summary FROM documents")
def stabilised_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that existed keep title and summary."""
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("summary"))
    return X.stabilised(old, d.select(F.col("doc_id").alias("id"), F.lit("new").alias("title"), F.col("text").alias("summary")))


@query("outline_rows", "SELECT k AS ord, 's' || item_id || '.' || k AS id, text AS title, k + 1 AS level, CASE WHEN k = 1 THEN 's' || item_id || '.0' END AS parent, 2 AS n_blocks FROM benchmark, (VALUES (0), (1)) v(k)")
def outline_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines read from JSON, one an item."""
    name = lambda k: F.concat(F.lit("s"), F.col("item_id").cast("string"), F.lit(f".{k}"))
    section = lambda k, up: F.struct(name(k).alias("id"), F.col("text").alias("title"), F.lit(k + 1).alias("level"), up.alias("parent"), F.lit("").alias("summary"), F.array(F.lit("a"), F.lit("b")).alias("blocks"))
    json = F.to_json(F.struct(F.array(section(0, F.lit(None).cast("string")), section(1, name(0))).alias("sections")))
    return X.outline_rows(table(spark, sf, "benchmark").select(json.alias("json"))).select("ord", "id", "title", "level", "parent", F.size("blocks").alias("n_blocks"))


@query("ingest_plan", """WITH i AS (SELECT page_id AS item, CASE WHEN page_id % 3 > 0 THEN page_id % 100 END AS h, CASE WHEN page_id % 2 = 0 THEN page_id % 120 END AS u FROM pages)
 SELECT item, CASE WHEN h < 10 OR u < 8 THEN 'duplicate' WHEN (h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY item) > 1) OR (u IS NOT NULL AND row_number() OVER (PARTITION BY u ORDER BY item) > 1) THEN 'repeat' ELSE 'add' END AS action FROM i""")  # fmt: skip
def ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with each page of a batch."""
    i = F.col("page_id")
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    items = table(spark, sf, "pages").select(i.alias("item"), i.alias("seq"), F.when(i % 3 > 0, key("h", i % 100)).alias("sha256"), F.when(i % 2 == 0, key("u", i % 120)).alias("url_key"))
    known = spark.range(10).select(key("h", F.col("id")).alias("sha256"), F.when(F.col("id") < 8, key("u", F.col("id"))).alias("url_key"))
    return X.ingest_plan(items, known)
