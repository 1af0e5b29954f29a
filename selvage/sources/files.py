"""Readers and sinks of the document store."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "source string, pos int, id string, type string, anchor string, text string, md string, title string"
USAGE = (
    "ts timestamp, stage string, backend string, model string, ok boolean, error_kind string, duration_s double, input_tokens bigint, output_tokens bigint, cost_usd double, "
    "limits struct<status:string,type:string,using_overage:boolean,windows:map<string,struct<utilization:double,resets_at:timestamp>>>, _corrupt_record string"
)


def read_blocks(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Blocks of JSON lines; unknown fields are dropped; of equal ids the last position wins."""
    df = spark.read.schema(BLOCK).json(path)
    if sources is not None:
        df = df.where(F.col("source").isin(sources))
    rest = [c for c in df.columns if c != "id"]
    return df.groupBy("id").agg(F.max_by(F.struct(*rest), "pos").alias("b")).select("id", "b.*")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """One JSON object a line, letters as they are; the commit protocol makes it atomic."""
    blocks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """S3: the usage log; broken lines are skipped."""
    df = spark.read.schema(USAGE).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: the lines that :func:`read_usage` skips."""
    lines = spark.read.text(path)
    return lines.where(F.try_parse_json("value").isNull())


def append_usage(records: DataFrame, path: str) -> None:
    """Append-only sink."""
    records.write.mode("append").json(path)


def tail(records: DataFrame, seq: str, most: int) -> DataFrame:
    """The newest ``most`` records, newest first."""
    return records.orderBy(F.desc(seq)).limit(most)


def upserted(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of their key; others stay, with columns that the update does not know."""
    kept = table.join(rows.select(key), key, "left_anti")
    old = table.join(rows.select(key), key, "left_semi").select(key, *(c for c in table.columns if c not in rows.columns))
    return kept.unionByName(rows.join(old, key, "left"), allowMissingColumns=True)


def decoded(content: Column, declared: Column) -> Column:
    """Text of page bytes: valid UTF-8 as such, else the declared legacy charset, else windows-1251."""
    latin = declared.isin("iso-8859-1", "latin-1", "latin1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(latin, F.decode(content, "ISO-8859-1")).otherwise(F.decode(content, "windows-1251"))


class _Main(HTMLParser):
    """Text of a page's main part: blocks on lines of their own, navigation and scripts left out."""

    SKIP = frozenset("script style nav footer header aside form noscript template title".split())
    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr blockquote pre article section main br hr figure".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.out: list[str] = []
        self.path: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCKS:
            level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
            self.out.append("\n" + ("#" * level + " " if level else "- " if tag == "li" else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def main_text(html: str | None) -> str:
    p = _Main()
    p.feed(html or "")
    p.close()
    return p.text()


def web_markdown(pages: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    """Main text of each page in Arrow batches (real pages are no XML, so SQL's xpath can't read them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [main_text(x) for x in b.pop(html)]
            yield b

    from pyspark.sql import types as T

    kept = T.StructType([f for f in pages.schema if f.name != html] + [T.StructField(out, T.StringType())])
    return pages.mapInPandas(run, kept)


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, n, href) of each page's links in order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), 1)).alias("n", "href"))


def failures(outputs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(name, rule) of every output that breaks a rule; ``rules`` are (name, condition that must hold)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))
    return outputs.select("name", F.explode(broken).alias("rule"))


def json_message(c: Column) -> Column:
    """A2: the JSON object of a message: inside a fence, else between the outermost braces; null if it does not parse."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, r"(?s)(\{.*\})", 1))
    # the parser stops behind the first value; in a list, whatever follows shows
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when((body != "") & whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull(), body)


def limit_rows(records: DataFrame, key: str, payload: str) -> DataFrame:
    """A3: (key, name, utilization, resets_at) of a limits payload in JSON."""
    schema = "windows map<string,struct<utilization:double,resetsAt:bigint>>"
    w = F.explode(F.from_json(payload, schema)["windows"])
    return records.select(key, w.alias("name", "w")).select(key, "name", "w.utilization", F.timestamp_seconds("w.resetsAt").alias("resets_at"))


def source_units(units: Column, slides: Column) -> Column:
    """Units worth showing: known and not zero; slides hide pages."""
    known = ("pages", "slides", "minutes", "chars", "images")
    return F.map_filter(units, lambda k, v: k.isin(*known) & (v != 0) & ~(slides & (k == "pages")))


def words_of(c: Column) -> Column:
    """Words from JSON tuples [start, end, text, prob?]."""
    rows = F.from_json(c, "array<array<string>>")
    return F.transform(rows, lambda w: F.struct(w[0].cast("double").alias("start"), w[1].cast("double").alias("end"), w[2].alias("text"), F.get(w, 3).cast("double").alias("prob")))


def natural_key(c: Column, width: int = 12) -> Column:
    """L1: sort key with digit runs padded, letters in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.lpad(p, width, "0")).otherwise(p)), "")


def capped(c: Column, most: int = 10) -> Column:
    """The first ``most`` entries and '+N more'."""
    s = F.array_sort(c)
    head = F.array_join(F.slice(s, 1, most), ", ")
    return F.when(F.size(s) > most, F.concat(head, F.lit(", +"), (F.size(s) - most).cast("string"), F.lit(" more"))).otherwise(head)


def versions(prompts: DataFrame) -> DataFrame:
    """Path of the highest numeric version of each prompt."""
    v = F.transform(F.regexp_extract_all("version", F.lit(r"([0-9]+)"), 1), lambda x: x.cast("int"))
    return prompts.groupBy("name").agg(F.max_by("path", v).alias("path"))


def evenly(n: str, count: Column, most: int = 300) -> Column:
    """Whether page ``n`` of ``count`` belongs to an even sample of at most ``most`` pages."""
    return (count <= most) | (F.floor(F.col(n) * most / count) != F.floor((F.col(n) - 1) * most / count))


def numbered_names(rows: DataFrame, base: str, order: str) -> DataFrame:
    """unique names: the first keeps its base, the next get -2, -3."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
