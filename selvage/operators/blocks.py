"""Blocks: addressable rows of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions import text as T


def lines(docs: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, *keep, i, line): every line with its place, one generator and no shuffle."""
    return docs.select(key, *keep, F.posexplode(F.split(text, "\n")).alias("i", "line"))


def numbered(rows: DataFrame, source: str = "source", order: str = "i", width: int = 3, prefix: Column | None = None) -> DataFrame:
    """Dense 1-based positions and ids ``SRC.b001`` (three digits at least) within each source."""
    w = Window.partitionBy(source).orderBy(order)
    rows = rows.withColumn("pos", F.row_number().over(w))
    name = prefix if prefix is not None else F.col(source).cast("string")
    n = F.col("pos").cast("string")
    return rows.withColumn("id", F.concat(name, F.lit(".b"), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))


def of_documents(docs: DataFrame) -> DataFrame:
    """Blocks of the documents table: non-empty lines, numbered within the document without a shuffle."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs.select("doc_id", "source", F.posexplode(kept).alias("p", "text"))
    n = (F.col("p") + 1).cast("string")
    pos = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return rows.select("doc_id", "source", (F.col("p") + 1).alias("pos"), F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(".b"), pos).alias("id"), "text")


def section_anchors(blocks: DataFrame, source: str = "source", pos: str = "pos", level: str = "level") -> DataFrame:
    """``SRC:§k`` counts the headings of the least level; blocks before the first are §0.

    ``level`` is null for blocks that are no headings (titles count as none).
    """
    whole = Window.partitionBy(source)
    upto = whole.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    top = F.min(level).over(whole)
    k = F.sum(F.when(F.col(level) == top, 1).otherwise(0)).over(upto)
    return blocks.withColumn("anchor", F.concat(F.col(source).cast("string"), F.lit(":§"), k.cast("string")))


def carried_anchors(blocks: DataFrame, source: str = "source", pos: str = "pos", anchor: str = "anchor") -> DataFrame:
    """Each block takes the last location at or before it; what precedes the first takes the first."""
    w = Window.partitionBy(source).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.withColumn("place", F.coalesce(F.last(anchor, True).over(upto), F.first(anchor, True).over(whole)))


def outside_fences(rows: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """Marks lines that lie in a fenced block, its fences included, by the parity of fences so far."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fence = F.rlike(F.ltrim(F.col(line)), F.lit("^(```|~~~)"))
    n = F.sum(fence.cast("int")).over(upto)
    return rows.withColumn("fenced", (n % 2 == 1) | fence)


def heading_anchors(rows: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """F16: (key, anchor, level) of ``{#anchor}`` headings outside fences; the last of an anchor wins."""
    p = r"^(#{1,6}) .*\{#([^}\s]+)[^}]*\}\s*$"
    rows = outside_fences(rows, key, order, line).where(~F.col("fenced") & F.rlike(line, F.lit(p)))
    rows = rows.select(key, order, F.regexp_extract(line, p, 2).alias("anchor"), F.length(F.regexp_extract(line, p, 1)).alias("level"))
    return rows.groupBy(key, "anchor").agg(F.max_by("level", order).alias("level"))


def ancestors(rows: DataFrame, key: str, order: str, line: str, level: int = 2) -> DataFrame:
    """(key, title, body) of the sections under headings of a level; text before the first is left out."""
    p = rf"^#{{{level}}} (.*)$"
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("title", F.last(F.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, 1)), True).over(upto))
    rows = rows.where(F.col("title").isNotNull() & ~F.rlike(line, F.lit(p)))
    parts = F.sort_array(F.collect_list(F.struct(order, line)))
    return rows.groupBy(key, "title").agg(F.array_join(F.transform(parts, lambda x: x[line]), "\n").alias("body"))


def contents(headings: DataFrame, key: str, pos: str, level: str, title: str) -> DataFrame:
    """Headings of the two top levels that occur, the second indented."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(level))
    rows = headings.withColumn("depth", rank).where("depth <= 2")
    return rows.select(key, pos, F.concat(F.when(F.col("depth") == 2, F.lit("  - ")).otherwise(F.lit("- ")), F.col(title)).alias("entry"))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by map-side combined aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(*keys, *(F.col(f"__v.{c}").alias(c) for c in rest))


def terms(blocks: DataFrame, key: str, pos: str, title: str, most: int = 60) -> DataFrame:
    """Distinct titles, letters' case aside, in order; the first ``most`` of each key."""
    rows = first_of_each(blocks.where(F.trim(F.col(title)) != "").withColumn("__k", F.lower(F.trim(F.col(title)))), [key, "__k"], pos)
    w = Window.partitionBy(key).orderBy(pos)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n", "__k")


def running_lines(rows: DataFrame, doc: str, page: str, line: str, share: float = 0.6, least: int = 2) -> DataFrame:
    """(doc, key, pages) of masked lines on at least max(least, ceil(share n)) of a document's n >= 3 pages,
    or of its odd or even pages when n >= 6; page numbers always."""
    # a filter on the key itself would compute it a second time
    rows = rows.where(T.has_running_key(F.col(line))).select(doc, page, T.running_marks(F.col(line)).alias("__m"))
    rows = rows.select(doc, page, "__m.key", "__m.number")
    seen = rows.groupBy(doc, "key", page).agg(F.max("number").alias("number"))
    odd = F.count_if(F.col(page) % 2 == 1)
    sizes = seen.groupBy(doc, page).agg(F.lit(1).alias("__1")).groupBy(doc).agg(F.count(F.lit(1)).alias("n"), odd.alias("n_odd"))
    keyed = seen.groupBy(doc, "key").agg(F.count(F.lit(1)).alias("pages"), odd.alias("odd"), F.max("number").alias("number"))
    keyed = keyed.join(sizes, doc)
    need = lambda n, floor: F.greatest(F.lit(floor), F.ceil(F.lit(share) * n))
    even, n_even = F.col("pages") - F.col("odd"), F.col("n") - F.col("n_odd")
    whole = (F.col("n") >= 3) & (F.col("pages") >= need(F.col("n"), least))
    half = (F.col("n") >= 6) & ((F.col("odd") >= need(F.col("n_odd"), 3)) | (even >= need(n_even, 3)))
    return keyed.where(F.col("number") | whole | half).select(doc, "key", "pages")


def repeated_digests(rows: DataFrame, doc: str, page: str, content: str, least: int = 2) -> DataFrame:
    """Digests of content on ``least`` pages or more of a document."""
    rows = rows.select(doc, page, F.sha2(F.col(content), 256).alias("digest"))
    return rows.groupBy(doc, "digest").agg(F.countDistinct(page).alias("pages")).where(F.col("pages") >= least)


def vocabulary(rows: DataFrame, doc: str, content: str) -> DataFrame:
    """Distinct lower-case words of a document, as rows so that no document has to fit a cell."""
    word = F.explode(F.regexp_extract_all(F.lower(F.col(content)), F.lit(r"(?U)[\p{L}\p{N}_-]+"), 0))
    return rows.select(doc, word.alias("word")).distinct()


def assembled(rows: DataFrame, keys: list[str], order: str, content: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a key joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, content)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[content]), separator).alias("body"))


def weighted_mode(rows: DataFrame, key: str, style: str, content: str) -> DataFrame:
    """The style of most characters, the smaller name on ties."""
    n = rows.groupBy(key, style).agg(F.sum(F.length(content)).alias("chars"))
    w = Window.partitionBy(key).orderBy(F.desc("chars"), style)
    return n.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
