"""Queries over blocks, citations and coverage of documents (W1, P2, F*, J1-J9, G1-G4, G11-G16, L2, U1-U5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import text as T
from selvage.operators import blocks as B
from selvage.operators import coverage as C
from selvage.operators import timeline as L
from selvage.plans import base
from selvage.plans.base import BLOCKS, CITED, FLAGGED
from selvage.plans.registry import query
from selvage.tables import table


@query("blocks", f"WITH {BLOCKS} SELECT doc_id, pos, id, type, length(text) AS chars FROM blocks")
def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with dense ids."""
    return base.blocks(spark, sf).select("doc_id", "pos", "id", "type", F.length("text").alias("chars"))


@query("block_types", f"""WITH {BLOCKS} SELECT source, CASE WHEN regexp_matches(text, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(text, '^([-*+]|[0-9]+[.)]) ') THEN 'list'
 WHEN regexp_matches(text, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(text, '^> ?') THEN 'quote' ELSE 'paragraph' END AS kind, count(*) AS n FROM blocks GROUP BY ALL""")  # fmt: skip
def block_types(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks by type and source."""
    return base.blocks(spark, sf).groupBy("source", T.line_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_FORMULA = r"(?s:\$\$.*?\$\$)|\$[^$\n]*\$"
_LINE = f"trim(regexp_replace(regexp_replace(text, '{_FORMULA}', '…', 'g'), '\\s+', ' ', 'g'))"


@query("text_measures", f"""WITH {BLOCKS} SELECT id, length(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\\s+', '', 'g')) AS size,
 CASE WHEN length({_LINE}) > 80 THEN rtrim(substr({_LINE}, 1, 79)) || '…' ELSE {_LINE} END AS snippet FROM blocks""")  # fmt: skip
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Size without white space, and the snippet of each block."""
    return base.blocks(spark, sf).select("id", T.text_size(F.col("text")).alias("size"), T.snippet(F.col("text")).alias("snippet"))


@query("citations", f"WITH {BLOCKS} SELECT doc_id AS section, id AS block FROM blocks WHERE {CITED}")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct citations read from src comments."""
    return C.citations(base.sections(spark, sf))


@query("coverage_report", f"""WITH {FLAGGED}, s AS (SELECT DISTINCT source FROM blocks)
 SELECT s.source, count(id) AS total, count(*) FILTER (WHERE covered) AS covered, CASE WHEN count(id) = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE covered) / count(id), 4) END AS ratio
 FROM s LEFT JOIN flagged USING (source) GROUP BY ROLLUP (s.source)""")  # fmt: skip
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage per source with verdicts, and the grand total."""
    b = base.blocks(spark, sf)
    rows = C.flagged(b, C.citations(base.sections(spark, sf)), base.verdicts(spark, sf))
    return C.report(b, rows).drop("percent")


@query("verdict_histogram", f"WITH {FLAGGED} SELECT verdict, count(*) AS n, count(*) FILTER (WHERE verdict IN ('unknown', 'missing')) AS open FROM flagged WHERE verdict IS NOT NULL GROUP BY verdict")
def verdict_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Listed blocks by verdict."""
    return C.histogram(C.flagged(base.blocks(spark, sf), C.citations(base.sections(spark, sf)), base.verdicts(spark, sf)))


@query("uncovered_top", f"""WITH {FLAGGED} SELECT id, source, verdict, '' AS note, CASE verdict WHEN 'missing' THEN 0 WHEN 'duplicate' THEN 2 WHEN 'admin' THEN 3 ELSE 1 END AS rank, pos AS n
 FROM flagged WHERE verdict IS NOT NULL ORDER BY rank, source, n, id LIMIT 500""")  # fmt: skip
def uncovered_top(spark: SparkSession, sf: str) -> DataFrame:
    """L2: the first 500 listed blocks in report order."""
    return C.uncovered(C.flagged(base.blocks(spark, sf), C.citations(base.sections(spark, sf)), base.verdicts(spark, sf)))


@query("covered_anti", f"WITH {BLOCKS} SELECT id FROM blocks WHERE type <> 'admin' AND NOT {CITED}")
def covered_anti(spark: SparkSession, sf: str) -> DataFrame:
    """J1 as an anti-join: blocks that no section cites."""
    cites = C.citations(base.sections(spark, sf)).select(F.col("block").alias("id"))
    return base.blocks(spark, sf).where("type <> 'admin'").select("id").join(cites, "id", "left_anti")


_OUTLINE = f"""{BLOCKS},
 placed AS (SELECT id AS block, 's' || lpad((doc_id % 30)::VARCHAR, 2, '0') AS section, pos AS ord FROM blocks WHERE pos % 11 <> 0
            UNION ALL SELECT id || 'x', 's99', pos FROM blocks WHERE pos = 3 UNION ALL SELECT id, 's98', pos FROM blocks WHERE pos = 5),
 unassigned AS (SELECT id AS block, CASE WHEN doc_id % 2 = 0 THEN 'off topic' ELSE '' END AS reason FROM blocks WHERE pos % 22 = 0 OR pos = 2)"""


def _outline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = base.blocks(spark, sf)
    sec = F.concat(F.lit("s"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"))
    row = lambda c, i, s: b.where(c).select(i.alias("block"), s.alias("section"), F.col("pos").alias("ord"))
    placed = row("pos % 11 <> 0", F.col("id"), sec).unionByName(row("pos = 3", F.concat("id", F.lit("x")), F.lit("s99"))).unionByName(row("pos = 5", F.col("id"), F.lit("s98")))
    left = b.where("pos % 22 = 0 OR pos = 2").select(F.col("id").alias("block"), F.when(F.col("doc_id") % 2 == 0, "off topic").otherwise("").alias("reason"))
    return b, placed, left


@query("outline_problems", f"""WITH {_OUTLINE}, every AS (SELECT block FROM placed UNION ALL SELECT block FROM unassigned)
 SELECT 'unknown' AS kind, block AS item FROM (SELECT DISTINCT block FROM every) WHERE block NOT IN (SELECT id FROM blocks)
 UNION ALL SELECT 'duplicate', block FROM placed GROUP BY block HAVING count(*) > 1
 UNION ALL SELECT 'missing', id FROM blocks WHERE type <> 'admin' AND id NOT IN (SELECT block FROM every)
 UNION ALL SELECT 'both', block FROM unassigned WHERE block IN (SELECT block FROM placed) GROUP BY block
 UNION ALL SELECT 'reason', block FROM unassigned WHERE trim(reason) = '' GROUP BY block""")  # fmt: skip
def outline_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Placement problems of an outline."""
    return C.problems(*_outline(spark, sf))


@query("outline_repaired", f"WITH {_OUTLINE} SELECT block, min_by(section, ord) AS section, min(ord) AS ord FROM placed JOIN blocks ON block = id WHERE pos <> 5 GROUP BY block")
def outline_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Known blocks, the first place of each."""
    b, placed, _ = _outline(spark, sf)
    return C.repaired(b.where("pos <> 5"), placed)


@query("context_neighbours", f"""WITH {_OUTLINE}, w AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS p, lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM blocks),
 own AS (SELECT section, block AS id FROM placed WHERE section <> 's98'),
 near AS (SELECT section, pos, unnest([p, q]) AS id FROM w JOIN own USING (id)),
 far AS (SELECT section, id, min(pos) AS pos FROM near n WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own o WHERE o.section = n.section AND o.id = n.id) GROUP BY ALL)
 SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY pos, id) AS n FROM far QUALIFY n <= 24""")  # fmt: skip
def context_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of each section's blocks."""
    b, placed, _ = _outline(spark, sf)
    return C.neighbours(b.drop("source").withColumnRenamed("doc_id", "source"), placed.where("section <> 's98'").select("section", "block"))


@query("outline_autofill")
def outline_autofill(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential placement of missing blocks beside their nearest neighbours (tests compare with a plain model)."""
    b = base.blocks(spark, sf)
    sec = F.when((F.col("pos") % 3 == 1) & (F.col("type") != "admin"), F.concat(F.lit("s"), (F.floor(F.col("pos") / 6)).cast("string")))
    return C.autofill(b.select(F.col("doc_id").alias("source"), F.col("pos").cast("int").alias("pos"), "id", sec.alias("section"), (sec.isNull() & (F.col("type") != "admin")).alias("missing")))


@query("lost_ids", f"WITH {BLOCKS} SELECT id FROM blocks WHERE NOT ({CITED})")
def lost_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that an edit would lose."""
    b = base.blocks(spark, sf)
    return C.lost(b, b.where(base.cited()))


@query("same_ids", f"WITH {BLOCKS} SELECT count(*) FILTER (WHERE pos % 3 <> 0 AND pos % 2 = 0) AS only_before, count(*) FILTER (WHERE pos % 3 = 0 AND pos % 2 <> 0) AS only_after, count(*) FILTER (WHERE pos % 6 = 0) AS \"both\", count(*) FILTER (WHERE (pos % 2 = 0) <> (pos % 3 = 0)) = 0 AS equal FROM blocks")
def same_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of ids compared."""
    b = base.blocks(spark, sf)
    return C.same_set(b.where("pos % 2 = 0"), b.where("pos % 3 = 0"))


_PAGED = r"(^|[^\p{L}\p{N}_])(стр|страница|page|pg|слайд|slide)($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])[сp]\.\s*[0-9]|[0-9]\s*(из|of|/)\s*[0-9]"
_NUMBER = r"^[0-9]{1,3}$|^[-–—]\s*[0-9]{1,4}\s*[-–—]$|^[0-9]{1,4}\s*(/|из|of)\s*[0-9]{1,4}$|^(стр\.?|страница|с\.|page|p\.|pg\.|слайд|slide)\s*[0-9]{1,4}(\s*(из|of|/)\s*[0-9]{1,4})?$|^c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
_EDGED = r"regexp_replace(regexp_replace(l, '^[0-9]{1,4}(\s*[|·•—–-]\s)', '#\1'), '([|·•—–-]\s*)[0-9]{1,4}$', '\1#')"


@query("running_lines", f"""WITH {BLOCKS}, l AS (SELECT source, doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS l FROM blocks),
 k AS (SELECT source, doc_id, length(l) <= 24 AND l <> '' AND regexp_matches(l, '{_NUMBER}') AS number,
       trim(CASE WHEN regexp_matches(l, '{_PAGED}') THEN regexp_replace(l, '[0-9]+', '#', 'g') ELSE {_EDGED} END, ' .·|-–—') AS key FROM l),
 c AS (SELECT * FROM k WHERE key <> ''),
 n AS (SELECT source, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 1) AS n_odd FROM c GROUP BY source),
 p AS (SELECT source, key, count(DISTINCT doc_id) AS pages, count(DISTINCT doc_id) FILTER (WHERE doc_id % 2 = 1) AS odd, bool_or(number) AS number FROM c GROUP BY ALL)
 SELECT source, key, pages FROM p JOIN n USING (source) WHERE number OR (n >= 3 AND pages >= greatest(2, ceil(0.1 * n)))
  OR (n >= 6 AND (odd >= greatest(3, ceil(0.1 * n_odd)) OR pages - odd >= greatest(3, ceil(0.1 * (n - n_odd)))))""")  # fmt: skip
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on a tenth of a source's documents, or of its odd or even ones (a document in the role of a page, lines in that of headers)."""
    return B.running_lines(base.blocks(spark, sf), "source", "doc_id", "text", share=0.1)


@query("repeated_digests", f"WITH {BLOCKS} SELECT source, sha256(text) AS digest, count(DISTINCT doc_id) AS pages FROM blocks GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3")
def repeated_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Lines on three documents of a source or more."""
    return B.repeated_digests(base.blocks(spark, sf), "source", "doc_id", "text", 3)


@query("exact_duplicates", "WITH s AS (SELECT doc_id AS id, sha256(text) AS h FROM documents) SELECT id, first AS \"of\" FROM (SELECT id, min(id) OVER (PARTITION BY h) AS first FROM s WHERE h IS NOT NULL) WHERE id <> first")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents equal to an earlier one."""
    from selvage.operators.manifest import duplicate_sources

    d = table(spark, sf, "documents")
    return duplicate_sources(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("url_key")))


@query("vocabulary_sizes", "SELECT source, count(DISTINCT w) AS words FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS w FROM documents) GROUP BY source")
def vocabulary_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of each source."""
    return B.vocabulary(table(spark, sf, "documents"), "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("words"))


_PLAIN = f"regexp_replace(text, '{_FORMULA}', ' ', 'g')"


@query("letter_shares", f"SELECT doc_id, CASE WHEN len(regexp_extract_all({_PLAIN}, '\\p{{L}}')) > 0 THEN round(len(regexp_extract_all({_PLAIN}, '[à-öø-ÿ]')) / len(regexp_extract_all({_PLAIN}, '\\p{{L}}')), 3) END AS share FROM documents")
def letter_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a script (marked Latin letters here) among letters."""
    return table(spark, sf, "documents").select("doc_id", T.letter_share(F.col("text"), "à-ÿ").alias("share"))


@query("delooped_lines", f"""WITH {BLOCKS}, n AS (SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM blocks),
 f AS (SELECT * FROM n WHERE k <> ''), g AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS new FROM f),
 r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT doc_id, pos, id FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) <= 2""")  # fmt: skip
def delooped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without the third and later of equal neighbours."""
    return L.delooped(base.blocks(spark, sf), "doc_id", "pos", "text", junk="^$").select("doc_id", "pos", "id")


@query("section_places", f"""WITH {BLOCKS} SELECT id, 'D' || doc_id || ':§' || sum(CASE WHEN pos % 4 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS anchor,
 coalesce(last_value(CASE WHEN pos % 5 = 3 THEN 'p' || pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
          first_value(CASE WHEN pos % 5 = 3 THEN 'p' || pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS place FROM blocks""")  # fmt: skip
def section_places(spark: SparkSession, sf: str) -> DataFrame:
    """Section counters and carried locations (every fourth block a heading, every fifth a place)."""
    b = base.blocks(spark, sf).drop("source").withColumn("source", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    b = b.withColumn("level", F.when(F.col("pos") % 4 == 2, 1)).withColumn("place_", F.when(F.col("pos") % 5 == 3, F.concat(F.lit("p"), F.col("pos").cast("string"))))
    return B.carried_anchors(B.section_anchors(b), anchor="place_").select("id", "anchor", "place")


@query("style_mode", "SELECT source, lang, chars FROM (SELECT source, lang, sum(length(text)) AS chars FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY chars DESC, lang) = 1")
def style_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The language of most characters of each source."""
    return B.weighted_mode(table(spark, sf, "documents"), "source", "lang", "text")


@query("master_documents", f"WITH {BLOCKS} SELECT doc_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS body FROM blocks GROUP BY doc_id")
def master_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks assembled in order."""
    return B.assembled(base.blocks(spark, sf), ["doc_id"], "pos", "text").select("doc_id", F.sha2("body", 256).alias("body"))


@query("content_keys", "SELECT doc_id, sha256(coalesce(lang, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(n_chars::VARCHAR, '')) AS key FROM documents")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    """H1: content keys over parts."""
    return table(spark, sf, "documents").select("doc_id", T.stage_key(F.col("lang"), F.col("source"), F.col("n_chars")).alias("key"))


@query("labelled_verdicts", "SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE d.doc_id IS NULL) AS lost FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY ALL")
def labelled_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Label rows with their documents."""
    d = table(spark, sf, "documents").select("doc_id", F.lit(True).alias("there"))
    return table(spark, sf, "labels").join(d, "doc_id", "left").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("lost"))
