"""Operator 6: URL filtering with redirect equivalence (native).

Rules name a host (and its subdomains) and a path prefix; the longest that fits decides.  Redirect and
canonical-link edges make URLs equivalent: connected components over them carry the decisions to
aliases without a rule.  An explicit allow takes precedence: a URL with a rule keeps it, and an alias
with both an allowed and a blocked equivalent is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.llm.common import LOWER, UPPER
from selvage.llm.graph import components

#: (verdict, host/path) in any order; a path is always there, if only "/".
Rule = tuple[str, str]
#: Rules are part of the plan up to this number; a longer list comes as a table (:func:`by_table`).
MOST_LITERAL = 1000
DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: The two attributes in either order.
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fits(h: Column, p: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((h == rule_host) | F.endswith(h, F.concat(F.lit("."), rule_host))) & F.startswith(p, rule_path)


def by_list(h: Column, p: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_LITERAL:
        raise ValueError(f"more than {MOST_LITERAL} rules: use by_table")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        out = F.when(_fits(h, p, F.lit(rule[:at]), F.lit(rule[at:])), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def by_table(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, verdict) for urls (key, host, path) and a rule table (rule, verdict) of any size: an equi-join on host suffixes."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    table = rules.select(F.col("rule"), "verdict", F.substring_index("rule", "/", 1).alias("s"), F.expr("substring(rule, instr(rule, '/'))").alias("rp"))
    hit = urls.select(key, "path", suffix.alias("s")).join(table, "s").where(F.startswith("path", "rp"))
    return hit.groupBy(key).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("m")).select(key, "m.rule", "m.verdict")


def node(url: Column) -> Column:
    """What identifies a URL as an alias: host, path and query; scheme and fragment do not count."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), path(url), F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)))


def _undotted(p: Column) -> Column:
    """A path that starts with a slash without its '.' and '..' segments."""
    parts = F.slice(F.split(p, "/"), 2, F.size(F.split(p, "/")))
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, to: Column) -> Column:
    """The target of a link on the page ``url``, as a browser reads it; null for other schemes and for places in the page."""
    at = F.concat(F.lit("http://"), host(url))
    own, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(url), r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    return (
        F.when(F.rlike(to, F.lit(_SCHEME + "//")), to).when(F.rlike(to, F.lit(_SCHEME)) | F.startswith(to, F.lit("#")), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to)).when(~F.contains(url, F.lit("://")), F.lit(None))
        .when(F.startswith(to, F.lit("?")), F.concat(at, path(url), to))
        .otherwise(F.concat(at, _undotted(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b) from each page's URL to its canonical link and its refresh target; relative targets are resolved against the page's URL."""
    link = F.regexp_extract(F.regexp_extract("html", _TAG, 0), _HREF, 1)
    one = pages.select("url", F.explode(F.array(link, F.regexp_extract("html", _REFRESH, 1))).alias("to")).where("url IS NOT NULL AND to <> ''")
    to = F.col("to")
    for a, b in _ENTITIES:
        to = F.replace(to, F.lit(a), F.lit(b))
    return one.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), to)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judged(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html).

    ``edges`` (a, b: nodes as of :func:`node`) default to those found in the pages.  A URL that is null
    or has no ``://`` has empty host and path, fits no rule, has no aliases and gets ``allow``.
    Repeated rows and ids are judged row by row; other columns are ignored.
    """
    edges = page_edges(pages) if edges is None else edges
    same = components(edges)
    said = by_list(F.substring_index(F.substring_index(F.col("node"), "/", 1), "?", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1), rules)
    # an allowed member outranks a blocked one: 'allow' < 'block'
    decided = same.withColumn("v", said["verdict"]).where("v IS NOT NULL").groupBy("comp").agg(F.min("v").alias("alias_verdict"))
    named = same.join(decided, "comp").select(F.col("node").alias("__node"), "alias_verdict")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("__url"))
    rows = rows.withColumn("__rule", by_list(F.col("host"), F.col("path"), rules))
    rows = rows.join(named, F.col("__url") == F.col("__node"), "left")
    return rows.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", "alias_verdict", F.lit(DEFAULT)).alias("verdict"))
