"""Markdown and page-text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selvage.functions.text import clean_line, let

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"


def plain_text(c: Column) -> Column:
    """text of Markdown: marks, link targets and list signs go; formulas stay."""
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^\s*(#{1,6}|[-*+]|[0-9]+[.)]|>)\s+", "")
    return F.trim(F.regexp_replace(c, r"(\*\*|__|`)", ""))


def front_matter(c: Column) -> Column:
    """struct(meta, body): a block between '---' at the very top, and what follows it."""
    has = F.rlike(c, F.lit(FRONT))
    return F.struct(F.when(has, F.regexp_extract(c, FRONT, 1)).alias("meta"), F.when(has, F.regexp_replace(c, FRONT, "")).otherwise(c).alias("body"))


def compose_source(meta: Column, body: Column) -> Column:
    """The inverse of :func:`front_matter`."""
    return F.when(meta.isNull(), body).otherwise(F.concat(F.lit("---\n"), meta, F.lit("\n---\n"), body))


def meta_value(meta: Column, key: str) -> Column:
    """A scalar of a front matter, quotes off; null if it has none."""
    v = F.regexp_extract(meta, rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.nullif(F.regexp_replace(F.trim(v), "^[\"'](.*)[\"']$", "$1"), F.lit(""))


def unfenced(c: Column) -> Column:
    """without a fence around the whole text."""
    p = r"(?s)\A\s*```[a-z]*\n(.*)\n```\s*\z"
    return F.when(F.rlike(c, F.lit(p)), F.regexp_extract(c, p, 1)).otherwise(c)


def normal_page(c: Column) -> Column:
    """outer fence off, titles one and two levels deep at the third, runs of blank lines as one."""
    c = F.regexp_replace(unfenced(c), r"(?m)^#{1,2} (?!#)", "### ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def div_balance(c: Column) -> Column:
    """struct(open, stray, drop): divs left open at the end, closers without an opener, and the lines of these.

    Lines of fenced code and of display formulas do not count; a fence closes with its own mark, a formula with the next ``$$``.
    """
    state = "struct<no:int,open:int,fence:string,math:boolean,drop:array<int>>"
    zero = F.struct(F.lit(0), F.lit(0), F.lit(""), F.lit(False), F.array().cast("array<int>")).cast(state)

    def step(a: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, r"^ {0,3}(```|~~~)", 1)
        fence = F.when(a["math"], a["fence"]).when(a["fence"] == "", mark).when(mark == a["fence"], "").otherwise(a["fence"])
        code = (a["fence"] != "") | (fence != "")
        odd = F.pmod(F.regexp_count(x, F.lit(r"\$\$")), F.lit(2)) == 1
        math = F.when(code, a["math"]).otherwise(a["math"] != odd)
        plain = ~code & ~a["math"]
        closes, opens = plain & F.rlike(x, F.lit(r"^:::+\s*$")), plain & F.rlike(x, F.lit(r"^:::+\s*[^:\s]"))
        depth = a["open"] + F.when(opens, 1).when(closes & (a["open"] > 0), -1).otherwise(0)
        drop = F.when(closes & (a["open"] == 0), F.array_append(a["drop"], a["no"])).otherwise(a["drop"])
        return F.struct(a["no"] + 1, depth, fence, math, drop).cast(state)

    return let(F.aggregate(F.split(c, "\n"), zero, step), lambda end: F.struct(end["open"].alias("open"), F.size(end["drop"]).alias("stray"), end["drop"].alias("drop")))


def balanced_divs(c: Column) -> Column:
    """the text without closers that close nothing, and with closers for the divs that stay open.

    Text and balance are computed once for all lines; a text without a mark stays as it is.
    """

    def mended(md: Column, end: Column) -> Column:
        kept = F.filter(F.split(md, "\n"), lambda x, i: ~F.array_contains(end["drop"], i))
        return F.concat(F.array_join(F.when(F.size(end["drop"]) > 0, kept).otherwise(F.split(md, "\n")), "\n"), F.repeat(F.lit("\n:::"), end["open"]))

    return let(c, lambda md: F.when(~F.contains(md, F.lit(":::")), md).otherwise(let(div_balance(md), lambda end: mended(md, end))))


def clean_markdown(c: Column, shift: int = 2) -> Column:
    """br as line ends, sup and sub as ^ and ~, other tags off, headings ``shift`` deeper, six at most."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</?sup>", "^"), r"(?i)</?sub>", "~")
    c = F.regexp_replace(c, r"</?[A-Za-z][^>\n]*>", "")
    c = F.regexp_replace(c, r"(?m)^(#{1,6}) ", "#" * shift + "$1 ")
    return F.regexp_replace(c, r"(?m)^#{7,} ", "###### ")


def fixed_heading(md: Column, title: Column, level: Column, anchor: Column) -> Column:
    """the text starts with the section's own heading; another first heading is replaced."""
    own = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit(" {#"), anchor, F.lit("}"))
    rest = F.regexp_replace(F.ltrim(md), r"\A#{1,6} [^\n]*\n*", "")
    return F.concat(own, F.lit("\n\n"), rest)


def unnumbered(c: Column) -> Column:
    """headings marked as unnumbered unless they are."""
    return F.regexp_replace(c, r"(?m)^(#{1,6} (?!.*\{[^}]*\.unnumbered)[^{\n]*?)\s*$", "$1 {.unnumbered}")


def strip_title(md: Column, title: Column) -> Column:
    """without a first line that repeats the title."""
    first = F.regexp_replace(F.element_at(F.split(F.ltrim(md), "\n", 2), 1), r"^#{1,6}\s+", "")
    same = F.lower(clean_line(first)) == F.lower(clean_line(title))
    return F.when(same, F.ltrim(F.coalesce(F.get(F.split(F.ltrim(md), "\n", 2), F.lit(1)), F.lit("")))).otherwise(md)


def slide_heading(source: Column, number: Column, title: Column) -> Column:
    """``### [[A1:s12]] title``."""
    return F.rtrim(F.concat(F.lit("### [["), source, F.lit(":s"), number.cast("string"), F.lit("]] "), F.coalesce(title, F.lit(""))))


def title_fragments(c: Column) -> Column:
    """parts of a title between formulas and quotes that hold a word."""
    parts = F.split(c, "\\$[^$]*\\$|[\"'«»“”„]")
    return F.filter(F.transform(parts, clean_line), lambda x: F.rlike(x, F.lit(r"(?U)\w")))


def tex_math(c: Column, display: bool) -> Column:
    r"""labels and \nonumber go; in display math, align and gather become aligned and gathered."""
    c = F.regexp_replace(c, r"\\(label|tag)\*?\{[^}]*\}|\\(nonumber|notag)\b", "")
    if display:
        c = F.regexp_replace(F.regexp_replace(c, r"\{(align|eqnarray|flalign)\*?\}", "{aligned}"), r"\{(gather|multline)\*?\}", "{gathered}")
    return F.trim(c)


#: F30, fixed values: words that open a theorem-like paragraph, by block type.
LABELS = {"definition": ("определение", "definition"), "theorem": ("теорема", "theorem"), "lemma": ("лемма", "lemma"), "example": ("пример", "example"), "proof": ("доказательство", "proof"), "remark": ("замечание", "remark")}


def theorem_label(c: Column) -> Column:
    """struct(type, title, rest) of 'Theorem 1.2 (title). rest'; null if no known label opens the text."""
    p = r"(?sU)^\W*(\p{L}+)\s*([0-9.]*)\s*(?:\(([^)]*)\))?\s*[.:]\s*(.*)$"
    kind = F.element_at(F.create_map(*(F.lit(x) for k, names in LABELS.items() for n in names for x in (n, k))), F.lower(F.regexp_extract(c, p, 1)))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.nullif(F.regexp_extract(c, p, 3), F.lit("")).alias("title"), F.regexp_extract(c, p, 4).alias("rest")))


def split_display(c: Column) -> Column:
    """a paragraph as an array of text and display formulas, each formula with the punctuation behind it."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(\$\$.*?\$\$[.,;:]?|(?:(?!\$\$).)+)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def glossary_terms(c: Column) -> Column:
    """F32: terms of a glossary's bullets: bold, or text before a dash; no formulas, 80 characters at most."""
    bullets = F.regexp_extract_all(c, F.lit(r"(?m)^[-*] +(.+)$"), 1)
    bold = lambda b: F.regexp_extract(b, r"^\*\*([^*]+)\*\*", 1)
    term = lambda b: F.trim(F.when(bold(b) != "", bold(b)).otherwise(F.regexp_extract(b, r"^([^—–-]+?)\s+[—–-]\s", 1)))
    return F.filter(F.transform(bullets, term), lambda t: (t != "") & ~F.rlike(t, F.lit(r"[$\\]")) & (F.length(t) <= 80))


def prompt(title: Column, terms: Column, most: int = 520) -> Column:
    """F32: a recogniser's prompt: the title and whole terms, distinct without case, up to ``most`` characters."""
    step = lambda a, t: F.when(F.array_contains(a.seen, F.lower(t)) | (F.length(a.out) + F.length(t) + 2 > most), a).otherwise(
        F.struct(F.concat(a.out, F.lit(", "), t).alias("out"), F.array_append(a.seen, F.lower(t)).alias("seen"))
    )
    return F.aggregate(terms, F.struct(F.coalesce(title, F.lit("")).alias("out"), F.array().cast("array<string>").alias("seen")), step)["out"]


def fixed_lines(c: Column) -> Column:
    """array of struct(at, text) of '[mm:ss] text' lines; other lines continue the one before."""
    joined = F.regexp_replace(c, r"\n(?!\[\d)", " ")
    rows = F.regexp_extract_all(joined, F.lit(r"(?m)^(\[\d+:\d{2}(?::\d{2})?\].*)$"), 1)
    return F.transform(rows, lambda r: F.struct(F.regexp_extract(r, r"^\[([\d:]+)\]", 1).alias("at"), F.trim(F.regexp_extract(r, r"^\[[\d:]+\](.*)$", 1)).alias("text")))


def safe_link(c: Column) -> Column:
    """a link target with an allowed scheme, a relative one, or '#'."""
    return F.when(F.rlike(c, F.lit(r"(?i)^(https?:|mailto:|#|/|\.{0,2}/?[a-z0-9_-][^:]*$)")), c).otherwise("#")


def local_images(c: Column) -> Column:
    """remote images become links."""
    return F.regexp_replace(c, r"!\[([^\]]*)\]\((https?://[^)\s]+)[^)]*\)", "[$1]($2)")


def notes_block(c: Column) -> Column:
    """speaker notes as a div; null for none."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit("::: notes\n"), F.trim(c), F.lit("\n:::")))


def uncertain_block(title: Column, text: Column) -> Column:
    """text whose reading is not sure."""
    return F.concat(F.lit("::: {.uncertain title=\""), title, F.lit("\"}\n"), text, F.lit("\n:::"))


def plain_math_letters(c: Column) -> Column:
    """mathematical alphanumerics as plain letters (the Latin part of the block is a fixed cycle of 52)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    styled = "".join(chr(0x1D400 + i) for i in range(13 * 52))
    digits = "".join(chr(0x1D7CE + i) for i in range(50))
    return F.translate(F.translate(c, styled, letters * 13), digits, "0123456789" * 5)


def despaced(c: Column) -> Column:
    """letters set apart, «М А Т Р И Ц А», as one word; at least four single letters in a row."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<=\b\p{L}) (?=\p{L}\b(?: \p{L}\b){2})|(?<=\b\p{L} \p{L}) (?=\p{L}\b)", "\u0001"), "\u0001", "")


def page_notes(*rules: tuple[Column, Column]) -> Column:
    """Notes whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), note) for cond, note in rules)))


def uncertain_counts(c: Column) -> Column:
    """struct(unreadable, uncertain) marks of a page."""
    return F.struct(F.regexp_count(c, F.lit(r"\[\?\]")).alias("unreadable"), F.regexp_count(c, F.lit(r"\[[^\]?]+\?\]")).alias("uncertain"))
