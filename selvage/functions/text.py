"""Scalar text functions as Column expressions.

Java regular expressions are ASCII by default; classes are spelled out where Unicode is meant.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RARE = r"\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[\s{_RARE}]+"
#: The runs that one space would change: all but a single space, which most are.
_WS_RUN = rf"[\t-\r{_RARE}][\s{_RARE}]*| [\s{_RARE}]+"
BLOCK_ID = r"[A-Z][0-9]+\.b[0-9]{3,}"
SRC_COMMENT = r"<!--\s*src:\s*([^>]*?)\s*-->"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_line(c: Column) -> Column:
    """runs of white space, NBSP included, become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def strip_math(c: Column) -> Column:
    """display and inline formulas become a space."""
    return F.regexp_replace(c, r"(?s)\$\$.*?\$\$|\$[^$\n]*\$", " ")


def text_size(c: Column) -> Column:
    """characters outside HTML comments and white space."""
    return F.length(F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), WS, ""))


def snippet(c: Column, limit: int = 80) -> Column:
    """one line of at most ``limit`` characters; formulas and cuts show as an ellipsis, which counts."""
    s = clean_line(F.regexp_replace(c, r"(?s)\$\$.*?\$\$|\$[^$\n]*\$", "…"))
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)


def index_line(c: Column, limit: int = 160) -> Column:
    """``limit`` characters of a line, then an ellipsis that does not count."""
    s = clean_line(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def first_sentence(c: Column, limit: int = 200) -> Column:
    """up to the first end mark before a space, cut at a word boundary with ' …'."""
    s = F.element_at(F.split(clean_line(c), r"(?<=[.!?…])\s", 2), 1)
    cut = F.regexp_replace(F.substring(s, 1, limit), r"\s+\S*$", "")
    return F.when(F.length(s) > limit, F.concat(cut, F.lit(" …"))).otherwise(s)


def escape_inline(c: Column) -> Column:
    r"""Markdown's inline marks get a backslash."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]<>#|$^~])", r"\\$1")


def escape_cell(c: Column) -> Column:
    """one line, inline marks and pipes escaped."""
    return escape_inline(clean_line(c))


def attr_value(c: Column) -> Column:
    """text for a quoted attribute: one line without quotes and backslashes."""
    return clean_line(F.regexp_replace(c, r'["\\]', " "))


def braces_balance(c: Column) -> Column:
    """F8: braces close in order and all close: the running depth never falls below zero and ends there."""
    steps = F.transform(F.regexp_extract_all(c, F.lit(r"([{}])"), 1), lambda b: F.when(b == "{", 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))
    end = F.aggregate(steps, zero, lambda a, s: F.struct((a.d + s).alias("d"), F.least(a.low, a.d + s).alias("low")))
    return (end["d"] == 0) & (end["low"] >= 0)


def wrap_bare_math(c: Column) -> Column:
    r"""F8: text with a bare TeX command becomes a formula if its braces balance, else code; other text stays."""
    bare = F.rlike(c, F.lit(r"\\[A-Za-z]+")) & ~F.contains(c, F.lit("$"))
    return F.when(~bare, c).when(braces_balance(c), F.concat(F.lit("$"), c, F.lit("$"))).otherwise(F.concat(F.lit("`"), c, F.lit("`")))


def tex_delimiters(c: Column) -> Column:
    r"""``\(…\)`` and ``\[…\]`` become ``$`` and ``$$``."""
    return F.regexp_replace(F.regexp_replace(c, r"\\\((.*?)\\\)", r"\$$1\$"), r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")


def escape_anchors(c: Column) -> Column:
    """a ``[[…]]`` anchor in front of a parenthesis must not read as a link."""
    return F.regexp_replace(c, r"(\[\[[^\]\n]+\]\])(?=\()", r"$1\\")


def location_anchor(c: Column) -> Column:
    """struct(anchor, rest) of a heading ``[[X:loc]] rest``; null without one."""
    p = r"^\s*\[\[([A-Z][0-9]*:[^\]\n]+)\]\]\s*(.*)$"
    return F.when(F.rlike(c, F.lit(p)), F.struct(F.regexp_extract(c, p, 1).alias("anchor"), F.regexp_extract(c, p, 2).alias("rest")))


def src_ids(c: Column) -> Column:
    """distinct block ids inside src comments, in order of appearance."""
    inside = F.regexp_extract_all(c, F.lit(SRC_COMMENT), 1)
    return F.array_distinct(F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(BLOCK_ID), 0))))


def topic_relative(c: Column, root: str) -> Column:
    """image targets without a scheme or a leading slash move below ``root``."""
    return F.regexp_replace(c, r"(!\[[^\]]*\]\()(?![a-z]+:|/)", rf"$1{root}/")


def clean_variant(c: Column) -> Column:
    """comments and anchors go; references to ids with a colon become their text."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"\[\[[A-Z][0-9]*:[^\]\n]+\]\]", "")
    return F.regexp_replace(c, r"\[([^\]]+)\]\(#[^)\s]*:[^)\s]*\)", "$1")


#: Letters and their transliterations.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "і": "i", "ї": "yi", "є": "ye", "ґ": "g", "ў": "u",
}
LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho", "σ": "sigma", "ς": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
}
#: Apostrophes, which vanish.
APOSTROPHES = "'’‘`ʼ"


def normal(c: Column, form: str) -> Column:
    """Unicode normal form, which no built-in function gives: Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    return run(c)


def _spelled(c: Column, table: dict[str, str]) -> Column:
    """Letters by their spelling: single ones and none by one ``translate``, the others one by one."""
    short = {a: b for a, b in table.items() if len(b) <= 1}
    kept = [a for a, b in short.items() if b]
    c = F.translate(c, "".join(kept) + "".join(a for a in short if a not in kept), "".join(short[a] for a in kept))
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b)) if len(b) > 1 else c
    return c


def slugify(c: Column, limit: int = 60) -> Column:
    """transliterated, lower-cased, runs of other characters become '-', cut at a word; empty is 'untitled'.

    Letters are looked up composed (so that a letter with a mark is one), Greek ones after
    decomposition; marks and letters without a transliteration vanish.
    """
    s = _spelled(F.lower(normal(c, "NFKC")), {**CYRILLIC, **LATIN, **dict.fromkeys(APOSTROPHES, "")})
    s = _spelled(normal(s, "NFKD"), GREEK)
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.substring(s, 1, limit)
    whole = F.when((F.length(s) > limit) & (F.substring(s, limit + 1, 1) != "-") & F.contains(head, F.lit("-")), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    whole = F.trim(whole, F.lit("-"))
    return F.when(whole == "", "untitled").otherwise(whole)


def human_title(c: Column) -> Column:
    """a file name without path and extension, '_' and runs of spaces as one space."""
    return clean_line(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,5}$", ""), "_+", " "))


def url_key(c: Column) -> Column:
    """a URL without scheme, 'www.', default port, fragment and trailing slash; path and query decoded."""
    s = F.regexp_replace(c, r"#.*$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^(?i)www\.", "")
    host = F.lower(F.regexp_extract(s, r"^[^/?]*", 0))
    rest = F.regexp_replace(s, r"^[^/?]*", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    return F.concat(host, F.regexp_replace(decoded, r"/(\?|$)", "$1"))


def url_display(c: Column) -> Column:
    """Host without 'www.' and the decoded path and query."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, r"://([^/?#]*)", 1)), r"^www\.", "")
    rest = F.regexp_extract(c, r"://[^/?#]*([^#]*)", 1)
    return F.concat(host, F.regexp_replace(F.coalesce(F.try_url_decode(rest), rest), "/$", ""))


def url_problem(c: Column) -> Column:
    """Why a URL can't be fetched, else null."""
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    port = F.regexp_extract(host, r":([^:\]]*)$", 1)
    return (
        F.when(F.rlike(c, F.lit(r"\s")), "space").when(~F.rlike(c, F.lit(r"^(?i)https?://")), "scheme").when(host == "", "host")
        .when(F.contains(host, F.lit("[")) & ~F.contains(host, F.lit("]")), "ipv6")
        .when((port != "") & (~F.rlike(port, F.lit("^[0-9]{1,5}$")) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535)), "port")
    )


def file_name(c: Column) -> Column:
    """Last step of a URL's path."""
    return F.regexp_extract(F.regexp_extract(c, r"://[^/?#]*([^?#]*)", 1), r"([^/]*)$", 1)


#: Hosts on which every page is a video, hosts on which some are, and extensions of media.
VIDEO_HOSTS = ("youtube.com", "youtu.be", "youtube-nocookie.com", "vkvideo.ru", "rutube.ru")
PARTLY_VIDEO_HOSTS = ("vk.com", "vk.ru")
MEDIA = {"video": ("mp4", "mkv", "webm", "avi", "mov"), "audio": ("mp3", "wav", "m4a", "ogg", "flac")}


def url_kind(c: Column) -> Column:
    """S13: 'video' by host (subdomains included) or extension, 'audio' by extension, else 'web'.

    On hosts that are only partly video the path must start with /video or /clip, or a query field ``z`` name one.
    """
    s = F.trim(c)
    host = F.rtrim(F.lower(F.regexp_extract(s, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))
    ext = F.lower(F.regexp_extract(file_name(s), r"\.([A-Za-z0-9]+)$", 1))
    on = lambda hosts: functools.reduce(lambda a, h: a | (host == h) | F.endswith(host, F.lit(f".{h}")), hosts, F.lit(False))
    path, query = F.regexp_extract(s, r"://[^/?#]*([^?#]*)", 1), F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda x: F.coalesce(F.try_url_decode(x), x))
    named = F.exists(fields, lambda x: F.rlike(x, F.lit(r"^z=(?i:video|clip)-?[0-9]")))
    some = on(PARTLY_VIDEO_HOSTS) & (F.rlike(path, F.lit("^/(?i:video|clip)")) | named)
    return F.when(on(VIDEO_HOSTS) | some | ext.isin(*MEDIA["video"]), "video").when(ext.isin(*MEDIA["audio"]), "audio").otherwise("web")


#: Format by extension, kind by format, first bytes by format.
FORMATS = {"pdf": "pdf", "pptx": "pptx", "docx": "docx", "md": "md", "markdown": "md", "tex": "tex", "html": "html", "htm": "html", "png": "image", "jpg": "image", "jpeg": "image", "mp4": "video", "mkv": "video", "mp3": "audio", "wav": "audio"}
KINDS = {"pptx": "slides", "image": "handwritten", "html": "web", "pdf": "pdf", "docx": "docx", "md": "markdown", "tex": "tex", "video": "video", "audio": "audio"}
MAGIC = {"255044462D": "pdf", "504B0304": "zip", "89504E470D0A1A0A": "image", "FFD8FF": "image", "1A45DFA3": "video", "494433": "audio"}


def file_format(name: Column, head: Column | None = None) -> Column:
    """Format by extension, else by the first bytes; null if neither tells."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), ext)
    if head is None:
        return out
    magic = F.lit(None).cast("string")
    for start, fmt in MAGIC.items():
        magic = F.when(F.startswith(F.hex(head), F.lit(start)), fmt).otherwise(magic)
    return F.coalesce(out, magic)


def kind_of(fmt: Column) -> Column:
    """Kind of source by format."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), fmt)


def html_title(c: Column) -> Column:
    """First title, else og:title, one line, 300 characters at most."""
    t = F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
    og = F.regexp_extract(c, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)", 1)
    s = F.when(F.trim(t) != "", t).otherwise(og)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.nullif(F.substring(clean_line(s), 1, 300), F.lit(""))


def html_charset(c: Column) -> Column:
    """Charset that a page declares, lower case."""
    return F.nullif(F.lower(F.regexp_extract(c, r"(?i)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)), F.lit(""))


def backslash_math(c: Column) -> Column:
    r"""``\(`` or ``\[`` outside code spans."""
    return F.rlike(F.regexp_replace(c, "`[^`\n]*`", ""), F.lit(r"\\[(\[]"))


#: P6, fixed patterns: texts that are nothing but a page number.
PAGE_NUMBER = (
    r"^[0-9]{1,3}$", r"^[-–—]\s*[0-9]{1,4}\s*[-–—]$", r"^[0-9]{1,4}\s*/\s*[0-9]{1,4}$", r"(?iu)^[0-9]{1,4}\s*(из|of)\s*[0-9]{1,4}$",
    r"(?iu)^(стр\.?|страница|с\.|page|p\.|pg\.|слайд|slide)\s*[0-9]{1,4}(\s*(из|of|/)\s*[0-9]{1,4})?$",
    r"(?i)^(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$",
)
#: P7, fixed patterns: words of page numbering, and a number at an edge next to a separator.
PAGE_WORD = r"(?iuU)(?<!\w)(стр|страница|page|pg|слайд|slide)(?!\w)|(?<!\w)[сp]\.\s*[0-9]|[0-9]\s*(из|of|/)\s*[0-9]"
ENDS = " .·|-–—"
EDGE_FIRST, EDGE_LAST = r"^[0-9]{1,4}(?=\s*[|·•—–-]\s)", r"([|·•—–-]\s*)[0-9]{1,4}$"


def is_page_number(c: Column) -> Column:
    """At most 24 characters and one of the page-number forms."""
    return let(clean_line(c), _is_page_number)


def _is_page_number(s: Column) -> Column:
    return (F.length(s) <= 24) & functools.reduce(lambda a, p: a | F.rlike(s, F.lit(p)), PAGE_NUMBER, F.lit(False))


def running_key(c: Column) -> Column:
    """Digits masked where a page word occurs, else only a number at the edge next to a separator; separators at the ends go."""
    return let(F.lower(clean_line(c)), _running_key)


def _running_key(s: Column) -> Column:
    edge = F.regexp_replace(F.regexp_replace(s, EDGE_FIRST, "#"), EDGE_LAST, "$1#")
    masked = F.when(F.rlike(s, F.lit(PAGE_WORD)), F.regexp_replace(s, "[0-9]+", "#")).otherwise(edge)
    # only digits are masked, so a line without one needs none of the patterns
    return F.trim(F.when(F.rlike(s, F.lit("[0-9]")), masked).otherwise(s), F.lit(ENDS))


def has_running_key(c: Column) -> Column:
    """Whether :func:`running_key` is not empty, by the first character that it keeps."""
    return F.rlike(c, F.lit(rf"[^\s{_RARE}.·|\-–—]"))


def running_marks(c: Column) -> Column:
    """struct(key, number) of a line that is cleaned once."""
    return let(clean_line(c), lambda s: F.struct(let(F.lower(s), _running_key).alias("key"), _is_page_number(s).alias("number")))


def line_type(c: Column) -> Column:
    """Block type of one Markdown paragraph; null for blanks, comments and rules."""
    s = F.trim(c)
    has = lambda p: F.rlike(s, F.lit(p))
    return (
        F.when(s.isNull() | (s == "") | has(r"(?s)^<!--.*-->$") | has(r"^(\*\s*){3,}$|^(-\s*){3,}$"), None)
        .when(has(r"(?s)^(\$\$.*?\$\$[\s.,;:]*)+$"), "formula").when(has(r"^(!\[[^\]]*\]\([^)]*\)\s*)+$"), "figure")
        .when(has("^#{1,6} "), "heading").when(has(r"^([-*+]|[0-9]+[.)]) "), "list").when(has(r"^\|.*\|$"), "table")
        .when(has("^> ?"), "quote").when(has("^(```|~~~)"), "code").otherwise("paragraph")
    )


#: P13, fixed patterns in order: what an agent's error text means.  A mere mention of a login counts last.
ERRORS = (
    ("auth", r"(?i)not logged in|\b401\b|unauthori[sz]ed|authentication[_ ]failed|invalid api key|invalid x-api-key|please run /login|oauth token|token (has )?expired|not authenticated|login required"),
    ("rate_limit", r"(?i)rate[_ -]?limit|\b429\b|usage limit|limit reached|hit your (usage )?limit|too many requests|quota|overloaded|\b529\b"),
    ("auth", r"(?i)\blog ?in\b|credentials"),
)


def error_kind(c: Column) -> Column:
    """The first class whose pattern occurs, else null."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(ERRORS):
        out = F.when(F.rlike(c, F.lit(p)), kind).otherwise(out)
    return out


def safe_path(c: Column) -> Column:
    """Relative, without '..', hidden steps, drives, streams or backslashes."""
    return ~F.rlike(c, F.lit(r"(^|/)\.|^/|[\\:]|(^|/)$")) & (F.length(c) > 0)


def letter_share(c: Column, script: str = r"\u0400-\u04ff") -> Column:
    """Share of a script among the letters outside formulas, 3 digits; null without letters."""
    s = strip_math(c)
    n = F.regexp_count(s, F.lit(r"\p{L}"))
    return F.when(n > 0, F.round(F.regexp_count(s, F.lit(rf"[{script}&&\p{{L}}]")) / n, 3))


# -- numbers -------------------------------------------------------------------------------


def percent(part: Column, total: Column) -> Column:
    """Floor to one decimal with a comma, never 100 unless complete; a dash without a total."""
    x = F.floor(F.least(100 * part / total, F.lit(99.9)) * 10 + F.lit(1e-9)) / 10
    shown = F.when(part < total, F.format_string("%.1f", x)).otherwise("100")
    return F.when(total == 0, "—").otherwise(F.concat(F.replace(F.regexp_replace(shown, r"\.0$", ""), F.lit("."), F.lit(",")), F.lit("%")))


def clock(seconds: Column) -> Column:
    """M:ss, or h:mm:ss from an hour on; negative times are zero."""
    t = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    h, m, s = F.floor(t / 3600).cast("long"), (F.floor(t / 60) % 60).cast("long"), (t % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def srt_time(seconds: Column) -> Column:
    """Hh:mm:ss,mmm with rounded milliseconds."""
    ms = F.greatest(F.round(seconds * 1000), F.lit(0)).cast("long")
    part = lambda d, m: (F.floor(ms / d) % m).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), (ms % 1000).cast("long"))


def parse_clock(c: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, else null."""
    p = r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})$"
    num = lambda g: F.coalesce(F.nullif(F.regexp_extract(c, p, g), F.lit("")).cast("long"), F.lit(0))
    return F.when(F.rlike(c, F.lit(p)), num(1) * 3600 + num(2) * 60 + num(3))


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, one decimal from KB on."""
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1 << 30, F.format_string("%.1f MB", F.bround(n / (1 << 20), 1))).otherwise(F.format_string("%.1f GB", F.bround(n / (1 << 30), 1)))
    )


def human_seconds(s: Column) -> Column:
    """Seconds, minutes or hours and minutes, rounded half to even."""
    m = F.bround(s / 60).cast("long")
    return F.when(s < 60, F.format_string("%d s", F.bround(s).cast("long"))).when(m < 60, F.format_string("%d min", m)).otherwise(F.format_string("%d h %02d min", F.floor(m / 60).cast("long"), m % 60))


def iso_time(c: Column) -> Column:
    """Timestamp of ISO text; without a zone it is UTC, and what is no time is null."""
    return F.try_to_timestamp(c)


def runs(chars: Column, each: int) -> Column:
    """Ceiling division, one at least."""
    return F.greatest(F.lit(1), F.ceil(chars / each)).cast("long")


def stage_key(*parts: Column) -> Column:
    """H1: sha256 of the parts joined by the unit separator; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def join_hyphenated(left: Column, right: Column, known: Column, hyphenating: Column) -> Column:
    """how a line that ends in a hyphen joins the next: glued, with its hyphen, or null (not one word).

    ``known`` is the array of the document's words.  A soft hyphen glues; a known compound keeps its
    hyphen; a known glued word glues; else the habit of the document decides.
    """
    a, b = F.regexp_extract(left, r"(?u)([\p{L}]+)[-\u00ad]$", 1), F.regexp_extract(right, r"(?u)^(\p{Ll}[\p{L}]*)", 1)
    glued, compound = F.concat(a, b), F.concat(a, F.lit("-"), b)
    return (
        F.when((a == "") | (b == ""), None).when(F.endswith(left, F.lit("\u00ad")), glued)
        .when(F.array_contains(known, F.lower(compound)), compound).when(F.array_contains(known, F.lower(glued)) | hyphenating, glued).otherwise(compound)
    )
