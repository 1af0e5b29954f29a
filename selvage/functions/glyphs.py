"""Glyph classes, trivial locations and wide-text codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: P5, fixed values: operators, arrows, letterlike signs of formulas, mathematical alphanumerics and Greek.
MATH_GLYPH = (
    r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2190}-\x{21FF}\x{27F0}-\x{27FF}\x{2900}-\x{297F}\x{1D400}-\x{1D7FF}"
    r"\x{2100}-\x{2102}\x{2104}\x{2106}-\x{2108}\x{210A}-\x{2115}\x{2118}-\x{2121}\x{2123}-\x{214F}"
    r"\x{0391}-\x{03C9}\x{03D1}\x{03D5}\x{03F1}\x{03F5}\x{B1}\x{D7}\x{F7}\x{AC}]"
)
#: P5, fixed values: replacement and private characters, and control characters but for tab and line ends.
GARBLED = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFF}\x01-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]"
#: P5, fixed values: parts of the names of fonts that set formulas; Symbol counts as a whole name only.
MATH_FONTS = (
    "CMMI CMSY CMEX CMBSY MSAM MSBM EURM EUSM EUFM EUEX TeX-?math TeXGyre\\w*Math Cambria-?Math STIX LatinModern-?Math LMMath XITS Asana KaTeX MathJax "
    "rsfs stmary esint wasy bbold dsrom MTSY MTEX MT-?Extra Euclid ^Symbol(?:MT)?$"
).split()
#: P20, fixed values: words of locations that say nothing but a number.
LOCATION_WORDS = ("страница", "слайд", "page", "slide")


def math_glyphs(c: Column) -> Column:
    """P5: characters of formulas."""
    return F.regexp_count(c, F.lit(MATH_GLYPH))


def garbled(c: Column) -> Column:
    """P5: characters that a broken text layer leaves."""
    return F.regexp_count(c, F.lit(GARBLED))


def is_math_font(c: Column) -> Column:
    """P5: a font of formulas, by its name without the mark of a subset."""
    return F.rlike(F.regexp_replace(c, r"^[A-Z]{6}\+", ""), F.lit("(?i)" + "|".join(MATH_FONTS)))


def trivial_location(c: Column) -> Column:
    """P20: a heading such as 'Slide 7' or 'Page 12.', which contents leave out."""
    return F.rlike(c, F.lit(rf"(?iu)^({'|'.join(LOCATION_WORDS)})\s+[0-9]+\.?$"))


def _codec(head: bytes | None) -> str | None:
    if head is None or b"\0" not in head and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return None
    for mark, name in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    pairs = len(head) // 2
    if not pairs:
        return ""
    zeros = [head[at : 2 * pairs : 2].count(0) for at in (0, 1)]
    for name, few, many in (("utf-16-le", *zeros), ("utf-16-be", *reversed(zeros))):
        if few <= pairs // 100 and many >= 0.02 * pairs:
            break
    else:
        return ""
    for end in (2 * pairs, 2 * pairs - 2):  # the end may part a surrogate pair
        try:
            text = head[:end].decode(name)
        except UnicodeDecodeError:
            continue
        shown = sum(ch.isprintable() or ch in "\t\r\n" for ch in text)
        return name if text and shown >= 0.95 * len(text) else ""
    return ""


def wide_codec(c: Column) -> Column:
    """Codec of wide text by its first bytes: by a mark, else by the places of zero bytes.

    Empty if zero bytes look like binary data, null for ordinary text and for null; Arrow batches.
    """

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(_codec, na_action="ignore")

    return run(c)
