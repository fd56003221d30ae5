"""Text functions as column expressions.

Spark has neither Unicode normalization nor case folding. Characters for which both are plain (ASCII
and the Latin letters U+00C0..U+00FF, with sharp s folding to ss) stay in the JVM; only a text that
holds others goes through an Arrow function, and the rest of the column crosses as nulls.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.session import text_udf

#: A character outside what the built-in path handles exactly.
UNUSUAL = r"[^\x00-\x7F\xC0-\xFF]"
CJK = r"\x{3400}-\x{9FFF}"
#: Characters without width that cleaning takes out (fixed values of the corpus format).
INVISIBLE = r"[\xAD\x{FEFF}\x{200B}-\x{200F}\x{2060}]"
#: Blanks between two CJK characters.
BETWEEN = rf"(?<=[{CJK}])[ \t]+(?=[{CJK}])"
#: What closes a sentence or a clause, and so no heading.
CLOSING = "。！？.!?；;，,"
#: Search tokens (fixed values of the token format): ASCII words with inner joiners, or runs of CJK. The dotless i belongs to case-insensitive a-z.
TOKEN = r"[a-z0-9\x{131}]+(?:[._/+\-][a-z0-9\x{131}]+)*|[\x{3400}-\x{9FFF}]+"
SPACES = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def _nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def _casefold(text: str) -> str:
    return text.casefold()


def _arrow(f: Callable[[str], str], text: Column) -> Column:
    return text_udf(f)(_unusual(text))


def _unusual(text: Column) -> Column:
    return F.when(text.rlike(UNUSUAL), text)


def nfkc(text: Column, exact: bool = True) -> Column:
    return F.coalesce(_arrow(_nfkc, text), text) if exact else text


def casefold(text: Column, exact: bool = True) -> Column:
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_arrow(_casefold, text), plain) if exact else plain


def folded(text: Column, exact: bool = True) -> Column:
    """Compatibility normal form, case-folded."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_arrow(_folded, text), plain) if exact else plain


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def squeezed(text: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return stripped(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column, exact: bool = True) -> Column:
    return squeezed(folded(text, exact))


def binding_form(text: Column, exact: bool = True) -> Column:
    """Without any white space and case-folded, but not normalized: the form in which evidence is sought."""
    return casefold(F.regexp_replace(text, SPACES, ""), exact)


def clean_inline(text: Column, exact: bool = True) -> Column:
    bare = F.regexp_replace(nfkc(text, exact), INVISIBLE, "")
    blanks = F.regexp_replace(F.regexp_replace(bare, r"\xA0", " "), r"[ \t\f\x0B]+", " ")
    return stripped(F.regexp_replace(blanks, r"(?U)\s*\n\s*", "\n"))


def clean_block(text: Column, exact: bool = True) -> Column:
    """One line without invisible characters. Where no character is unusual only ASCII's white space is left to squeeze."""
    any_ = F.regexp_replace(squeezed(clean_inline(text, exact)), BETWEEN, "")
    return F.when(text.rlike(UNUSUAL), any_).otherwise(F.trim(F.regexp_replace(text, r"[\t-\r ]+", " ")))


#: What Markdown puts around words, in the order in which it goes: (pattern, the group that stays or 0 for none). Images, links, a leading
#: quotation mark, emphasis (fixed values of the corpus format).
MARKUP = ((r"!\[([^\]]*)\]\([^)]*\)", 1), (r"\[([^\]]+)\]\([^)]*\)", 1), (r"(?U)^\s*>\s?", 0), (r"(?<!\\)[*_~]{1,3}", 0))


def strip_markdown(text: Column, exact: bool = True) -> Column:
    bare = reduce(lambda t, rule: F.regexp_replace(t, rule[0], f"${rule[1]}" if rule[1] else ""), MARKUP, text)
    return clean_block(bare, exact)


def _pairs(run: Column) -> Column:
    """A CJK run as overlapping pairs (a single character as itself): the dictionary-free stand-in for word segmentation."""
    return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(text: Column, exact: bool = True) -> Column:
    """Search tokens of a text, in order."""
    normal = normalize_text(text, exact)
    units = F.regexp_extract_all(normal, F.lit(TOKEN), F.lit(0))
    parted = F.flatten(F.transform(units, lambda u: F.when(u.rlike(f"^[{CJK}]"), _pairs(u)).otherwise(F.array(u))))
    return F.when(normal.rlike(f"[{CJK}]"), parted).otherwise(units)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary")), 1, 20))


#: Lines that open a section (fixed values of the corpus format).
HEADINGS = (
    "^第[一二三四五六七八九十百零〇0-9]+(?:章|节|部分|篇)",
    r"(?U)^[一二三四五六七八九十]+[、.]\s*\S+",
    r"(?U)^\(?[0-9]{1,2}\)?[、.]\s*\S+",
    r"(?U)^(?i:(?:chapter|section|part|appendix)\s+[A-Z0-9IVX]+)",
    "^[A-Z][A-Z0-9 /&(),.-]{5,80}$",
)
PAGE_NUMBER = r"(?U)^(?:第\s*)?[-—–]?\s*\d{1,4}\s*(?:页|/\s*\d{1,4})?\s*[-—–]?$"


def is_heading(line: Column) -> Column:
    """Of a cleaned line: short, without closing punctuation, opening like a heading."""
    opens = F.lit(False)
    for pattern in HEADINGS:
        opens = opens | line.rlike(pattern)
    return (F.length(line) > 0) & (F.length(line) <= 100) & ~F.right(line, F.lit(1)).isin(*CLOSING) & opens


def heading_level(line: Column) -> Column:
    return F.when(F.length(line) <= 35, 1).otherwise(2)


def section_path(headings: Column) -> Column:
    """Fold of array<struct<level, text>>: each heading replaces all from its level down."""
    start = F.array().cast("array<string>")
    return F.aggregate(headings, start, lambda path, h: F.concat(F.slice(path, F.lit(1), F.least(F.greatest(h["level"], F.lit(1)), F.lit(6)) - 1), F.array(h["text"])))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)
