"""Column expressions for lines of text: breaks, white space, digits, headers and table rows.

All regular expressions here mean the same in Java and in RE2, so the checking SQL uses them too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks (fixed values); CRLF first, else it would make a blank line.
NL = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: White space (fixed values).
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: The characters of WS, for trims, which look at the ends of a text only.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Digits beyond \p{Nd} (fixed values): superscripts, circled and other digit characters.
_DIGITS = "B2-B3 B9 1369-1371 19DA 2070 2074-2079 2080-2089 2460-2468 2474-247C 2488-2490 24EA 24F5-24FD 24FF 2776-277E 2780-2788 278A-2792 10A40-10A43 10E60-10E68 11052-1105A 1F100-1F10A"
DIGIT = r"[\p{Nd}" + "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in _DIGITS.split()) + "]"
EDGES = f"^{WS}|{WS}$"
NOT_CAPITAL = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]"
#: A longer line is no header.
HEADER_CHARS = 80
GENERAL = "General"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(SPACES))


def strip_end(x: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(x, F.lit(SPACES))


def blank(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def has_digit(x: Column) -> Column:
    return F.coalesce(x.rlike(DIGIT), F.lit(False))


def is_table_row(s: Column) -> Column:
    """Of a stripped line: it holds a pipe, a tab or two blanks in a row."""
    return s.contains("|") | s.contains("\t") | s.contains("  ")


def is_header(s: Column, before: Column) -> Column:
    """Of a stripped line and the stripped line before it (null or empty if blank)."""
    capitals = s.rlike(r"\p{Lu}") & ~s.rlike(NOT_CAPITAL)
    return (s != "") & (F.length(s) <= HEADER_CHARS) & ~has_digit(s) & ~has_digit(before) & (s.endswith(":") | capitals)


def title_of(s: Column) -> Column:
    """A header line as a title: trailing colons go, nothing left is General."""
    return F.coalesce(F.nullif(F.regexp_replace(s, ":+$", ""), F.lit("")), F.lit(GENERAL))


def row_cells(s: Column) -> Column:
    """Cells of a stripped table row: pipes beat tabs, tabs beat runs of blanks; empty cells go."""
    parts = F.when(s.contains("|"), F.split(s, r"\|")).when(s.contains("\t"), F.split(s, "\t")).otherwise(F.split(s, " {2,}"))
    return F.filter(F.transform(parts, strip), lambda c: c != "")


def default(x: Column, value: str) -> Column:
    """x, or value where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(value))
