"""Column helpers for Unicode text whose meaning is the same in every engine.

Java's ``\\s`` is ASCII only, so white space is always spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Members of a Java character class: every code point that separates tokens.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, SOLID = f"[{SPACES}]", f"[^{SPACES}]"
#: The same among ASCII characters; Java matches this short class several times as fast.
ASCII_SPACE, ASCII_SOLID = r"[\t-\r\x1c-\x20]", r"[^\t-\r\x1c-\x20]"
#: A word is a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White-space runs become one space; none is left at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def is_ascii(c: Column) -> Column:
    """True where no character takes more than one byte; costs no scan of the text by a regular expression."""
    return F.octet_length(c) == F.length(c)


def tokens(c: Column) -> Column:
    whole = lambda solid: F.regexp_extract_all(c, F.lit(f"{solid}+"), F.lit(0))
    return F.when(is_ascii(c), whole(ASCII_SOLID)).otherwise(whole(SOLID))


def token_count(c: Column) -> Column:
    return F.when(is_ascii(c), F.regexp_count(c, F.lit(f"{ASCII_SOLID}+"))).otherwise(F.regexp_count(c, F.lit(f"{SOLID}+")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
