"""Text expressions that follow Unicode-aware matching rules."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns for digits, white space, citations and heading numbers.
DIGIT = r"\p{Nd}"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
CITATION = (
    rf"\[{DIGIT}+(?:{SPACE}*[,;–-]{SPACE}*{DIGIT}+)*\]"
    rf"|\([A-ZÀ-Ỹ][^()\n]{{0,100}},{SPACE}*{DIGIT}{{4}}[a-z]?\)"
)
HEADING_NUMBER = rf"^({DIGIT}+(?:\.{DIGIT}+)*)[.)]?{SPACE}"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """Every decimal digit of Unicode, and the ASCII digit of the same value."""
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(every), "".join(str(unicodedata.decimal(c)) for c in every)


def decimal_digits(text: Column) -> Column:
    return F.translate(text, *_digits())


def citation_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))


def heading_level(text: Column) -> Column:
    """Number of dotted parts of a leading number, 1 when there is none."""
    number = F.regexp_extract(text, HEADING_NUMBER, 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def fold_case(text: Column) -> Column:
    """Case folding for comparing names; ``Straße``, ``STRASSE`` and ``STRAẞE`` meet.

    The replacement also keeps the optimizer from reducing lower(upper(x)) to lower(x).
    """
    return F.lower(F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS")))


def line_count(text: Column) -> Column:
    """Lines of a text, a final line end not opening a new one, and at least one."""
    lines = F.size(F.split(text, LINE_END, -1))
    closed = text.rlike(rf"(?:{LINE_END})\z").cast("int")
    return F.greatest(F.lit(1), lines - closed)


def first_line(text: Column) -> Column:
    return F.split(text, LINE_END, 2)[0]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """File extension with its dot; none for ``.name``, ``name.`` and plain names."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?s)[^\s\x0B\x1C-\x1F\x85\p{{Z}}]")
