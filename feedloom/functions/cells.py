"""Spreadsheet cells and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (results depend on them) -------------------------------------
COMPANY_WORDS = ["firma", "company", "virksomhed", "employer", "arbejdsgiver"]
CITY_WORDS = ["by", "city", "kommune", "location", "lokation", "sted"]
COUNT_WORDS = ["antal", "count", "number", "n", "employees", "medarbejdere"]
INDEX_WORDS = ["indeks", "index", "idx", "salary", "løn", "median", "average", "gennemsnit"]
COMPOUND_WORDS = ["antal", "indeks", "løn", "gennemsnit", "medarbejdere"]
ID_WORDS = ["id", "personnummer"]
HEADER_SEARCH_ROWS = 10
# --- end of fixed values ---------------------------------------------------------

WORD = "a-zæøåöäü0-9"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Trim any white space at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def parse_number(c: Column) -> Column:
    """Localized number in a text cell, null when it is none or ambiguous.

    With both separators dots are thousands and the comma is the decimal sign.  A
    lone comma followed by exactly three digits is ambiguous and rejected.  Values
    that are not finite are rejected too.
    """
    text = F.replace(F.translate(strip(c), " ", " "), F.lit(" "), F.lit(""))
    comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    plain = (
        F.when(comma & dot, F.translate(text, ",.", "."))
        .when(comma & text.rlike(r"^[+-]?\d+,\d{3}$"), F.lit(None))
        .when(comma, F.translate(text, ",", "."))
        .otherwise(text)
    )
    digits = F.regexp_replace(plain, r"(?<=\d)_(?=\d)", "")
    value = F.when(digits.rlike(_NUMBER), digits).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def is_ambiguous_number(c: Column) -> Column:
    """Dot used as decimal sign together with a thousands comma (``1,234.56``)."""
    return F.coalesce(strip(c).rlike(r"^[+-]?\d{1,3}(?:,\d{3})*,?\d*\.\d+$") & F.contains(c, F.lit(",")), F.lit(False))


def header_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]+)"), F.lit(1))


def header_matches(c: Column, words: list[str]) -> Column:
    """A word of the list is a token of the header, or a compound word is inside it."""
    hit = F.arrays_overlap(header_tokens(c), F.array(*[F.lit(w) for w in words]))
    for w in words:
        if w in COMPOUND_WORDS:
            hit = hit | F.contains(F.lower(c), F.lit(w))
    return F.coalesce(hit, F.lit(False))


def column_type(c: Column) -> Column:
    """``count``, ``index`` or null; count words win."""
    return F.when(header_matches(c, COUNT_WORDS), "count").when(header_matches(c, INDEX_WORDS), "index")


def strip_type_words(c: Column, words: list[str]) -> Column:
    """Category name left after the type words are taken out of a header."""
    pattern = f"(?<![{WORD}])(?:{'|'.join(words)})(?![{WORD}])"
    return F.btrim(F.regexp_replace(F.lower(c), pattern, ""), F.lit(" _-"))
