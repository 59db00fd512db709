"""Normalization of posting titles and company names.

Every function maps a Column to a Column and stays inside generated code.  The
expensive Unicode steps are guarded by cheap exact tests (``octet_length`` equals
``length`` for pure ASCII; a character class tells whether any rule can fire), so
ordinary rows pay for a lower-casing and one or two regular expressions.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (results depend on them) -------------------------------------
INVISIBLE = "­​‌‍﻿"
NBSP = " "
UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
DASHES = "‐‑‒–—―−"

GENDER_SUFFIX = r"[:*_]in(?:nen)?\b"
GENDER_WORDED = r"[(\[]\s*(?:all\s+genders?|alle\s+geschlechter)\s*[)\]]"
GENDER_SLASHLESS = r"[(\[]\s*(?:mwd|wmd|mfd|fmd|dmw|wdm|fmx|mwi|gn)\s*[)\]]"
GENDER_SLASHED = r"[(\[]?\s*[mwfdxign]\s*(?:/\s*[mwfdxign]\s*){1,2}[)\]]?"
GENDER_STAR = r"\(\s*\*\s*\)|\*"

LEGAL_FORMS = [
    "gmbh & co. kg", "gmbh & co kg", "ag & co. kg", "ag & co kg", "co. kg", "co kg",
    "gmbh", "mbh", "ohg", "gbr", "kgaa", "kg", "gag", "ag", "se", "ug", "e.v.", "ev",
    "gruppe", "group", "holding", "deutschland", "germany",
]
# --- end of fixed values ---------------------------------------------------------

# The slashed marker only where it stands on its own, for callers that do not want
# "system/network" to lose letters.
GENDER_SLASHED_STRICT = r"(?<![a-z0-9])" + GENDER_SLASHED + r"(?![a-z0-9])"

# Any title rule needs one of these characters.
_TITLE_TRIGGER = r"[:*_/(\[]"


def _unicode(pattern: str) -> str:
    """Give ``\\s`` and ``\\b`` their Unicode meaning on every Java version."""
    return "(?U)" + pattern


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """Compatibility decomposition as (matching, replacement, class, json map).

    The first two strings feed ``translate``: one-to-one foldings, then everything
    that is deleted (combining marks and invisible characters).  Characters with a
    longer decomposition go to the map.  Hangul syllables are left composed; they
    only decompose to other letters outside ASCII, which no rule looks at.
    """
    one: dict[str, str] = {NBSP: " "}
    many: dict[str, str] = {}
    deleted = list(INVISIBLE)
    dash = dict.fromkeys(map(ord, DASHES), "-")
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if ch in INVISIBLE:
            continue
        full = unicodedata.normalize("NFKD", ch)
        out = "".join(x for x in full if not unicodedata.combining(x)).translate(dash)
        if out == ch:
            continue
        if out == "":
            deleted.append(ch)
        elif len(out) == 1:
            one[ch] = out
        else:
            many[ch] = out
    matching = "".join(one) + "".join(deleted)
    char_class = "[" + "".join(many) + "]"
    return matching, "".join(one.values()), char_class, json.dumps(many, ensure_ascii=False)


def strip_invisibles(c: Column) -> Column:
    """Delete zero-width characters and soft hyphens; NBSP becomes a space."""
    return F.translate(c, NBSP + INVISIBLE, " ")


def fold_letters(c: Column) -> Column:
    """First half of ``fold``: all foldings to a single character, and deletions."""
    matching, replacement, _, _ = _fold_tables()
    out = F.lower(c)
    for src, dst in UMLAUTS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    out = F.translate(out, matching, replacement)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(out)


def fold_ligatures(c: Column) -> Column:
    """Second half of ``fold``: characters that decompose into several."""
    _, _, char_class, many = _fold_tables()
    table = F.from_json(F.lit(many), "map<string,string>")
    spelled = F.array_join(
        F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), ""
    )
    return F.when((F.octet_length(c) != F.length(c)) & c.rlike(char_class), spelled).otherwise(c)


def fold(c: Column) -> Column:
    """Lower case, German transliteration, accents off, dashes unified.

    Also drops the invisible characters, so ``fold`` is complete on its own.
    """
    return fold_ligatures(fold_letters(c))


def collapse(c: Column) -> Column:
    """Every run outside ``[a-z0-9]`` becomes one space; trimmed."""
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def title_rules(folded: Column, strict: bool = False) -> Column:
    """Remove the gender markers from folded text."""
    slashed = GENDER_SLASHED_STRICT if strict else GENDER_SLASHED
    for pattern, put in (
        (GENDER_SUFFIX, ""),
        (GENDER_WORDED, " "),
        (GENDER_SLASHLESS, " "),
        (slashed, " "),
        (GENDER_STAR, " "),
    ):
        folded = F.regexp_replace(folded, _unicode(pattern), put)
    return folded


def may_have_marker(folded: Column) -> Column:
    """Every title rule needs one of a few punctuation characters."""
    return folded.rlike(_TITLE_TRIGGER)


def normalize_title(c: Column, strict: bool = False) -> Column:
    """Title part of the posting key.

    ``strict`` keeps the letters of words such as ``system/network``, which the
    default rule treats as a marker.
    """
    return collapse(title_rules(fold(F.coalesce(c, F.lit(""))), strict))


def _whole_tokens(forms: list[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(re.escape(f) for f in forms) + ")(?![a-z0-9])"


def _legal_form_passes() -> tuple[str, str, list[str]]:
    """(dotted form, one pattern, three patterns) that equal removing the forms one at a
    time, longest first.

    A removal puts a space where a whole token stood, so it neither makes nor breaks the
    edges of another token, and one alternation does for all - except around the form that
    ends in a dot.  That one can be uncovered by an earlier removal ("e.v.gmbh") or be
    hidden from it until a later one ("e.v.kg"), so where it occurs it gets a turn of its
    own between the forms before and after it.
    """
    ordered = sorted(LEGAL_FORMS, key=len, reverse=True)
    dotted = next(f for f in ordered if f.endswith("."))
    at = ordered.index(dotted)
    three = [_whole_tokens(ordered[:at]), _whole_tokens([dotted]), _whole_tokens(ordered[at + 1:])]
    return dotted, _whole_tokens([f for f in ordered if f != dotted]), three


def company_rules(folded: Column) -> Column:
    """Remove legal and group forms from folded text."""
    dotted, single, three = _legal_form_passes()
    stepwise = folded
    for pattern in three:
        stepwise = F.regexp_replace(stepwise, pattern, " ")
    return F.when(F.contains(folded, F.lit(dotted)), stepwise).otherwise(F.regexp_replace(folded, single, " "))


def normalize_company(c: Column) -> Column:
    """Company part of the posting key: legal and group forms removed."""
    return collapse(company_rules(fold(F.coalesce(c, F.lit("")))))


def posting_key(company: Column, title: Column) -> Column:
    """Identity of a posting across sources; two nulls give ``"|"``."""
    return F.concat(normalize_company(company), F.lit("|"), normalize_title(title))


def escape_html(c: Column) -> Column:
    """Escape text for HTML bodies and attributes."""
    for src, dst in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


def collapse_whitespace(c: Column) -> Column:
    """Runs of any white space become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def or_empty_as_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))
