import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.functions.sql import register_functions


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in rows.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


MARKED = [
    "Data Engineer" + m
    for m in (" (m/w/d)", " (w/m/d)", " (m/f/d)", " (d/m/w)", " (w/d/m)", " (f/m/x)", " (m/w/i)", " m/w/d",
              " (mwd)", " (wmd)", " (gn)", " (all genders)", " (alle Geschlechter)", "*", " (*)", " [m / w / d]")
]


def test_markers_vanish(spark):
    assert set(apply(spark, text.normalize_title, MARKED)) == {"data engineer"}


def test_inclusive_suffixes(spark):
    names = ["Entwickler" + s for s in ("", ":in", "*in", ":innen", "*innen", "_in")]
    assert set(apply(spark, text.normalize_title, names)) == {"entwickler"}


def test_invisible_characters_and_umlauts(spark):
    got = apply(spark, text.normalize_title, [
        "Da­ta En­gi­neer", "Data​ Engineer﻿", "Data Engineer",
        "Softwareentwickler für Großsysteme", "Café – Crème", None, "",
    ])
    assert got == ["data engineer", "data engineer", "data engineer", "softwareentwickler fuer grosssysteme", "cafe creme", "", ""]


def test_compatibility_characters(spark):
    got = apply(spark, text.fold, ["ﬁne", "½", "（m／w／d）", "𝐱②", "ｆｕｌｌ", "☃"])
    assert got == ["fine", "1⁄2", "(m/w/d)", "x2", "full", "☃"]


def test_different_titles_stay_different(spark):
    got = apply(spark, text.normalize_title, ["Senior Engineer", "Engineer", "Softwareentwickler", "Software-Entwickler"])
    assert len(set(got)) == 4


def test_slashed_rule_and_strict_option(spark):
    assert apply(spark, text.normalize_title, ["System/Network"]) == ["syste etwork"]
    assert apply(spark, lambda c: text.normalize_title(c, strict=True), ["System/Network (m/w/d)"]) == ["system network"]


@pytest.mark.parametrize("left,right", [
    ("Bertrandt AG", "Bertrandt"), ("Muster GmbH & Co. KG", "Muster"),
    ("Bundesdruckerei Gruppe GmbH", "Bundesdruckerei-Gruppe"), ("ACME Holding Deutschland", "acme"),
])
def test_legal_forms_equal(spark, left, right):
    a, b = apply(spark, text.normalize_company, [left, right])
    assert a == b


def test_legal_forms_only_as_tokens(spark):
    got = apply(spark, text.normalize_company, ["Agentur Seven", "Siemens AG", "Siemens Energy AG", "x e.v.gmbh", "x e.v.kg", "x e.v."])
    assert got == ["agentur seven", "siemens", "siemens energy", "x", "x e v", "x"]


def one_at_a_time(name):
    """The definition: forms removed one by one, longest first."""
    for form in sorted(text.LEGAL_FORMS, key=len, reverse=True):
        name = re.sub("(?<![a-z0-9])" + re.escape(form) + "(?![a-z0-9])", " ", name)
    return " ".join(re.findall("[a-z0-9]+", name))


PIECES = [*text.LEGAL_FORMS, " ", "-", ".", "&", " & ", "co", "co.", "x", "e.v.", "a1"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=7).map("".join), min_size=200, max_size=200))
def test_legal_forms_in_one_pass_equal_the_definition(spark, names):
    assert apply(spark, text.normalize_company, names) == [one_at_a_time(n) for n in names]


def test_key(spark):
    df = spark.createDataFrame([(None, None), ("Bertrandt AG", "Data Engineer (m/w/d)")], "c string, t string")
    got = [r[0] for r in df.select(text.posting_key(F.col("c"), F.col("t"))).collect()]
    assert got == ["|", "bertrandt|data engineer"]


def test_escape_and_title_case(spark):
    assert apply(spark, text.escape_html, ["<script>'x' & \"y\"</script>"]) == ["&lt;script&gt;&#x27;x&#x27; &amp; &quot;y&quot;&lt;/script&gt;"]
    assert apply(spark, text.title_case, ["o'neil 2nd all-staff", "it support"]) == ["O'Neil 2Nd All-Staff", "It Support"]


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    values = MARKED + ["Muster GmbH & Co. KG", "Ørsted A/S", "ﬁne Größe e.v.kg", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    df.createOrReplaceTempView("vals")
    got = spark.sql("select feed_title(s) t, feed_company(s) c, feed_key(s, s) k from vals").collect()
    want = df.select(text.normalize_title(F.col("s")).alias("t"), text.normalize_company(F.col("s")).alias("c"),
                     text.posting_key(F.col("s"), F.col("s")).alias("k")).collect()
    assert got == want
