import json

import pytest
from pyspark.sql import functions as F

from feedloom.functions import cells
from feedloom.operators import sheets, validate


def reshape(spark, header, *rows, before=0):
    data = [("s", i + 1, ["title", None]) for i in range(before)] + [("s", before + 1, header)]
    data += [("s", before + 2 + i, r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "sheet string, row int, cells array<string>")
    return [(r["company"], r["city"], {k: (v["count"], v["index"]) for k, v in r["categories"].items()})
            for r in sheets.reshape(df).orderBy("row").collect()]


@pytest.mark.parametrize("header,row,want", [
    (["Company", "Engineering Count", "Engineering Index"], ["Example Corp", "12", "105.5"], {"engineering": (12, 105.5)}),
    (["Company", "Antal kvinder", "Antal mænd", "Kvinder indeks", "Mænd indeks"], ["E", "15", "20", "95", "108"], {"kvinder": (15, 95.0), "mænd": (20, 108.0)}),
    (["Company", "Antal", "IT Count", "IT Index"], ["E", "250", "30", "108.5"], {"antal": (250, None), "it": (30, 108.5)}),
    (["Company", "Salary Index", "Notes", "Id"], ["E", "105.5", "good", "7"], {"salary_index": (None, 105.5)}),
    (["Company", "Salary Index"], ["E", "1.234,5"], {"salary_index": (None, 1234.5)}),
    (["Company", "Salary Index"], ["E", "1,234"], {}),
    (["Company", "IT Count", "IT Index"], ["E", "3.9", None], {"it": (3, None)}),
    (["Company", "X", "x"], ["E", "1", "2"], {"x": (None, 2.0)}),
    (["Company", "X", "x"], ["E", "1", "-"], {"x": (None, 1.0)}),
    (["Company", "IT Count", "IT Count", "IT Index"], ["E", "1", "2", "3"], {"it": (1, 3.0), "it_count": (2, None)}),
])
def test_layouts_and_values(spark, header, row, want):
    assert reshape(spark, header, row) == [("E" if row[0] == "E" else row[0], "", want)]


def test_ragged_rows_blank_companies_and_late_header(spark):
    got = reshape(spark, ["Firma", "By", "Index"], [" A ", "Ulm ", "1"], ["B"], ["", "x", "1"], [None, "x"], before=4)
    assert got == [("A", "Ulm", {"index": (None, 1.0)}), ("B", "", {})]
    assert reshape(spark, ["Company", "Index"], ["A", "1"], before=10) == []


def test_last_company_column_counts(spark):
    assert reshape(spark, ["Company", "Employer", "Index"], ["A", "B", "1"]) == [("B", "", {"index": (None, 1.0)})]


def test_headers(spark):
    df = spark.createDataFrame([("Lønindeks",), ("Baby",), ("by (kommune)",), ("Number of n",), ("Income",)], "h string")
    got = df.select(cells.column_type(F.col("h")).alias("t"), cells.header_matches(F.col("h"), cells.CITY_WORDS).alias("c")).collect()
    assert [tuple(r) for r in got] == [("index", False), (None, False), (None, True), ("count", False), (None, False)]


@pytest.mark.parametrize("text,value", [
    ("105.5", 105.5), (" 1 234 ", 1234.0), ("1.234,5", 1234.5), ("1,5", 1.5), ("1,234", None), ("-1,234", None), ("1,2345", 1.2345),
    ("1,234.56", 1.23456), ("1_000", 1000.0), ("12d", None), ("nan", None), ("inf", None), ("", None), ("+3", 3.0), ("2e3", 2000.0), (".5", 0.5), ("5.", 5.0), (None, None),
])
def test_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(cells.parse_number(F.col("s")).alias("n")).first()["n"] == value


def issues(spark, companies):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(companies, 1)], "pos bigint, j string")
    found = validate.collect_issues(df.select("pos", F.parse_json("j").alias("entry")))
    return [(r["severity"], r["message"]) for r in found.orderBy("pos", "rule", "path").collect()]


def test_valid_entries_have_no_issues(spark):
    assert issues(spark, [{"company": "A", "city": None, "categories": None}, {"company": "B", "categories": {}},
                          {"company": "C", "categories": {"a": {"count": 1, "index": "n/a"}, "b": {"count": True, "index": 1.5}, "c": {}}}]) == []


def test_every_entry_rule(spark):
    got = issues(spark, ["x", {}, {"company": " "}, {"company": 3}, {"company": "A", "city": 1}, {"company": "B", "categories": []},
                         {"company": "C", "categories": {"x": 1.5, "y": {"count": "1", "index": []}, "z": None}}, {"company": "a"}])
    want = ["companies[1] must be an object", "companies[2].company must be a non-empty string", "companies[3].company must be a non-empty string",
            "companies[4].company must be a non-empty string", "companies[5].city must be a string when provided",
            "companies[6].categories must be an object when provided",
            "companies[7].categories.x must be an object with 'count' and/or 'index' (got float)",
            "companies[7].categories.z must be an object with 'count' and/or 'index' (got NoneType)",
            "companies[7].categories.y.count must be a number (got str)", "companies[7].categories.y.index must be a number or string (got list)"]
    assert [m for s, m in got if s == "error"] == want
    assert [m for s, m in got if s == "warning"] == ["Duplicate company name 'a' (companies[5] and companies[8])"]


def test_root_rules_and_fail_fast(spark):
    def root(doc):
        df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("doc"))
        return [r["message"] for r in validate.root_issues(df).orderBy("rule").collect()]

    assert root([]) == ["top-level JSON value must be an object"]
    assert root({"metadata": 3, "companies": {}}) == ["'metadata' must be an object when provided", "'companies' must be a list"]
    assert root({"metadata": None, "companies": []}) == []
    df = spark.createDataFrame([(2, "warning", 1, "", "w"), (3, "error", 2, "", "second"), (1, "error", 3, "", "first")], "pos bigint, severity string, rule int, path string, message string")
    with pytest.raises(validate.DatasetError, match="first"):
        validate.fail_fast(df)
    validate.fail_fast(df.filter("severity = 'warning'"))
