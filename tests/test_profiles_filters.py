import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators import filters, profiles, report

FULL = profiles.PROFILE_SCHEMA


def profile(spark, *rows):
    keys = ["id", "enabled", "query", "location", "portals", "portal_overrides", "exclude_titles", "require_any", "jobage", "limit"]
    plain = FULL.replace("VARIANT", "STRING")
    df = spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], plain)
    return df.withColumn("portal_overrides", F.transform_values("portal_overrides", lambda _, m: F.transform_values(m, lambda _, v: F.parse_json(v))))


@pytest.mark.parametrize("requested,result", [
    (None, ["a", "b"]), ([], ["a", "b"]), (["+c"], ["a", "b", "c"]), (["-a"], ["b"]), (["-a", "+c"], ["b", "c"]), (["z"], ["z"]),
    (["+a"], ["a", "b"]), (["+c", "d", "-c"], ["a", "b", "d"]),
])
def test_source_lists(spark, requested, result):
    df = spark.createDataFrame([(requested,)], "p array<string>")
    got = df.select(profiles.resolve_portals(F.array(F.lit("a"), F.lit("b")), F.col("p")).alias("r")).first()["r"]
    assert got == result


def params(spark, defaults, row):
    return {r["portal"]: r for r in profiles.requests(profile(spark, row), defaults).collect()}


def test_layered_parameters(spark):
    defaults = {"portals": ["freehire-search", "linkedin-search", "xing-search"], "jobage": 7, "limit": 25,
                "portal_overrides": {"freehire-search": {"country": "DE", "lang": "de"}, "linkedin-search": {"location": "Germany"}}}
    row = {"id": "p", "query": "Engineer", "location": "München", "limit": 5, "portal_overrides": {
        "freehire-search": {"city": '"Munich"', "lang": '"en"', "remote": "true", "junk": "false", "none": "null", "-v": "1.5"},
        "xing-search": {"location": "null", "jobage": "3"}}}
    got = params(spark, defaults, row)
    assert got["freehire-search"]["params"] == {"--query": "Engineer", "--city": "Munich", "--jobage": "7", "--limit": "5",
                                                "--country": "DE", "--lang": "en", "--remote": None, "-v": "1.5"}
    assert got["linkedin-search"]["params"]["--location"] == "Germany" and got["linkedin-search"]["problem"] is None
    assert got["xing-search"]["params"] == {"--query": "Engineer", "--jobage": "3", "--limit": "5"}


def test_requests_that_cannot_be_made(spark):
    got = params(spark, {"portals": ["linkedin-search", "nowhere"]}, {"id": "p", "query": "x"})
    assert got["linkedin-search"]["problem"] == "profile 'p': linkedin-search requires a location"
    with pytest.raises(profiles.ProfileError, match="requires a location"):
        profiles.require_possible(profiles.requests(profile(spark, {"id": "p", "query": "x"}), {"portals": ["linkedin-search"]}))
    assert "no parameter mapping" in got["nowhere"]["problem"]


def test_profile_checks(spark):
    good = profile(spark, {"id": "a", "query": "x"}, {"id": "b", "location": "y"})
    assert profiles.require_valid(good) is good
    for bad, words in (({"id": "a", "query": "x"}, "duplicate profile id 'a'"), ({"query": "x"}, "needs an 'id'"), ({"id": "c"}, "'c' needs a 'query'")):
        with pytest.raises(profiles.ProfileError, match=words):
            profiles.require_valid(good.unionByName(profile(spark, bad)))
    loose = profiles.profile_issues(profile(spark, {"id": "a", "query": "x", "exclude_titles": ["(gn)"]})).collect()
    assert [r["severity"] for r in loose] == ["warning"]


def test_profile_selection(spark):
    df = profile(spark, {"id": "on", "query": "x"}, {"id": "off", "query": "x", "enabled": False})
    assert [r["id"] for r in profiles.select_profiles(df).collect()] == ["on"]
    assert [r["id"] for r in profiles.select_profiles(df, "off").collect()] == ["off"]
    with pytest.raises(profiles.ProfileError, match="off, on"):
        profiles.select_profiles(df, "typo")


def test_title_filters(spark):
    rows = spark.createDataFrame([("p", "Werkstudent (m/w/d)"), ("p", "WERKSTUDENT ROENTGENTECHNIK"), ("p", None), ("q", None), ("r", "Ausbildung*")], "profile string, title string")
    prof = spark.createDataFrame([("p", None, ["röntgen"]), ("q", ["x"], None), ("r", ["aus-bildung", "Ausbildung (gn)"], [])],
                                 "id string, exclude_titles array<string>, require_any array<string>")
    got = {(r["profile"], r["title"]): r["keep"] for r in filters.flag_titles(rows, prof).collect()}
    assert got == {("p", "Werkstudent (m/w/d)"): False, ("p", "WERKSTUDENT ROENTGENTECHNIK"): True, ("p", None): False, ("q", None): True, ("r", "Ausbildung*"): False}
    kept = filters.keep_titles(rows, exclude=["Ausbildung"], require=["Werkstudent"]).collect()
    assert {r["title"] for r in kept} == {"Werkstudent (m/w/d)", "WERKSTUDENT ROENTGENTECHNIK"}
    empty = filters.keep_titles(rows, exclude=[], require=None)
    assert empty.count() == 5


def test_text_layer(spark):
    df = spark.createDataFrame([(1, " a \n\t b  text ", 1), (2, "a b", 2), (3, "", 1), (4, None, None)], "id int, text string, pages int")
    got = {r["id"]: r["failure"] for r in filters.check_text_layer(df, 1, 4, ("a  b", "text")).collect()}
    assert got == {1: None, 2: "expected 1 page(s), found 2", 3: "text layer has 0 character(s); expected at least 4", 4: "expected 1 page(s), found none"}
    got = filters.check_text_layer(df.filter("id = 1"), None, 1, ("zz",)).first()
    assert got["failure"] == "text layer is missing required text: 'zz'"


def test_run_report(spark):
    prof = spark.createDataFrame([("p", True), ("off", False)], "id string, enabled boolean")
    pairs = spark.createDataFrame([("p", x) for x in ("a", "b", "gone", "quiet", "dead")], "profile string, portal string")
    portals = spark.createDataFrame([("a", None), ("b", False), ("quiet", True), ("dead", True)], "portal string, enabled boolean")
    landed = spark.createDataFrame([("p", "a", None), ("p", "quiet", None), ("p", "dead", "timed out after 120s")], "profile string, portal string, error string")
    rows = spark.createDataFrame([("p", "a", True), ("p", "a", False)], "profile string, portal string, keep boolean")
    got = {(r["profile"], r["portal"]): tuple(r)[2:] for r in report.run_report(prof, pairs, portals, landed, rows).collect()}
    assert got == {("p", "a"): ("ok", None, 2, 1), ("p", "b"): ("disabled", None, None, None), ("p", "gone"): ("missing", "not installed", None, None),
                   ("p", "quiet"): ("ok", None, 0, 0), ("p", "dead"): ("failed", "timed out after 120s", None, None), ("off", None): ("disabled", None, None, None)}
    dry = {r["portal"]: r["status"] for r in report.run_report(prof, pairs, portals, landed, rows, dry_run=True, only="p").collect()}
    assert dry == {"a": "dry-run", "b": "disabled", "gone": "missing", "quiet": "dry-run", "dead": "dry-run"}
    assert filters.problems(report.run_report(prof, pairs, portals, landed, rows)).count() == 2


def test_recent_cap_and_retention(spark):
    day = lambda n: (datetime.date(2025, 3, 10) - datetime.timedelta(n))
    rows = spark.createDataFrame([("p", "x", i, day(i), day(i).isoformat()) for i in range(40)], "profile string, portal string, ord int, date date, first_seen string")
    today = F.lit("2025-03-10").cast("date")
    assert [r["ord"] for r in filters.recent(rows, today).collect()] == list(range(8))
    assert sorted(r["ord"] for r in report.cap_per_request(rows, 3, F.col("ord")).collect()) == [0, 1, 2]
    assert sorted(r["ord"] for r in report.cap_per_request(rows, 9, F.desc("ord"), 4, today).collect()) == [0, 1, 2, 3, 4]
    assert report.keep_dates(rows, today).agg(F.max("ord")).first()[0] == 30


def test_digest(spark):
    rows = spark.createDataFrame([("", None, None, None, None, 'http://x/"a"', [("xing", "u"), (None, "v")]), ("p", "<b>", "A & B", "Ulm", "xing", None, None)],
                                 "profile string, title string, company string, location string, portal string, url string, also_on array<struct<portal:string,url:string>>")
    got = {r["profile"]: r for r in report.digest_rows(rows).collect()}
    assert (got["unassigned"]["title"], got["unassigned"]["company"], got["unassigned"]["also_note"], got["unassigned"]["url"]) == ("(untitled)", "—", "also on xing, ?", "http://x/&quot;a&quot;")
    assert (got["p"]["title"], got["p"]["company"], got["p"]["also_note"]) == ("&lt;b&gt;", "A &amp; B", None)
    groups = {r["profile"]: r["jobs"] for r in report.by_profile(rows, F.col("title")).collect()}
    assert groups == {"unassigned": 1, "p": 1}
