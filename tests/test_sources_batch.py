import datetime
import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import careers, dedup, lookup, report, seen, sheets
from feedloom.operators.profiles import ProfileError
from feedloom.operators.validate import DatasetError
from feedloom.plans.batch import merge_pool, new_history, run_batch
from feedloom.sources import landing
from feedloom.sources.tables import (
    LINK_SCHEMA, AlreadyClaimed, PoolTable, SeenStore, SnapshotTable, read_dataset, subfolders, write_dataset,
)
from feedloom.streaming import incremental

JOB = {"title": "Data Engineer", "company": "Acme GmbH", "url": "u1"}


@pytest.mark.parametrize("payload,n", [
    ([JOB], 1), ({"results": [JOB]}, 1), ({"jobs": [JOB]}, 1), ({"data": [JOB, JOB]}, 2), ({"results": [], "jobs": [JOB]}, 1),
    ({"results": None, "data": [JOB]}, 1), ([JOB, "x", 3, None, [1]], 1), ("text", 0), (5, 0), ({}, 0), ({"results": {"a": 1}, "data": [JOB]}, 0), ([], 0),
    ({"results": 0, "jobs": "", "data": [JOB]}, 1),
])
def test_result_shapes(spark, tmp_path, payload, n):
    (tmp_path / "xing.json").write_text(json.dumps(payload))
    rows = landing.read_results(spark, [str(tmp_path / "xing.json")]).collect()
    assert len(rows) == n and all(r["portal"] == "xing" and r["title"] == "Data Engineer" for r in rows)


def test_sources_are_named_and_ordered(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{**JOB, "portal": "own"}, {**JOB, "portal": "", "extra": {"x": 1}}]))
    (tmp_path / "a.json").write_text(json.dumps([JOB]))
    got = landing.read_results(spark, {"first": str(tmp_path / "b.json"), "second": str(tmp_path / "a.json")}).orderBy("arrival").collect()
    assert [r["portal"] for r in got] == ["own", "first", "second"]
    assert [r["asked_portal"] for r in got] == ["first", "first", "second"]
    assert json.loads(got[1]["extras"].toJson())["extra"] == {"x": 1}
    (tmp_path / "bad.json").write_text("{")
    log = {r["portal"]: r["error"] for r in landing.read_result_log(spark, [str(tmp_path / "*.json")]).collect()}
    assert log == {"a": None, "b": None, "bad": "unparseable output"}


def test_profile_document(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"profiles": [{"id": "a", "query": "x", "portals": ["+y"], "portal_overrides": {"y": {"r": 3, "b": True}}, "limit": 5}]}))
    row = landing.read_profiles(spark, str(path)).first()
    assert (row["id"], row["portals"], row["limit"], row["enabled"]) == ("a", ["+y"], 5, None)
    assert row["portal_overrides"]["y"]["b"].toPython() is True
    for bad in ({"profiles": {}}, [], {"profiles": ["x"]}, {"profiles": [{"id": "a"}]}, {"profiles": [{"id": "a", "query": "x"}] * 2},
                {"profiles": [{"id": "a", "query": "x", "portals": "not a list"}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ProfileError):
            landing.read_profiles(spark, str(path))


def test_seen_document(spark, tmp_path):
    path = tmp_path / "seen.json"
    path.write_text(json.dumps({"seen": {"k|t": {"title": "T", "fit": {"score": 3}, "also_on": [{"portal": "x", "url": "u"}], "rank_score": 60, "gaps": ["g"]}, "http://u": {"company": "C"}}}))
    got = {r["stored_key"]: r for r in landing.read_seen_document(spark, str(path)).collect()}
    assert json.loads(got["k|t"]["fit"]) == {"score": 3} and got["k|t"]["gaps"] == ["g"] and got["http://u"]["fit"] is None
    links = seen.explode_links(landing.read_seen_document(spark, str(path)))
    assert [tuple(r) for r in links.collect()] == [("k|t", "x", "u")]
    path.write_text("[]")
    with pytest.raises(ValueError):
        landing.read_seen_document(spark, str(path))


def test_dataset_document(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"metadata": {"source": "S", "index_baseline": 200}, "companies": [
        {"company": "A", "categories": {"it": {"count": 2, "index": 220}}}, {"company": "B", "loose": {"index": "n/a"}, "note": "x"}]}))
    meta, companies = landing.load_dataset(spark, str(path))
    assert meta["index_baseline"] == 200 and meta["index_label"] == "Index"
    rows = {r["company"]: r for r in lookup.benchmark_rows(companies, meta["index_baseline"]).collect()}
    assert rows["A"]["diff_shown"] == "+10.0%" and rows["B"]["label"] == "Loose"
    path.write_text(json.dumps({"companies": [{"company": ""}]}))
    with pytest.raises(DatasetError, match=r"companies\[1\].company"):
        landing.load_dataset(spark, str(path))
    path.write_text("{")
    with pytest.raises(DatasetError, match="not valid JSON"):
        landing.load_dataset(spark, str(path))


def test_entries_without_categories_show_plain_fields(spark):
    docs = [{"company": "A", "city": "X", "base_pay": 5, "note": "ok"}, {"company": "B", "it": {"index": 1}, "note": "x"}, {"company": "C", "categories": {"a": {}}}]
    entries = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs, 1)], "pos bigint, j string").select("pos", F.parse_json("j").alias("entry"))
    assert {tuple(r) for r in landing.plain_fields(entries).collect()} == {(1, "A", "Base Pay", "5"), (1, "A", "Note", "ok")}


def test_sheet_files_to_dataset(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Title,,\nCompany,IT Count,IT Index\n"Acme, Inc",3,"1.050,5"\nB\n')
    found = sheets.reshape(landing.read_sheets(spark, str(tmp_path / "*.csv")))
    out = str(tmp_path / "set")
    write_dataset(sheets.as_dataset(found), out, source="one")
    meta, companies = read_dataset(spark, out)
    assert meta.first()["baseline_description"] == "Index 100 = baseline"
    rows = lookup.benchmark_rows(companies).collect()
    assert [(r["company"], r["count_shown"], r["index_shown"]) for r in rows] == [("Acme, Inc", "3", "1050.5")]


def test_posting_and_outcome_files(spark, tmp_path):
    (tmp_path / "RYZ Labs - Front End 100% C++ - React.txt").write_text("whole\ntext")
    row = landing.read_posting_texts(spark, str(tmp_path / "*.txt")).first()
    assert tuple(row) == ("RYZ Labs", "Front End 100% C++ - React", "whole\ntext")
    folder = tmp_path / "acme_engineer"
    folder.mkdir()
    (folder / "outcome.md").write_text("# Outcome\n\n**Status:** rejected\n\n**Date resolved:** 2025-02-03\n\n- [x] Phone screen\n- [X] Case interview\n- [ ] Final round\n")
    row = landing.read_outcomes(spark, str(tmp_path / "*/outcome.md")).first()
    assert (row["application"], row["status"], str(row["date_resolved"]), row["status_unknown"]) == ("acme_engineer", "rejected", "2025-02-03", False)
    assert [k for k, v in row["stages"].items() if v] == ["Phone screen", "Case interview"]
    funnel = careers.outcome_funnel(landing.read_outcomes(spark, str(tmp_path / "*/outcome.md"))).first()
    assert (funnel["applications"], funnel["phone_screen"], funnel["final_round"]) == (1, 1, 0)


ROWS = "ord bigint, profile string, portal string, title string, company string, url string, location string"


def collected(spark, *titles):
    return spark.createDataFrame([(i, "p", p, t, c, u, None) for i, (p, t, c, u) in enumerate(titles)], ROWS)


@pytest.fixture()
def setup(spark, tmp_path):
    profiles = spark.createDataFrame([("p", ["praktikum"], None)], "id string, exclude_titles array<string>, require_any array<string>")
    log = spark.createDataFrame([("p", "xing", "ok")], "profile string, portal string, status string")
    store = SeenStore(spark, str(tmp_path / "seen"))
    pools = PoolTable(spark, str(tmp_path / "pools"))
    history = new_history(store, str(tmp_path / "history"))

    def go(day, rows, **kw):
        run_batch(collected(spark, *rows), F.col("ord"), profiles, log, store, pools, history, today=datetime.date.fromisoformat(day), **kw)

    return store, pools, history, go


def test_two_daily_runs(spark, setup):
    store, pools, history, go = setup
    first = [("xing", "Data Engineer (m/w/d)", "Acme GmbH", "u1"), ("indeed", "Data Engineer", "ACME", "u2"), ("xing", "Praktikum", "Acme", "u3")]
    go("2025-01-01", first, remember=False)
    assert store.entries().count() == 0 and pools.read("new", "2025-01-01").count() == 1
    go("2025-01-01", first)
    meta = pools.read("meta", "2025-01-01").first()
    assert (meta["input_records"], meta["unique_jobs"], meta["new"], meta["already_seen"], meta["seen_entries_added"]) == (2, 1, 1, 0, 1)
    assert pools.read("new", "2025-01-01").first()["also_on"][0]["portal"] == "indeed"
    go("2025-02-15", first + [("xing", "Other", "Acme", "u4"), ("monster", "Data-Engineer", "acme ag", "u5")])
    assert [r["title"] for r in pools.read("new", "2025-02-15").collect()] == ["Other"]
    assert {(r["stored_key"], r["first_seen"]) for r in store.entries().collect()} == {("acme|data engineer", "2025-01-01"), ("acme|other", "2025-02-15")}
    assert {(r["portal"], r["url"]) for r in store.links().collect()} == {("indeed", "u2"), ("monster", "u5")}
    rows = {r["dedup_key"]: r for r in history.read().collect()}
    assert json.loads(rows["acme|data engineer"]["also_on"]) == [{"portal": "indeed", "url": "u2"}, {"portal": "monster", "url": "u5"}]
    assert {str(r["date"]) for r in pools.read("new").collect()} == {"2025-02-15"}


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "s"))
    write = incremental.new_postings_writer(store, str(tmp_path / "out"), F.col("ord"), F.lit("2025-01-01"))
    a, b = collected(spark, ("xing", "A", "C", "u1"), ("indeed", "A", "C", "u2")), collected(spark, ("xing", "A*", "C", "u3"), ("xing", "B", "C", "u4"))
    write(a, 0)
    write(b, 1)
    before = sorted(map(tuple, store.entries().collect())), sorted(map(tuple, store.links().collect()))
    write(b, 1)
    assert (sorted(map(tuple, store.entries().collect())), sorted(map(tuple, store.links().collect()))) == before
    assert [r["title"] for r in incremental.reported(spark, str(tmp_path / "out"), store).orderBy("ord", "batch").collect()] == ["A", "B"]


def test_stream_equals_batch(spark, tmp_path):
    waves = [[("xing", "A", "C", "u1"), ("indeed", "A", "C", "u2")], [("xing", "A*", "C", "u3"), ("xing", "B", "C", "u4")], [("xing", "B", "C", "u4")]]
    for i, wave in enumerate(waves):
        spark.createDataFrame([(10 * i + k, "p", *w, None) for k, w in enumerate(wave)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    store = SeenStore(spark, str(tmp_path / "seen"))
    arrivals = lambda: incremental.file_arrivals(spark, str(tmp_path / "landing"), ROWS, files_per_batch=1)
    args = (store, str(tmp_path / "out"), str(tmp_path / "cp"), F.col("ord"), F.lit("2025-01-01"))
    incremental.run_available(arrivals(), *args)
    incremental.run_available(arrivals(), *args)
    everything = spark.read.parquet(str(tmp_path / "landing"))
    pool = merge_pool(everything, F.col("ord"))
    assert {r["stored_key"] for r in store.entries().collect()} == {r["dedup_key"] for r in pool.unique.collect()}
    # Only alternates of an arrival are added; the link that won its own arrival is not one.
    assert {tuple(r) for r in store.links().collect()} == {("c|a", "indeed", "u2")}
    new = incremental.reported(spark, str(tmp_path / "out"), store)
    assert sorted(r["dedup_key"] for r in new.collect()) == ["c|a", "c|b"]


def test_careers(spark):
    apps = spark.createDataFrame([(1, datetime.date(2025, 3, 1), 0), (2, datetime.date(2025, 2, 1), 2), (3, datetime.date(2025, 3, 5), None)], "id int, last_contact date, followups int")
    got = {r["id"]: (r["days_quiet"], r["nudge_due"], r["stale"]) for r in careers.follow_ups(apps, F.lit("2025-03-11").cast("date")).collect()}
    assert got == {1: (10, True, False), 2: (38, False, True), 3: (6, False, False)}
    schema = "company string, role string, gaps array<string>, provenance string, weight double"
    tracked = spark.createDataFrame([("Acme", "Dev", ["SQL"], "inferred", 0.5), ("Beta", "Dev", ["Go"], "recorded", 0.2)], schema)
    ranked = spark.createDataFrame([("ACME", "dev", ["Spark", "sql"], "recorded", 0.3)], schema)
    holders = careers.gap_sources(tracked, ranked)
    assert {(r["company"], r["source"]) for r in holders.collect()} == {("ACME", "ranked"), ("Beta", "tracked")}
    assert {r["skill"]: round(r["weight"], 2) for r in careers.skill_gaps(holders).collect()} == {"spark": 0.3, "sql": 0.3, "go": 0.2}
    assert careers.gap_header(holders).first()["header"] == "1 tracked, 1 ranked"


def test_source_health(spark):
    log = spark.createDataFrame([("a", "ok", 0, "2025-01-01"), ("a", "ok", 3, "2025-01-02"), ("a", "failed", None, "2025-01-03")], "portal string, status string, returned long, date string")
    assert tuple(report.source_health(log).first()) == ("a", 3, 1, 1, "2025-01-02")


def test_history_json(spark):
    entries = spark.createDataFrame([("k", "t", "c", "u", "p", "2025-01-01", "new", "3", [("x", "y")]), ("j", "t", "c", "u", "p", "d", "new", None, [])],
                                    "stored_key string, title string, company string, url string, portal string, first_seen string, status string, fit string, also_on array<struct<portal:string,url:string>>")
    rows = {r["dedup_key"]: r for r in report.as_history(entries).collect()}
    assert json.loads(rows["k"]["also_on"]) == [{"portal": "x", "url": "y"}] and rows["j"]["also_on"] is None


def test_wide_ragged_and_quoted_sheet_rows(spark, tmp_path):
    text = '"Salary\nIndex",Company,a,"b ""x"", y"\r\n1,,3\r\n\r\n,"",z,,last\n1e300,"Acme"\n'
    (tmp_path / "w.csv").write_text(text, newline="")
    rows = {r["row"]: r["cells"] for r in landing.read_sheets(spark, str(tmp_path / "w.csv")).collect()}
    assert rows[1] == ["Salary\nIndex", "Company", "a", 'b "x", y'] and rows[2] == ["1", None, "3"]
    assert [rows[k] for k in sorted(rows)][-2:] == [[None, None, "z", None, "last"], ["1e300", "Acme"]]
    (tmp_path / "big.csv").write_text("Company,IT Count,IT Index\nAcme,1e300,1e300\n")
    found = sheets.reshape(landing.read_sheets(spark, str(tmp_path / "big.csv"))).first()
    assert found["categories"]["it"]["count"] is None and found["categories"]["it"]["index"] == 1e300


def test_unreadable_result_files_stop_the_scan(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"title": "A", "portal": false}, {"title": "B", "portal": 0}, {"title": "C", "portal": "own"}]')
    (tmp_path / "bad.json").write_text('[{"title": ')
    paths = [str(tmp_path / "good.json"), str(tmp_path / "bad.json")]
    with pytest.raises(Exception, match="unparseable output: bad.json"):
        landing.read_results(spark, paths).collect()
    got = landing.read_results(spark, paths, skip_unreadable=True).collect()
    assert {(r["title"], r["portal"]) for r in got} == {("A", "good"), ("B", "good"), ("C", "own")}


def test_nothing_reported_yet(spark, tmp_path):
    assert incremental.reported(spark, str(tmp_path / "out"), SeenStore(spark, str(tmp_path / "store"))).count() == 0


ENTRY = "stored_key string, title string, company string, url string, first_seen string, fit string, status string, portal string"


def test_one_writer_per_batch(spark, tmp_path):
    one, two = SeenStore(spark, str(tmp_path / "s")), SeenStore(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(k, "T", "C", "u", "2025-01-01", None, "new", "x")], ENTRY)
    none = spark.createDataFrame([], LINK_SCHEMA)
    batch = one.next_batch()
    assert two.next_batch() == batch
    one.append(batch, row("a"), none)
    with pytest.raises(AlreadyClaimed):
        two.append(batch, row("b"), none)
    one.append(batch, row("a"), none)
    assert [r["stored_key"] for r in two.entries().collect()] == ["a"]
    two.append(two.next_batch(), row("b"), none)
    assert sorted(r["stored_key"] for r in one.entries().collect()) == ["a", "b"]
    one.commits.claim(7, "dead")
    one.commits.release(7)
    two.append(7, row("c"), none)


def test_imported_ranks_survive_merges_and_newer_scores_win(spark, tmp_path):
    path = tmp_path / "seen.json"
    path.write_text(json.dumps({"seen": {"k|t": {"title": "T", "company": "K", "also_on": [{"portal": "x", "url": "u"}], "rank_score": 60,
                                                 "rank_verdict": "apply", "gaps": ["g", "h"], "status": "ranked"}, "j|s": {"title": "S", "status": "new"}}}))
    store = SeenStore(spark, str(tmp_path / "store"))
    store.import_entries(landing.read_seen_document(spark, str(path)))
    assert [tuple(r) for r in store.links().collect()] == [("k|t", "x", "u")]
    store.append(store.next_batch(), spark.createDataFrame([("n|n", "N", "N", "u", "2025-01-01", None, "new", "x")], ENTRY), spark.createDataFrame([], LINK_SCHEMA))
    rows = {r["stored_key"]: r for r in store.ranked().collect()}
    assert rows["k|t"]["rank_score"] == 60 and rows["k|t"]["gaps"] == ["g", "h"] and rows["k|t"]["status"] == "ranked"
    assert rows["j|s"]["rank_score"] is None and rows["j|s"]["status"] == "new"
    assert [r["stored_key"] for r in report.shortlist(store.ranked(), 5).collect()] == ["n|n", "j|s"]
    store.append_ranks(spark.createDataFrame([("k|t", 30, "skip", None, ["z"], "ranked")],
                                             "stored_key string, rank_score int, rank_verdict string, strengths array<string>, gaps array<string>, status string"))
    newer = {r["stored_key"]: r for r in store.ranked().collect()}["k|t"]
    assert newer["rank_score"] == 30 and newer["gaps"] == ["z"]


def test_old_versions_of_a_snapshot_go(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k INT")
    for k in range(5):
        table.replace(spark.createDataFrame([(k,)], "k int"))
    assert table.read().first()["k"] == 4 and subfolders(spark, str(tmp_path / "t/data")) == ["version=3", "version=4"]


def test_outcome_notes_are_landed_by_several_tasks(spark, tmp_path):
    import re

    from feedloom.plans import queries

    spark.range(40).selectExpr("id AS s_suppkey", "concat('Supplier ', id) AS s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    found = queries.outcome_files(spark, str(tmp_path))
    parts = {re.search(r"part-(\d+)", f)[1] for f in found.inputFiles()}
    assert len(found.inputFiles()) == 40 and len(parts) > 1
    assert {r["application"] for r in found.collect()} == {f"firm_{i}" for i in range(40)}
