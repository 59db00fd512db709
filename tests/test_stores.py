"""Keyed tables, the seen store's folders and filters, claims that expire, one state for readers."""
import datetime
import glob
import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from feedloom.operators import seen
from feedloom.plans.batch import new_history, run_batch
from feedloom.sources import membership, storage
from feedloom.sources.keyed import KeyedTable, bucket_of, read_bucketed, read_folders, with_keys, write_bucketed
from feedloom.sources.manifest import AlreadyClaimed, Commits, ManifestLog, StaleWriter
from feedloom.sources.tables import FANOUT, LINK_SCHEMA, RANK_SCHEMA, PoolTable, SeenStore

ROW = "k string, v int, w string"
ENTRY = "stored_key string, title string, company string, url string, first_seen string, fit string, status string, portal string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROW)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_below(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def entry(spark, *keys):
    return spark.createDataFrame([(k, k.partition("|")[2], k.partition("|")[0], "u", "2025-01-01", None, "new", "x") for k in keys], ENTRY)


# --- keyed tables ----------------------------------------------------------------------

def test_a_load_rewrites_only_buckets_whose_keys_changed(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=8)
    assert table.upsert(rows(spark, *[(f"k{i}", i, None) for i in range(100)])) == list(range(8))
    before = files_below(table.path)
    assert len(before) == 8
    touched = table.upsert(rows(spark, ("k5", 500, "x"), ("k6", 6, None)))  # k6 is as it was
    assert len(touched) == 1
    new = files_below(table.path) - before
    assert len(new) == 1 and {bucket_of(f) for f in new} == set(touched)
    used = {f"{f['path']}/{f['file']}" for f in table.state()["parts"]["data"]}
    assert len(used) == 8 and len(used & before) == 7
    want = sorted([(f"k{i}", i, None) for i in range(100) if i != 5] + [("k5", 500, "x")], key=repr)
    assert content(table.read()) == want
    place = table.commits.log.last_place()
    assert table.upsert(rows(spark, ("k5", 500, "x"))) == [] and table.commits.log.last_place() == place


def test_rows_of_a_key_are_replaced_together(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    table.upsert(rows(spark, ("a", 1, None), ("a", 2, None), ("b", 1, "x")))
    table.upsert(rows(spark, ("a", 3, None), ("c", None, None)))
    assert content(table.read()) == sorted([("a", 3, None), ("b", 1, "x"), ("c", None, None)], key=repr)
    table.upsert(rows(spark, ("a", 3, None), ("a", 3, None)))  # repeated rows are a change as well
    assert content(table.read().filter("k = 'a'")) == [("a", 3, None)] * 2
    assert table.upsert(rows(spark)) == []


def test_upserts_against_a_model(spark, tmp_path):
    rng, model = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    for turn in range(5):
        load = {f"k{rng.randrange(40)}": (rng.randrange(3), rng.choice(["x", None])) for _ in range(12)}
        table.upsert(rows(spark, *[(k, *v) for k, v in load.items()]))
        model.update(load)
        if turn == 2:
            table.grow()
            assert table.state()["buckets"] == 8
        assert content(table.read()) == sorted(((k, *v) for k, v in model.items()), key=repr)
    assert table.vacuum(keep=1, grace=0)
    assert content(table.read()) == sorted(((k, *v) for k, v in model.items()), key=repr)


def test_a_reader_keeps_the_state_it_started_from(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=2)
    table.upsert(rows(spark, ("a", 1, None)), {"through": 1})
    then = table.read()
    table.upsert(rows(spark, ("a", 2, None)), {"through": 2})
    assert content(then) == [("a", 1, None)] and content(table.read()) == [("a", 2, None)]
    assert table.note() == {"through": 2}
    table.upsert(rows(spark, ("a", 2, None)), {"through": 3})
    assert table.note() == {"through": 3} and content(table.read()) == [("a", 2, None)]


def test_of_two_loads_at_once_one_fails(spark, tmp_path):
    one, two = (KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=2) for _ in range(2))
    state = two.state()
    one.upsert(rows(spark, ("a", 1, None)))
    with pytest.raises(AlreadyClaimed):
        two._replace(rows(spark, ("b", 1, None)), [0, 1], state)
    two.upsert(rows(spark, ("b", 1, None)))
    assert content(one.read()) == [("a", 1, None), ("b", 1, None)]


def test_folders_in_buckets_are_joined_where_they_lie(spark, tmp_path):
    base = str(tmp_path / "b'ase")
    for name, keys in (("one", range(50)), ("two", range(50, 90)), ("none", ())):
        write_bucketed(spark.createDataFrame([(f"k{i}", i) for i in keys], "k string, v int"), f"{base}/{name}", "k", 4)
    table = read_bucketed(spark, base, ["one", "two", "none"], "k string, v int", "k", 4)
    assert table.count() == read_folders(spark, base, ["one", "two", "none"], "k string, v int").count() == 90
    asked = spark.createDataFrame([("k3",), ("k70",), ("zz",)], "k string")
    found = with_keys(table, asked, "k", 4)
    assert content(found) == [("k3", 3), ("k70", 70)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_keys(table, asked, "k", 4)._jdf.queryExecution().sparkPlan().toString()
        prepared = with_keys(table, asked, "k", 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan
    assert prepared.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in prepared


# --- claims and manifests --------------------------------------------------------------

def test_a_dead_writer_is_replaced_and_can_not_come_back(spark, tmp_path):
    ttl = 1.0
    dead, next_ = (Commits(spark, str(tmp_path / "t"), ttl) for _ in range(2))
    turn = dead.turn(0, "dead")
    held = turn.__enter__()
    with pytest.raises(AlreadyClaimed):
        next_.claim(0, "next")  # the owner still beats
    turn.__exit__(None, None, None)  # from here on nobody beats
    time.sleep(1.5)
    with next_.turn(0, "next") as mine:
        assert mine.fence == 1
        with pytest.raises(StaleWriter):
            held.publish({"data": []})
        mine.publish({"data": [{"path": "x"}]})
    assert next_.last() == 0 and next_.log.newest()["parts"] == {"data": [{"path": "x"}]}
    with pytest.raises(StaleWriter):
        held.publish({"data": []})
    with pytest.raises(AlreadyClaimed):
        dead.claim(0, "dead")


def test_a_crashed_batch_does_not_block_the_next_run(spark, tmp_path):
    path = str(tmp_path / "s")
    crashed = SeenStore(spark, path, ttl=0.2)
    fence = crashed.commits.claim(0, crashed.writer)  # died before anything was published
    time.sleep(0.5)
    store = SeenStore(spark, path, ttl=0.2)
    store.append(store.next_batch(), entry(spark, "a|b"), spark.createDataFrame([], LINK_SCHEMA))
    assert [r["stored_key"] for r in store.entries().collect()] == ["a|b"] and fence == 0
    with pytest.raises((StaleWriter, AlreadyClaimed)):
        crashed.append(0, entry(spark, "z|z"), spark.createDataFrame([], LINK_SCHEMA))
    assert [r["stored_key"] for r in store.entries().collect()] == ["a|b"]


def test_unfinished_manifests_are_passed_over(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "t"))
    assert log.newest() is None and log.last_place() == -1
    state = {"number": 0, "writer": "w", "parts": {"data": [{"path": "a"}]}}
    log.publish(state, -1)
    storage.create_file(spark, f"{log.path}/manifests/{1:012d}", '{"number": 1, "wri')
    assert log.newest() == state and log.last_place() == 1
    with pytest.raises(StaleWriter):
        log.publish(state | {"number": 1}, 0)
    log.publish(state | {"number": 1}, 1)
    assert log.newest()["number"] == 1 and log.newest(before=1)["number"] == 0


def test_storage_that_does_not_decide_is_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "UNSAFE_SCHEMES", frozenset({"file"}))
    with pytest.raises(storage.UnsafeStorage):
        SeenStore(spark, str(tmp_path / "s")).append(0, entry(spark, "a|b"), spark.createDataFrame([], LINK_SCHEMA))


# --- the seen store --------------------------------------------------------------------

def test_folders_stay_few_and_a_reader_sees_one_state(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "s"), buckets=2)
    none = spark.createDataFrame([], LINK_SCHEMA)
    started = None
    for batch in range(FANOUT + 2):
        if batch == FANOUT - 1:
            started = store.entries()
        links = spark.createDataFrame([(f"c|{batch}", "p", "u")], LINK_SCHEMA) if batch % 2 else none
        store.append(batch, entry(spark, f"c|{batch}"), links)
    assert store.folders("entries") == 3 and store.folders("keys") == 3
    assert store.folders("links") == (FANOUT + 2) // 2  # only batches with links have a folder of them
    assert {r["stored_key"] for r in started.collect()} == {f"c|{b}" for b in range(FANOUT - 1)}
    assert sorted(r["stored_key"] for r in store.entries().collect()) == sorted(f"c|{b}" for b in range(FANOUT + 2))
    assert store.links().count() == (FANOUT + 2) // 2
    assert {r["stored_key"] for r in store.keys_since(FANOUT).collect()} == {f"c|{FANOUT + 1}"}
    gone = store.vacuum(keep=1, grace=0)
    assert any(p.startswith("keys/") for p in gone)
    assert sorted(r["stored_key"] for r in store.entries().collect()) == sorted(f"c|{b}" for b in range(FANOUT + 2))
    pool = spark.createDataFrame([(f"c|{b}",) for b in range(FANOUT + 4)], "dedup_key string")
    assert sum(r["is_known"] for r in store.flag(pool).collect()) == FANOUT + 2


def test_the_newest_ranks_survive_merges(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "s"))
    for turn in range(FANOUT + 1):
        store.append_ranks(spark.createDataFrame([("k", turn, "v", None, [str(turn)], "ranked"), (f"k{turn}", 1, "v", None, None, "ranked")], RANK_SCHEMA))
    got = {r["stored_key"]: r["rank_score"] for r in store.ranks().collect()}
    assert got == {"k": FANOUT} | {f"k{t}": 1 for t in range(FANOUT + 1)}
    assert len(store.rank_commits.log.newest()["parts"]["ranks"]) == 2


def test_flags_are_those_of_a_join(spark, tmp_path):
    rng = random.Random(7)
    store = SeenStore(spark, str(tmp_path / "s"), buckets=4)
    none = spark.createDataFrame([], LINK_SCHEMA)
    stored = []
    for batch in range(3):
        keys = [f"c{rng.randrange(400)}|t" for _ in range(60)] + ([f"https://x/{batch}"] if batch else [])
        # Entries of old stand under their URL and are recognized by company and title.
        part = [(k, "t", f"old{batch}" if k.startswith("http") else k[:-2], "u", "2025-01-01", None, "new", "x") for k in sorted(set(keys))]
        stored += part
        store.append(batch, spark.createDataFrame(part, ENTRY), none)
    entries = spark.createDataFrame(stored, ENTRY)
    pool = spark.createDataFrame([(f"c{i}|t",) for i in range(500)] + [("old1|t",), ("old2|t",), ("|",)], "dedup_key string")
    known = {r["dedup_key"] for r in seen.known_keys(entries).collect()}
    own = {r[0] for r in stored}
    got = store.flag(pool).collect()
    assert len(got) == 503
    for r in got:
        assert (r["is_known"], r["has_entry"]) == (r["dedup_key"] in known, r["dedup_key"] in own), r
    assert not any(r["is_known"] for r in store.flag(pool, before=0).collect())


def test_filters_lose_nothing_and_rarely_err(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    blocks = membership.blocks_for(20_000)
    filters = membership.build(keys, "k", 5, blocks).unionByName(membership.build(keys.limit(0), "k", 6, 1))
    asked = spark.range(10_000, 40_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    got = {r["k"] for r in membership.ask(asked, "k", filters, [(5, blocks), (6, 1)]).collect()}
    assert {f"k{i}" for i in range(10_000, 20_000)} <= got
    assert len(got) - 10_000 < 0.02 * 20_000


def test_new_rows_skip_the_lookup(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "s"), buckets=2)
    store.append(0, entry(spark, *[f"c{i}|t" for i in range(50)]), spark.createDataFrame([], LINK_SCHEMA))
    fresh = spark.createDataFrame([(f"new{i}|t",) for i in range(20)], "dedup_key string")
    read = []
    real = store._with_keys
    store._with_keys = lambda part, asked, before=None, folders=None, count=None: read.append((part, folders)) or real(
        part, asked, before, folders, count)
    assert not any(r["is_known"] for r in store.flag(fresh).collect())
    assert read == [("keys", [])]  # no folder of keys was opened
    assert sum(r["is_known"] for r in store.flag(entry(spark, "c1|t").selectExpr("stored_key AS dedup_key")).collect()) == 1


@pytest.mark.parametrize("n_batches", [2])
def test_shuffled_bytes_do_not_grow_with_the_store(n_batches):
    """Bytes written to shuffles while a pool meets stores of two sizes, from the event log."""
    import subprocess
    import sys
    code = """
import sys
from feedloom.cluster import build_session
from feedloom.sources.tables import LINK_SCHEMA, SeenStore
from pyspark.sql import functions as F
base, n = sys.argv[1], int(sys.argv[2])
spark = build_session("bytes", "local[2]", **{
    "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": base + "/events", "spark.eventLog.compress": "false",
    "spark.checkpoint.dir": base + "/cp", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": base + "/wh",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
ids = spark.range(n).select(F.concat(F.lit("c"), F.col("id"), F.lit("|t")).alias("stored_key"))
text = lambda c: F.lit("x").alias(c)
entries = ids.select("stored_key", text("title"), text("company"), text("url"), text("first_seen"), text("fit"), text("status"), text("portal"), F.col("stored_key").alias("name_key"))
store = SeenStore(spark, base + "/s", buckets=4)
store.append(0, entries, ids.select("stored_key", text("portal"), text("url")))
pool = spark.range(0, 2 * n, n // 50).select(F.concat(F.lit("c"), F.col("id"), F.lit("|t")).alias("dedup_key"))
spark.sparkContext.setJobGroup("ask", "ask")
store.flag(pool).write.format("noop").mode("overwrite").save()
store.fresh_links(pool.select("dedup_key", F.lit("x").alias("portal"), F.lit("y").alias("url"))).write.format("noop").mode("overwrite").save()
spark.stop()
"""
    def written(n):
        base = tempfile.mkdtemp(prefix="bytes-")
        os.makedirs(f"{base}/events")
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYTHONPATH": root}
        subprocess.run([sys.executable, "-c", code, base, str(n)], check=True, env=env, capture_output=True, timeout=240)
        stages, total = set(), 0
        for file in glob.glob(f"{base}/events/**/*", recursive=True):
            if not os.path.isfile(file):
                continue
            for line in open(file):
                event = json.loads(line)
                if event["Event"] == "SparkListenerJobStart" and event.get("Properties", {}).get("spark.jobGroup.id") == "ask":
                    stages.update(event["Stage IDs"])
                elif event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in stages:
                    total += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
        return total

    small, large = written(2_000), written(100_000)
    assert 0 < large < 1.5 * small + 2_000


def test_history_makes_up_for_a_run_that_died_before_its_load(spark, tmp_path):
    profiles = spark.createDataFrame([("p", None, None)], "id string, exclude_titles array<string>, require_any array<string>")
    log = spark.createDataFrame([("p", "xing", "ok")], "profile string, portal string, status string")
    store, pools = SeenStore(spark, str(tmp_path / "seen"), buckets=2), PoolTable(spark, str(tmp_path / "pools"))
    history = new_history(store, str(tmp_path / "history"))

    def run(day, titles, to=None):
        got = spark.createDataFrame([(i, "p", "xing", t, "Acme", f"u{i}", None) for i, t in enumerate(titles)],
                                    "ord int, profile string, portal string, title string, company string, url string, location string")
        run_batch(got, F.col("ord"), profiles, log, store, pools, to, today=datetime.date(2025, 1, day))

    run(1, ["One"], history)
    run(2, ["Two"])  # the load never came
    assert {r["title"] for r in history.read().collect()} == {"One"} and history.note() == {"through": 0}
    run(3, ["Three"], history)
    rows = {r["title"]: r["first_seen"] for r in history.read().collect()}
    assert rows == {"One": "2025-01-01", "Two": "2025-01-02", "Three": "2025-01-03"} and history.note() == {"through": 2}
    place = history.commits.log.last_place()
    run(4, ["Three"], history)  # nothing new: only how far the load went is published
    assert history.note() == {"through": 3} and history.commits.log.last_place() == place + 1


def test_sessions_share_a_store(spark, tmp_path):
    path = str(tmp_path / "s")
    SeenStore(spark, path).append(0, entry(spark, "a|b"), spark.createDataFrame([], LINK_SCHEMA))
    other: SparkSession = spark.newSession()
    assert [r["stored_key"] for r in SeenStore(other, path).entries().collect()] == ["a|b"]
