import random

import pytest
from pyspark.sql import functions as F

from feedloom import cluster
from feedloom.operators import dedup, report, seen
from feedloom.plans.batch import merge_pool

SCHEMA = "ord bigint, portal string, title string, company string, url string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def run(spark, rows, **kw):
    pool = merge_pool(frame(spark, rows), F.col("ord"))
    nested = dedup.nest_alternates(pool.unique, pool.others, **kw)
    return {r["dedup_key"]: r for r in nested.collect()}


def test_best_source_wins_and_keeps_the_other(spark):
    got = run(spark, [("stepstone", "Data Engineer (m/w/d)", "Bertrandt AG", "u1"), ("arbeitsagentur", "Data Engineer", "Bertrandt", "u2")])
    (row,) = got.values()
    assert row["portal"] == "arbeitsagentur" and [tuple(a) for a in row["also_on"]] == [("stepstone", "u1")]


def test_identical_row_twice_has_no_alternate(spark):
    (row,) = run(spark, [("xing", "A", "B", "u")] * 2).values()
    assert row["also_on"] is None and row["n_rows"] == 2


def test_portal_rank(spark):
    df = spark.createDataFrame([(" linkedin-search ",), ("linkedin",), ("indeed",), ("other",), (None,)], "p string")
    assert [r[0] for r in df.select(dedup.portal_rank(F.col("p"))).collect()] == [2, 2, 4, 7, 7]


def brute(rows):
    """Group, stable sort by rank, collect alternates - on plain lists."""
    ranks = {p: i for i, p in enumerate(dedup.PORTAL_PRIORITY)}
    groups = {}
    for r in rows:
        groups.setdefault(r[1].lower().strip(), []).append(r)
    out = {}
    for key, members in groups.items():
        members.sort(key=lambda r: ranks.get(r[0], 7))
        links = []
        for m in members[1:]:
            if (m[0], m[3]) not in links and (m[0], m[3]) != (members[0][0], members[0][3]):
                links.append((m[0], m[3]))
        out["co|" + key] = (members[0][0], members[0][3], links, len(members))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    portals = dedup.PORTAL_PRIORITY + ["zzz", None]
    rows = [(rnd.choice(portals), rnd.choice(["Hot"] * 10 + ["a", "b", "c", "d"]), "Co GmbH", rnd.choice([None, "u1", "u2", "u3", f"v{i}"]))
            for i in range(600)]
    got = run(spark, rows)
    want = brute(rows)
    assert got.keys() == want.keys()
    for key, (portal, url, links, n) in want.items():
        r = got[key]
        assert (r["portal"], r["url"], r["n_rows"]) == (portal, url, n)
        assert [tuple(a) for a in (r["also_on"] or [])] == links
        assert r["n_alternates"] == len(links)


def test_large_groups_keep_every_link(spark):
    rows = [("xing", "Hot", "Co", f"u{i:05}") for i in range(25_000)] + [("xing", "Cold", "Co", "u"), ("indeed", "Cold", "Co", "w")]
    pool = merge_pool(frame(spark, rows), F.col("ord"))
    nested = dedup.nest_alternates(pool.unique, pool.others)
    hot = nested.filter("dedup_key = 'co|hot'").orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in hot] == list(range(25)) and {r["n_alternates"] for r in hot} == {24_999}
    assert [len(r["also_on"]) for r in hot] == [1000] * 24 + [999]
    assert [a["url"] for r in hot for a in r["also_on"]] == [f"u{i:05}" for i in range(1, 25_000)]
    (cold,) = nested.filter("dedup_key = 'co|cold'").collect()
    assert cold["chunk_no"] == 0 and len(cold["also_on"]) == 1


def test_stats(spark):
    rows = [("xing", t, "c", str(i)) for i, t in enumerate("aabc")]
    stats = dedup.pool_stats(merge_pool(frame(spark, rows), F.col("ord")).unique).first()
    assert tuple(stats) == (4, 3, 1, 25.0)
    empty = dedup.pool_stats(merge_pool(frame(spark, rows).filter("ord < 0"), F.col("ord")).unique).first()
    assert tuple(empty) == (0, 0, 0, 0.0)


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16)], "c long, n long")
    assert [r[0] for r in df.select(dedup.redundancy_pct(F.col("c"), F.col("n"))).collect()] == [6.2, 18.8]


def test_dedup_is_idempotent(spark):
    pool = merge_pool(frame(spark, [("xing", "A", "B", "u1"), ("indeed", "A*", "B AG", "u2"), ("xing", "C", None, "u3")]), F.col("ord"))
    again = merge_pool(pool.unique.select(*[c.split()[0] for c in SCHEMA.split(", ")]), F.col("ord"))
    assert again.unique.select("dedup_key", "portal", "url").orderBy("dedup_key").collect() == \
        pool.unique.select("dedup_key", "portal", "url").orderBy("dedup_key").collect()


ENTRY = "stored_key string, title string, company string, url string, first_seen string, fit string, status string, portal string"


def test_url_keyed_entries_are_recognized_but_gain_an_entry(spark):
    entries = spark.createDataFrame([("https://x/1", "Data Engineer (m/w/d)", "Acme GmbH", "https://x/1", "2025-01-01", None, "new", "xing"),
                                     ("https://x/2", None, "", "https://x/2", "2025-01-01", None, "new", "xing")], ENTRY)
    keys = {r[0] for r in seen.known_keys(entries).collect()}
    assert keys == {"https://x/1", "https://x/2", "acme|data engineer"}
    pool = merge_pool(frame(spark, [("xing", "Data Engineer", "ACME", "u9"), ("xing", "Other", "ACME", "u8")]), F.col("ord")).unique
    known = seen.known_keys(entries)
    assert [r["title"] for r in seen.new_only(pool, known).collect()] == ["Other"]
    assert [r["title"] for r in seen.already_seen(pool, known).collect()] == ["Data Engineer"]
    assert {(r["title"], r["is_known"]) for r in seen.flag_known(pool, known).collect()} == {("Other", False), ("Data Engineer", True)}
    added = {r["stored_key"]: r for r in seen.new_entries(entries, pool, F.lit("2025-02-02")).collect()}
    assert added.keys() == {"acme|data engineer", "acme|other"}
    assert added["acme|other"]["first_seen"] == "2025-02-02" and added["acme|other"]["status"] == "new"


def test_links_are_added_once(spark):
    links = spark.createDataFrame([("k", "xing", "u1"), ("k", None, None)], "stored_key string, portal string, url string")
    others = spark.createDataFrame([("k", "xing", "u1"), ("k", "indeed", "u2"), ("k", None, None), ("j", None, "u3")], "dedup_key string, portal string, url string")
    got = {tuple(r) for r in seen.new_links(links, others).collect()}
    assert got == {("k", "indeed", "u2"), ("j", None, "u3")}
    entries = spark.createDataFrame([("k", "indeed", "u2")], "stored_key string, portal string, url string")
    assert {tuple(r) for r in seen.new_links(links, others, exclude_self=entries).collect()} == {("j", None, "u3")}


def test_ranks_replace_and_survive(spark):
    entries = spark.createDataFrame([("a", "new", ["g1"]), ("b", "new", ["g2"])], "stored_key string, status string, gaps array<string>")
    scores = spark.createDataFrame([("a", 70, "apply", ["s"], ["g9"], "ranked")],
                                   "stored_key string, rank_score int, rank_verdict string, strengths array<string>, gaps array<string>, status string")
    got = {r["stored_key"]: r for r in seen.write_ranks(entries, scores).collect()}
    assert (got["a"]["gaps"], got["a"]["rank_score"], got["a"]["status"]) == (["g9"], 70, "ranked")
    assert (got["b"]["gaps"], got["b"]["rank_score"], got["b"]["status"]) == (["g2"], None, "new")


def test_upsert_replaces_whole_rows(spark):
    schema = "dedup_key string, title string, fit string"
    old = spark.createDataFrame([("a", "t", "x"), ("b", "t", "x")], schema)
    new = spark.createDataFrame([("a", None, None), ("c", "n", None)], schema)
    once = report.upsert(old, new)
    rows = {tuple(r) for r in once.collect()}
    assert rows == {("a", None, None), ("b", "t", "x"), ("c", "n", None)}
    assert {tuple(r) for r in report.upsert(once, new).collect()} == rows


def test_links_carry_every_value_once(spark):
    rows = frame(spark, [("xing", "A", "B", "u1"), ("xing", "A", "B", "u1"), ("indeed", "A", "B", "u2")])
    links = dedup.collapse_links(dedup.with_key(rows), F.col("ord"))
    assert links.schema["record"].dataType.names == ["title", "company"]
    bare = dedup.collapse_links(dedup.with_key(rows, fields=["ord", "portal", "url"]), F.col("ord"))
    assert "record" not in bare.columns
    (best,) = dedup.pick_winners(bare).collect()
    assert (best["dedup_key"], best["ord"], best["portal"], best["url"], best["n_rows"], best["n_alternates"]) == ("b|a", 0, "xing", "u1", 3, 1)
    # An order that isn't a column of the rows, or only has the name of one.
    for order in (-F.col("ord"), (-F.col("ord")).alias("ord")):
        (best,) = dedup.pick_winners(dedup.collapse_links(dedup.with_key(rows.filter("portal = 'xing'")), order)).collect()
        assert (best["ord"], best["title"], best["n_rows"]) == (1, "A", 2)


@pytest.mark.parametrize("most, few", [(0, 1000), (3, 1000), (3, 1), (40, 1000), (10 ** 6, 1000)])
def test_large_groups_are_listed_like_small_ones(spark, monkeypatch, most, few):
    monkeypatch.setattr(dedup, "FEW_LARGE", few)
    rnd = random.Random(7)
    rows = [("xing", rnd.choice(["Hot"] * 8 + ["a", "b", "c"]), "Co", f"u{rnd.randint(0, 300)}") for _ in range(500)] + [("xing", "Lone", "Co", "u")]
    pool = merge_pool(frame(spark, rows), F.col("ord"))
    got = {(r["dedup_key"], r["chunk_no"]): [a["url"] for a in r["also_on"] or []]
           for r in dedup.nest_alternates(pool.unique, pool.others, 7, most).collect()}
    want = {}
    for title in {r[1] for r in rows}:
        urls = list(dict.fromkeys(r[3] for r in rows if r[1] == title))[1:]
        want |= {(f"co|{title.lower()}", at // 7): urls[at:at + 7] for at in range(0, max(len(urls), 1), 7)}
    assert got == want
    links = pool.others.select(F.col("dedup_key").alias("k"), "portal", "url", "arrival")
    listed = {(r["k"], r["chunk_no"]): [a["url"] for a in r["also_on"]] for r in dedup.in_chunks(links, "k", ["arrival"], 7, most).collect()}
    assert listed == {at: urls for at, urls in want.items() if urls}


def test_nesting_moves_alternates_once(spark):
    pool = merge_pool(frame(spark, [("xing", "A", "B", f"u{i}") for i in range(50)]), F.col("ord"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.nest_alternates(pool.unique, pool.others)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The links, the winners' links that they are compared with, and the winners.
    assert plan.count("Exchange hashpartitioning") == 3 and "rangepartitioning" not in plan


def test_scans_of_many_rows_are_dealt_into_small_parts(spark, tmp_path, monkeypatch):
    spark.range(10_000).selectExpr("id", "id % 7 AS n").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(cluster, "TASK_ROWS", 500)
    dealt = cluster.spread(rows, ["id"])
    assert dealt.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
