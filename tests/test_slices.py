import random

import pytest
from pyspark.sql import functions as F

from feedloom import cluster
from feedloom.operators import dedup
from feedloom.plans import batch, queries
from feedloom.sources import storage

FIELDS = ["arrival", "portal", "url", "title", "company"]


@pytest.fixture
def postings(spark, tmp_path):
    """Rows in files, with a key that holds a third of them, missing names and repeated rows."""
    rnd = random.Random(5)
    portals = dedup.PORTAL_PRIORITY + ["zzz", None]
    rows = []
    for i in range(900):
        title, company = rnd.choice([(None, None), (None, ""), *[(f"T{rnd.randrange(40)}", f"C{rnd.randrange(9)} GmbH") for _ in range(4)]])
        rows.append((i, rnd.choice(portals), rnd.choice([None, f"u{rnd.randrange(30)}", f"v{i}"]), title, company))
    rows += rows[:100]
    spark.createDataFrame(rows, "arrival long, portal string, url string, title string, company string").write.parquet(f"{tmp_path}/rows")
    return spark.read.parquet(f"{tmp_path}/rows")


def sorted_rows(df):
    return sorted(df.select(*sorted(df.columns)).collect(), key=str)


@pytest.fixture
def calls(monkeypatch):
    """How many rows each call of ``collapse_links`` gets, which is what a shuffle of links holds at a time."""
    sizes, real = [], dedup.collapse_links
    monkeypatch.setattr(dedup, "collapse_links", lambda keyed, *a, **kw: sizes.append(keyed.count()) or real(keyed, *a, **kw))
    return sizes


@pytest.mark.parametrize("make", [batch.unique_postings, batch.nested_postings])
def test_slices_give_what_one_turn_gives(spark, postings, calls, monkeypatch, make):
    want = sorted_rows(make(postings, F.col("arrival"), FIELDS))
    assert calls == [1000]
    calls.clear()
    monkeypatch.setattr(batch, "SLICE_BYTES", 1)
    got = make(postings, F.col("arrival"), FIELDS)
    assert sorted_rows(got) == want
    assert len(calls) > 8 and sum(calls) == 1000 and max(calls) < 500
    assert spark.conf.get(cluster.SHUFFLE_CLEANUP, None) is None


def test_slices_of_nothing(spark, postings, monkeypatch):
    monkeypatch.setattr(batch, "SLICE_BYTES", 1)
    assert batch.unique_postings(postings.filter("arrival < 0"), F.col("arrival"), FIELDS).count() == 0


@pytest.mark.parametrize("name", ["per_portal", "digest_rows", "seen_merge"])
def test_large_pools_are_collapsed_in_slices(spark, calls, monkeypatch, name):
    one = sorted_rows(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    whole = sum(calls)
    calls.clear()
    monkeypatch.setattr(batch, "SLICE_BYTES", 50_000)
    assert sorted_rows(queries.QUERIES[name](spark, "/root/testdata/sf0.001")) == one
    assert sum(calls) == whole and max(calls) < whole / 2


def test_a_slice_is_removed_before_the_next(spark, postings, monkeypatch):
    monkeypatch.setattr(batch, "SLICE_BYTES", 1)
    left = []

    def make(keyed):
        where = keyed.inputFiles()[0].rsplit("/", 2)[0]
        left.append(len(storage.subfolders(spark, where)))
        return keyed.select("dedup_key").distinct()

    batch.by_slices(postings, FIELDS, make)
    assert left == list(range(len(left), 0, -1))


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    before = spark.conf.get(cluster.SHUFFLE_CLEANUP, None)
    with cluster.passing_shuffles(spark):
        assert spark.conf.get(cluster.SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(cluster.SHUFFLE_CLEANUP, None) == before
    with pytest.raises(ZeroDivisionError), cluster.passing_shuffles(spark):
        1 / 0
    assert spark.conf.get(cluster.SHUFFLE_CLEANUP, None) == before
