"""The registered queries on the smallest tables, and the pipeline against its parts."""
import glob
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from feedloom.llm import mixing, quality, simhash
from feedloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_queries_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_covers_its_table(spark, name):
    if name == "op11_hard_negatives":
        assert QUERIES[name](spark, SF_DIR).columns
        return
    table = "pages" if name == "op6_language" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = Counter(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
    got = QUERIES[name](spark, SF_DIR)
    found = Counter(r[0] for r in got.select(key).collect())
    if name == "op10_decontamination":
        assert set(found) <= set(ids) and found
    else:
        assert found == ids


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(cursor.fetchall())


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = quality.classify(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    good = {r["doc_id"] for r in scored if r["predicted"]}
    one = docs.filter(docs.doc_id.isin(sorted(good)))
    groups = simhash.near_duplicates(one).collect()
    single = {r["component_id"] for r in groups}
    two = docs.filter(docs.doc_id.isin(sorted(single)))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, two, SF_DIR).collect()}
    items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    contains = lambda text: any(" ".join(i) in " ".join(re.findall(r"\w+", text.lower())) for i in items)
    assert kept == {r["doc_id"] for r in two.collect() if not contains(r["text"])}
    three = docs.filter(docs.doc_id.isin(sorted(kept)))
    copies = Counter()
    for r in mixing.mix(three).collect():
        copies[r["doc_id"]] += r["copies"]
    got = corpus_pipeline.run(spark, SF_DIR)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == +copies
    by_shard = Counter()
    for r in rows:
        by_shard[r["shard"]] += r["size"]
    biggest = max(r["size"] for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 2 * biggest
    assert sorted((r["shard"], r["slot"]) for r in rows) == [
        (s, k) for s in sorted(by_shard) for k in range(sum(r["shard"] == s for r in rows))]


def test_every_stage_takes_an_empty_table(spark):
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF_DIR)
        assert out.count() == 0
        assert name == "sharding" or out.columns == empty.columns
