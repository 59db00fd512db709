import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions import cells, names
from feedloom.operators import filters, lookup


def score(spark, pairs):
    df = spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate(pairs)], "i int, q string, n string")
    return [r[1] for r in df.select("i", names.match_score(F.col("q"), F.col("n")).alias("s")).orderBy("i").collect()]


def test_known_scores(spark):
    got = score(spark, [("Novo Nordisk", "Novo Nordisk A/S"), ("Novo", "Novo Nordisk A/S"), ("Novo Nordisk", "Novo"), ("Orsted", "Ørsted A/S"),
                        ("Google", "Microsoft"), ("", "x"), ("x", ""), (None, "x"), ("x", None)])
    assert got == [100, 83, 75, 85, 0, 0, 0, 0, 0]
    assert score(spark, [("Novo Tech", "Novo Nordisk Tech A/S"), ("a b c alpha beta", "alpha gamma")]) == [70, 50]


def test_noise_words(spark):
    df = spark.createDataFrame([("  Novo Nordisk A/S ",), ("ABC (VG) Danmark ApS",), ("Foo, Aarhus branch",), ("XY a.m.b.a.",)], "s string")
    assert [r[0] for r in df.select(names.name_norm(F.col("s"))).collect()] == ["novonordisk", "abc", "foo", "xyamba"]
    assert df.select(names.anglicize(F.lit("Ærø Åby Öl"))).first()[0] == "aero aaby ol"


WORDS = ["novo", "nordisk", "tech", "it", "ørsted", "orsted", "a", "bank", "dan", "dansk", "danske", "sø", "so", "x1", "ag"]


def names_of(rnd, n):
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 3))) + rnd.choice(["", " A/S", " Group", "(x)"]) for _ in range(n)]


@pytest.mark.parametrize("shuffle", [False, True])
def test_blocking_loses_nothing_and_repeats_nothing(spark, shuffle):
    rnd = random.Random(3)
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(names_of(rnd, 60))], "query_id int, query string")
    companies = spark.createDataFrame([(i, c) for i, c in enumerate(names_of(rnd, 150))], "ord int, company string")
    for floor in (30, 70, 71, 80, 100):
        found = lookup.match_companies(queries, companies, min_score=floor, force_shuffle=shuffle).select("query_id", "ord", "score").collect()
        every = lookup.match_companies(queries, companies, force_shuffle=shuffle).filter(F.col("score") >= floor)
        assert sorted(map(tuple, found)) == sorted(map(tuple, every.select("query_id", "ord", "score").collect()))
    got = lookup.match_companies(queries, companies, force_shuffle=shuffle).select("query_id", "ord", "score").collect()
    everything = queries.crossJoin(companies).withColumn("score", names.match_score(F.col("query"), F.col("company")))
    want = everything.filter("score >= 30").select("query_id", "ord", "score").collect()
    assert len(want) > 500
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("k, first, floor", [(1, 1, 30), (3, 1, 30), (10, None, 30), (4, 2, 60), (3, None, 75), (5, None, 30)])
def test_best_companies_are_the_first_of_all_matches(spark, k, first, floor):
    rnd = random.Random(k)
    town = lambda: rnd.choice([None, "Køge", "Aarhus", "København 2"])
    long = " ".join(f"{w}{i}" for i, w in enumerate(WORDS[:9]))
    queries = spark.createDataFrame(
        [(i, q, rnd.choice([None, None, "kobenhavn", "århus"])) for i, q in enumerate([*names_of(rnd, 60), long + " tech novo", "", "x1 ørsted so"])],
        "query_id int, query string, city string")
    companies = spark.createDataFrame(
        [(i, c, town()) for i, c in enumerate([*names_of(rnd, 250), long, long + " bank", "møller moller bank"])], "ord int, company string, city string")
    got = lookup.best_companies(queries, companies, k, F.col("ord"), min_score=floor, first=first, few_pairs=-1 if first or k == 10 else 10 ** 6)
    want = lookup.top_matches(lookup.match_companies(queries, companies, min_score=floor), k, F.col("ord"))
    as_rows = lambda df: sorted(map(tuple, df.select("query_id", "place", "ord", "company", "city", "score").collect()), key=repr)
    assert as_rows(got) == as_rows(want)


def test_common_words_do_not_multiply_pairs(spark):
    """All companies share a word with the query; only the heads of the lists meet it."""
    companies = spark.range(5000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("Common Trade "), F.col("id")).alias("company"))
    queries = spark.createDataFrame([(1, "quite common"), (2, "trade common other")], "query_id int, query string")
    met = []
    real = lookup.names.score_parts
    lookup.names.score_parts = lambda q, n: met.append(1) or real(q, n)
    try:
        got = lookup.best_companies(queries, companies, 3, F.col("ord"), few_pairs=9_000)
    finally:
        lookup.names.score_parts = real
    rows = sorted(map(tuple, got.select("query_id", "place", "ord", "score").collect()))
    first = sorted(range(5000), key=lambda i: f"Common Trade {i}")[:3]
    assert rows == [(1, p, o, 50) for p, o in enumerate(first, 1)] + [(2, p, o, 56) for p, o in enumerate(first, 1)]
    assert len(met) <= 2  # grams, and one round of lists


def test_counts_of_matches(spark):
    matches = spark.createDataFrame([(1, 100), (1, 70), (1, 50), (2, 75)], "query_id int, score int")
    assert sorted(map(tuple, lookup.matches_per_query(matches).collect())) == [(1, 3, 100, 2), (2, 1, 75, 0)]


def odd_tables(spark, seed):
    """Queries that ask the same, ids that come several times or are null, cities, long names, empty names."""
    rnd = random.Random(seed)
    town = lambda: rnd.choice([None, "", "Køge", "Aarhus", "København 2", "KØBENHAVN 21"])
    long = " ".join(f"{w}{i}" for i, w in enumerate(WORDS[:9]))
    texts = [*names_of(rnd, 30), long + " tech novo", long, "", None, "x1 ørsted so", "NOVO tech", "novo  Tech A/S", "tech novo"]
    ids = [None, None, 1, 1, 1, *range(2, 2 * len(texts))]
    asked = [(i, rnd.choice(texts), rnd.choice([None, None, "", "kobenhavn", "København 2", "århus"])) for i in ids]
    queries = spark.createDataFrame(asked, "query_id int, query string, city string")
    held = [(i, c, town()) for i, c in enumerate([*names_of(rnd, 200), long, long + " bank", "møller moller bank", None, *names_of(rnd, 5) * 3])]
    return queries, spark.createDataFrame(held, "ord int, company string, city string")


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_queries_that_ask_the_same_are_matched_once(spark):
    queries, companies = odd_tables(spark, 8)
    asked, members = lookup.alike(queries)
    assert asked.count() < members.count() == queries.select("query_id").distinct().count()
    same = spark.createDataFrame([(1, "Novo Tech A/S", "Køge"), (2, "novo  TECH", "koge"), (3, "Novo Tech", None), (4, "novo tech", "")],
                                 "query_id int, query string, city string")
    assert lookup.alike(same)[0].count() == 2
    once = lookup.of_all(lookup.match_companies(asked, companies), members)
    columns = "query_id", "query", "ord", "company", "city", "score"
    assert as_rows(once, *columns) == as_rows(lookup.match_companies(queries, companies), *columns)
    ranked = lookup.of_all(lookup.rank_all(lookup.match_companies(asked, companies, min_score=75), ["ord"]), members)
    assert as_rows(ranked, "query_id", "score", "place") == as_rows(
        lookup.rank_all(lookup.match_companies(queries, companies, min_score=75).withColumn("query_id", F.coalesce("query_id", F.lit(-1))), ["ord"])
        .withColumn("query_id", F.expr("nullif(query_id, -1)")), "query_id", "score", "place")


def test_names_that_begin_alike_meet_only_inside_one_another(spark):
    """What is cut of a name depends on the lengths asked for, not on how many queries begin like it."""
    companies = spark.range(2000).select(F.concat(F.lit("commontrade"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("ang"))
    few, many = (spark.range(n).select(F.concat(F.lit("commontrade"), F.lpad(F.col("id").cast("string"), 6, "x")).alias("ang")) for n in (10, 1000))
    cut = [lookup._found_in(companies, "ang", asked, "ang").count() for asked in (few, many)]
    assert cut == [2000, 2000]
    found = lookup._found_in(spark.createDataFrame([("banana",), ("an",), ("",)], "o string"), "o",
                             spark.createDataFrame([("an",), ("ana",), ("banana",), ("b",), ("",), ("nab",)], "i string"), "i")
    texts = found.join(spark.createDataFrame([("an",), ("ana",), ("banana",), ("b",), ("nab",)], "i string"), F.col("_found") == F.col("i"))
    assert as_rows(texts, "o", "i") == [("an", "an"), ("banana", "an"), ("banana", "ana"), ("banana", "b"), ("banana", "banana")]


@pytest.mark.parametrize("k, first", [(1, 1), (3, None), (4, 2)])
def test_best_companies_of_repeated_and_missing_ids(spark, k, first):
    queries, companies = odd_tables(spark, k)
    got = lookup.best_companies(queries, companies, k, F.col("ord"), first=first, few_pairs=-1)
    want = lookup.top_matches(lookup.match_companies(queries, companies), k, F.col("ord"))
    # The text isn't compared, as queries of one id may tie.
    assert as_rows(got, "query_id", "place", "ord", "company", "city", "score") == as_rows(want, "query_id", "place", "ord", "company", "city", "score")


@pytest.mark.parametrize("few_pairs", [-1, 10 ** 6])
def test_counts_are_those_of_all_matches(spark, few_pairs):
    queries, companies = odd_tables(spark, 11)
    want = lookup.matches_per_query(lookup.match_companies(queries, companies))
    columns = "query_id", "n", "best", "n_by_words"
    got = lookup.count_matches(queries, companies, few_pairs=few_pairs)
    assert as_rows(got, *columns) == as_rows(want, *columns) and got.schema.names == want.schema.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def test_counting_scores_no_pair_for_a_common_word(spark):
    companies = spark.range(3000).select(F.concat(F.lit("Common Trade "), F.col("id")).alias("company"))
    queries = spark.createDataFrame([(1, "quite common"), (2, "trade common other"), (3, "Common Trade 7")], "query_id int, query string")
    met, real = [], lookup._meet

    def meet(q, n, *args, **kwargs):
        pairs = real(q, n, *args, **kwargs)
        met.append(pairs.count())
        return pairs

    lookup._meet = meet
    try:
        got = lookup.count_matches(queries, companies, few_pairs=100)
        rows = as_rows(got, "query_id", "n", "best", "n_by_words")
    finally:
        lookup._meet = real
    assert rows == [(1, 3000, 50, 3000), (2, 3000, 56, 3000), (3, 3000, 100, 3000 - 111)]
    assert sum(met) == 111  # Common Trade 7, 70 to 79, 700 to 799


def test_single_search_equals_batch_and_city(spark):
    companies = spark.createDataFrame([(1, "Novo Nordisk A/S", "København"), (2, "Novo Tech", None), (3, "Other", "København")], "ord int, company string, city string")
    found = lookup.ordered(lookup.search_company(companies, "Novo"), F.col("ord")).collect()
    assert [(r["ord"], r["score"]) for r in found] == [(2, 85), (1, 83)]
    assert [r["ord"] for r in lookup.search_company(companies, "novo", city="kobenhavn").collect()] == [1]
    batch = lookup.match_companies(spark.createDataFrame([(9, "Novo", "kobenhavn")], "query_id int, query string, city string"), companies)
    assert [(r["query_id"], r["ord"]) for r in batch.collect()] == [(9, 1)]
    df = spark.createDataFrame([("København", "kobenhavn"), (None, "x"), (None, ""), ("Aarhus", "århus")], "a string, b string")
    assert [r[0] for r in df.select(filters.in_city(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


def test_complete_ranking_equals_a_window(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2]), i, rnd.choice("abc"), rnd.choice([70, 70, 100])) for i in range(500)]
    matches = spark.createDataFrame(rows, "query_id int, ord int, company string, score int")
    got = {(r["query_id"], r["ord"]): r["place"] for r in lookup.rank_all(matches, ["ord"], partitions=7).collect()}
    for q in (1, 2):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2], r[1]))
        for place, r in enumerate(order, 1):
            assert got[(q, r[1])] == place
    top = lookup.top_matches(matches, 2, F.col("ord")).collect()
    assert {(r["query_id"], r["ord"]) for r in top} == {k for k, p in got.items() if p <= 2}


def test_benchmark_rows(spark):
    df = spark.range(1).select(F.lit("Acme").alias("company"), F.from_json(F.lit(
        '{"base_pay": {"count": 3, "index": 45000}, "text": {"count": 0, "index": "n/a"}, "none": {}, "hidden": {"count": 2}, "flag": {"index": true}}'),
        "map<string,struct<count:double,index:variant>>").alias("categories"))
    rows = {r["category"]: r for r in lookup.benchmark_rows(df, 40000).collect()}
    assert rows.keys() == {"base_pay", "text", "hidden", "flag"}
    assert (rows["base_pay"]["label"], rows["base_pay"]["diff_shown"], rows["base_pay"]["index_shown"], rows["base_pay"]["count_shown"]) == ("Base Pay", "+12.5%", "45000.0", "3")
    assert (rows["text"]["index_shown"], rows["text"]["diff_shown"], rows["text"]["count_shown"]) == ("n/a", "", "0")
    assert (rows["hidden"]["index_shown"], rows["hidden"]["diff_pct"]) == ("N/A*", None)
    zero = {r["category"]: r for r in lookup.benchmark_rows(df, 0).collect()}
    assert zero["base_pay"]["diff_pct"] is None and zero["base_pay"]["diff_shown"] == ""


def test_patterns_are_not_multiplied(spark):
    """The normalization stands in the plan once per row, however often its result is used."""
    df = spark.createDataFrame([("A", "t", "c")], "company string, title string, city string")
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    one = count(filters.keep_titles(df, exclude=["red"]))
    assert 0 < one == count(filters.keep_titles(df, exclude=["red", "blue"], require=["x", "y", "z"]))
    assert count(lookup.search_company(df, "Novo Nordisk")) <= 60


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_noise_is_removed_once_for_all_parts(spark):
    """Both parts of a name come from one cleaning; a name with white space at its ends gives the same parts."""
    odd = ["Red Bolt A/S", " a/s red", "x, y\n", "x, y\n z", "nor(x)dic red", "snapshots ivsx", "a.m.b.a.b", "Bånd Holding\t", "", None, "e \u00e6 12"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(odd)], "i int, c string")
    flat = names.with_name_parts(df, "c", "p_")
    struct = df.select("i", names.name_parts(F.col("c")).alias("s")).select("i", *[F.col(f"s.{p}").alias(f"p_{p}") for p in names.PARTS])
    columns = ["i", *[f"p_{p}" for p in names.PARTS]]
    assert sorted(map(tuple, flat.select(columns).collect()), key=str) == sorted(map(tuple, struct.select(columns).collect()), key=str)
    assert _plan(flat.select("p_words", "p_norm")).count("regexp_extract_all") == 1
    # Once for the lowered name, and once for names that are trimmed first.
    assert _plan(flat).count("scandinavia") <= 2 * _plan(flat.select("p_words")).count("scandinavia")
    assert _plan(flat.select("p_words")).count(r"(?=holding)") == 1


def test_a_filter_does_not_repeat_the_score(spark):
    companies = spark.createDataFrame([("Red Bolt", "x"), ("Blue Bolt", "y")], "company string, city string")
    queries = spark.createDataFrame([(1, "bolt", "x"), (2, "blue bolt gear", None)], "query_id int, query string, city string")
    found = lookup.match_companies(queries, companies, min_score=30)
    assert _plan(found).count("cast(array_intersect") + _plan(found).count("array_intersect(_q_words") <= 1
    assert sorted(map(tuple, found.select("query_id", "company", "score").collect())) == [
        (1, "Red Bolt", 85), (2, "Blue Bolt", 86), (2, "Red Bolt", 43)]


def test_results_of_few_rows_come_in_few_parts(spark):
    companies = spark.createDataFrame([(i, f"Bolt {i}") for i in range(20)], "ord int, company string")
    queries = spark.createDataFrame([(i, "bolt") for i in range(50)], "query_id int, query string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        best = lookup.best_companies(queries, companies, 3, F.col("ord"))
        assert best.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert best.count() == 150


def test_ambiguous_numbers(spark):
    values = ["1,234.56", "1.234,56", "12.5", "1,234", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(cells.is_ambiguous_number(F.col("v"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False, False, False]
