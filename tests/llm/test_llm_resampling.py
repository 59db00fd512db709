"""Importance resampling against a plain model, and its checksums against zlib."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import SCHEMA, clashing, frame, make_rows

from feedloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def model(docs, target, max_run=1, buckets=10_000, min_words=20):
    """(doc_id, n_features, weight, score, rank) of every row, by the definition."""
    def features(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [" ".join(words[i:i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t)[1])
    t = Counter(place(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(all_s) / ((s[b] + 1) * float(all_t))))
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain(place(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words)))
    due = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0], r[2], r[1]))
    top = due[:10 * len(due) // 100]
    ranks = Counter()
    for k, r in enumerate(top, 1):
        ranks[(*r[:4], k)] += 1
    out = ranks + Counter()
    for r, n in (Counter(r[:4] for r in rows) - Counter(r[:4] for r in top)).items():
        out[(*r, None)] += n
    return out


def test_checksums_of_every_width():
    rng = np.random.default_rng(1)
    widths = [0, 1, 2, 3, 7, 7, 7, 511, 512, 513, 513, 1024, 1025, 1500, 5000, 5000]
    features = [rng.integers(0, 256, w, dtype=np.uint8).tobytes() for w in widths]
    assert resampling.checksums(features).tolist() == [zlib.crc32(f) for f in features]
    assert resampling.checksums([]).tolist() == []


@pytest.mark.parametrize("max_run", [1, 3])
def test_stretches_of_words_give_all_runs(max_run, monkeypatch):
    texts = [("One two, THREE " * 40 + "é" * 300 + " end").encode(), b"", None, b"a b a", b"one"]
    whole = list(resampling._scan(texts, resampling._Known(997), max_run))
    monkeypatch.setattr(resampling, "STRETCH", 16)
    monkeypatch.setattr(resampling, "KNOWN", 2)
    cut = list(resampling._scan(texts, resampling._Known(997), max_run))
    bag = lambda found: Counter(np.frombuffer(found[2], np.uint32).tolist())
    assert len(whole) == len(texts) and [(c[:2], bag(c)) for c in cut] == [(w[:2], bag(w)) for w in whole]


@pytest.mark.parametrize("max_run", [1, 2])
def test_scores_and_ranks_against_the_definition(spark, max_run):
    rows = make_rows(n=150)
    docs = [(r[0], r[1]) for r in rows]
    target = ["aa b cd", "e d c", None, "", "two words", "LONG a é"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for table in (frame(spark, rows), clashing(spark, rows)):
        got = resampling.scored(table, bench, max_run=max_run)
        assert set(table.columns) - {"score"} <= set(got.columns)
        found = Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()))
        assert found == model(docs, target, max_run)


def test_drawn_rows_keep_their_columns(spark):
    rows = make_rows(n=150)
    bench = spark.createDataFrame([("abc de",)], "text string")
    table = clashing(spark, rows)
    drawn = resampling.resampled(table, bench)
    assert drawn.columns == table.columns
    ranked = resampling.scored(table, bench, keep=["doc_id"]).filter("rank is not null")
    assert Counter(r[0] for r in drawn.select("doc_id").collect()) == Counter(r[0] for r in ranked.select("doc_id").collect())


def test_ties_go_by_id_and_reruns_agree(spark):
    text = " ".join(["same"] * 30)
    table = spark.createDataFrame([(7, text)] * 60 + [(3, text)] * 60, "doc_id long, text string")
    bench = spark.createDataFrame([("same",)], "text string")
    runs = [sorted(map(tuple, resampling.scored(table, bench).filter("rank is not null").drop("text").collect()), key=lambda r: r[-1])
            for _ in range(2)]
    assert runs[0] == runs[1]
    assert [r[-1] for r in runs[0]] == list(range(1, 13)) and len({r[0] for r in runs[0]}) == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.scored(empty, bench).count() == 0
    assert resampling.resampled(empty, bench).columns == empty.columns
    rows = [(1, "a b"), (None, None)]
    got = resampling.scored(spark.createDataFrame(rows, "doc_id long, text string"), bench, min_words=1, share=(100, 100))
    found = Counter(map(tuple, got.select("doc_id", "n_features", "weight", "rank").collect()))
    assert {(r[0], r[1], r[3]) for r in found} == {(1, 2, 1), (None, 0, None)}
