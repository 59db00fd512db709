"""Hard negatives against comparing every anchor with every row."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import hard_negatives
from feedloom.llm.hard_negatives import Anchors, Lists, spanning_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, keep=5, low=80, high=100):
    ok = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, lab, v in ok:
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        ranked = sorted({(-score(w), j, m == lab) for j, m, w in ok if j != i})
        for s, p, _ in [r for r in ranked if r[2]][:keep]:
            fits = [(-t, j) for t, j, same in ranked if not same and -low * s <= -100 * t <= -high * s][:keep]
            for k, (t, j) in enumerate(fits, 1):
                out[(i, p, k, j, -s, t)] += 1
    return out


def mined(spark, rows, every=10, schema=SCHEMA, **options):
    table = spark.createDataFrame(rows, schema)
    got = hard_negatives.mine(table, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("id") % every == 0, **options)
    return Counter(map(tuple, got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clusters(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    at = rng.integers(0, 6, n)
    v = centres[at] + spread * rng.normal(size=(n, size))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, [float(np.float32(x)) for x in v[i]], int((at[i] + (rng.random() < 0.4)) % 6)) for i in range(n)]


def test_the_tree_spans_at_least_cost():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 5))
    edges = spanning_tree(points)
    assert edges[0][1] == -1 and len({c for c, _, _ in edges}) == 40
    known = set()
    for child, parent, distance in edges:
        assert parent in known or parent == -1
        known.add(child)
        if parent >= 0:
            assert distance == pytest.approx(np.linalg.norm(points[child] - points[parent]))
    gap = np.linalg.norm(points[:, None] - points[None], axis=2)
    pairs = sorted((gap[a, b], a, b) for a in range(40) for b in range(a))
    group, total = list(range(40)), 0.0
    for d, a, b in pairs:  # Kruskal
        if group[a] != group[b]:
            total += d
            group = [group[a] if g == group[b] else g for g in group]
    assert sum(d for *_, d in edges) == pytest.approx(total)
    assert spanning_tree(points[:0]) == []


@pytest.mark.parametrize("spread", [0.01, 0.3, 2.0])
@pytest.mark.parametrize("block", [7, 1024])
def test_against_all_pairs(spark, spread, block):
    rows = clusters(5, 400, 8, spread)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows, block=block) == want


def test_bounds_leave_rows_out_where_anchors_are_close():
    rows = clusters(5, 3000, 8, 0.02)
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    ids, labels = np.arange(3000), np.array([r[2] for r in rows])
    some = ids[::20]
    lists = Lists(Anchors(some, labels[some], v[some], [[(60_000, 66_000)]] * len(some), 5, False))
    for at in range(0, 3000, 500):
        lists.compare(ids[at:at + 500], labels[at:at + 500], v[at:at + 500])
    assert lists.scored < 0.4 * lists.compared
    for a, i in enumerate(some):
        scores = v @ v[i]
        due = sorted((-scores[j], j) for j in ids if labels[j] != labels[i] and 60_000 <= scores[j] <= 66_000)[:5]
        assert [(-s, j) for j, s in zip(*lists.best[a][0])] == due


def test_awkward_rows(spark):
    rng = random.Random(2)
    vec = lambda n=4: [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)]
    rows = [(i, vec(), rng.randrange(3)) for i in range(60)]
    rows += [(100 + i, rows[0][1], 1) for i in range(30)]  # one vector for a third of all rows, all tied
    rows += [rows[5]] * 3 + [rows[10]] * 2 + [(10, vec(), 2)]  # repeated rows, an id used twice
    rows += [(None, vec(), 1), (200, None, 1), (201, vec(), None), (202, [0.1, None, 0.2, 0.3], 1),
             (203, [0.1, float("nan"), 0.2, 0.3], 1), (210, [float("inf"), 0.0, 0.0, 0.0], 1)]
    rows += [(220, [], 1), (221, [0.5], 2), (230, vec(6), 0), (240, [0.0] * 4, 2)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-10 ** 6, 10 ** 6)) for _ in range(4)], i % 3) for i in range(60)]
    assert mined(spark, rows, schema="vec_id long, embedding array<double>, label int") == brute(rows, lambda i: i % 10 == 0)


def test_empty_tables_and_clashing_names(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(3, [1.0], 1), (4, [1.0], 1)])
    assert not mined(spark, [(10, [1.0], 1), (20, [1.0], 2)])
    rows = [(*r, 1, 2, 3, 4) for r in clusters(5, 100, 4, 0.3)]
    schema = SCHEMA + ", id int, v int, score int, window int"
    assert mined(spark, rows, schema=schema) == brute([r[:3] for r in rows], lambda i: i % 10 == 0)
