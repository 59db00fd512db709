"""Exact and near copies, mixing, sharding and lines against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from llm_fixtures import SCHEMA, clashing, frame, make_rows
from pyspark.sql import functions as F

from feedloom.llm import exact, lines, mixing, sharding, simhash
from feedloom.llm.common import bounded_sample, numbered

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# -- shared helpers -----------------------------------------------------------------------

def test_numbered_and_sample(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = {r["v"]: r["at"] for r in numbered(df, [F.col("v").asc()], "at").collect()}
    assert got == {v: v for v in range(500)}
    sample = [r["v"] for r in bounded_sample(df, F.xxhash64("v"), 40).collect()]
    assert 15 <= len(sample) <= 40 and sample == [r["v"] for r in bounded_sample(df, F.xxhash64("v"), 40).collect()]


# -- exact copies -------------------------------------------------------------------------

@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.unhex(F.hex(F.crc32(F.encode(c, "UTF-8")) % 3))])
def test_exact_groups(spark, digest):
    """With a digest of three values, only the comparison of contents tells groups apart."""
    rows = make_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = Counter()
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep)] += 1
    got = exact.exact_groups(clashing(spark, rows), digest=digest, salts=3).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want


def test_exact_of_nothing(spark):
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


# -- near copies --------------------------------------------------------------------------

def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("bits,limit", [(2, 16), (2, 2), (1, 16), (1, 2)])
def test_links_keep_components(spark, bits, limit):
    rng = random.Random(bits * 10 + limit)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:12]:
        for _ in range(12):
            for _ in range(rng.randrange(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = simhash.fingerprint_links(df, bits, limit)
    assert all(((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits for a, b in links.collect())
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = slow_roots(prints, bits)
    groups, got = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[want[p]].add(signed(p))
        got[roots.get(signed(p), signed(p))].add(signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
    assert all(root == min(got[root]) for root in got)


def test_near_duplicates(spark):
    rows = make_rows()
    prints = [slow_print(r[1]) for r in rows]
    roots = slow_roots(set(prints), 2)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[roots[p]] = min(r[0], least.get(roots[p], r[0]))
    want = Counter((r[0], signed(p), least.get(roots[p])) for r, p in zip(rows, prints, strict=True))
    docs = clashing(spark, rows)
    got = simhash.near_duplicates(docs.drop("fp", "id")).collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({roots[p] for p in prints}) and set(ids) - {None} == set(least.values())
    assert simhash.keep_one(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(docs.select("fp"), 3)


# -- mixing -------------------------------------------------------------------------------

def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    due, full = sum(sizes.values()), {}
    while True:
        left = {s: weight[s] for s in sizes if s not in full}
        rest = due - sum(full.values())
        target = {s: rest * w / sum(left.values()) for s, w in left.items()}
        above = {s: cap * sizes[s] for s in target if target[s] > cap * sizes[s]}
        if not above:
            return {**full, **target}
        full |= above


def test_mix(spark):
    rows = make_rows(n=400)
    docs = clashing(spark, rows)
    size = [len(WORDS.findall(r[1] or "")) for r in rows]
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    want = slow_targets(sizes)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], n) for r, n in zip(rows, size, strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        whole = int(r["target"] / r["source_size"] + 1e-9) if r["source_size"] else 0
        assert r["copies"] in (whole, whole + 1) and r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in want.items():
        biggest = max(n for r, n in zip(rows, size, strict=True) if r[3] == source)
        assert abs(taken[source] - target) <= biggest / 2 + 1
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mix.collect()) == +copies


def test_capped_sources_of_mostly_empty_texts(spark):
    rows = [(i, "three more words" if i % 20 == 0 else (None, "", " ")[i % 3], "en", f"src{i % 5}", 0) for i in range(300)]
    rows += [(i, "w " * 500, "en", "src9", 0) for i in range(300, 320)]
    docs = frame(spark, rows + [(400 + k, "one for each", "en", f"src{k}", 0) for k in range(5)])
    capped = [r for r in mixing.mix(docs).collect() if r["source"] != "src9"]
    assert {r["copies"] for r in capped} == {3} and all(r["target"] == 3 * r["source_size"] for r in capped)
    params = mixing.mix_parameters(mixing.sized(docs).select("source", "size", "uniform"))
    assert {r["_cut"] for r in params.collect() if r["_key"] != "=src9"} == {-1}


def test_mix_prefers_long_documents(spark):
    rows = [(i, "w " * (4 if i % 2 else 64), "en", "a" if i < 900 else "b", 0) for i in range(1000)]
    got = mixing.mix(frame(spark, rows), weights=(1.0, 1.0)).filter("source = 'a'").collect()
    share = {n: sum(r["copies"] for r in got if r["size"] == n) / sum(r["size"] == n for r in got) for n in (4, 64)}
    assert share[64] > 2 * share[4] > 0


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "a", 0)], [(1, "a b c", "en", "a", 5)] * 9])
def test_mix_of_little(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert len({r["copies"] for r in got}) <= 1 or {r["size"] for r in got} == {0}


# -- sharding -----------------------------------------------------------------------------

@pytest.mark.parametrize("interval_rows", [4, 20_000])
def test_shards(spark, interval_rows):
    rows = make_rows(n=300) + [(1000 + i, "the same text " * 3, "en", "src0", 1) for i in range(200)]
    docs = clashing(spark, rows)
    got = sharding.shard(docs, interval_rows=interval_rows).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(loads.values()) / 8
    biggest = max(len((r[1] or "").encode()) + 1 for r in rows)
    assert all(abs(loads[k] - ideal) <= biggest + 0.01 * ideal for k in range(8))
    assert sorted(map(str, sharding.shard(docs.repartition(5), interval_rows=interval_rows).collect())) == sorted(map(str, got))


def test_small_groups_stay_together_and_large_ones_are_divided(spark):
    rows = [(i, f"text {i // 2} " * 20, "en", "s", 1) for i in range(2000)]
    rows += [(5000 + i, "hot " * 40, "en", "s", 1) for i in range(1000)]
    got = sharding.shard(frame(spark, rows), tolerance=0.02).collect()  # a pair has 0.6 % of a shard
    at, loads = defaultdict(set), Counter()
    for r in got:
        at[r["text"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert len(at["hot " * 40]) >= 2 and all(len(s) == 1 for t, s in at.items() if t != "hot " * 40)
    assert max(loads.values()) < 1.05 * min(loads.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "same", "en", "s", 4)] * 50])
def test_shards_of_little(spark, rows):
    got = sharding.shard(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# -- lines --------------------------------------------------------------------------------

def line_rows(seed=4, n=60):
    rng = random.Random(seed)
    common = ["Share this", "  share THIS\r", "all rights reserved", "ÄÖ x", "", " ", "\x0b\x0c"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 8))]
        rows.append((i, "\n".join(parts), "en", "s", 1))
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s", 0), rows[0], (None, "share this\nown", "en", "s", 1),
                   (n + 2, "share this", "en", "s", 1), (n + 3, "\n" * 50, "en", "s", 1)]


def slow_lines(rows, least):
    strip = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\r\x0b\x0c"))
    split = [(r[1] or "").split("\n") for r in rows]
    counts = Counter(k for parts in split for k in {strip(p) for p in parts} if k)
    out = []
    for r, parts in zip(rows, split, strict=True):
        kept = [p for p in parts if counts[strip(p)] < least]
        out.append((r[0], len(parts), len(parts) - len(kept), "\n".join(kept).encode()))
    return Counter(out)


def as_counter(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], bytes(r["kept_text"])) for r in df.collect())


@pytest.mark.parametrize("filter_bytes", [lines.FILTER_BYTES, -1])
def test_lines(spark, filter_bytes):
    rows = line_rows()
    docs = clashing(spark, rows)
    got = lines.drop_lines(docs, min_docs=10, filter_bytes=filter_bytes)
    assert as_counter(got) == slow_lines(rows, 10)
    assert got.columns == docs.columns + ["n_lines", "n_dropped", "kept_text"]
    assert lines.drop_lines(docs.limit(0), filter_bytes=filter_bytes).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rows = line_rows()
    first, more = frame(spark, rows[:40]), frame(spark, rows[40:])
    before = lines.reference_counts(first)
    filters = lines.build_filters(before.filter("n >= 10").select("key"), 3)
    after = lines.inserted(before, more)
    grown = lines.updated_filters(filters, before, after)
    both = frame(spark, rows)
    assert as_counter(lines.drop_lines(both, counts=after, filters=grown)) == slow_lines(rows, 10)
    back = lines.deleted(after, more)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, before.collect()))
    shrunk = lines.updated_filters(grown, after, back)
    assert as_counter(lines.drop_lines(first, counts=back, filters=shrunk)) == slow_lines(rows[:40], 10)
    held = lambda f: sum(sum(c != b"\0\0\0\0" for c in (bytes(r["cells"])[k:k + 4] for k in range(0, len(r["cells"]), 4)))
                         for r in f.collect())
    assert held(shrunk) == held(filters) == before.filter("n >= 10").count()
    assert held(grown) == after.filter("n >= 10").count()


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    room = lines.Cuckoo.for_keys(2000)
    for key in keys[:2000]:
        room.insert(key)
    assert not room.full
    import numpy as np
    flat = lambda ks: np.frombuffer(b"".join(ks), np.uint8).reshape(-1, 16)
    test = lines.membership([{"shard": 0, "n_shards": 1, "buckets": room.buckets, "cells": room.cells.tobytes()}])
    assert test(flat(keys[:2000])).all() and test(flat(keys[2000:])).sum() <= 1
    for key in keys[:1000]:
        room.delete(key)
    test = lines.membership([{"shard": 0, "n_shards": 1, "buckets": room.buckets, "cells": room.cells.tobytes()}])
    assert test(flat(keys[1000:2000])).all() and test(flat(keys[:1000])).sum() <= 1
    small = lines.Cuckoo(1)
    for key in keys[:9]:
        small.insert(key)
    assert small.full


def test_digest_columns_of_the_sharding_query(spark):
    text = "é and more"
    df = frame(spark, [(1, text, "en", "s", 1)])
    crc = df.select(F.crc32(F.encode("text", "UTF-8")).alias("c")).first()["c"]
    assert crc == zlib.crc32(text.encode())


def test_lines_ask_their_shard_where_the_filter_is_large(spark, monkeypatch):
    """Small shards and bounds: every filter is asked in its shard, a hot one in several parts."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    monkeypatch.setattr(lines, "SHARD_LINES", 40)
    texts = [f"hot line\nline {k % 30}\n own {k}\nLINE {k % 7} \n\nhot line" for k in range(120)] + [None, "", "hot line"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    docs = frame(spark, rows)
    asked = []
    real = lines._asked_by_shard
    monkeypatch.setattr(lines, "_asked_by_shard", lambda *a: asked.append(1) or real(*a))
    got = lines.drop_lines(docs, filter_bytes=100)
    assert as_counter(got) == slow_lines(rows, 10) and len(asked) == 2
    none_due = lines.drop_lines(docs, min_docs=1000, filter_bytes=-1)
    assert as_counter(none_due) == slow_lines(rows, 1000)


def test_shards_of_equal_rows(spark):
    """A group of rows equal in every column is dealt over the shards, within the tolerance."""
    rows = [(1, "the same text", "en", "s", 13)] * 6000 + [(k, f"text number {k}", "en", "s", 1) for k in range(2, 2000)] + [(None, None, None, None, None)] * 40
    got = sharding.shard(frame(spark, rows), tolerance=0.01, interval_rows=200).select("doc_id", "size", "shard", "slot").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    held = Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    total = sum(held.values())
    assert len(held) == 8 and all(abs(v - total / 8) <= 0.02 * total / 8 + 20 for v in held.values()), held
    slots = Counter((r["shard"], r["slot"]) for r in got)
    assert max(slots.values()) == 1
    for s in range(8):
        mine = sorted(k for t, k in slots if t == s)
        assert mine == list(range(len(mine)))
