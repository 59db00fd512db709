"""Suffix-array dedup against the definition."""
import hashlib
import random

import pytest

from feedloom.llm import suffixes as S


def by_definition(texts, length):
    """Removed positions of every text: each window that starts anywhere else too."""
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
    out = []
    for t in texts:
        gone = set()
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone.update(range(p, p + length))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_order_and_common_prefixes(seed):
    rng = random.Random(seed)
    known = rng.choice([0, 3])
    strings = [b"abc"[:known] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    strings += strings[:5]
    order, shared = S.suffix_order(strings, known, shallow=4)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    for k in range(1, len(order)):
        assert shared[k] == S.common_prefix(strings[order[k - 1]], strings[order[k]])


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    part = bytes(rng.choice(b"abcd") for _ in range(60))
    a, b = b"xyz" * 7 + part + b"q" * 30, part + b"rs" * 20
    at = a.index(part)
    reach, _ = S.reach_of(40)
    for offset in range(21):
        inside = lambda found, p: [x - p for x in found if p <= x < p + reach]
        assert set(inside(S.anchors(a, 40), at + offset)) & set(inside(S.anchors(b, 40), offset))


def check(spark, texts, length, bucket):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_definition([(t or "").encode() for t in texts], length)
    got = {r["doc_id"]: r for r in S.remove_repeats(docs, length=length, bucket=bucket).collect()}
    assert got.keys() == set(range(len(texts)))
    for i, t in enumerate(texts):
        gone = {p for s in got[i]["spans"] for p in range(s["start"], s["stop"])}
        assert gone == want[i], (i, t)
        assert bytes(got[i]["kept"]) == bytes(b for p, b in enumerate((t or "").encode()) if p not in gone)


@pytest.mark.parametrize("length,bucket,seed", [(12, 128, 0), (12, 3, 1), (30, 4, 2), (40, 128, 3)])
def test_against_the_definition(spark, length, bucket, seed):
    rng = random.Random(seed)
    letters = "ab " if seed % 2 else "abcdefgé \n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randrange(10, 90)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(30)) for _ in range(rng.randrange(6))]
        text = "".join(parts)
        if text and rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + 1:]
        texts.append(text)
    check(spark, texts + [None, "", texts[3], "a" * 100], length, bucket)


def test_one_passage_in_many_different_places(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef") for _ in range(35))
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 25)))
    check(spark, [word() + passage + word() for _ in range(60)], 30, 4)


def test_empty_table_repeated_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, spans string, kept int, d1 int, pos int"
    assert S.remove_repeats(spark.createDataFrame([], schema), length=12).count() == 0
    row = (1, "the same text twice", "x", 2, 3, 4)
    out = S.remove_repeats(spark.createDataFrame([row, row, (None, None, None, None, None, None)], schema), length=12)
    assert out.columns == ["doc_id", "text", "d1", "pos", "spans", "kept"]
    assert sorted(bytes(r["kept"]) for r in out.collect()) == [b"", b"", b""]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
