"""Elements of large documents against the json module, with splits of a few bytes."""
import json
import random

import pytest

from feedloom.sources import landing
from feedloom.sources.json_split import MalformedDocument, elements


def some_value(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return rnd.choice(["", "plain", 'a "quoted" word', "braces } { ] [ here", "back\\slash\\", "\\\"}", "é🙂\n", ', "x": {', '"seen": {'])
    if kind == 2:
        return rnd.choice([0, -1.5, 10 ** 15, True, False, None])
    if kind in (3, 4):
        return rnd.choice([[], {}, "}}"])
    if kind == 5:
        return [some_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {f"{rnd.choice(['k', 'seen', 'companies', '}', 'a b'])}{i}": some_value(rnd, depth + 1) for i in range(rnd.randrange(4))}


def read(spark, path, member, split):
    rows = sorted(elements(spark, str(path), member, split).selectExpr("pos", "key", "to_json(value) AS v").collect(), key=lambda r: tuple(r["pos"]))
    return [(r["key"], json.loads(r["v"])) for r in rows]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("split", [40, None])
def test_members_of_random_documents(spark, tmp_path, seed, split):
    rnd = random.Random(seed)
    store = {f"key {i}": some_value(rnd) for i in range(rnd.randrange(30))}
    listed = [some_value(rnd) for _ in range(rnd.randrange(30))]
    parts = [("version", 1), ("meta", {"a": {"seen": {"no": {}}}, "companies": [{"no": {}}]}), ("seen", store), ("note", "} ] {"),
             ("companies", listed), ("tail", [{"x": [1, {}]}])]
    rnd.shuffle(parts)
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(dict(parts), indent=rnd.choice([None, 1]), ensure_ascii=bool(seed % 2)) + "\n" * (seed % 3))
    found = read(spark, path, "seen", split)
    assert dict(found) == store and len(found) == len(store)
    assert read(spark, path, "companies", split) == [(None, v) for v in listed]


def test_documents_that_are_not_whole(spark, tmp_path):
    for text in ('{"seen": {"a": {}', '[{"seen": {}}]', '{"other": {}}', '{"seen": 3}', "", '{"seen": {"a": {"b": 1}}}}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(MalformedDocument):
            elements(spark, str(tmp_path / "bad.json"), "seen").collect()
    (tmp_path / "odd.json").write_text('{"seen": {"a": {"b": nonsense}, "c": {}}}')
    with pytest.raises(Exception, match="unreadable element 0 of seen"):
        elements(spark, str(tmp_path / "odd.json"), "seen").collect()


def test_a_store_beyond_the_limit_of_one_value(spark, tmp_path):
    """A document that one VARIANT can't hold is imported whole."""
    path = tmp_path / "seen.json"
    filler = "x" * 1000
    n = 150_000
    with open(path, "w") as out:
        out.write('{"seen": {')
        for i in range(n):
            out.write(f'{", " if i else ""}"k{i}": {{"title": "T{i}", "company": "C", "url": "{filler}", "also_on": [{{"portal": "p", "url": "u{i}"}}]}}')
        out.write("}}")
    assert path.stat().st_size > 150_000_000
    found = landing.read_large_seen_document(spark, str(path), split_bytes=16_000_000)
    got = found.selectExpr("count(*) AS n", "count(DISTINCT stored_key) AS keys", "min(length(url)) AS least", "max(also_on[0].url) AS last").first()
    assert (got["n"], got["keys"], got["least"], got["last"]) == (n, n, 1000, "u99999")


def test_large_readers_equal_the_plain_ones(spark, tmp_path):
    path = tmp_path / "store.json"
    path.write_text(json.dumps({"seen": {"k|t": {"title": "T", "fit": {"score": 3}, "also_on": [{"portal": "x", "url": "u"}]}, "url": {"company": "A"}},
                                "companies": [{"company": "A"}, "junk", {"company": "B", "city": "} ]"}]}))
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert as_rows(landing.read_large_seen_document(spark, str(path), 30)) == as_rows(landing.read_seen_document(spark, str(path)))
    whole = landing.read_dataset_entries(spark, str(path))[1]
    large = landing.read_large_dataset_entries(spark, str(path), 30)
    text = lambda df: as_rows(df.selectExpr("pos", "to_json(entry) AS e"))
    assert text(large) == text(whole)
