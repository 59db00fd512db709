"""Quality, decontamination, personal data and languages against brute force and held-out rows."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import SCHEMA, clashing, frame, make_rows
from pyspark.sql import functions as F

from feedloom.llm import decontamination, language, pii, quality

LABELS = "doc_id long, quality int, toxic int"


# -- quality ------------------------------------------------------------------------------

def graded(n=400, seed=2):
    """Prose, and prose with a stretch of junk somewhere."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 300))]
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(len(words))
            words[at:at + 15] = ["%%%" + w.upper() + "!!" for w in words[at:at + 15]]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = graded()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = quality.classify(docs, marks).collect()
    truth = dict((i, q) for i, q, _ in labels)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    kept = quality.good_only(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_held_out_labels_change_nothing(spark):
    rows, labels = graded(120)
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, LABELS)
    turned = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda m: {r["doc_id"]: r["score"] for r in quality.classify(docs, m).collect()}
    assert scores(marks) == scores(turned)


def test_quality_of_awkward_rows(spark):
    docs = clashing(spark, make_rows())
    for labels in ([], [(1, 1, 0), (2, None, 0)], [(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 1), (4, 0, 1), (6, 1, 0)]):
        got = quality.classify(docs, spark.createDataFrame(labels, LABELS))
        assert [c for c in got.columns if c not in docs.columns] == ["held_out", "predicted"]  # score is replaced
        values = [r["score"] for r in got.collect()]
        assert len(values) == docs.count() and all(0 <= v <= 1 for v in values)
        if not labels:
            assert set(values) == {0.5}
    assert quality.classify(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_gradients_and_pieces():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.FEATURES)).astype(np.float32) for k in (1, 4, 7, 2) * 20]
    y = np.array([float(b[:, 3].max() > 0.8) for b in bags])
    score = quality.fit(bags, y).score(bags)
    assert ((score > 0.5) == (y > 0)).mean() > 0.9
    text = "some words here | and | there\n" * 60_000
    assert abs(len(quality.encode(text)) - 60_000 * 7 / 50) < 5
    assert len(quality.encode("")) == len(quality.encode(None)) == len(quality.encode(" \n")) == 1


# -- decontamination ----------------------------------------------------------------------

ITEMS = "item_id long, text string"
QUESTION = "Tom has 3 apples and buys 5 more while Anna eats 3 of them after a walk of 2 km"


def leaks(spark, texts, items=(QUESTION,), **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = decontamination.contaminated(docs, bench, F.col("doc_id"), F.col("item_id"), **options).collect()
    return {(r["doc"], r["item"]): r["coverage"] for r in got}


def test_parameters_may_change_but_must_be_consistent(spark):
    texts = [
        "before. " + QUESTION + " after.",
        QUESTION.upper() + "!",
        "Well. " + QUESTION.replace("Tom", "Bob").replace("Anna", "Eve").replace("3", "7").replace("5", "12").replace("km", "miles"),
        QUESTION.replace("eats 3", "eats 8"),  # one value of the item became two
        QUESTION.replace("5", "3"),            # two values became one
        "Tom has 3 apples and buys 5 more",    # a third of the item
        "an ordinary text about apples and a walk of 2 km", None, "",
    ]
    got = leaks(spark, texts)
    # A first word may be a name or not, so it stays a word: "Tom" and "Bob" differ.
    assert {d for d, _ in got} == {0, 1, 2} and all(v > 0.9 for v in got.values())


@pytest.mark.parametrize("item, changed", [
    ("what is the next number in the sequence 2 4 8 16 32 64 128", "what is the next number in the sequence 3 9 27 81 243 729 2187"),
    ("the four planks measure 5 cm 7 cm 9 cm 11 cm in the list of the yard",
     "the four planks measure 2 in 4 in 3 in 12 in in the list of the yard"),
])
def test_items_that_repeat_a_slot_template(spark, item, changed):
    added = item.replace(" the ", " really the ", 1)  # from there on at another offset
    got = leaks(spark, [item, "so. " + item + " 256 512", changed, added], [item], coverage=0.7)
    assert {d for d, _ in got} == {0, 1, 2, 3} and got[0, 0] == got[1, 0] == got[2, 0] == 1.0


def test_new_values_may_collide(spark):
    item = "on a farm there are 4 cows and 6 goats and the farmer sells 4 of them at the market in town"
    texts = [
        item.replace("4", "8").replace("6", "8"),               # different values became equal
        item.replace("4 of", "7 of").replace("4 cows", "9 cows"),  # equal values became different
        item.replace("4", "6").replace("6 goats", "9 goats"),   # a new value equals another one of the item
        item.replace("4 of", "6 of"),                           # a copy that contradicts what it keeps
    ]
    assert leaks(spark, texts, [item]) == {(0, 0): 1.0, (1, 0): 1.0, (2, 0): 1.0}


def test_first_words_and_number_words(spark):
    names = "Tom has 3 apples. Ann has 5 pears. Sam eats 2 of them."
    words = "she buys three apples and walks two km home before she eats four of them again"
    asks = "How many of the apples that Tom has does he eat before Ann comes home"
    got = leaks(spark, [
        names.replace("Tom", "Bob").replace("Ann", "Eve").replace("Sam", "Joe").replace("3", "7"),
        words.replace("three", "seven").replace("two km", "nine miles").replace("four", "5"),
        asks.replace("How", "Tell me how").replace("Tom", "Bob").replace("Ann", "Eve"),
        names.replace("apples", "plums").replace("pears", "figs"),
    ], [names, words, asks])
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0}


def slow_coverage(text, item, window=5):
    tokens = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    a, b = tokens(text), tokens(item)
    here = {tuple(a[k:k + window]) for k in range(len(a) - window + 1)}
    covered = {k + j for k in range(len(b) - window + 1) if tuple(b[k:k + window]) in here for j in range(window)}
    return len(covered) / len(b)


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(rng.randrange(12, 30))) for _ in range(12)]
    texts = []
    for _ in range(60):
        words = rng.choice(items).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(20))] + words + [word() for _ in range(rng.randrange(20))]))
    want = {(d, i): slow_coverage(t, q) for d, t in enumerate(texts) for i, q in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert leaks(spark, texts, items) == pytest.approx(want) and len(want) > 20


def test_short_items_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    got = leaks(spark, [QUESTION, QUESTION, "say blue moon now"], [QUESTION, "Blue moon", QUESTION, "", None])
    assert set(got) == {(0, 0), (0, 2), (1, 0), (1, 2), (2, 1)}
    assert leaks(spark, ["a b c d e f"], []) == {} and leaks(spark, [], [QUESTION]) == {}


def test_leaking_rows_go(spark):
    rows = make_rows() + [(900, "so: " + QUESTION, "en", "s", 1), (900, "clean row with the id of a leak", "en", "s", 1)] * 2
    docs, bench = clashing(spark, rows), spark.createDataFrame([(1, QUESTION)], ITEMS)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["text"] for r in kept.collect()) == Counter(r[1] for r in rows if QUESTION not in (r[1] or ""))


# -- personal data ------------------------------------------------------------------------

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(6)
    pieces = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "..", "-", " ", "é", "_", "12", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (918) 555-3922", "+", "(", ")", "word", "\n", "0000", "%", "999.1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(text) == slow_spans(text), text


def phones(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 8)))
        kind = rng.randrange(4)
        number = f"1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"
        piece = ["+" + number, f"{rng.randrange(10 ** 11):011}", f"id {rng.randrange(10 ** 9)}", "+" + number][kind]
        cue = "call " if kind in (0, 3) else "order no. "
        rows.append((i, f"{word()} {word()} {cue}{piece} {word()}", "en", "s", 1))
    return rows


def test_candidates_in_the_form_and_place_of_true_ones_are_added(spark):
    rows = phones() + [(5000, "please call 1 (918) 555-3922 now", "en", "s", 1), (5001, "order no. 55538921234 is", "en", "s", 1),
                       (5002, None, "en", "s", 1), (5003, "", "en", "s", 1), (5004, "a clean text with 12 numbers", "en", "s", 1)]
    docs = clashing(spark, rows)
    got = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    spans = lambda i, c: [(s["start"], s["kind"], s["end"]) for s in got[i][c]]
    names = [k for k, _ in PATTERNS]
    for i, text, *_ in rows:
        base = [(s, names[k], e) for s, k, e in slow_spans(text or "")]
        assert spans(i, "base_spans") == base and set(base) <= set(spans(i, "all_spans"))
    assert spans(5000, "all_spans") == [(12, "phone", 28)] and spans(5001, "all_spans") == spans(5004, "all_spans") == []
    cut = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert cut[5000] == "please call <phone> now" and cut[5002] is None and pii.redacted(docs).columns == docs.columns
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, pii.FEATURES))
    x[:, 0] = rng.integers(0, 4, 4000)
    y = (x[:, 2] > 0.3) & (x[:, 5] < 0.5) & (x[:, 0] != 3)
    forest = pii.fit(x, y)
    fresh = rng.normal(size=(2000, pii.FEATURES))
    fresh[:, 0] = rng.integers(0, 4, 2000)
    truth = (fresh[:, 2] > 0.3) & (fresh[:, 5] < 0.5) & (fresh[:, 0] != 3)
    _, accepted = forest.accepts(fresh)
    assert truth[accepted].mean() > 0.9 and accepted[truth].mean() > 0.8 and 3 not in forest.thresholds
    assert not pii.fit(x, np.zeros(4000, bool)).thresholds and not pii.Forest().accepts(fresh)[1].any()


# -- languages ----------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def model():
    samples = {"aa": "bada kada mada bala kala " * 20, "bb": "xilo pilo milo xipo pipo " * 20}
    counts = np.array([language.trigrams(t) for t in samples.values()], float) + 0.5
    return language.Model(list(samples), np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy())


def pages(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb"])
        words = ["bada", "kada", "mala"] if lang == "aa" else ["xilo", "pipo", "milo"]
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))
        host = {"aa": "one.aa", "bb": "two.bb"}[lang] if rng.random() < 0.8 else "both.com"
        declared = f' lang="{lang}-XX"' if rng.random() < 0.7 else ""
        rows.append((i, f"https://{host}/p{i}", f"<html{declared}><script>xilo</script><body>{text}&nbsp;<!-- xilo --></body></html>"))
    return rows + [(90, None, None), (91, "not an address", "<p>"), (92, "https://one.aa/", "<p>?</p>"), rows[0], (None, "http://two.bb:80/x", "<p>xilo</p>")]


def slow_fusion(rows, m):
    n = len(m.languages)
    found = []
    for page_id, url, page in rows:
        logs = m.evidence(language.visible_text(page))
        host = re.match(r"[a-z]+://([^/:]+)", url or "")
        host = host and host.group(1)
        whole = sum(math.exp(v) for v in logs)
        found.append((page_id, host, host and host.rpartition(".")[2], language.declared_language(page), logs,
                      [round(math.exp(v) / whole * 1e6) for v in logs]))
    sums = defaultdict(lambda: [0] * n)
    for _, host, suffix, declared, _, w in found:
        for key in (("all",), ("h", host), ("s", suffix), ("d", declared)):
            sums[key] = [a + b for a, b in zip(sums[key], w, strict=True)]
    kinds = len({f[3] for f in found} - {None})
    out = []
    for page_id, host, suffix, declared, logs, w in found:
        def shrunk(key, above, strength, w=w):
            rest = [(a - b) / 1e6 for a, b in zip(sums[key], w, strict=True)] if key[-1] is not None else [0] * n
            return [(a + strength * p) / (sum(rest) + strength) for a, p in zip(rest, above, strict=True)]
        prior = shrunk(("h", host), shrunk(("s", suffix), shrunk(("all",), [1 / n] * n, 1.0), 20.0), 4.0)
        scores = []
        for k in range(n):
            rate = 1.0
            if declared is not None:
                rate = ((sums[("d", declared)][k] - w[k]) / 1e6 + 5 / kinds) / ((sums[("all",)][k] - w[k]) / 1e6 + 5)
            scores.append(logs[k] + math.log(rate) + math.log(prior[k]))
        best = max(scores)
        out.append((page_id, m.languages[scores.index(best)], round(1 / sum(math.exp(s - best) for s in scores), 5)))
    return Counter(out)


def test_fusion_against_brute_force(spark):
    rows, m = pages(), model()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES + ", row int, host string, logs string")
    got = language.identify(df, m)
    assert got.columns == ["page_id", "url", "row", "logs", "host", "suffix", "declared", "text_lang", "lang", "prob"]
    rows_out = got.collect()
    assert Counter((r["page_id"], r["lang"], round(r["prob"], 5)) for r in rows_out) == slow_fusion(rows, m)
    assert {r["page_id"]: r["lang"] for r in rows_out}[92] == "aa"  # no letters: the host decides
    assert language.identify(df.limit(0), m).count() == 0
    # Without a model there is no language; the page's own evidence stays.
    assert {(r["lang"], r["text_lang"]) for r in language.identify(df, language.Model([], np.zeros((1, 0)))).collect()} == {(None, None)}


def test_trigram_tables_from_labelled_documents(spark):
    rows = [(i, "bada kada mada" if i % 2 else "xilo pilo", "aa" if i % 2 else "bb", "s", 1) for i in range(30)]
    m = language.fit(frame(spark, [*rows, (99, None, "aa", "s", 1), (98, "x", None, "s", 1)]))
    assert m.languages == ["aa", "bb"]
    assert m.evidence("kada bada")[0] == 0 > m.evidence("kada bada")[1] and m.evidence("12 !") == [0.0, 0.0]
    assert language.fit(spark.createDataFrame([], SCHEMA)).languages == []


# -- round 3: rows that share an id, values mixed up, masked personal data, hostile texts ---

def test_rows_of_one_id_do_not_lend_each_other_parts(spark):
    words = QUESTION.split()
    half = len(words) // 2
    parts = [" ".join(words[:half + 2]), " ".join(words[half - 2:])]
    schema = "doc_id long, text string, n int"
    bench = spark.createDataFrame([(0, QUESTION)], ITEMS)
    ask = lambda rows: decontamination.contaminated(
        spark.createDataFrame(rows, schema), bench, F.col("doc_id"), F.col("item_id")).collect()
    assert ask([(7, parts[0], 1), (7, parts[1], 2), (None, parts[0], 1), (None, parts[1], 2)]) == []
    got = ask([(7, QUESTION, 1), (7, QUESTION + " again", 2), (None, QUESTION, 1), (3, None, 1)])
    assert sorted((r["doc"] is None, r["doc"]) for r in got) == [(False, 7), (False, 7), (True, None)]
    kept = decontamination.decontaminate(spark.createDataFrame([(7, parts[0], 1), (7, parts[1], 2), (7, QUESTION, 3)], schema), bench)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2]


def test_mixed_up_values_are_told_apart(spark):
    texts = [QUESTION, QUESTION.replace("eats 3", "eats 8"), "an ordinary text", QUESTION.replace("5", "9")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, QUESTION)], ITEMS)
    got = decontamination.contaminated(docs, bench, F.col("doc_id"), F.col("item_id"), mixed=True).collect()
    assert {r["doc"]: r["consistent"] for r in got} == {0: True, 1: False, 3: True}
    assert all(r["coverage"] >= 0.8 for r in got)
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [2]


def test_many_texts_at_once_are_read_like_one(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Tom", "has", "3", "km", ".", "five", "Ann", "apples", "\n", "12", "é"]) for _ in range(rng.randrange(0, 40)))
             for _ in range(200)] + ["", None, "?", "3"]
    for sizes in ([5], [2, 5], None):
        together = decontamination._windows(texts, sizes, None)
        assert together == [decontamination._windows([t], sizes, None)[0] for t in texts]
    some = np.array(sorted({w["hash"] for ws in together for w in ws})[::7], np.int64).view(np.uint64)
    wanted = decontamination.Wanted(some)
    hits = decontamination._windows(texts, [5], wanted)
    known = set(some.view(np.int64).tolist())
    assert hits == [[w for w in ws if w["hash"] in known] for ws in decontamination._windows(texts, [5], None)]


def test_empty_benchmark_gives_no_pairs(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = decontamination.contaminated(docs, spark.createDataFrame([], ITEMS), F.col("doc_id"), F.col("item_id"), mixed=True)
    assert none.columns == ["doc", "item", "coverage", "n_slots", "consistent"] and none.count() == 0


def _private_texts(seed, n):
    rng = random.Random(seed)
    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        for last in range(10):
            if pii._luhn("".join(map(str, digits)) + str(last)):
                return "".join(map(str, digits)) + str(last)
    makes = [
        lambda: f"{rng.choice('abcdef')}{rng.randrange(999)}.x@mail{rng.randrange(9)}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        card,
        lambda: f"+{rng.randrange(1, 99)} {rng.randrange(100, 999)} {rng.randrange(100000, 9999999)}",
    ]
    words = "the of and a letter house goes under green water to them with some more".split()
    out = []
    for _ in range(n):
        kind = rng.randrange(5)
        said = [rng.choice(words) for _ in range(12)]
        if kind < 4:
            said.insert(rng.randrange(12), makes[kind]())
        else:
            said.insert(rng.randrange(12), rng.choice([str(rng.randrange(10 ** 15, 10 ** 16)), f"order {rng.randrange(10 ** 8)}",
                                                       f"{rng.randrange(2000)}:{rng.randrange(60)}:{rng.randrange(60)}"]))
        out.append(" ".join(said))
    return out


def test_masked_spans_are_found_again(spark):
    """Recall on held-out spans whose decisive mark was removed, and texts without any stay as they are."""
    docs = spark.createDataFrame(list(enumerate(_private_texts(1, 3000))), "doc_id long, text string")
    found = pii.scratch(docs.select(F.lit(0).alias("row"), "text"), "t")
    rows = [row for (t,) in found.select("text").collect() for row in pii.labelled(t)]
    forest = pii.fit(np.array([x for x, _ in rows], np.float64), np.array([y for _, y in rows], bool))
    hits, places = np.zeros(4), np.zeros(4)
    for text in _private_texts(2, 2000):
        for start, kind, end in pii.base_spans(text):
            written = pii.masked(text[start:end], kind, start)
            changed = text[:start] + written + text[end:]
            proposed = [(k, s, e) for k, s, e in pii.candidates(changed)]
            x = np.array([pii.features(changed, *c) for c in proposed], np.float64).reshape(-1, pii.FEATURES)
            spans = pii.all_spans(changed, pii.base_spans(changed), proposed, x, forest)
            places[kind] += 1
            hits[kind] += any(s < start + len(written) and start < e for s, _, e in spans)
    recall = hits / places
    assert (recall >= 0.9).all(), recall


@pytest.mark.parametrize("text", ["1.1.1." * 40_000, "1 " * 100_000, "a@b.c " * 30_000, "+1 234 567 8901 " * 12_000, "a at b dot c " * 15_000])
def test_spans_of_hostile_texts_take_linear_time(text):
    import time
    start = time.perf_counter()
    found = pii._found(text)
    pii._judge(found["base"], found["proposed"], pii.Forest(thresholds={0: -1.0, 1: -1.0, 2: -1.0, 3: -1.0}))
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("part", ["<!--", "<", "<script ", "<head>", "</script ", "<html ", "<meta ", "<meta content-language ", "<a", "-->", "lang=", "&", "<!-- --"])
def test_pages_are_read_in_linear_time(part):
    import time
    page = "<html>" + part * (1_000_000 // len(part))
    start = time.perf_counter()
    language.visible_text(page)
    language.declared_language(page)
    assert time.perf_counter() - start < 2


def test_what_a_page_shows():
    read = lambda page: language.visible_text(page).split()
    assert read("a<!-- b -->c<script>d</SCRIPT >e<b>f</b>&amp;") == ["a", "c", "e", "f", "&"]
    assert read("a<script>b") == ["a"] and read("a<!-- b") == ["a"] and read("a <nav> b <i>c</i>") == ["a", "b", "c"]
    assert read("1 < 2") == ["1", "<", "2"] and read("") == [] and read(None) == []
    assert language.declared_language('<HTML class="x" lang="DE-at">') == "de"
    assert language.declared_language('<html><meta name=a><meta http-equiv="content-language" content="fr">') == "fr"
    assert language.declared_language("<p lang=it>") is None


def test_pages_without_labelled_documents(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "https://a.example.de/x", "<html lang=de>guten Tag")], "page_id long, url string, html string")
    row = language.identify(pages, language.fit(docs)).first()
    assert (row["page_id"], row["suffix"], row["declared"], row["lang"], row["prob"]) == (1, "de", "de", None, None)


def test_languages_with_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_BYTES", 50)
    docs = spark.createDataFrame([(1, "short words", "en"), (2, "x" * 60, "en"), (3, "lange Worte " * 10, "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"]
    want = language.trigrams("lange Worte " * 10) + 0.5
    assert np.allclose(model.logs[:, 0], np.log(want / want.sum()))
    want = language.trigrams("short words") + 0.5
    assert np.allclose(model.logs[:, 1], np.log(want / want.sum()))
    many = spark.createDataFrame([(k, f"text number {k}", "en") for k in range(200)], "doc_id long, text string, lang string")
    assert language.fit(many, documents=10).logs.shape[1] == 1


def test_one_row_of_a_repeated_id_is_sampled(spark):
    docs = spark.range(100_000).select(F.lit(3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).unionByName(
        spark.createDataFrame([(4, "another text")], "doc_id int, text string"))
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], LABELS)
    passages, y = quality.fit_sample(docs, labels)
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).distinct().collect()}
    assert len(passages) == len(y) == sum(not h for h in held.values())
