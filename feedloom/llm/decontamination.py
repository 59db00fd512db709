"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: words in lower case, ``<num>`` for numbers (with a
currency or per cent sign), ``<unit>`` for a unit after a number, ``<name>`` for a capitalised
word.  Five-token windows of the documents are hash-joined with those of the benchmark, in three
forms: names kept as words; names inside a sentence replaced; all capitalised words replaced,
first words included, and number words as well.  A match counts when

* its template is equal token by token, not just by hash;
* its slots are not mixed up: where a document keeps most values of the item (at one offset, of
  one kind), none of the kept values stands for another one too or is replaced elsewhere.  New
  values may be equal for different ones of the item, and differ for equal ones.  Where the form
  with the most slots is mixed up, the forms with fewer count alone;
* the matching windows cover at least 0.8 of the item's tokens, in one place of about the
  item's length.  A place may unite several offsets, as words may be added or left out; windows
  of an item that repeats itself match at wrong offsets too, so every offset is judged alone.

So a question with other numbers, names or units is found, and a copy whose values are mixed up
is not.  An item shorter than a window is one window of its own length.

The benchmark is the query set: its window hashes go to the tasks in blocks of bounded size,
and only windows that hit one leave the scan of the documents.

Windows are brought together by row, not by the caller's id, so rows that share an id (or have
none) can't lend each other a part of an item.

Defined cases: a null text has no tokens; items without tokens are found nowhere; rows with one
id are each reported, rows equal in every column once, and repeated items once for their id;
empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from feedloom.llm.common import attach, scratch

WINDOW = 5
COVERAGE = 0.8
# Benchmark windows that are sent to the tasks at a time (8 bytes each).
BLOCK = 2_000_000
# Characters of text that are made into tokens at a time.
STRETCH = 1_000_000
# Units that may follow a number.
UNITS = frozenset("""
    mm cm m km in inch inches ft foot feet yd yard yards mi mile miles
    mg g gram grams kg t ton tons lb lbs pound pounds oz ounce ounces
    ml cl l liter liters litre litres gallon gallons
    ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    percent percentage degree degrees celsius fahrenheit kelvin
    eur euro euros usd dollar dollars cent cents gbp yen franc francs
    v volt volts w watt watts kw kwh hz khz mhz ghz kb mb gb tb j joule joules n newton newtons
""".split())
# Number words and their values; compound ones are several tokens.
COUNTS = {w: str(n) for n, w in enumerate("""
    zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
    eighteen nineteen twenty
""".split())} | {w: str(10 * n) for n, w in enumerate("thirty forty fifty sixty seventy eighty ninety".split(), 3)} | {
    "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000"}
# Letters by range; what lies between the ranges is punctuation and symbols.
_LETTERS = "[a-zA-ZÀ-ÖØ-öø-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufdff\U00010000-\U0010ffff]+"
_TOKEN = re.compile(rf"{_LETTERS}(?:['’]{_LETTERS})*|[.!?\n]|[$€£¥]?\d+(?:[.,]\d+)*[%°]?")
_WORD, _NUMBER, _UNIT, _CAPITAL, _STOP, _COUNT, _CAPITAL_COUNT = range(7)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACEHOLDERS = {_NUMBER: "<num>", _UNIT: "<unit>", _CAPITAL: "<name>"}

WINDOWS = pa.struct([
    ("pos", pa.int32()), ("n_tokens", pa.int32()), ("hash", pa.int64()), ("template", pa.string()),
    ("slots", pa.list_(pa.string())), ("form", pa.int32()),
])
_WINDOW_TYPE = "array<struct<pos:int,n_tokens:int,hash:bigint,template:string,slots:array<string>,form:int>>"


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 42)


_PLACEHOLDER_HASHES = {kind: np.uint64(_hash(token)) for kind, token in _PLACEHOLDERS.items()}


class _Vocabulary(dict):
    """Raw token -> number; hash and kind of each number in arrays.  Starts anew when it has grown large."""

    LIMIT = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.kinds = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int8)

    def __missing__(self, raw: str) -> int:
        number, low = len(self), raw.lower()
        if number == len(self.hashes):
            self.hashes, self.kinds = (np.concatenate((a, np.zeros_like(a))) for a in (self.hashes, self.kinds))
        if raw[-1].isdigit() or raw[0] in "$€£¥" or raw[-1] in "%°":
            found = _hash(_PLACEHOLDERS[_NUMBER]), _NUMBER
        elif raw in ".!?\n":
            found = 0, _STOP
        elif low in UNITS:
            found = _hash(low), _UNIT
        elif raw[0].isupper() and len(raw) > 1 and raw[1:] == low[1:]:
            found = _hash(low), _CAPITAL_COUNT if low in COUNTS else _CAPITAL
        elif low in COUNTS:
            found = _hash(low), _COUNT
        else:
            found = _hash(low), _WORD
        self.hashes[number], self.kinds[number] = found
        self[raw] = number
        return number


_KNOWN = _Vocabulary()


@dataclass
class Tokens:
    """Template tokens of a run of texts, one after the other.

    ``places`` are the raw tokens that are no stops, ``first`` where each text's places start (and
    the end of the last), ``forms`` kinds and hashes of the places in the three forms: names kept;
    names inside a sentence replaced; all capitalised words and number words replaced.  A form
    without a slot of its own is the first one.
    """

    raw: list[str]
    places: np.ndarray
    first: np.ndarray
    forms: list[tuple[np.ndarray, np.ndarray]]


def canonical(texts: list[str | None]) -> Tokens:
    if len(_KNOWN) > _Vocabulary.LIMIT:
        _KNOWN.clear()
    each = [_TOKEN.findall(t) if t else [] for t in texts]
    ends = np.cumsum([len(r) for r in each])
    raw = list(chain.from_iterable(each))
    numbers = np.fromiter(map(_KNOWN.__getitem__, raw), np.int64, len(raw))
    kinds, hashes = _KNOWN.kinds[numbers], _KNOWN.hashes[numbers]
    before = np.empty_like(kinds)
    before[1:] = kinds[:-1]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    before[starts[starts < len(raw)]] = _STOP
    places = np.flatnonzero(kinds != _STOP)
    first = np.searchsorted(places, np.concatenate((starts, [len(raw)])))
    kinds, hashes, before = kinds[places], hashes[places], before[places]
    capitals, counts = (kinds == _CAPITAL) | (kinds == _CAPITAL_COUNT), kinds >= _COUNT
    after_count = (kinds == _UNIT) & (before >= _COUNT)

    def typed(form: tuple[np.ndarray, np.ndarray], *slots: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of, by = form[0].copy(), form[1].copy()
        for kind, here in slots:
            of[here], by[here] = kind, _PLACEHOLDER_HASHES[kind]
        return of, by

    words = np.where(kinds == _NUMBER, _NUMBER, _WORD).astype(np.int8), hashes
    plain = typed(words, (_UNIT, (kinds == _UNIT) & (before == _NUMBER)))
    forms = [plain]
    for slots in ([(_CAPITAL, capitals & (before != _STOP))],
                  [(_CAPITAL, capitals & ~counts), (_NUMBER, counts), (_UNIT, after_count)]):
        forms.append(typed(plain, *slots) if any(here.any() for _, here in slots) else plain)
    return Tokens(raw, places, first, forms)


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` tokens; other sizes give other hashes."""
    count = len(hashes) - size + 1
    rolled = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        rolled *= _MIX
        rolled ^= hashes[k:k + count]
        rolled ^= rolled >> np.uint64(29)
    return rolled


class Wanted:
    """A set of hashes; most others are turned away by their first bits."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.near = np.zeros(1 << self.BITS, bool)
        self.near[self.hashes >> np.uint64(64 - self.BITS)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``hashes`` the set's are."""
        near = np.flatnonzero(self.near[hashes >> np.uint64(64 - self.BITS)])
        at = np.searchsorted(self.hashes, hashes[near])
        at[at == len(self.hashes)] = 0
        return near[self.hashes[at] == hashes[near]]


def _windows(texts: list[str | None], sizes: list[int] | None, wanted: Wanted | None, window: int = WINDOW) -> list[list[dict]]:
    """For every text its windows, or those whose hash is in ``wanted``.

    Without ``sizes`` a text's windows have the length ``window``, or its own if it is shorter.
    """
    found = canonical(texts)
    lengths = np.diff(found.first)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    out: list[list[dict]] = [[] for _ in texts]
    for size in sizes if sizes is not None else sorted({min(window, int(n)) for n in lengths if n}):
        if len(found.places) < size:
            continue
        inside = text_of[:len(text_of) - size + 1] == text_of[size - 1:]
        if sizes is None and size < window:
            inside &= lengths[text_of[:len(inside)]] == size
        done: list[np.ndarray] = []
        for form, (kinds, tokens) in enumerate(found.forms):
            if form and tokens is found.forms[0][1]:
                continue
            hashes = _rolled(tokens, size)
            here = np.flatnonzero(inside) if wanted is None else wanted.places(hashes)
            here = here[inside[here]]
            for other in done:
                here = here[hashes[here] != other[here]]
            done.append(hashes)
            for i in here.tolist():
                template, slots = [], []
                for k in range(i, i + size):
                    kind, token = int(kinds[k]), found.raw[found.places[k]].lower()
                    template.append(_PLACEHOLDERS.get(kind, token))
                    if kind != _WORD:
                        slots.append(f"{kind}:{COUNTS.get(token, token) if kind == _NUMBER else token}")
                text = int(text_of[i])
                out[text].append({
                    "pos": i - int(found.first[text]), "n_tokens": int(lengths[text]), "hash": int(hashes[i].astype(np.int64)),
                    "template": " ".join(template), "slots": slots, "form": form})
    return out


def item_windows(items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item`` (all columns), ``pos, n_tokens, hash, template, slots, form``: all windows of every item."""

    @F.arrow_udf(_WINDOW_TYPE)
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array(_windows(texts.to_pylist(), None, None, window), pa.list_(WINDOWS))

    return items.select(F.struct("*").alias("item"), F.explode(cut(F.col(text).cast("string"))).alias("w")).select(
        "item", "w.*")


def _stretches(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in runs of about ``STRETCH`` characters."""
    run, size = [], 0
    for t in texts:
        run.append(t.as_py())
        size += len(run[-1] or "")
        if size >= STRETCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def row_identity(every: list[Column]) -> list[Column]:
    """Two hashes of a whole row: ``d1, d2``."""
    return [F.xxhash64(F.lit(5), *every).alias("d1"), F.xxhash64(F.lit(6), *every).alias("d2")]


def _matching(docs: DataFrame, text: Column, hashes: np.ndarray, sizes: list[int]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hashes.view(np.uint64))

    @F.arrow_udf(_WINDOW_TYPE)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = Wanted(sent.value)
        for texts in batches:
            rows = [found for run in _stretches(texts) for found in _windows(run, sizes, wanted)]
            yield pa.array(rows, pa.list_(WINDOWS))

    return docs.withColumn("w", F.explode(hits(text))).select("d1", "d2", "doc", "w.*")


_ALIGNMENT = ["d1", "d2", "item_key", "start"]


def _levels(pairs: DataFrame) -> DataFrame:
    """For every alignment with slots the form with the most slots that is not mixed up (-1: none is).

    Values of a kind are mixed up, if they are mostly kept and another one stands for a kept one or
    in its place.  New values may fall together or apart by chance; that alone is no contradiction.
    """
    value = F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("v")
    values = (
        pairs.select(*_ALIGNMENT, "form", value).select(*_ALIGNMENT, "form", "v.a", "v.b").repartition(*_ALIGNMENT)
        .groupBy(*_ALIGNMENT, "a", "b").agg(F.min("form").alias("f"))
    )
    # One row a value: the first form in which it is kept, and in which it takes part in a change.
    same, none = F.col("a") == F.col("b"), F.lit(None).cast("int")
    side = lambda v, kept, changed, first: F.struct(
        v.alias("value"), kept.alias("kept"), changed.alias("changed"), F.lit(first).alias("first"))
    sides = F.when(same, F.array(side(F.col("a"), F.col("f"), none, 1))).otherwise(
        F.array(side(F.col("a"), none, F.col("f"), 1), side(F.col("b"), none, F.col("f"), 0)))
    forms = range(3)
    upto = lambda c, form: F.sum(F.when((F.col("s.first") == 1) & (F.col(f"s.{c}") <= form), 1).otherwise(0))
    touched = (
        values.select(*_ALIGNMENT, F.substring("a", 1, 2).alias("kind"), F.explode(sides).alias("s"))
        .groupBy(*_ALIGNMENT, "kind", "s.value").agg(
            F.greatest(F.min("s.kept") + 0 * F.min("s.changed"), F.min("s.changed") + 0 * F.min("s.kept")).alias("clash"),
            *[upto(c, k).alias(f"{c}_{k}") for c in ("kept", "changed") for k in forms])
    )
    kinds = touched.groupBy(*_ALIGNMENT, "kind").agg(
        F.min("clash").alias("clash"), *[F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in ("kept", "changed") for k in forms])
    mixed = [F.max(F.coalesce((F.col(f"kept_{k}") > F.col(f"changed_{k}")) & (F.col("clash") <= k), F.lit(False))).alias(f"mixed_{k}")
             for k in forms]
    return kinds.groupBy(*_ALIGNMENT).agg(*mixed).select(
        *_ALIGNMENT, F.when(~F.col("mixed_2"), 2).when(~F.col("mixed_1"), 1).when(~F.col("mixed_0"), 0).otherwise(-1).alias("level"))


def contaminated(docs: DataFrame, items: DataFrame, doc: Column, item: Column, text: str = "text",
                 item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, mixed: bool = False) -> DataFrame:
    """Pairs ``doc, item, coverage, n_slots`` (``doc`` and ``item`` as the columns given).

    ``coverage`` is the share of the item's tokens that the best place of the document covers.
    With ``mixed``, pairs whose windows cover an item but whose values are mixed up are there as
    well, and a column ``consistent`` tells them apart.
    """
    cut = item_windows(items.select(item.alias("item_id"), F.col(item_text).cast("string").alias("item_text")),
                       "item_text", window)
    bench = scratch(cut.select(
        F.xxhash64("item").alias("item_key"), F.col("item.item_id").alias("item"), "pos", "n_tokens", "hash", "template",
        "slots", "form"), "windows")
    distinct = bench.select("hash").distinct()
    sizes = sorted(r["size"] for r in bench.select(F.least("n_tokens", F.lit(window)).alias("size")).distinct().collect())
    blocks = max(1, -(-distinct.count() // BLOCK))
    every = [F.col(f"`{c}`") for c in docs.columns]
    texts = docs.select(*row_identity(every), doc.alias("doc"), F.col(text).cast("string").alias("t"))
    found = None
    for block in range(blocks):
        part = distinct.filter(F.pmod("hash", F.lit(blocks)) == block).toArrow()["hash"].to_numpy()
        if not len(part):
            continue
        hits = _matching(texts, F.col("t"), part, sizes)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        schema = StructType([texts.schema["doc"], bench.schema["item"], StructField("coverage", DoubleType()),
                             StructField("n_slots", LongType()), *([StructField("consistent", BooleanType())] if mixed else [])])
        return docs.sparkSession.createDataFrame([], schema)
    mine = bench.select("hash", "template", "item_key", "item", F.col("n_tokens").alias("length"),
                        F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("form").alias("item_form"))
    # Windows at one offset are one alignment; it is judged alone, and a wrong offset has no say about the right one.
    pairs = scratch(attach(scratch(found, "hits"), mine, ["hash", "template"]).select(
        "d1", "d2", "doc", "item_key", "item", "length", (F.col("pos") - F.col("item_pos")).alias("start"),
        F.greatest("form", "item_form").alias("form"), "item_pos", "item_slots", "slots"), "pairs")
    levels = scratch(_levels(pairs), "levels")
    kept = (F.size("item_slots") == 0) | (F.col("form") <= F.coalesce("level", F.lit(2)))
    # A place is a stretch of the item's length; two sets of stretches, so that one holds a copy whole.
    half = F.col("length").cast("double") / 2
    places = F.array(*[F.struct(F.lit(k).alias("set"), F.floor((F.col("start") + half * k) / F.col("length")).alias("at"))
                       for k in (0, 1)])
    whose = ["d1", "d2", "doc", "item_key", "item"]
    placed = pairs.join(levels, _ALIGNMENT, "left").select(
        *whose, "length", "item_pos", "item_slots", kept.alias("kept"), F.explode(places).alias("place"))
    if not mixed:
        placed = placed.filter("kept")
    spots = placed.groupBy(*whose, "length", "place").agg(
        F.collect_set("item_pos").alias("all_at"), F.collect_set(F.when(F.col("kept"), F.col("item_pos"))).alias("at"),
        F.size(F.array_distinct(F.flatten(F.collect_set("item_slots")))).alias("n_slots"))

    def share(starts: str) -> Column:
        tokens = F.transform(starts, lambda p: F.sequence(p, p + F.least(F.col("length"), F.lit(window)) - 1))
        return F.size(F.array_distinct(F.flatten(tokens))) / F.col("length")

    judged = spots.withColumn("share", share("at")).withColumn("all_share", share("all_at")).filter(F.col("all_share") >= coverage)
    consistent = F.col("share") >= coverage
    out = judged.groupBy(*whose).agg(
        F.max("share").alias("share"), F.max("all_share").alias("all_share"),
        F.max(F.when(consistent, F.col("n_slots"))).alias("n"), F.max("n_slots").alias("all_n"))
    return out.select(
        "doc", "item", F.when(consistent, F.col("share")).otherwise(F.col("all_share")).alias("coverage"),
        F.when(consistent, F.col("n")).otherwise(F.col("all_n")).cast("long").alias("n_slots"),
        *([consistent.alias("consistent")] if mixed else []))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                  **options) -> DataFrame:
    """``docs`` without the rows that contain an item, with consistent values or mixed up."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    identity = F.struct(*row_identity(every))
    bad = scratch(contaminated(docs, items, identity, F.lit(0), text, item_text, mixed=True, **options)
                  .select("doc.*").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), identity.alias("doc")).select("row", "doc.*")
    return attach(rows, bad, ["d1", "d2"], "left_anti").select("row.*")
