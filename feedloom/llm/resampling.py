"""Importance resampling towards a target: hashed features, log-ratio weights, a Gumbel top-k.

A document's features are its runs of 1 to ``max_run`` consecutive words; each falls into the
bucket given by its CRC-32.  The weight of a document is the sum of its buckets' gains, the log
ratio of the bucket's share in the target texts to its share in the documents (add-one
smoothed, in thousandths, floored).  A draw without replacement in proportion to the weights'
exponentials is the top of ``weight + Gumbel noise``; the noise comes from a hash of the id.

The checksums are not taken feature by feature.  The distinct features of a stretch of texts
are grouped by length; a group is a two-dimensional uint8 matrix, one row a feature, and all
checksums of it advance together, one column at a time.  Results are scattered back to the
features.  Rows beyond ``WIDE`` bytes are cut into blocks of that width, which are rows of one
matrix again; a checksum is linear, so the block checksums are folded with the table that
moves a state past ``WIDE`` bytes.

One scan reads the texts and stores bucket numbers; counts, weights and draw work from there.
Only the gains (one number per bucket) pass through the driver.

Defined cases: a null or empty text has no features and weight 0.  A null id counts as an empty
one in the noise and comes last among ties.  Equal scores go by id, then by the other columns;
rows equal in all of them are interchangeable.  An empty target or table is smoothed like any
other.  Kept columns named like a result are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import numbered, scratch

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
SHARE = (10, 100)
SEED = "2024"
# Widest matrix; longer features are folded from blocks of this width.
WIDE = 512
# Bytes of text that are split into words at a time, and bounds of the remembered features.
STRETCH = 4_000_000
KNOWN, KNOWN_BYTES = 300_000, 32_000_000
RESULTS = ("n_words", "n_features", "weight", "score", "rank")

# Letters and digits in lower case and all bytes beyond ASCII stay, everything else separates.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


# -- checksums ----------------------------------------------------------------------------

def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _columns(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """States after the bytes of their rows, column by column."""
    for column in np.ascontiguousarray(matrix.T):
        state = _TABLE[(state ^ column) & 0xFF] ^ (state >> 8)
    return state


def _skip_tables(width: int) -> np.ndarray:
    """For each byte of a state, what it becomes ``width`` zero bytes later."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    for _ in range(width):
        states = _TABLE[states & 0xFF] ^ (states >> 8)
    return states.reshape(4, 256)


_SKIP = _skip_tables(WIDE)


def checksums(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    out = np.zeros(len(features), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        width = int(lengths[rows[0]])
        matrix = np.frombuffer(b"".join([features[k] for k in rows.tolist()]), np.uint8).reshape(len(rows), width)
        head = width % WIDE if width > WIDE else width
        state = _columns(np.full(len(rows), 0xFFFFFFFF, np.uint32), matrix[:, :head])
        if width > head:
            blocks = (width - head) // WIDE
            alone = _columns(np.zeros(len(rows) * blocks, np.uint32), matrix[:, head:].reshape(-1, WIDE))
            for block in alone.reshape(len(rows), blocks).T:
                moved = block
                for byte in range(4):
                    moved = moved ^ _SKIP[byte][(state >> np.uint32(8 * byte)) & 0xFF]
                state = moved
        out[rows] = state ^ np.uint32(0xFFFFFFFF)
    return out


# -- features -----------------------------------------------------------------------------

def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        yield text[at:end].split()
        at = end


def _runs(words: list[bytes], tail: list[bytes], max_run: int) -> list[bytes]:
    """Runs that end in ``words``; ``tail`` holds the words just before them."""
    out = list(words)
    line = tail + words
    for n in range(2, max_run + 1):
        first = max(0, len(tail) - n + 1)
        out += map(b" ".join, zip(*(islice(line, first + k, None) for k in range(n)), strict=False))
    return out


class _Known(dict):
    """Feature -> bucket for the features met so far; starts anew beyond its bounds."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.bytes = buckets, 0

    def learn(self, features: set[bytes]) -> None:
        """Take in the features that aren't known yet; their checksums are taken together."""
        if len(self) > KNOWN or self.bytes > KNOWN_BYTES:
            self.clear()
            self.bytes = 0
        new = [f for f in features if f not in self]
        self.update(zip(new, (checksums(new) % np.uint32(self.buckets)).tolist(), strict=True))
        self.bytes += sum(map(len, new))

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.uint32, len(features))


def _together(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``STRETCH`` bytes; a longer one comes alone."""
    run, size = [], 0
    for text in texts:
        text = text or b""
        if len(text) >= STRETCH:
            if run:
                yield run
            yield [text]
            run, size = [], 0
            continue
        run.append(text)
        size += len(text)
        if size >= STRETCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def _scan(texts: Iterable[bytes | None], known: _Known, max_run: int) -> Iterator[tuple[int, int, bytes]]:
    """For every text the number of words and of features, and the buckets as bytes."""
    for run in _together(texts):
        if len(run) == 1:
            yield _long(run[0], known, max_run)
            continue
        words = [text.translate(_FOLD).split() for text in run]
        features = [_runs(w, [], max_run) for w in words]
        known.learn(set().union(*features))
        for w, f in zip(words, features, strict=True):
            yield len(w), len(f), known.of(f).tobytes()


def _long(text: bytes, known: _Known, max_run: int) -> tuple[int, int, bytes]:
    """The same for one text, a stretch at a time."""
    n_words, parts, tail = 0, [], []
    for words in _stretches(text.translate(_FOLD)):
        features = _runs(words, tail, max_run)
        known.learn(set(features))
        parts.append(known.of(features))
        n_words += len(words)
        tail = (tail + words)[-(max_run - 1):] if max_run > 1 else []
    found = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return n_words, len(found), found.tobytes()


_SCANNED = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])


def featurize(docs: DataFrame, text: str, buckets: int, max_run: int, keep: list[str]) -> DataFrame:
    """``row`` (the kept columns), ``n_words, n_features, buckets``, stored.

    ``buckets`` is a binary of little-endian 32-bit numbers, one for each feature.
    """
    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,buckets:binary>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(buckets)
        for texts in batches:
            data = (t.as_buffer().to_pybytes() if t.is_valid else None for t in texts)
            columns = list(zip(*_scan(data, known, max_run), strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCANNED, strict=True)], fields=list(_SCANNED))

    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    scanned = docs.select(row.alias("row"), scan(F.col(text).cast("string")).alias("f"))
    return scratch(scanned.select("row", F.monotonically_increasing_id().alias("at"), "f.*"), "features")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; every task adds up its own part before anything is shuffled."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint32), minlength=buckets)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["bucket", "n"])

    parts = features.filter("n_features > 0").select("buckets").mapInArrow(add, "bucket bigint, n bigint")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the shares of every bucket in thousandths, rounded down."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target)))
                     for s, t in zip(map(float, source), map(float, target), strict=True)], np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# -- weights and draw ---------------------------------------------------------------------

def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
          doc_id: str = "doc_id", buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: str = SEED,
          keep: list[str] | None = None) -> DataFrame:
    """``row`` (columns ``keep``, default all), ``at, id, n_words, n_features, weight, score``."""
    names = docs.columns if keep is None else keep
    wanted = names if doc_id in names else [*names, doc_id]
    found = featurize(docs, text, buckets, max_run, wanted)
    gain = gains(bucket_counts(found, buckets), bucket_counts(featurize(target, target_text, buckets, max_run, []), buckets))

    @F.arrow_udf("bigint")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in batches:
            yield pa.array([int(gain[np.frombuffer(b.as_buffer(), np.uint32)].sum()) for b in held], pa.int64())

    weighed = found.withColumn("id", F.col(f"row.`{doc_id}`")).withColumn("weight", weight("buckets")).drop("buckets")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def draw(weighed: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """``weighed`` with ``rank`` (from 1) for the drawn rows, null for all others.

    Ranks are positions in a range-partitioned sort, so no task sees more than one range.
    """
    weighed = scratch(weighed, "weighed")
    due = F.col("n_words") >= min_words
    n = weighed.filter(due).count()
    take = share[0] * n // share[1]
    ties = [F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("at")]
    placed = numbered(weighed.filter(due), [F.desc("score"), *ties], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < take, F.col("place") + 1)).drop("place")
    return ranked.unionByName(weighed.filter(~due).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS,
              **options) -> DataFrame:
    """The drawn rows of ``docs``, with their columns as they are."""
    drawn = draw(weigh(docs, target, **options), share, min_words).filter("rank IS NOT NULL")
    return drawn.select("row.*")


def scored(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS,
           keep: list[str] | None = None, **options) -> DataFrame:
    """Columns ``keep`` (default all) of every row with ``n_words, n_features, weight, score, rank``."""
    rows = draw(weigh(docs, target, keep=keep, **options), share, min_words)
    kept = [F.col(f"row.`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    return rows.select(*kept, *RESULTS)
