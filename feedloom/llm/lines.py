"""Line dedup with sharded cuckoo filters over exact reference counts.

The reference-count table holds, for every distinct line key, the number of documents it stands
in; it is exact and additive, so documents can be inserted and deleted.  Keys that reach
``min_docs`` are in a cuckoo filter, sharded by the key; keys that fall below it are deleted
from the filter again, so the state after a deletion is the state without that document.

A scan of the documents asks the filter only.  The filter has no false negatives, and its
false positives are found beforehand by asking it for every key of the count table that is not
due, so the result is exact.  Where filter or false positives are too large to send to every
task, lines travel to the shard of their key and ask there; a shard with very many lines is asked
in several tasks, as many as the counts say.

Defined cases: a null or empty text is one empty line; an empty key is never dropped; rows are
documents (repeated rows count each); ``\\r`` belongs to the white space around a line; a text
all of whose lines are dropped becomes empty; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.cluster import fits_broadcast
from feedloom.llm.common import attach, scratch

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 50_000
FILTER_BYTES = 64 << 20
# Lines that ask one shard in one task, where shards don't go to all tasks.
SHARD_LINES = 500_000
SLOTS = 4
KICKS = 500
FILTER_SCHEMA = "shard int, n_shards int, buckets long, full boolean, cells binary"


def line_keys(data: bytes | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of UTF-8 bytes and the digest of each line's key (None: never dropped)."""
    lines = (data or b"").split(b"\n")
    digests: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()  # bytes know the ASCII white space and A-Z only
        long_enough = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
        digests.append(hashlib.blake2b(key, digest_size=16).digest() if key and long_enough else None)
    return lines, digests


def reference_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, n``: in how many documents each line key stands."""

    @F.arrow_udf("array<binary>")
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({k for k in line_keys(t.as_py(), min_chars)[1] if k}) for t in texts], pa.list_(pa.binary()))

    found = docs.select(F.explode(keys(F.encode(F.col(text).cast("string"), "UTF-8"))).alias("key"))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def inserted(counts: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """The counts with more documents."""
    more = reference_counts(docs, **options)
    return counts.unionByName(more).groupBy("key").agg(F.sum("n").alias("n"))


def deleted(counts: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """The counts without documents that are in them."""
    less = reference_counts(docs, **options).withColumn("n", -F.col("n"))
    return counts.unionByName(less).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


# -- the filter ---------------------------------------------------------------------------

def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard number, fingerprint (never 0) and first bucket number of 16-byte keys."""
    words = keys.view("<u4").reshape(-1, 4)
    return words[:, 0], np.maximum(words[:, 1], 1), words[:, 2]


def _other(bucket: np.ndarray, mark: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The second bucket of a fingerprint; its second bucket is the first one."""
    mixed = (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (bucket.astype(np.uint64) ^ mixed) & (buckets.astype(np.uint64) - np.uint64(1))


class Cuckoo:
    """One shard: ``buckets`` (a power of two) of four 32-bit fingerprints."""

    def __init__(self, buckets: int, cells: bytes | None = None, full: bool = False):
        self.buckets, self.full = buckets, full
        self.cells = np.zeros((buckets, SLOTS), np.uint32) if cells is None else (
            np.frombuffer(cells, "<u4").reshape(buckets, SLOTS).copy())

    @classmethod
    def for_keys(cls, n: int) -> Cuckoo:
        return cls(1 << max(2, int(np.ceil(np.log2(max(n, 1) / SLOTS / 0.6)))))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        _, mark, bucket = _parts(np.frombuffer(key, np.uint8))
        first = bucket & np.uint32(self.buckets - 1)
        return int(mark[0]), int(first[0]), int(_other(first, mark, np.array([self.buckets]))[0])

    def insert(self, key: bytes) -> None:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
        bucket, size = second, np.array([self.buckets])
        for kick in range(KICKS):
            slot = (kick + mark) % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = int(_other(np.array([bucket]), np.array([mark], np.uint32), size)[0])
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return
        self.full = True  # the last fingerprint has no place: build the shard anew

    def delete(self, key: bytes) -> None:
        """``key`` has to be in the filter."""
        mark, first, second = self._places(key)
        for bucket in (first, second):
            here = np.flatnonzero(self.cells[bucket] == mark)
            if len(here):
                self.cells[bucket, here[0]] = 0
                return

    def row(self, shard: int, n_shards: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "n_shards": [n_shards], "buckets": [self.buckets],
                             "full": [self.full], "cells": [self.cells.astype("<u4").tobytes()]})


def _shard(n_shards: int) -> Column:
    """The first four bytes of the key, little end first, as ``_parts`` reads them."""
    hexed = F.hex("key")
    turned = F.concat(*[F.substring(hexed, k, 2) for k in (7, 5, 3, 1)])
    return (F.conv(turned, 16, 10).cast("long") % n_shards).cast("int")


def build_filters(due: DataFrame, n_shards: int) -> DataFrame:
    """The shards of a filter with every ``key`` of ``due``."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        room = Cuckoo.for_keys(len(group))
        while True:
            for key in group["key"]:
                room.insert(key)
            if not room.full:
                return room.row(int(group["shard"].iloc[0]), n_shards)
            room = Cuckoo(room.buckets * 2)

    return due.select("key", _shard(n_shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def updated_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after the counts changed: keys that became due go in, others out.

    Only shards with changes are touched.  A shard that overflows is built anew from ``after``.
    """
    first = filters.select("n_shards").first()
    n_shards = first["n_shards"] if first else 1
    was, now = (c.filter(F.col("n") >= min_docs).select("key") for c in (before, after))
    changes = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(
        was.join(now, "key", "left_anti").withColumn("add", F.lit(False))).withColumn("shard", _shard(n_shards))

    def change(stored: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        if len(stored):
            at = stored.iloc[0]
            room, shard = Cuckoo(int(at["buckets"]), at["cells"], bool(at["full"])), int(at["shard"])
        else:
            room, shard = Cuckoo.for_keys(len(moved)), int(moved["shard"].iloc[0])
        for key in moved.loc[~moved["add"].astype(bool), "key"]:
            room.delete(key)
        for key in moved.loc[moved["add"].astype(bool), "key"]:
            room.insert(key)
        return room.row(shard, n_shards)

    out = scratch(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, FILTER_SCHEMA), "filters")
    again = out.filter("full").select("shard")
    rebuilt = build_filters(now.withColumn("shard", _shard(n_shards)).join(again, "shard", "left_semi").select("key"), n_shards)
    return out.filter(~F.col("full")).unionByName(rebuilt)


def membership(rows: list[dict]) -> Callable[[np.ndarray], np.ndarray]:
    """A test of 16-byte keys (n x 16 bytes) against all shards at once."""
    if not rows:
        return lambda keys: np.zeros(len(keys), bool)
    n_shards = rows[0]["n_shards"]
    buckets, offset, at, cells = np.ones(n_shards, np.int64), np.zeros(n_shards, np.int64), 1, [np.zeros((1, SLOTS), "<u4")]
    for row in rows:
        buckets[row["shard"]], offset[row["shard"]] = row["buckets"], at
        cells.append(np.frombuffer(row["cells"], "<u4").reshape(-1, SLOTS))
        at += row["buckets"]
    table = np.concatenate(cells)

    def test(keys: np.ndarray) -> np.ndarray:
        shard, mark, bucket = _parts(np.ascontiguousarray(keys))
        shard = shard % np.uint32(n_shards)
        size = buckets[shard]
        first = bucket.astype(np.int64) & (size - 1)
        second = _other(first, mark, size).astype(np.int64)
        base = offset[shard]
        return ((table[base + first] == mark[:, None]) | (table[base + second] == mark[:, None])).any(axis=1)

    return test


# -- the scan -----------------------------------------------------------------------------

_RESULT = "struct<n_lines:bigint,n_dropped:bigint,kept_text:binary>"


def _split(data: bytes | None, drop: Callable[[list[bytes | None]], list[bool]], min_chars: int) -> dict:
    lines, digests = line_keys(data, min_chars)
    out = drop(digests)
    kept = [line for line, gone in zip(lines, out, strict=True) if not gone]
    return {"n_lines": len(lines), "n_dropped": len(lines) - len(kept), "kept_text": b"\n".join(kept)}


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
               counts: DataFrame | None = None, filters: DataFrame | None = None,
               filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs`` with ``n_lines, n_dropped, kept_text`` (UTF-8 bytes); such columns are replaced.

    ``counts`` and ``filters`` are the stored state; without them both come from ``docs``.
    """
    counts = scratch(reference_counts(docs, text, min_chars), "counts") if counts is None else counts
    due = counts.filter(F.col("n") >= min_docs).select("key")
    if filters is None:
        filters = scratch(build_filters(due, max(1, -(-due.count() // SHARD_KEYS))), "filters")
    size = filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0)).alias("s")).first()["s"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    data = F.encode(F.col(text).cast("string"), "UTF-8")
    if size > filter_bytes:
        return _dropped_by_shard(docs, counts, filters, data, min_docs, min_chars)
    test = docs.sparkSession.sparkContext.broadcast(filters.toArrow().to_pylist())

    @F.arrow_udf("boolean")
    def positive(keys: pa.Array) -> pa.Array:
        return pa.array(membership(test.value)(np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 16)))

    wrong = scratch(counts.filter(F.col("n") < min_docs).select("key").filter(positive("key")), "positives")
    if not fits_broadcast(wrong):
        return _dropped_by_shard(docs, counts, filters, data, min_docs, min_chars)
    spared = frozenset(wrong.toArrow()["key"].to_pylist())

    @F.arrow_udf(_RESULT)
    def cut(batch: pa.Array) -> pa.Array:
        ask = membership(test.value)

        def drop(digests: list[bytes | None]) -> list[bool]:
            known = [k for k in digests if k]
            if not known:
                return [False] * len(digests)
            hits = iter(ask(np.frombuffer(b"".join(known), np.uint8).reshape(-1, 16)).tolist())
            return [k is not None and next(hits) and k not in spared for k in digests]

        return pa.array([_split(v.as_py(), drop, min_chars) for v in batch], _arrow_result())

    return docs.select(*kept, cut(data).alias("_r")).select(*kept, "_r.*")


def _arrow_result() -> pa.DataType:
    return pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.binary())])


def _asked_by_shard(keys: DataFrame, filters: DataFrame, asks: DataFrame, n_shards: int) -> DataFrame:
    """Rows ``d1, d2, key`` of ``keys`` that the shard of their key holds.

    ``asks`` says for each shard in how many parts its keys are asked.  A part is one run of rows in
    a task: first the shard, then its keys, however many.
    """
    placed = keys.withColumn("shard", _shard(n_shards))
    placed = attach(placed, asks, "shard").withColumn("part", F.pmod(F.xxhash64("d1", "d2", "key"), F.col("parts")).cast("int")).select(
        "shard", "part", F.lit(1).alias("line"), "d1", "d2", "key", F.lit(None).cast("binary").alias("cells"))
    sent = attach(filters, asks, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"), F.lit(0).alias("line"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("d1", "long"), ("d2", "long"), ("key", "binary"))], "cells")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = None, None
        for batch in batches:
            shards, lines = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            starts = np.flatnonzero((lines == 0) | (np.diff(shards, prepend=shards[:1]) != 0))
            edges = sorted({0, *starts.tolist(), batch.num_rows})
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if lines[at] == 0:
                    shard = shards[at]
                    table = np.frombuffer(batch.column(6)[at].as_py(), "<u4").reshape(-1, SLOTS)
                    at += 1
                if at == end or shards[at] != shard:
                    continue  # nothing to ask, or no key of this shard is due
                some = batch.slice(at, end - at)
                asked = np.frombuffer(b"".join(some.column(5).to_pylist()), np.uint8).reshape(-1, 16)
                yield some.select([3, 4, 5]).filter(pa.array(_holds(table, asked)))

    both = placed.unionByName(sent).repartition("shard", "part").sortWithinPartitions("shard", "part", "line")
    return both.mapInArrow(ask, "d1 long, d2 long, key binary")


def _holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys one shard may hold."""
    _, mark, bucket = _parts(np.ascontiguousarray(keys))
    first = bucket.astype(np.int64) & (len(table) - 1)
    second = _other(first, mark, np.full(len(mark), len(table))).astype(np.int64)
    return ((table[first] == mark[:, None]) | (table[second] == mark[:, None])).any(axis=1)


def _dropped_by_shard(docs: DataFrame, counts: DataFrame, filters: DataFrame, data: Column, min_docs: int, min_chars: int) -> DataFrame:
    """The same result with lines that travel to the shard of their key."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    identity = [F.xxhash64(F.lit(3), *every).alias("d1"), F.xxhash64(F.lit(4), *every).alias("d2")]

    @F.arrow_udf("array<binary>")
    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({k for k in line_keys(t.as_py(), min_chars)[1] if k}) for t in texts], pa.list_(pa.binary()))

    @F.arrow_udf(_RESULT)
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, gone, strict=True):
            due_here = frozenset(g.as_py() or ())
            out.append(_split(t.as_py(), lambda ds, due=due_here: [d in due for d in ds], min_chars))
        return pa.array(out, _arrow_result())

    first = filters.select("n_shards").first()
    n_shards = first["n_shards"] if first else 1
    asks = scratch(counts.groupBy(_shard(n_shards).alias("shard")).agg(
        F.ceil(F.sum("n") / SHARD_LINES).alias("parts"), F.ceil(F.count(F.lit(1)) / SHARD_LINES).alias("key_parts")), "asks")
    rare = counts.filter(F.col("n") < min_docs).select(F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "key")
    wrong = scratch(_asked_by_shard(rare, filters, asks.select("shard", F.col("key_parts").alias("parts")), n_shards).select("key"), "positives")
    lines = docs.select(*identity, F.explode(keys(data)).alias("key"))
    found = attach(_asked_by_shard(lines, filters, asks.select("shard", "parts"), n_shards), wrong, "key", "left_anti")
    gone = found.groupBy("d1", "d2").agg(F.collect_set("key").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), data.alias("data"), *identity).join(gone, ["d1", "d2"], "left")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    return rows.select("row", cut("data", "gone").alias("_r")).select(*[F.col(f"row.`{c}`") for c in names], "_r.*")
