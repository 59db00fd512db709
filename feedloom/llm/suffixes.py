"""Suffix-array dedup: bytes covered by long repeated strings, by deep-shallow suffix sorting.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else, in the same
document or another.  Not every suffix has to be sorted.  Every window of ``length`` bytes has
an anchor, chosen by its content alone (the smallest hashed gram among its first ``reach``
starts, of equal ones the last), so two equal windows have equal anchors at the same offset,
and the suffixes at their anchors share at least ``length - reach`` bytes.  Anchors whose
suffix begins like no other's are done.  For the others:

* anchors with equal surroundings (everything their windows can reach) repeat as a whole;
* the distinct surroundings of a bucket, suffixes with a long common prefix, are sorted:
  multikey quicksort to a shallow depth, a blind trie for what is still equal there.  The
  suffixes to the right and the reversed strings to the left give, with the longest common
  prefixes of both orders, how far each surrounding agrees with another;
* a bucket of more than ``BUCKET`` distinct surroundings is first divided: a window reaches
  either its first or its second half of offsets, and all windows of a half share more bytes.

Every decision compares bytes or two independent 64-bit hashes.  Keys of more than ``HOT`` rows (one
passage in a third of all documents) are met by broadcasting the counted keys, so that their rows
stay in the tasks that hold their documents.

Defined cases: a null text is empty; a text shorter than ``length`` loses nothing; equal rows
lose everything if long enough; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.cluster import fits_broadcast
from feedloom.llm.common import attach, scratch

LENGTH = 400
BUCKET = 128
SHALLOW = 24
# Keys of more rows are joined without dealing their rows by key alone.
HOT = 2_000
SALTS = 64
_GRAM = 8
_PIECE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def reach_of(length: int) -> tuple[int, int]:
    """How many starts choose an anchor, and the bytes of a gram."""
    gram = min(_GRAM, max(1, length // 2))
    return max(1, length // 2 - gram), gram


# -- anchors ------------------------------------------------------------------------------

def anchors(data: bytes, length: int = LENGTH) -> np.ndarray:
    """The anchor positions of all windows of ``data``, ascending."""
    reach, gram = reach_of(length)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = []
    padded = data + bytes(_GRAM)
    for at in range(0, n, _PIECE):
        count = min(_PIECE, n - at) + reach - 1
        grams = np.ndarray((count,), "<u8", padded, at, (1,))
        if gram < _GRAM:
            grams = grams & np.uint64((1 << 8 * gram) - 1)
        mixed = (grams ^ (grams >> np.uint64(31))) * _MULTIPLIER
        least = (mixed & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(count, dtype=np.uint64))
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[:len(least) - (reach - span)], least[reach - span:])
        place = np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))
        found.append(np.unique(place).astype(np.int64) + at)
    return np.unique(np.concatenate(found))


def _hashed(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Anchors with the hash of the shared prefix, the hash of the surroundings, and their bounds."""
    reach, _ = reach_of(length)
    at = anchors(data, length)
    lo, hi = np.maximum(at - (reach - 1), 0), np.minimum(at + length, len(data))
    prefix, whole, size = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest, length - reach + 1
    h = np.array([prefix(data[a:a + size], 1) for a in at.tolist()], np.uint64).view(np.int64)
    c = np.array([whole(data[a:b], a0) for a, b, a0 in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)],
                 np.uint64).view(np.int64)
    return h, c, at, at - lo, hi - at


_ANCHOR = "array<struct<h:bigint,c:bigint,pos:bigint,left:int,right:int>>"


def _anchor_rows(docs: DataFrame, data: Column, length: int) -> DataFrame:
    names = ["h", "c", "pos", "left", "right"]

    @F.arrow_udf(_ANCHOR)
    def rows(texts: pa.Array) -> pa.Array:
        parts = [_hashed(t.as_py() or b"", length) for t in texts]
        offsets = np.cumsum([0, *[len(p[0]) for p in parts]]).astype(np.int32)
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        flat = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)
        return pa.ListArray.from_arrays(pa.array(offsets), flat)

    return docs.select("d1", "d2", F.explode(rows(data)).alias("a")).select("d1", "d2", "a.*")


# -- deep-shallow sorting -----------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _BlindTrie:
    """A trie of branching points only: ``(depth, {byte: child})``; a leaf is a list of strings' numbers.

    A string is inserted by following its bytes blindly to some leaf, comparing with that
    leaf's string once, and going down again to the depth where they differ.
    """

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, [first]

    @staticmethod
    def _byte(string: bytes, depth: int) -> int:
        return string[depth] if depth < len(string) else -1

    def insert(self, number: int) -> None:
        string = self.strings[number]
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._byte(string, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common_prefix(string, other)
        if depth == len(string) == len(other):
            node.append(number)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][self._byte(string, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(string, depth)] = [number]
            return
        branch = (depth, {self._byte(other, depth): node, self._byte(string, depth): [number]})
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(string, parent[0])] = branch

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Numbers in order, each with its common prefix with the one before (-1 for the first)."""
        stack, shared = [(self.root, -1)], -1
        while stack:
            node, shared = stack.pop()
            if isinstance(node, tuple):
                depth, children = node
                keys = sorted(children)
                stack.extend((children[k], depth if k != keys[0] else shared) for k in reversed(keys))
                continue
            for number in node:
                yield number, shared
                shared = len(self.strings[number])


def suffix_order(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of strings that share ``known`` bytes, and the common prefix of neighbours.

    Multikey quicksort to ``known + shallow`` bytes, then blind tries.
    """
    order: list[int] = []
    shared: list[int] = []
    deep = known + shallow
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), known, -1)]
    while stack:
        group, depth, before = stack.pop()
        if not group:
            continue
        if len(group) == 1:
            order.append(group[0])
            shared.append(before)
        elif depth >= deep:
            trie = _BlindTrie(strings, group[0])
            for number in group[1:]:
                trie.insert(number)
            for k, (number, prefix) in enumerate(trie.ordered()):
                order.append(number)
                shared.append(prefix if k else before)
        else:
            byte = _BlindTrie._byte
            pivot = byte(strings[group[len(group) // 2]], depth)
            less = [i for i in group if byte(strings[i], depth) < pivot]
            same = [i for i in group if byte(strings[i], depth) == pivot]
            more = [i for i in group if byte(strings[i], depth) > pivot]
            parts = [(less, depth), (same, depth + 1 if pivot >= 0 else deep), (more, depth)]
            parts = [p for p in parts if p[0]]
            stack.extend((g, d, before if k == 0 else depth) for k, (g, d) in reversed(list(enumerate(parts))))
    return order, shared


def _agreement(strings: list[bytes], known: int) -> np.ndarray:
    """How many bytes each pair shares, from the sorted order."""
    order, shared = suffix_order(strings, known)
    m = len(order)
    least = np.zeros((m, m), np.int64)
    gaps = np.array(shared, np.int64)
    for i in range(m - 1):
        least[i, i + 1:] = np.minimum.accumulate(gaps[i + 1:])
    least = np.maximum(least, least.T)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    return least[np.ix_(rank, rank)]


def repeats_in_bucket(left: list[bytes], right: list[bytes], lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each surrounding, the bytes before and after its anchor that repeated windows cover.

    Windows start ``lo`` to ``hi`` bytes before the anchor; both are 0 where none repeats.
    """
    before = np.minimum(_agreement([x[::-1] for x in left], lo), hi)
    after = _agreement(right, length - hi)
    first = np.maximum(lo, length - after)  # the smallest offset the right side allows
    repeated = first <= before
    np.fill_diagonal(repeated, False)
    return (np.where(repeated, before, 0).max(axis=1), np.where(repeated, length - first, 0).max(axis=1))


# -- the job ------------------------------------------------------------------------------

def _surroundings(docs: DataFrame, data: Column, wanted: DataFrame) -> DataFrame:
    """The bytes left and right of the wanted anchors (``d1, d2, h, c, n, pos, left, right``)."""
    places = wanted.groupBy("d1", "d2").agg(
        F.sort_array(F.collect_list(F.struct("pos", "left", "right", "h", "c", "n"))).alias("places"))
    rows = docs.select("d1", "d2", data.alias("data")).join(places, ["d1", "d2"])

    @F.arrow_udf("array<struct<before:binary,after:binary>>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        out = []
        for text, list_ in zip(texts, lists, strict=True):
            data, anchors_here = text.as_py() or b"", list_.as_py()
            out.append([{"before": data[p["pos"] - p["left"]:p["pos"]], "after": data[p["pos"]:p["pos"] + p["right"]]}
                        for p in anchors_here])
        return pa.array(out, kind)

    both = F.arrays_zip(F.col("places"), F.col("cut"))
    return (
        rows.withColumn("cut", cut("data", "places")).select("d1", "d2", F.explode(both).alias("x"))
        .select("d1", "d2", "x.places.*", "x.cut.*").drop("left", "right")
    )


_SPAN = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _sorted_repeats(rows: DataFrame, length: int) -> DataFrame:
    """Spans of surroundings seen once (``n = 1``) that agree with another of their bucket."""

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket: list[dict]) -> list[dict]:
            # Buckets go by a hash; what is sorted together does share its bytes.
            alike: dict[tuple[bytes, bytes], list[dict]] = {}
            for r in bucket:
                lo, hi = r["lo"], r["hi"]
                alike.setdefault((r["before"][len(r["before"]) - lo:], r["after"][:length - hi]), []).append(r)
            return [span for group in alike.values() for span in spans_of(group)]

        def spans_of(group: list[dict]) -> list[dict]:
            if len(group) < 2 or all(r["n"] > 1 for r in group):
                return []
            before, after = repeats_in_bucket(
                [r["before"] for r in group], [r["after"] for r in group], group[0]["lo"], group[0]["hi"], length)
            return [{"d1": r["d1"], "d2": r["d2"], "start": r["pos"] - int(b), "stop": r["pos"] + int(a)}
                    for r, b, a in zip(group, before, after, strict=True) if r["n"] == 1 and a > 0]

        bucket: list[dict] = []
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1024):
                for row in batch.slice(at, 1024).to_pylist():
                    if bucket and bucket[0]["bucket"] != row["bucket"]:
                        out += done(bucket)
                        bucket = []
                    bucket.append(row)
            yield pa.RecordBatch.from_pylist(out, _SPAN)
        yield pa.RecordBatch.from_pylist(done(bucket), _SPAN)

    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        sort_buckets, "d1 long, d2 long, start long, stop long")


def _hot(keys: DataFrame, on: list[str], size: str) -> DataFrame | None:
    """Keys of more than ``HOT`` rows, for a broadcast; None where there are too many of them for that."""
    hot = keys.filter(F.col(size) > HOT).select(*on)
    return F.broadcast(hot) if fits_broadcast(hot) else None


def _meeting(rows: DataFrame, keys: DataFrame, on: list[str], size: str) -> DataFrame:
    """Stored rows whose key is in ``keys`` (stored, distinct, with the key's number of rows).

    Rows of hot keys stay where they are; the others are dealt by key.
    """
    hot = _hot(keys, on, size)
    if hot is None:
        return rows.join(keys.select(*on), on)
    rest = rows.join(hot, on, "left_anti").join(keys.filter(F.col(size) <= HOT).select(*on), on)
    return rows.join(hot, on).unionByName(rest)


def _salted(rows: DataFrame, keys: DataFrame, on: str, size: str) -> DataFrame:
    """The same for rows that are worked out on the way: hot keys are dealt by a salt as well."""
    hot = _hot(keys, [on], size)
    if hot is None:
        return rows.join(keys.select(on), on)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("d1", "d2", "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    salted = rows.join(hot.withColumn("_hot", F.lit(True)), on, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.sequence(F.lit(0), F.when(F.col(size) > HOT, F.lit(SALTS - 1)).otherwise(0))
    return salted.join(keys.select(on, F.explode(salts).alias("_salt")), [on, "_salt"]).drop("_salt")


def _bytes_of(lo: Column, hi: Column, length: int) -> Column:
    """What all windows that start between ``lo`` and ``hi`` bytes before the anchor share."""
    return F.concat(F.substring(
        F.col("before"), F.greatest(F.octet_length("before") - lo + 1, F.lit(1)), lo), F.substring(F.col("after"), F.lit(1), length - hi))


def repeat_spans(docs: DataFrame, data: Column, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """Spans ``d1, d2, start, stop`` whose union is what repeats; ``docs`` has ``d1, d2``."""
    reach, _ = reach_of(length)
    found = _anchor_rows(docs, data, length)
    shared = scratch(found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1), "shared")
    alive = scratch(_salted(found, shared, "h", "m"), "anchors")
    by_context = scratch(
        alive.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "pos", "left", "right")).alias("one")),
        "contexts")
    whole = _meeting(alive, by_context.filter(F.col("n") > 1), ["h", "c"], "n").filter(
        F.col("left") + F.col("right") >= length).select(
        "d1", "d2", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("stop"))
    mixed = by_context.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("n") == 1).alias("open")).filter(
        (F.col("m") > 1) & F.col("open")).select("h", "m")
    wanted = _meeting(by_context, scratch(mixed, "mixed"), ["h"], "m").select("h", "c", "n", "one.*")
    rows = scratch(
        _surroundings(docs, data, wanted).select(
            "d1", "d2", "pos", "n", "before", "after", F.col("h").alias("bucket"),
            F.lit(0).alias("lo"), F.lit(reach - 1).alias("hi")), "surroundings")
    spans = [whole]
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
        large = scratch(sizes.filter(F.col("m") > bucket).select("bucket"), "large")
        if large.isEmpty():
            spans.append(_sorted_repeats(rows, length))
            break
        spans.append(_sorted_repeats(attach(rows, large, "bucket", "left_anti"), length))
        rows, settled = _divided(attach(rows, large, "bucket", "left_semi"), length)
        spans.append(settled)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _divided(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large buckets under halves of their offsets, and the spans that are settled by that.

    In a half, rows with equal bytes over all of its windows repeat there as a whole; one of
    them goes on to be compared with the others.
    """
    lo, hi = F.col("lo"), F.col("hi")
    middle = F.floor((lo + hi) / 2).cast("int")
    halves = F.when(lo == hi, F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(
        F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi"))))
    split = rows.withColumn("half", F.explode(halves)).withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi"))
    split = split.filter((F.octet_length("before") >= lo) & (F.octet_length("after") >= length - hi))
    reach_left = F.least(F.octet_length("before"), hi)
    reach_right = F.least(F.octet_length("after"), length - lo)
    split = scratch(
        split.withColumn("bucket", F.xxhash64("bucket", lo, hi, _bytes_of(lo, hi, length)))
        .withColumn("all", F.struct(reach_left.alias("l"), reach_right.alias("r"), F.md5(_bytes_of(reach_left, length - reach_right, length)).alias("m")))
        .drop("half"), "halves")
    alike = split.groupBy("bucket", "all").agg(
        F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.min(F.struct("d1", "d2", "pos", "before", "after")).alias("one"),
        F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    alike = scratch(alike, "alike")
    settled = _meeting(split, alike.filter(F.col("k") > 1), ["bucket", "all"], "k").filter(
        F.col("all.l") + F.col("all.r") >= length).select(
        "d1", "d2", (F.col("pos") - F.col("all.l")).alias("start"), (F.col("pos") + F.col("all.r")).alias("stop"))
    partners = scratch(alike.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("bucket"), "partners")
    # A row that stands for several is only there to be compared with.
    on = attach(alike, partners, "bucket", "left_semi").select(
        "one.*", F.when(F.col("k") > 1, 2).otherwise(F.col("n")).cast("long").alias("n"), "bucket", "lo", "hi")
    single = on.filter(F.col("lo") < F.col("hi"))
    return scratch(single.select("d1", "d2", "pos", "n", "before", "after", "bucket", "lo", "hi"), "surroundings"), settled


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of spans that touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``spans`` (removed runs of bytes, end exclusive) and ``kept`` (the other bytes)."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    data = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    identity = [F.xxhash64(F.lit(1), *every).alias("d1"), F.xxhash64(F.lit(2), *every).alias("d2")]
    spans = repeat_spans(docs.select(*identity, data.alias("data")), F.col("data"), length, bucket)
    by_doc = spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    result = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    @F.arrow_udf("struct<spans:array<struct<start:bigint,stop:bigint>>,kept:binary>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for value, list_ in zip(texts, lists, strict=True):
            content, runs = value.as_py(), merged(list_.as_py() or [])
            edges = [0, *[edge for run in runs for edge in run], len(content)]
            kept = b"".join(content[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append({"spans": [{"start": a, "stop": b} for a, b in runs], "kept": kept})
        return pa.array(out, result)

    rows = docs.select(F.struct("*").alias("row"), data.alias("data"), *identity).join(by_doc, ["d1", "d2"], "left")
    names = [c for c in docs.columns if c.lower() not in ("spans", "kept")]
    return rows.select("row", cut("data", "found").alias("r")).select(*[F.col(f"row.`{c}`") for c in names], "r.*")
