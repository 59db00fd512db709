"""Near duplicates by SimHash and pigeonhole blocks.

A fingerprint has 64 bits; a bit is set when more than half of the hashes of a document's
shingles have it.  Two fingerprints are linked at ``max_bits`` or fewer differing bits.  With
``max_bits + 2`` blocks of bits, at least two blocks of such a pair are equal, so every pair
meets under one of the combinations of two blocks.  Distinct fingerprints are joined on these
keys and the distance is verified.

A key under which more than ``JOIN_LIMIT`` fingerprints meet (a large group of near copies)
is not joined: fingerprints at most two bits apart have one in the middle, one bit from each,
so each is sent to its one-bit neighbours that keep the key, and all that meet at a neighbour
are linked to the smallest of them.  That is exact, and linear in the fingerprints.

Groups are the connected components of the links, found by alternating star contraction on
fingerprints (not documents).

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; repeated
rows are members of the same group; a null id is the smallest of a group only if there is no
other; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import scratch

SHINGLE = 3
MAX_BITS = 2
JOIN_LIMIT = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes as an unsigned number."""
    words = (text or b"").lower().split()  # bytes know A-Z and the ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    ends = ends[size - 1:]
    total, hashed = len(starts), xxhash.xxh64_intdigest
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, total, _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist(), strict=True)
        hashes = np.array([hashed(joined[a:b], 42) for a, b in spans], dtype="<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256)
    set_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    majority = (counts @ set_bits).reshape(64) * 2 > total
    return sum(1 << int(i) for i in np.flatnonzero(majority))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py(), shingle) for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return of_batch(F.encode(text, "UTF-8"))


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, limit: int = JOIN_LIMIT) -> DataFrame:
    """Links ``a, b`` between distinct ``fp`` that keep all connections of pairs within ``max_bits``."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    edges = [64 * i // (max_bits + 2) for i in range(max_bits + 3)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    shared = rows.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    meeting = scratch(rows.join(shared, ["combo", "key"]), "blocks")

    few = meeting.filter(F.col("n") <= limit)
    distance = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    joined = (
        few.alias("x").join(few.alias("y"), ["combo", "key"])
        .filter((F.col("x.fp") < F.col("y.fp")) & (distance <= max_bits))
        .select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b"))
    )
    # One bit cleared (pairs one bit apart) or flipped (pairs with a fingerprint in the middle).
    changes = []
    for i, mask in enumerate(masks):
        free = [signed(1 << k) for k in range(64) if not mask >> k & 1]
        if max_bits == 1:
            changed = [F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(~b)).alias("near")) for b in free]
        else:
            changed = [F.struct(F.lit(0).cast("long").alias("bit"), F.col("fp").bitwiseXOR(F.lit(b)).alias("near"))
                       for b in [0, *free]]
        changed = [c.cast("struct<bit:bigint,near:bigint>") for c in changed]
        changes.append(F.when(F.col("combo") == i, F.array(*changed)))
    near = (
        meeting.filter(F.col("n") > limit)
        .select("fp", "combo", F.explode(F.coalesce(*changes)).alias("c")).select("fp", "combo", "c.*")
    )
    spot = ["combo", "bit", "near"]
    least = near.groupBy(*spot).agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    starred = near.join(least.drop("n"), spot).filter(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b")
    return joined.unionByName(starred).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node; the root is the smallest node of the component."""
    edges, before = scratch(links, "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Larger neighbours move to the smallest, then all neighbours of the smaller kind do.
        edges = both.join(least, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = scratch(
            edges.join(least, "a").filter(F.col("b") > F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def near_groups(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (a stored table with ``id, fp``) with ``root`` and ``component_id``."""
    prints = scratch(rows.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    roots = scratch(components(fingerprint_links(prints.select("fp"), max_bits)), "roots")
    member = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(member.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id of its group)."""
    rows = scratch(docs.select(F.col(doc_id).alias("id"), fingerprints(F.col(text), shingle).alias("fp")), "fingerprints")
    return near_groups(rows, max_bits).select(F.col("id").alias("doc_id"), "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every group: the smallest id, of rows with that id one."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    digests = [F.xxhash64(F.lit(7), *every).alias("d1"), F.xxhash64(F.lit(8), *every).alias("d2")]
    rows = scratch(docs.select(F.col(doc_id).alias("id"), *digests, fingerprints(F.col(text), shingle).alias("fp")),
                   "fingerprints")
    kept = near_groups(rows, max_bits).groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "d1", "d2")).alias("k")).select("k.d1", "k.d2")
    found = docs.select(F.struct("*").alias("row"), *digests).join(kept, ["d1", "d2"])
    place = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("d1"))
    return found.withColumn("place", place).filter(F.col("place") == 1).select("row.*")
