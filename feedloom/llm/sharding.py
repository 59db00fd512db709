"""Sharding by histogram sort (built-in functions only).

Documents are ordered by a 126-bit key: a hash of the text, then a hash of the whole row, so
equal texts are neighbours.  Shards are ranges of that order with nearly equal bytes.  The
boundaries are found without sorting: bytes are counted exactly between candidate keys, the
intervals that hold a boundary and more bytes than the tolerance (or more rows than one task
should sort) get new candidates inside, and so on until all boundaries are met.  A group of
equal texts stays together where it fits the tolerance; a larger one is divided by the second
half of the key.  Rows equal in every column have one key; where there are too many of them for an
interval they are stored, numbered part by part, and dealt into pieces by their numbers.  Then rows
are exchanged once, by interval, and numbered inside.

Defined cases: a null text counts as empty (size 1); rows equal in every column are
interchangeable and may lie in several shards; an empty table gives no rows.  Other columns ride along;
columns named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import attach, scratch, text_or_empty

# A boundary may miss its ideal place by this share of a shard's bytes.
TOLERANCE = 0.005
# Rows of an interval, about.  One that holds four times its even share is divided.
INTERVAL_ROWS = 20_000
# Candidates inside an interval that is refined.
PROBES = 256
_BITS = 63


def _keys(docs: DataFrame, text: str) -> tuple[Column, Column]:
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], F.lit(9))
    return F.shiftrightunsigned(F.xxhash64(text_or_empty(text)), 1), F.shiftrightunsigned(whole, 2)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    first, second = _keys(docs, text)
    return docs.select(F.struct("*").alias("row"), (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"),
                       F.struct(first.alias("h1"), second.alias("h2")).alias("key"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def _placed(cells: DataFrame) -> DataFrame:
    """Bytes and rows before every cell.  Sums over 1,024 ranges of the key carry the total."""
    cells = cells if "piece" in cells.columns else cells.withColumn("piece", F.lit(0))
    cells = cells.withColumn("_top", F.shiftright(F.col("lo.h1"), _BITS - 10))
    tops = cells.groupBy("_top").agg(F.sum("bytes").alias("_b"), F.sum("rows").alias("_r"))
    over = Window.orderBy("_top")
    tops = tops.select("_top", (F.sum("_b").over(over) - F.col("_b")).alias("_b0"),
                       (F.sum("_r").over(over) - F.col("_r")).alias("_r0"))
    inside = Window.partitionBy("_top").orderBy("lo", "piece")
    return (
        cells.join(F.broadcast(tops), "_top")
        .withColumn("bytes_before", F.col("_b0") + F.sum("bytes").over(inside) - F.col("bytes"))
        .withColumn("rows_before", F.col("_r0") + F.sum("rows").over(inside) - F.col("rows"))
        .drop("_top", "_b0", "_r0")
    )


def _refined(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of the heavy cells get a new cell, by probes set evenly over the keys seen there."""
    joined = attach(rows, heavy, "cell", "left")
    by_text = F.col("lo.h1") < F.col("hi.h1")
    here = F.when(by_text, F.col("key.h1") - F.col("lo.h1")).otherwise(F.col("key.h2") - F.col("lo.h2"))
    width = F.when(by_text, F.col("hi.h1") - F.col("lo.h1")).otherwise(F.col("hi.h2") - F.col("lo.h2"))
    return (
        joined.withColumn("_here", here).withColumn("_width", width)
        .withColumn("cell", F.when(F.col("lo").isNull(), F.col("cell")).otherwise(
            F.concat_ws("/", "cell", F.expr(f"_here div (_width div {PROBES} + 1)").cast("string"))))
        .drop("lo", "hi", "_here", "_width")
    )


def split_intervals(keys: DataFrame, shards: int, tolerance: float = TOLERANCE,
                    interval_rows: int = INTERVAL_ROWS) -> tuple[DataFrame, list[DataFrame], DataFrame | None, int]:
    """The intervals with their shard and first slot, the refinements, groups of equal rows that
    are dealt in pieces (``cell, per``), and the first bits.

    ``keys`` (a stored table of ``key, size``) is counted once per round.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    bits = min(30, max(8, math.ceil(math.log2(max(1, total["rows"]) / interval_rows + 1))))
    ideal = max(total["bytes"], 1) / shards
    many = 4 * max(16, total["rows"] / 2 ** bits)
    boundary = lambda place: F.floor(place / F.lit(ideal))
    rows = keys.select(first_cell(bits).alias("cell"), "size", "key")
    cells, rounds = scratch(_counted(rows), "cells"), []
    while True:
        after = F.col("bytes_before") + F.col("bytes")
        heavy = (F.col("rows") > many) | (
            (F.col("bytes") > tolerance * ideal) & (boundary(F.col("bytes_before")) < boundary(after - 1)))
        wanted = scratch(
            _placed(cells).filter(heavy & (F.col("lo") < F.col("hi"))).select("cell", "lo", "hi"), "heavy")
        if wanted.isEmpty():
            break
        rounds.append(wanted)
        finer = _refined(attach(rows, wanted.select("cell"), "cell", "left_semi"), wanted)
        cells = scratch(cells.join(wanted.select("cell"), "cell", "left_anti").unionByName(_counted(finer)), "cells")
        rows = _refined(rows, wanted)
    # What is heavy still has a single key: rows that are equal in every column.
    per = F.greatest(F.lit(1), F.least(F.lit(int(many)), F.floor(F.lit(tolerance * ideal) * F.col("rows") / F.col("bytes")))).cast("long")
    equal = scratch(_placed(cells).filter(heavy & (F.col("rows") > 1)).withColumn("per", per).select(
        "cell", "bytes", "rows", "lo", "hi", "per"), "equal")
    groups = None if equal.isEmpty() else equal.select("cell", "per")
    if groups is not None:
        pieces = equal.withColumn("size", F.expr("bytes div rows")).withColumn(
            "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rows - 1) div per"))))
        pieces = pieces.withColumn("rows", F.least(F.col("per"), F.col("rows") - F.col("piece") * F.col("per")))
        cells = attach(cells, groups, "cell", "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(pieces.select(
            F.concat_ws("#", "cell", F.col("piece").cast("string")).alias("cell"), (F.col("rows") * F.col("size")).alias("bytes"),
            "rows", "lo", "hi", "piece"))
    middle = F.col("bytes_before") + F.col("bytes") / 2
    placed = _placed(cells).withColumn("shard", F.least(boundary(middle), F.lit(shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("_first"))
    out = placed.join(F.broadcast(firsts), "shard").select(
        "cell", "shard", (F.col("rows_before") - F.col("_first")).alias("first_slot"))
    return scratch(out, "intervals"), rounds, groups, bits


def _dealt(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups get the cell of their piece.

    They are stored as they come, counted in every part and numbered inside it, so no task sees a
    whole group.
    """
    mine = scratch(attach(rows, groups, "cell").withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id()), "equal-rows")
    before = Window.partitionBy("cell").orderBy("_part")
    firsts = mine.groupBy("cell", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "cell", "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_first"))
    number = F.col("_first") + F.row_number().over(Window.partitionBy("cell", "_part").orderBy("_at")) - 1
    numbered = attach(mine, scratch(firsts, "firsts"), ["cell", "_part"]).withColumn("_number", number)
    dealt = numbered.withColumn("cell", F.concat_ws("#", "cell", F.expr("_number div per").cast("string")))
    return attach(rows, groups.select("cell"), "cell", "left_anti").unionByName(dealt.select(*rows.columns))

def first_cell(bits: int) -> Column:
    return F.shiftright(F.col("key.h1"), _BITS - bits).cast("string")


def shard(docs: DataFrame, shards: int = 8, text: str = "text", tolerance: float = TOLERANCE,
          interval_rows: int = INTERVAL_ROWS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes + 1), ``shard`` and ``slot`` (gapless from 0 in the shard)."""
    rows = _keyed(docs, text)
    intervals, rounds, groups, bits = split_intervals(
        scratch(rows.select("key", "size"), "keys"), shards, tolerance, interval_rows)
    rows = rows.withColumn("cell", first_cell(bits))
    for wanted in rounds:
        rows = _refined(rows, wanted)
    if groups is not None:
        rows = _dealt(rows, groups)
    slot = F.col("first_slot") + F.row_number().over(Window.partitionBy("cell").orderBy("key")) - 1
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    return attach(rows, intervals, "cell").select(
        *[F.col(f"row.`{c}`") for c in kept], "size", "shard", slot.cast("long").alias("slot"))
