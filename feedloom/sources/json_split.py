"""Elements of one very large JSON document, without ever holding it whole.

The document is read in pieces that end at closing braces, in as many splits as its size gives.
Whether a piece starts inside a string, and how deep, follows from sums over all pieces before it:
a piece turns the string state if it holds an odd number of quotes, and changes the depth by its
brackets outside strings, which are counted for both states.  The sums are taken split by split.
Pieces between two closing braces at the depth of the wanted member make up an element; only an
element has to fit into one value.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.cluster import checkpointed


class MalformedDocument(ValueError):
    """The document is not one JSON object, or lacks the member."""


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier pieces of the document."""
    rows = rows.withColumn("_v", value.cast("long"))
    sums = rows.groupBy("block").agg(F.sum("_v").alias("_s"))
    splits = sums.select("block", (F.sum("_s").over(Window.orderBy("block")) - F.col("_s")).alias("_o"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(splits), "block").withColumn(
        name, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_o")


def _net(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^{\[]", "")) - F.length(F.regexp_replace(c, r"[^}\]]", ""))


def pieces(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``block, at, value, in_string, depth, closes, after``: pieces in order, with their state.

    ``closes`` tells whether the brace that ends the piece closes something; ``after`` is the depth
    behind it.
    """
    reader = spark.read.option("lineSep", "}")
    if split_bytes:
        reader = reader.option("maxPartitionBytes", split_bytes)
    raw = reader.text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    even, odd = (F.array_join(F.filter("_parts", lambda _, i: i % 2 == k), " ") for k in (0, 1))  # noqa: B023
    rows = raw.withColumn("_parts", parts).select(
        "block", "at", "value", ((F.size("_parts") - 1) % 2).alias("turns"), _net(even).alias("out"), _net(odd).alias("in"))
    rows = _before(checkpointed(rows), F.col("turns"), "_quotes").withColumn("in_string", F.col("_quotes") % 2 == 1)
    closes = F.col("in_string") == (F.col("turns") == 1)
    change = F.when(F.col("in_string"), F.col("in")).otherwise(F.col("out"))
    rows = checkpointed(rows.withColumn("closes", closes).withColumn("change", change - closes.cast("int")).drop("_quotes", "out", "in"))
    rows = _before(rows, F.col("change"), "depth")
    # White space behind the last brace of the document is no piece of it.
    rest = (F.col("depth") == 0) & F.col("value").rlike(r"^\s+$")
    return rows.filter(~rest).select("block", "at", "value", "in_string", "depth", "closes", (F.col("depth") + F.col("change")).alias("after"))


def _member_start(member: str):
    """Where in a piece the content of the member begins (-1: not here), and its bracket."""
    pattern = re.compile(r'"((?:[^"\\]|\\.)*+)"|([{\[}\]])', re.DOTALL)
    name = re.compile(r'\s*+:\s*+([{\[])')

    @F.arrow_udf("struct<start:int,bracket:string>")
    def find(values: pa.Array, strings: pa.Array, depths: pa.Array) -> pa.Array:
        import json

        def one(text: str, in_string: bool, depth: int) -> dict:
            at = 0
            if in_string:
                end = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL).match(text)
                at = end.end() if end else len(text)
            while m := pattern.search(text, at):
                at = m.end()
                if m[2]:
                    depth += 1 if m[2] in "{[" else -1
                elif depth == 1 and json.loads(f'"{m[1]}"', strict=False) == member:
                    opened = name.match(text, at)
                    if opened:
                        return {"start": opened.end(), "bracket": opened[1]}
            return {"start": -1, "bracket": None}

        return pa.array([one(t.as_py(), s.as_py(), d.as_py()) for t, s, d in zip(values, strings, depths, strict=True)],
                        pa.struct([("start", pa.int32()), ("bracket", pa.string())]))

    return find


def _array_end():
    """Where in a piece the array at depth 2 ends; -1: not here."""
    pattern = re.compile(r'"(?:[^"\\]|\\.)*+"|([{\[}\]])', re.DOTALL)
    inside = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)

    @F.arrow_udf("int")
    def find(values: pa.Array, strings: pa.Array, depths: pa.Array) -> pa.Array:
        def one(text: str, in_string: bool, depth: int) -> int:
            start = inside.match(text) if in_string else None
            for m in pattern.finditer(text, start.end() if start else 0):
                if m[1]:
                    depth += 1 if m[1] in "{[" else -1
                    if depth < 2:
                        return m.start()
            return -1

        return pa.array([one(t.as_py(), s.as_py(), d.as_py()) for t, s, d in zip(values, strings, depths, strict=True)], pa.int32())

    return find


def elements(spark: SparkSession, path: str, member: str, split_bytes: int | None = None) -> DataFrame:
    """``pos, key, value``: the entries of an object or array that is a member of the document.

    ``value`` is a VARIANT; ``key`` is null in arrays; ``pos`` orders them (plain members between two
    objects come by key, as a VARIANT keeps them so).  Only single elements, and runs of plain values
    between two objects, have to fit into a VARIANT.
    """
    rows = checkpointed(pieces(spark, path, split_bytes))
    ends = rows.agg(F.max_by("after", F.struct("block", "at")).alias("last"), F.min("depth").alias("least"),
                    F.min_by("value", F.struct("block", "at")).alias("head")).first()
    if ends["last"] != 0 or ends["least"] < 0 or not (ends["head"] or "").lstrip().startswith("{"):
        raise MalformedDocument(f"{path} is not a JSON object")
    found = _member_start(member)("value", "in_string", F.col("depth").cast("int"))
    first = rows.filter((F.col("depth") == 0) | F.contains("value", F.lit(member))).withColumn("m", found).filter("m.start >= 0").orderBy("block", "at").select(
        "block", "at", "m.*").first()
    if first is None:
        raise MalformedDocument(f"{path} has no object or array {member!r}")
    here = F.struct("block", "at")
    begin = F.struct(F.lit(first["block"]).alias("block"), F.lit(first["at"]).alias("at"))
    is_first = here == begin
    text = F.when(is_first, F.substring("value", first["start"] + 1, 1 << 30)).otherwise(F.col("value"))
    rows = rows.filter(here >= begin).withColumn("value", text)
    if first["bracket"] == "{":
        last = rows.filter("closes AND after <= 1").agg(F.min(here).alias("p")).first()["p"]
        cut = F.lit(-1)
    else:
        # The first piece starts right behind the array's bracket.
        state = (F.when(is_first, F.lit(False)).otherwise(F.col("in_string")), F.when(is_first, F.lit(2)).otherwise(F.col("depth")).cast("int"))
        end = rows.filter(F.contains("value", F.lit("]"))).withColumn("_end", _array_end()("value", *state)).filter("_end >= 0").select(
            here.alias("p"), "_end").orderBy("p").first()
        last = end["p"] if end else None
        cut = F.lit(end["_end"] if end else -1)
    if last is None:
        raise MalformedDocument(f"{path}: {member!r} is never closed")
    stop = F.struct(F.lit(last["block"]).alias("block"), F.lit(last["at"]).alias("at"))
    is_last = here == stop
    rows = rows.filter(here <= stop)
    # The brace that ended a piece belongs to it, but not the one that closes the member.
    whole = F.when(is_last & (cut >= 0), F.substring("value", F.lit(1), cut)).when(is_last, F.col("value")).otherwise(
        F.concat("value", F.lit("}")))
    ended = F.col("closes") & (F.col("after") == 2) & ~is_last
    rows = _before(checkpointed(rows.withColumn("piece", whole).withColumn("ended", ended)), F.col("ended").cast("int"), "element")
    joined = rows.groupBy("element").agg(F.sort_array(F.collect_list(F.struct("block", "at", "piece"))).alias("p")).select(
        "element", F.regexp_replace(F.array_join("p.piece", ""), r"^[\s,]+|[\s,]+$", "").alias("text")).filter(F.col("text") != "")
    if first["bracket"] == "{":
        parsed = joined.select("element", F.try_parse_json(F.concat(F.lit("{"), "text", F.lit("}"))).try_cast("map<string,variant>").alias("v"))
        out = parsed.select("element", F.col("v").isNull().alias("bad"), F.posexplode_outer(F.map_entries("v")).alias("at", "e")).select(
            "element", "bad", "at", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    else:
        parsed = joined.select("element", F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))).try_cast("array<variant>").alias("v"))
        out = parsed.select("element", F.col("v").isNull().alias("bad"), F.posexplode_outer("v").alias("at", "value")).select(
            "element", "bad", "at", F.lit(None).cast("string").alias("key"), "value")
    problem = F.concat(F.lit(f"{path}: unreadable element "), F.col("element").cast("string"), F.lit(f" of {member}"))
    checked = F.when(F.col("bad"), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return out.filter(checked).select(F.struct("element", "at").alias("pos"), "key", "value")
