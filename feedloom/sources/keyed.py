"""Tables in buckets of a key: joined without moving them, rewritten bucket by bucket.

A folder of such a table is written with one file for each bucket that has rows.  Folders are read
through an external table of the session's catalog that knows the buckets, so a join on the key
moves the other side only.  The catalog holds nothing but their description; which folders belong
to a table is said by its manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.sources import storage
from feedloom.sources.manifest import GRACE, KEEP, TTL, Commits

BUCKETS = 16
# States between two removals of files that none uses.
VACUUM = 8
# Keys of a bucket that are looked up by hash.
HASHED_KEYS = 1_000_000
# Descriptions of folders that stay in the session's catalog; older ones are dropped.
TABLES = 64
_TABLES: dict[str, list[str]] = {}
_BUCKET = re.compile(r"_(\d+)(?:\.c\d+)?\.\w+(?:\.\w+)?$")


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new folder with at most one file a bucket, sorted by the key."""
    spark, name = rows.sparkSession, f"feedloom_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
        .option("path", path).mode("overwrite").saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")


def read_folders(spark: SparkSession, base: str, folders: list[str], schema: str) -> DataFrame:
    """The rows of folders below ``base``."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in folders])


def read_bucketed(spark: SparkSession, base: str, folders: list[str], schema: str, key: str, buckets: int) -> DataFrame:
    """The same with their buckets known to Spark, for a join on the key (``with_keys``).

    Not for anything else: where a union of such reads makes an exchange unnecessary, Spark may
    still decide to read them without their buckets.
    """
    if not folders:
        return spark.createDataFrame([], schema)
    name = "feedloom_" + hashlib.sha1("\n".join([base, key, str(buckets), schema, *folders]).encode()).hexdigest()
    known = _TABLES.setdefault(spark.sparkContext.applicationId, [])
    if name in known:
        known.remove(name)
    known.append(name)
    while len(known) > TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {known.pop(0)}")
    if not spark.catalog.tableExists(name):
        at = lambda path: "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"CREATE TABLE {name} ({schema}, _folder STRING) USING parquet PARTITIONED BY (_folder) "
                  f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION {at(base)}")
        spark.sql(f"ALTER TABLE {name} ADD " + " ".join(
            f"PARTITION (_folder='{k}') LOCATION {at(f'{base}/{f}')}" for k, f in enumerate(folders)))
    return spark.table(name).drop("_folder")


def with_keys(bucketed: DataFrame, asked: DataFrame, key: str, buckets: int, count: int | None = None) -> DataFrame:
    """Rows of a bucketed table whose key is asked for; only ``asked`` (distinct keys, ``count`` at most) is moved.

    Keys that fit a task's memory bucket by bucket are hashed there, and the table just passes by;
    of more than that the buckets are sorted.
    """
    keys = asked.select(key)
    few = (keys.count() if count is None else count) <= HASHED_KEYS * buckets
    return bucketed.join(keys.hint("shuffle_hash") if few else keys.hint("merge"), key, "left_semi")


def bucket_of(file: str) -> int:
    """The bucket of a file, from its name."""
    return int(_BUCKET.search(file)[1])


class KeyedTable:
    """A table that is upserted by key; a load rewrites the buckets whose keys changed, no others.

    A key may have several rows, which are replaced together.  ``buckets`` is fixed by the first
    load; ``grow`` doubles it.  Versions are claimed and published in turns, see ``manifest``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS,
                 writer: str | None = None, ttl: float = TTL):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.writer = writer or uuid.uuid4().hex
        self.commits = Commits(spark, self.path, ttl)
        self._buckets = buckets

    def state(self) -> dict:
        newest = self.commits.log.newest()
        return newest if newest and newest["parts"] else {"number": -1, "buckets": self._buckets, "parts": {"data": []}}

    def _rows(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f['path']}/{f['file']}" for f in files])

    def read(self) -> DataFrame:
        return self._rows(self.state()["parts"]["data"])

    def _signatures(self, rows: DataFrame) -> DataFrame:
        """One row a key that differs where the rows of the key differ."""
        every = [F.col(f"`{c}`") for c in self.spark.createDataFrame([], self.schema).columns]
        # Two sums of bits of two hashes; sums of whole 64-bit numbers could overflow.
        part = lambda seed, shift: F.sum(F.shiftright(F.xxhash64(F.lit(seed), *every), shift))
        return rows.groupBy(self.key).agg(
            F.struct(F.count(F.lit(1)), part(1, 20), part(2, 20), F.bit_xor(F.xxhash64(F.lit(3), *every))).alias("_sign"))

    def note(self) -> dict:
        """What the last load left with its state."""
        return self.state().get("note", {})

    def upsert(self, incoming: DataFrame, note: dict | None = None) -> list[int]:
        """Rows of keys in ``incoming`` replace those keys; returns the buckets that were rewritten.

        ``note`` is kept with the state, so that a load and how far it went are published together.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        staged = f"staged/{uuid.uuid4().hex}"
        state = self.state()
        buckets = state["buckets"]
        place = F.pmod(F.hash(self.key), F.lit(buckets)).alias("_bucket")
        # Stored first: the rows are read twice, and what they come from may read this table.
        incoming.select(*columns).write.parquet(f"{self.path}/{staged}")
        new = read_folders(self.spark, self.path, [staged], self.schema)
        held: dict[int, list[dict]] = {}
        for f in state["parts"]["data"]:
            held.setdefault(f["bucket"], []).append(f)
        met = [r["_bucket"] for r in new.select(place).distinct().collect()]
        old = self._rows([f for b in met for f in held.get(b, [])])
        changed = self._signatures(new).join(
            self._signatures(old).withColumnRenamed("_sign", "_old"), self.key, "left").filter(~F.col("_sign").eqNullSafe(F.col("_old")))
        touched = sorted(r["_bucket"] for r in changed.select(place).distinct().collect())
        if touched:
            some = lambda rows: rows.filter(place.isin(touched))
            stay = self._rows([f for b in touched for f in held.get(b, [])]).join(new.select(self.key).distinct(), self.key, "left_anti")
            self._replace(stay.select(*columns).unionByName(some(new).select(*columns)), touched, state, note=note)
        elif note is not None and note != state.get("note", {}):
            with self.commits.turn(state["number"] + 1, self.writer) as turn:
                turn.publish(state["parts"], buckets=buckets, note=note)
        storage.discard(self.spark, f"{self.path}/{staged}")
        return touched

    def _replace(self, rows: DataFrame, touched: list[int] | None, state: dict, buckets: int | None = None,
                 note: dict | None = None) -> None:
        """Publish a state in which ``rows`` are what the touched buckets (None: all) hold."""
        number, count = state["number"] + 1, buckets or state["buckets"]
        with self.commits.turn(number, self.writer) as turn:
            path = f"data/{number:08d}-{turn.fence}-{uuid.uuid4().hex[:8]}"
            write_bucketed(rows, f"{self.path}/{path}", self.key, count)
            found = [{"path": path, "file": f, "bucket": bucket_of(f)}
                     for f in storage.files(self.spark, f"{self.path}/{path}") if f.endswith(".parquet")]
            stay = [] if touched is None else [f for f in state["parts"]["data"] if f["bucket"] not in touched]
            turn.publish({"data": sorted(stay + found, key=lambda f: f["bucket"])}, buckets=count,
                         note=state.get("note", {}) if note is None else note)
        if self.commits.log.last_place() % VACUUM == 0:
            self.vacuum()

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> list[str]:
        """Remove files that no state uses any more."""
        return self.commits.log.vacuum(keep, grace)

    def grow(self, buckets: int | None = None) -> None:
        """Deal the rows into twice as many buckets (or a given number)."""
        state = self.state()
        self._replace(self.read(), None, state, buckets or 2 * state["buckets"])
