"""Tables the jobs keep: pools per date, the seen store, versioned snapshots, data sets.

Plain Parquet folders on shared storage.  Nothing is ever rewritten in place while it is
being read: a store grows by batch folders, a snapshot by version folders, a keyed table by
buckets, and a manifest - written last - says what counts.  A job that dies half-way leaves
folders no reader looks at, and running it again with the same batch gives the same state.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.cluster import checkpointed
from feedloom.operators import seen
from feedloom.sources import membership
from feedloom.sources.keyed import BUCKETS, KeyedTable, read_bucketed, read_folders, with_keys, write_bucketed
from feedloom.sources.manifest import GRACE, KEEP, TTL, AlreadyClaimed, Commits, StaleWriter, Turn
from feedloom.sources.storage import discard, files, subfolders

__all__ = [
    "HISTORY_SCHEMA", "LINK_SCHEMA", "AlreadyClaimed", "KeyedTable", "PoolTable", "SeenStore", "SnapshotTable", "StaleWriter",
    "discard", "read_dataset", "subfolders", "write_dataset",
]

ENTRY_SCHEMA = (
    "stored_key STRING, title STRING, company STRING, url STRING, first_seen STRING, "
    "fit STRING, status STRING, portal STRING, name_key STRING"
)
LINK_SCHEMA = "stored_key STRING, portal STRING, url STRING"
KEY_SCHEMA = "dedup_key STRING, is_entry BOOLEAN"
RANK_SCHEMA = (
    "stored_key STRING, rank_score INT, rank_verdict STRING, strengths ARRAY<STRING>, gaps ARRAY<STRING>, status STRING"
)
# Versions of a snapshot that stay readable.
KEEP_VERSIONS = 2
# Folders of one size that are merged into one of the next.
FANOUT = 8
HISTORY_SCHEMA = (
    "dedup_key STRING, title STRING, company STRING, url STRING, portal STRING, "
    "first_seen STRING, status STRING, fit STRING, also_on STRING, chunk_no INT"
)


class SeenStore:
    """Append-only memory of everything reported: ``entries``, ``links`` and ``ranks``.

    Beside them stand ``keys``, by which entries are recognized.  Every batch adds a folder to each
    part, in buckets of its key, so a pool meets the memory without moving it.  When ``FANOUT``
    folders of a size have come together they are merged into one of the next size, so a reader has
    to open a number of folders that grows with the logarithm of the batches.

    ``writer`` names who appends (a streaming query passes its checkpoint, so that it may
    repeat its own batches after a restart); by default every store object is its own writer.
    """

    PARTS = {"entries": ("stored_key", ENTRY_SCHEMA), "keys": ("dedup_key", KEY_SCHEMA), "links": ("stored_key", LINK_SCHEMA)}

    def __init__(self, spark: SparkSession, path: str, writer: str | None = None, buckets: int = BUCKETS, ttl: float = TTL):
        self.spark, self.path = spark, path.rstrip("/")
        self.writer = writer or uuid.uuid4().hex
        self.commits = Commits(spark, self.path, ttl)
        self.rank_commits = Commits(spark, f"{self.path}/ranks", ttl)
        self._buckets = buckets

    # -- reading ------------------------------------------------------------------------

    def _state(self, before: int | None = None) -> dict:
        state = self.commits.log.newest(before)
        return state if state and state["parts"] else {"buckets": self._buckets, "parts": {p: [] for p in self.PARTS}}

    def _read(self, part: str, before: int | None = None, folders: list[dict] | None = None) -> DataFrame:
        chosen = self._state(before)["parts"][part] if folders is None else folders
        return read_folders(self.spark, self.path, [f["path"] for f in chosen], self.PARTS[part][1])

    def _with_keys(self, part: str, asked: DataFrame, before: int | None = None, folders: list[dict] | None = None,
                   count: int | None = None) -> DataFrame:
        """Rows of a part whose key is asked for (distinct keys); the part isn't moved."""
        state, (key, schema) = self._state(before), self.PARTS[part]
        chosen = state["parts"][part] if folders is None else folders
        return with_keys(read_bucketed(
            self.spark, self.path, [f["path"] for f in chosen], schema, key, state["buckets"]), asked, key, state["buckets"], count)

    def entries(self, before: int | None = None) -> DataFrame:
        """Committed entries; ``before`` shows the state a given batch started from."""
        return self._read("entries", before)

    def links(self, before: int | None = None) -> DataFrame:
        return self._read("links", before)

    def folders(self, part: str) -> int:
        """How many folders a reader of the part opens."""
        return len(self._state()["parts"][part])

    def next_batch(self) -> int:
        last = self.commits.last()
        return 0 if last is None else last + 1

    # -- asking -------------------------------------------------------------------------

    def flag(self, pool: DataFrame, before: int | None = None) -> DataFrame:
        """``pool`` (one row a key) with ``is_known`` and ``has_entry``.

        Known are keys that an entry is recognized by; an entry of its own has what is stored under
        the very key.  The filters of the folders are asked first: only keys that one of them may
        hold are looked up, and only folders that may hold one are read.  Only the pool is moved.
        """
        state = self._state(before)
        folders = state["parts"]["keys"]
        if not folders:
            return pool.withColumns({"is_known": F.lit(False), "has_entry": F.lit(False)})
        filters = read_bucketed(self.spark, self.path, [f["filter"] for f in folders], membership.SCHEMA, "spot", state["buckets"])
        maybe = checkpointed(membership.ask(
            pool.select("dedup_key"), "dedup_key", filters, [(f["seed"], f["blocks"]) for f in folders]))
        met = maybe.agg(F.count(F.lit(1)).alias("n"), F.collect_set("seed").alias("seeds")).first()  # at most a seed a folder
        found = self._with_keys(
            "keys", maybe.select("dedup_key").distinct(), before, [f for f in folders if f["seed"] in met["seeds"]], met["n"]
        ).groupBy("dedup_key").agg(F.max("is_entry").alias("_entry"))
        return pool.join(found, "dedup_key", "left").withColumns({
            "is_known": F.col("_entry").isNotNull(), "has_entry": F.coalesce("_entry", F.lit(False))}).drop("_entry")

    def fresh_links(self, others: DataFrame, before: int | None = None) -> DataFrame:
        """Alternates (``dedup_key, portal, url``) that their keys lack, as rows to append."""
        if not self._state(before)["parts"]["links"]:
            return seen.new_links(self.links(before), others)
        asked = checkpointed(others.select(F.col("dedup_key").alias("stored_key")).distinct())
        return seen.new_links(self._with_keys("links", asked, before), others)

    def of_keys(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries and links of some keys (``stored_key``, distinct), without moving the rest."""
        return self._with_keys("entries", keys), self._with_keys("links", keys)

    def keys_since(self, batch: int) -> DataFrame:
        """``stored_key`` of everything that batches after ``batch`` added to (merged folders: and maybe more)."""
        parts = self._state()["parts"]
        late = [self._read(p, None, [f for f in parts[p] if f["last"] > batch]).select("stored_key") for p in ("entries", "links")]
        return late[0].unionByName(late[1]).distinct()

    # -- growing ------------------------------------------------------------------------

    def append(self, batch: int, entries: DataFrame, links: DataFrame) -> None:
        """Write one batch; the same batch again replaces itself, another writer's fails."""
        with self.commits.turn(batch, self.writer) as turn:
            if "name_key" not in entries.columns:
                entries = seen.with_name_key(entries)
            state = turn.base()
            state = state if state and state["parts"] else self._state(-1)
            new = {part: {"path": f"{part}/{batch:08d}-{turn.fence}-{uuid.uuid4().hex[:8]}", "first": batch, "last": batch, "level": 0}
                   for part in self.PARTS}
            self._write("entries", entries, new["entries"], state)
            stored = self._read("entries", None, [new["entries"]])
            if self._holds_rows(new["entries"]):
                self._write("keys", seen.recognized_keys(stored), new["keys"], state)
            self._write("links", links, new["links"], state)
            # Folders without rows aren't listed.
            turn.publish({p: state["parts"][p] + [new[p]] * self._holds_rows(new[p]) for p in self.PARTS}, buckets=state["buckets"])
            if self._merge_due():
                self._compact(turn)

    def _write(self, part: str, rows: DataFrame, folder: dict, state: dict) -> None:
        key, schema = self.PARTS[part]
        columns = self.spark.createDataFrame([], schema).columns
        write_bucketed(rows.select(*columns), f"{self.path}/{folder['path']}", key, state["buckets"])
        if part == "keys":
            folder["filter"] = folder["path"].replace("keys/", "filters/")
            keys = read_folders(self.spark, self.path, [folder["path"]], schema)
            folder["seed"], folder["blocks"] = membership.new_seed(), membership.blocks_for(keys.count())
            write_bucketed(membership.build(keys, key, folder["seed"], folder["blocks"]), f"{self.path}/{folder['filter']}",
                           "spot", state["buckets"])

    def _holds_rows(self, folder: dict) -> bool:
        return any(f.endswith(".parquet") for f in files(self.spark, f"{self.path}/{folder['path']}"))

    def _merge_due(self) -> list[tuple[str, int]]:
        levels = [(p, f["level"]) for p, folders in self._state()["parts"].items() for f in folders]
        return sorted({x for x in levels if levels.count(x) >= FANOUT})

    def _compact(self, turn: Turn) -> None:
        """Merge folders of a size until no size has ``FANOUT`` of them; readers see before or after."""
        state = self._state()
        parts = {p: list(folders) for p, folders in state["parts"].items()}
        while True:
            due = [(p, level) for p in parts for level in {f["level"] for f in parts[p]}
                   if sum(f["level"] == level for f in parts[p]) >= FANOUT]
            if not due:
                break
            for part, level in sorted(due):
                group = [f for f in parts[part] if f["level"] == level]
                first, last = min(f["first"] for f in group), max(f["last"] for f in group)
                folder = {"path": f"{part}/{first:08d}-{last:08d}-{turn.fence}-{uuid.uuid4().hex[:8]}", "first": first, "last": last,
                          "level": level + 1}
                rows = self._read(part, None, group)
                if part == "keys":
                    rows = rows.groupBy("dedup_key").agg(F.max("is_entry").alias("is_entry"))
                self._write(part, rows, folder, state)
                parts[part] = sorted([f for f in parts[part] if f["level"] != level] + [folder], key=lambda f: f["first"])
        turn.publish(parts, buckets=state["buckets"])
        self.vacuum()

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> list[str]:
        """Remove folders that no state uses any more."""
        gone = self.commits.log.vacuum(keep, grace)
        for path in gone:
            if path.startswith("keys/"):
                discard(self.spark, f"{self.path}/{path.replace('keys/', 'filters/')}")
        return gone

    # -- ranks --------------------------------------------------------------------------

    def append_ranks(self, scores: DataFrame) -> int:
        """Write scores (columns of ``RANK_SCHEMA``, one row per key) as the latest of their keys."""
        last = self.rank_commits.last()
        batch = 0 if last is None else last + 1
        names = self.spark.createDataFrame([], RANK_SCHEMA).columns
        with self.rank_commits.turn(batch, self.writer) as turn:
            folder = {"path": f"data/{batch:08d}-{turn.fence}-{uuid.uuid4().hex[:8]}", "first": batch, "last": batch, "level": 0}
            scores.select(*names).withColumn("batch", F.lit(batch).cast("long")).write.parquet(f"{self.path}/ranks/{folder['path']}")
            folders = [*((turn.base() or {}).get("parts", {}).get("ranks", [])), folder]
            turn.publish({"ranks": folders})
            while True:
                levels = [f["level"] for f in folders]
                due = sorted({v for v in levels if levels.count(v) >= FANOUT})
                if not due:
                    break
                group = [f for f in folders if f["level"] == due[0]]
                first, last = min(f["first"] for f in group), max(f["last"] for f in group)
                merged = {"path": f"data/{first:08d}-{last:08d}-{turn.fence}-{uuid.uuid4().hex[:8]}", "first": first, "last": last,
                          "level": due[0] + 1}
                self._latest_ranks(group).write.parquet(f"{self.path}/ranks/{merged['path']}")
                folders = sorted([f for f in folders if f["level"] != due[0]] + [merged], key=lambda f: f["first"])
                turn.publish({"ranks": folders})
                self.rank_commits.log.vacuum()
        return batch

    def _latest_ranks(self, folders: list[dict]) -> DataFrame:
        rows = self.spark.read.schema(f"{RANK_SCHEMA}, batch BIGINT").parquet(*[f"{self.path}/ranks/{f['path']}" for f in folders])
        names = [c for c in rows.columns if c not in ("stored_key", "batch")]
        latest = rows.groupBy("stored_key").agg(F.max_by(F.struct(*names), "batch").alias("r"), F.max("batch").alias("batch"))
        return latest.select("stored_key", "r.*", "batch")

    def ranks(self) -> DataFrame:
        """The latest scores of every key."""
        state = self.rank_commits.log.newest()
        folders = (state or {}).get("parts", {}).get("ranks", [])
        return self._latest_ranks(folders).drop("batch") if folders else self.spark.createDataFrame([], RANK_SCHEMA)

    def ranked(self) -> DataFrame:
        """Entries with their rank fields; a merge of entries can't lose them."""
        return seen.write_ranks(self.entries(), self.ranks())

    def import_entries(self, found: DataFrame) -> None:
        """Take in an existing store (rows of ``landing.seen_entries``): entries, links, ranks."""
        names = [c for c in self.spark.createDataFrame([], ENTRY_SCHEMA).columns if c != "name_key"]
        self.append(self.next_batch(), found.select(*names), seen.explode_links(found))
        fields = [c for c in self.spark.createDataFrame([], RANK_SCHEMA).columns if c not in ("stored_key", "status")]
        self.append_ranks(found.filter(F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in fields]).isNotNull()))


class SnapshotTable:
    """A table that is replaced as a whole, version by version; old versions are removed."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.commits = Commits(spark, self.path)

    def read(self) -> DataFrame:
        last = self.commits.last()
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/version={last}")

    def replace(self, rows: DataFrame) -> int:
        last = self.commits.last()
        version = 0 if last is None else last + 1
        with self.commits.turn(version, uuid.uuid4().hex) as turn:
            rows.write.mode("overwrite").parquet(f"{self.path}/data/version={version}")
            turn.publish({"data": [{"path": f"data/version={version}"}]})
        self.commits.log.vacuum(KEEP_VERSIONS, 0)
        return version


class PoolTable:
    """Results of runs, one folder per date: ``meta``, ``report`` and ``new``."""

    PARTS = ("meta", "report", "new")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, day: str, meta: DataFrame, report: DataFrame, new: DataFrame) -> None:
        """Write a run; a second run on the same date replaces the first."""
        for part, rows in zip(self.PARTS, (meta, report, new)):
            rows.drop("date").write.mode("overwrite").parquet(f"{self.path}/{part}/date={day}")

    def read(self, part: str, day: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{part}")
        return rows if day is None else rows.filter(F.col("date") == F.lit(day).cast("date"))

    def prune(self, today: date, days: int = 30) -> list[str]:
        """Delete folders of dates more than ``days`` old; returns the dates."""
        oldest = today - timedelta(days=days)
        gone = set()
        for part in self.PARTS:
            for name in subfolders(self.spark, f"{self.path}/{part}"):
                day = name.removeprefix("date=")
                if name.startswith("date=") and date.fromisoformat(day) < oldest:
                    discard(self.spark, f"{self.path}/{part}/{name}")
                    gone.add(day)
        return sorted(gone)


def write_dataset(
    companies: DataFrame,
    path: str,
    source: str,
    baseline: float = 100,
    label: str = "Index",
    description: str | None = None,
) -> None:
    """Company data set with its metadata row."""
    spark = companies.sparkSession
    text = description or f"Index {baseline} = baseline"
    spark.range(1).select(
        F.lit(source).alias("source"), F.lit(float(baseline)).alias("index_baseline"),
        F.lit(label).alias("index_label"), F.lit(text).alias("baseline_description"),
    ).write.mode("overwrite").parquet(f"{path}/metadata")
    companies.write.mode("overwrite").parquet(f"{path}/companies")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, companies) as written by ``write_dataset``."""
    return spark.read.parquet(f"{path}/metadata"), spark.read.parquet(f"{path}/companies")
