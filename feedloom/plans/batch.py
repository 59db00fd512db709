"""The daily run: collected postings in, pool, memory and history out."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.cluster import checkpointed, passing_shuffles, passing_workspaces, workspace
from feedloom.operators import dedup, filters, report, seen
from feedloom.sources import storage
from feedloom.sources.tables import HISTORY_SCHEMA, KeyedTable, PoolTable, SeenStore, discard

# Input files, in bytes, of the rows that are collapsed at a time (``by_slices``), and in how many turns at most.
SLICE_BYTES = 256 * 1024 * 1024
MOST_SLICES = 16


class Pool(NamedTuple):
    links: DataFrame
    unique: DataFrame
    others: DataFrame
    folder: str


def slices_for(rows: DataFrame) -> int:
    """In how many turns the rows are collapsed, by the size of the files they come from."""
    size = sum(storage.size_of(rows.sparkSession, path) for path in rows.inputFiles())
    return max(1, min(MOST_SLICES, -(-size // SLICE_BYTES)))


def by_slices(postings: DataFrame, fields: list[str] | None, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make`` of the keyed postings, where ``make`` gives rows for each ``dedup_key`` by itself.

    Shuffled rows take several times the space that they take in columns.  So the rows of a large
    pool are stored keyed, in slices of whole keys, and ``make`` gets slice after slice; what
    a slice was made from and what it shuffled is removed before the next, so the disk holds a slice
    of that at a time.  Within a slice nothing changes: a hot key is combined like in one turn.
    """
    keyed, slices = dedup.with_key(postings, fields=fields), slices_for(postings)
    if slices == 1:
        return make(keyed)
    spark = keyed.sparkSession
    base, done = workspace(spark, "slices"), []
    packed = {"compression": "zstd"}
    with passing_shuffles(spark):
        at = F.pmod(F.xxhash64("dedup_key"), F.lit(slices)).cast("int")
        keyed.withColumn("_slice", at).write.partitionBy("_slice").options(**packed).parquet(f"{base}/keyed")
        for name in storage.subfolders(spark, f"{base}/keyed"):
            with passing_workspaces(spark):
                rows = spark.read.schema(keyed.schema).parquet(f"{base}/keyed/{name}")
                make(rows).write.options(**packed).parquet(f"{base}/made/{name}")
            storage.discard(spark, f"{base}/keyed/{name}")
            done.append(f"{base}/made/{name}")
    return spark.read.option("basePath", f"{base}/made").parquet(*done).drop("_slice") if done else make(keyed)


def unique_postings(postings: DataFrame, order: Column, fields: list[str] | None = None) -> DataFrame:
    """The winners alone, with ``fields`` (see ``merge_pool``)."""
    return by_slices(postings, fields, lambda keyed: dedup.pick_winners(dedup.collapse_links(keyed, order)))


def nested_postings(postings: DataFrame, order: Column, fields: list[str] | None = None) -> DataFrame:
    """Winners with their alternates in arrays (``dedup.nest_alternates``)."""
    def nested(keyed: DataFrame) -> DataFrame:
        pool = _pool_of(keyed, order)
        return dedup.nest_alternates(pool.unique, pool.others)

    return by_slices(postings, fields, nested)


def merge_pool(postings: DataFrame, order: Column, fields: list[str] | None = None) -> Pool:
    """Keyed and collapsed once, on shared storage; winners and alternates derive from it.

    The heavy text work and the first shuffle therefore run a single time, and a lost
    executor costs a re-read, not a re-run.  ``folder`` may be discarded when nothing reads
    the pool any more.  ``fields`` are the columns that the pool keeps (all, if not given); the
    key, the link and the order are always there.
    """
    return _pool_of(dedup.with_key(postings, fields=fields), order)


def _pool_of(keyed: DataFrame, order: Column) -> Pool:
    spark = keyed.sparkSession
    base = workspace(spark, "pool")
    dedup.collapse_links(keyed, order).write.parquet(f"{base}/links")
    links = spark.read.parquet(f"{base}/links")
    dedup.pick_winners(links).write.parquet(f"{base}/unique")
    unique = spark.read.parquet(f"{base}/unique")
    return Pool(links, unique, dedup.alternates(links, unique), base)


def run_batch(
    collected: DataFrame,
    order: Column,
    profiles: DataFrame,
    run_report: DataFrame,
    store: SeenStore,
    pools: PoolTable,
    history: KeyedTable | None = None,
    today: date | None = None,
    remember: bool = True,
    retention_days: int = 30,
) -> None:
    """Filter, collapse, split off what is new, write the pool, grow the memory.

    ``remember=False`` is a preview: it writes the pool and leaves the memory alone.  The
    numbers of the run are observed while the flagged pool is written, and the history takes in
    what the run touched, not the whole memory.
    """
    day = today or date.today()
    spark = collected.sparkSession
    kept = filters.flag_titles(collected, profiles).filter("keep").drop("keep")
    pool = merge_pool(kept, order)
    batch = store.next_batch()
    with store.commits.turn(batch, store.writer) if remember else nullcontext():
        flagged_path = workspace(spark, "flagged")
        seen_now, numbers = store.flag(pool.unique, before=batch), Observation()
        seen_now.observe(
            numbers, F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
            F.count_if("is_known").alias("n_known"), F.count_if(~F.col("has_entry")).alias("n_added"),
        ).write.parquet(flagged_path)
        flagged = spark.read.parquet(flagged_path)
        fresh = flagged.filter("NOT is_known").drop("is_known", "has_entry")
        nested = dedup.nest_alternates(fresh, pool.others.join(fresh.select("dedup_key"), "dedup_key", "left_semi"))
        pools.write(day.isoformat(), run_stats(spark, numbers.get, remember), run_report, nested.drop("link"))
        if remember:
            added = seen.entry_rows(flagged.filter("NOT has_entry"), F.lit(day.isoformat()))
            store.append(batch, added, store.fresh_links(pool.others, before=batch))
    if remember and history is not None:
        # From where the last load got to, so a run that died before its load is made up for.
        touched = checkpointed(store.keys_since(history.note().get("through", -1)))
        history.upsert(history_rows(store, keys=touched), {"through": batch})
    pools.prune(day, retention_days)
    for path in (pool.folder, flagged_path):
        discard(spark, path)


def run_stats(spark: SparkSession, numbers: dict, remember: bool) -> DataFrame:
    """The observed numbers of a run as its one row of statistics."""
    count = lambda n: F.lit(int(n)).cast("long")
    one = spark.range(1).select(
        count(numbers["n_rows"]).alias("input_records"), count(numbers["n_keys"]).alias("unique_jobs"),
        count(numbers["n_keys"] - numbers["n_known"]).alias("new"), count(numbers["n_known"]).alias("already_seen"))
    return dedup.with_redundancy(one).withColumn("seen_entries_added", count(numbers["n_added"] if remember else 0))


def history_rows(store: SeenStore, chunk: int = dedup.CHUNK, keys: DataFrame | None = None) -> DataFrame:
    """History form of the store, or of some of its keys; all links as JSON text, ``chunk`` of them per row."""
    entries, links = (store.entries(), store.links()) if keys is None else store.of_keys(keys)
    return report.as_history(entries.join(dedup.in_chunks(links, "stored_key", ["portal", "url"], chunk), "stored_key", "left"))


def new_history(store: SeenStore, path: str) -> KeyedTable:
    return KeyedTable(store.spark, path, HISTORY_SCHEMA, "dedup_key")
