"""Report each posting once, over arrivals that keep coming.

The state is the seen store, which never forgets; a watermark would make old postings
new again.  The store lies in buckets of its keys, so a micro-batch shuffles its own rows
and never the memory.  A micro-batch sees only what was committed by earlier batches and
writes folders named after itself, so a retry after a failure rewrites the same rows.  A
store belongs to one checkpoint, whose batch numbers it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.cluster import workspace
from feedloom.operators import dedup, seen
from feedloom.sources.tables import SeenStore, discard


def new_postings_writer(
    store: SeenStore,
    output: str,
    order: Column,
    day: Column,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: emit the new postings of a batch, then remember them."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if prepare is None else prepare(batch)
        base = workspace(spark, f"batch-{number}")
        dedup.collapse_links(dedup.with_key(rows), order).write.parquet(f"{base}/links")
        links = spark.read.parquet(f"{base}/links")
        dedup.pick_winners(links).write.parquet(f"{base}/unique")
        unique = spark.read.parquet(f"{base}/unique")
        others = dedup.alternates(links, unique)
        store.flag(unique, before=number).write.parquet(f"{base}/flagged")
        flagged = spark.read.parquet(f"{base}/flagged")
        flagged.filter("NOT is_known").drop("link", "is_known", "has_entry").write.mode("overwrite").parquet(
            f"{output}/batch={number}")
        store.append(number, seen.entry_rows(flagged.filter("NOT has_entry"), day), store.fresh_links(others, before=number))
        discard(spark, base)

    return write


def run_available(
    arrivals: DataFrame,
    store: SeenStore,
    output: str,
    checkpoint: str,
    order: Column,
    day: Column,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Process everything that has arrived, then stop.  One query per checkpoint."""
    query = (
        arrivals.writeStream.foreachBatch(new_postings_writer(store, output, order, day, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def file_arrivals(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed files with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def reported(spark: SparkSession, output: str, store: SeenStore) -> DataFrame:
    """New postings of all committed batches."""
    last = store.commits.last()
    if last is None:
        return spark.createDataFrame([], "dedup_key STRING, batch INT")
    rows = spark.read.parquet(output)
    return rows.filter(F.col("batch") <= F.lit(-1 if last is None else last))
