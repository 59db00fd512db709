"""Helpers the operators share: scratch tables, size-checked joins, positions, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.cluster import fits_broadcast, workspace

# Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Used where a table is read several times or where lineage should end: files on shared
    storage survive the loss of executors.
    """
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is usually small: broadcast only after measuring it.

    Beyond the bound Spark joins by shuffle, and adaptive execution splits a hot key.
    """
    return rows.join(F.broadcast(small) if fits_broadcast(small) else small, on, how)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def key_of(column: str) -> Column:
    """A string that is equal for equal values and never null."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based positions in the order given, without one task that sees every row.

    The order has to be total.  Rows are range-partitioned and written; the counts of the
    partitions (one row for each) give every partition its first position.
    """
    parts = scratch(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    offsets = (
        parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + inside - 1).cast("long")).drop("_part", "_before")
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, digest: Column, n: int) -> DataFrame:
    """About ``n`` rows and never more, chosen by a hash, so that reruns agree.

    The rows are counted first, and only those below the matching hash go on; no task ever
    holds or sends more than its part of the sample.
    """
    total = rows.count()
    if total > n:
        rows = rows.filter(F.shiftrightunsigned(digest, 1) < int(2 ** 63 * n / total))
    return rows.orderBy(digest).limit(n)
