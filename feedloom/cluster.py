"""Session defaults, shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import math
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side must be under both bounds; anything larger is left to Spark's own
# measured choice (adaptive execution splits skewed partitions of the join instead).
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 * 1024 * 1024

# Rows of a narrow scan that one task takes (``spread``).
TASK_ROWS = 1_500_000

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The expressions here are built by many small calls; recording a stack for each of
    # them is most of the time it takes to put a plan together.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for.

    On a cluster, pass ``spark.checkpoint.dir`` (a folder every executor reaches).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders made by ``workspace`` and not removed yet, by application.
_MADE: dict[str, list[str]] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor reaches.

    Only where none is configured (tests, a laptop) a folder in the warehouse is used, which is
    shared as well; in local mode it is removed when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/feedloom-{spark.sparkContext.applicationId}"
    spark.sparkContext.setCheckpointDir(base)
    if spark.sparkContext.master.startswith("local"):
        atexit.register(shutil.rmtree, base.removeprefix("file:"), ignore_errors=True)
    return base


@contextmanager
def passing_workspaces(spark: SparkSession) -> Iterator[None]:
    """Workspaces made in the block are removed at its end.

    For blocks whose results are written elsewhere and don't read their intermediates any more.
    """
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del made[before:]


# Whether Spark removes the shuffle files of a statement when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in the block go when each write has ended.

    Otherwise they stay until the driver happens to collect the plan as garbage.  A plan that was
    run in the block and is run again afterwards shuffles again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize once on shared storage and cut the lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Count at most ``rows + 1`` rows and add up their size as JSON."""
    seen = (
        df.limit(rows + 1)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes"),
        )
        .first()
    )
    return seen["rows"] <= rows and seen["bytes"] <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it.

    ``df`` is kept on shared storage first, so measuring doesn't compute it a second time.
    """
    df = checkpointed(df)
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


def spread(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Repartition a scan that has fewer splits than the session has cores.

    For small or single-file inputs ahead of heavy per-row work.  Large inputs have many
    splits and are returned unchanged, without a shuffle.

    Narrow rows pack so well that a split may hold many millions of them, which a task can't sort
    in its memory once they have grown wide.  With ``by`` (columns that tell rows apart) such a
    scan is dealt into parts of at most about ``TASK_ROWS``; counting it reads only the files' footers.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if by is not None and (needed := math.ceil(df.count() / TASK_ROWS)) > max(parts, cores):
        return df.repartition(needed, *by)
    return df.repartition(cores) if parts < cores else df
