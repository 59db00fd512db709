"""Exact duplicates by skew-safe combining.

Rows are combined three times, and the full content is a grouping key each time:

1. inside a task, by content (Spark's partial aggregation);
2. by (digest, salt, content), where the salt is the task a row comes from, so the copies of
   one text arrive as one row per task, spread over the salts;
3. by (digest, content) over the winners of the salts, for digests found under several salts
   only; all others are complete.

Rows then look up their group by digest.  Where one digest stands for different contents (it
never does with SHA-256, but the digest is a parameter), the content decides there too.

Defined cases: a null text counts as empty; a null id comes after every other; rows that
repeat an id count each and are kept with it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import attach, scratch, text_or_empty

SALTS = 64


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def content_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``digest, content, keep_id, group_size, several`` from ``id, digest, content``.

    ``several`` marks a digest with more than one content; only there is the content kept.
    """
    def combined(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys, "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    salted = scratch(combined(
        rows.select("digest", (F.spark_partition_id() % salts).alias("salt"), "content",
                    F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")),
        "digest", "salt"), "salted")
    split = scratch(
        salted.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("digest"), "split")
    alone = attach(salted, split, "digest", "left_anti").select(
        "digest", F.lit(None).cast("string").alias("content"), "keep_id", "group_size", F.lit(False).alias("several"))
    merged = scratch(combined(attach(salted, split, "digest", "left_semi"), "digest"), "merged")
    contents = merged.groupBy("digest").agg((F.count(F.lit(1)) > 1).alias("several"))
    together = merged.join(contents, "digest").select(
        "digest", F.when(F.col("several"), F.col("content")).alias("content"), "keep_id", "group_size", "several")
    return alone.unionByName(together)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``."""
    rows = docs.select(F.col(doc_id).alias("id"), normalised(text).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    groups = scratch(content_groups(rows, salts), "groups")
    clashes = scratch(groups.filter("several").select("digest").distinct(), "clashes")
    wanted = attach(rows, clashes.withColumn("_clash", F.lit(True)), "digest", "left").select(
        "id", "digest", F.when(F.col("_clash"), F.col("content")).alias("content"))
    found = wanted.alias("a").join(
        groups.drop("several").alias("b"),
        (F.col("a.digest") == F.col("b.digest"))
        & (F.coalesce("a.content", F.lit("")) == F.coalesce("b.content", F.lit(""))))
    return found.select(
        F.col("a.id").alias("doc_id"), "keep_id", "group_size",
        F.col("a.id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("a.digest").alias("digest"))
