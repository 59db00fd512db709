"""What is new, what was seen before, and how the memory of it grows.

The memory is two append-only tables: ``entries`` (one row per stored key) and
``links`` (one row per alternate link).  A merge never rewrites a row, so fields that
other jobs put on an entry cannot be lost, and one posting with very many links costs
rows, not an ever longer array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators import dedup


def with_name_key(entries: DataFrame) -> DataFrame:
    """Add ``name_key``: the key of company and title, null where both are missing.

    Done once when an entry is stored, so that later runs read it instead of normalizing
    the whole memory again.
    """
    named = F.expr("coalesce(company, '') <> '' OR coalesce(title, '') <> ''")
    return (
        dedup.with_key(entries)
        .withColumn("name_key", F.when(named, F.col("dedup_key")))
        .drop("dedup_key")
    )


def known_keys(entries: DataFrame) -> DataFrame:
    """Distinct keys an entry can be recognized by.

    The stored key, and the key of company and title where either is given (entries of old
    were stored under their URL).  The distinct leaves the rows partitioned on the key,
    which the following join uses as it is.
    """
    keyed = entries if "name_key" in entries.columns else with_name_key(entries)
    return keyed.select(F.explode(F.array_compact(F.array("stored_key", "name_key"))).alias("dedup_key")).distinct()


def recognized_keys(entries: DataFrame) -> DataFrame:
    """``dedup_key, is_entry``: the same keys, and whether an entry is stored under the very key."""
    forms = F.array(F.struct(F.col("stored_key").alias("dedup_key"), F.lit(True).alias("is_entry")),
                    F.struct(F.col("name_key").alias("dedup_key"), F.lit(False).alias("is_entry")))
    return entries.select(F.inline(forms)).filter("dedup_key IS NOT NULL").groupBy("dedup_key").agg(
        F.max("is_entry").alias("is_entry"))


def new_only(pool: DataFrame, known: DataFrame) -> DataFrame:
    """Pool rows whose key is not known."""
    return pool.join(known.select("dedup_key"), "dedup_key", "left_anti")


def already_seen(pool: DataFrame, known: DataFrame) -> DataFrame:
    """Pool rows whose key is known."""
    return pool.join(known.select("dedup_key"), "dedup_key", "left_semi")


def flag_known(pool: DataFrame, known: DataFrame) -> DataFrame:
    """Both splits from one join: adds ``is_known``."""
    marked = known.select("dedup_key", F.lit(True).alias("_known"))
    return pool.join(marked, "dedup_key", "left").withColumn(
        "is_known", F.coalesce("_known", F.lit(False))
    ).drop("_known")


def new_entries(entries: DataFrame, unique: DataFrame, today: Column) -> DataFrame:
    """Rows to append to ``entries``: pool rows without an entry under their own key.

    Matched on the stored key alone: a posting known only through an old URL entry
    gains an entry under its normalized key here.
    """
    return entry_rows(unique.join(entries.select(F.col("stored_key").alias("dedup_key")), "dedup_key", "left_anti"), today)


def entry_rows(unique: DataFrame, today: Column) -> DataFrame:
    """Pool rows as entries."""
    def field(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in unique.columns else F.lit(None).cast(kind).alias(name)

    return unique.select(
        F.col("dedup_key").alias("stored_key"),
        "title", "company", "url",
        today.cast("string").alias("first_seen"),
        field("fit"),
        F.coalesce(field("status"), F.lit("new")).alias("status"),
        "portal",
        F.expr("CASE WHEN coalesce(company, '') <> '' OR coalesce(title, '') <> '' THEN dedup_key END AS name_key"),
    )


def new_links(links: DataFrame, others: DataFrame, exclude_self: DataFrame | None = None) -> DataFrame:
    """Rows to append to ``links``: alternates whose (portal, url) the key lacks.

    ``exclude_self`` (the entries) also leaves out the entry's own link, which the
    default keeps when it arrives as an alternate in a later run.
    """
    pair = F.struct("portal", "url").alias("link")
    have = links.select("stored_key", pair)
    if exclude_self is not None:
        have = have.unionByName(exclude_self.select("stored_key", pair))
    arrived = others.select(F.col("dedup_key").alias("stored_key"), pair)
    return arrived.join(have, ["stored_key", "link"], "left_anti").select(
        "stored_key", F.col("link.portal").alias("portal"), F.col("link.url").alias("url")
    )


def write_ranks(entries: DataFrame, scores: DataFrame) -> DataFrame:
    """Put rank fields on entries; a new score replaces the arrays of an old one.

    ``scores``: stored_key, rank_score, rank_verdict, strengths, gaps, status - one row
    per key.  Entries without a score pass through unchanged.
    """
    kinds = {
        "rank_score": "int", "rank_verdict": "string", "strengths": "array<string>",
        "gaps": "array<string>", "status": "string",
    }
    base = entries
    for name, kind in kinds.items():
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    incoming = scores.select("stored_key", F.struct(*kinds).alias("_s"))
    joined = base.join(incoming, "stored_key", "left")
    return joined.withColumns({
        name: F.when(F.col("_s").isNotNull(), F.col(f"_s.{name}")).otherwise(F.col(name)) for name in kinds
    }).drop("_s")


def explode_links(nested: DataFrame, key: str = "stored_key") -> DataFrame:
    """Long form of an ``also_on`` array column."""
    return nested.select(key, F.explode("also_on").alias("a")).select(
        F.col(key).alias("stored_key"), F.col("a.portal").alias("portal"), F.col("a.url").alias("url")
    )
