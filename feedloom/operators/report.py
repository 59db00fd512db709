"""Run reports, digests, source health, history questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import text

UNASSIGNED = "unassigned"
NONE_MARK = "—"


def run_report(
    profiles: DataFrame,
    pairs: DataFrame,
    portals: DataFrame,
    landed: DataFrame,
    postings: DataFrame,
    dry_run: bool = False,
    only: str | None = None,
) -> DataFrame:
    """Status per (profile, portal), with rows returned and kept.

    profiles  id, enabled
    pairs     profile, portal (the fan-out of the profiles in use)
    portals   portal, enabled - a portal without a row is missing
    landed    profile, portal, error - one row per request made
    postings  profile, portal, keep - the rows of the requests
    """
    counts = postings.groupBy("profile", "portal").agg(
        F.count(F.lit(1)).alias("returned"), F.count_if("keep").alias("kept")
    )
    known = portals.select("portal", F.coalesce("enabled", F.lit(True)).alias("_on"))
    made = landed.select("profile", "portal", "error", F.lit(True).alias("_made"))
    failed = F.coalesce("error", F.when(F.col("_made").isNull(), F.lit("no result landed")))
    status = F.when(F.col("_on").isNull(), "missing").when(~F.col("_on"), "disabled")
    status = status.when(F.lit(True), "dry-run") if dry_run else status.when(failed.isNotNull(), "failed").otherwise("ok")
    rows = (
        pairs.select("profile", "portal").distinct()
        .join(known, "portal", "left")
        .join(made, ["profile", "portal"], "left")
        .join(counts, ["profile", "portal"], "left")
        .withColumn("status", status)
        .withColumn("detail", F.when(F.col("status") == "missing", F.lit("not installed")).when(F.col("status") == "failed", failed))
        .select(
            "profile", "portal", "status", "detail",
            F.when(F.col("status") == "ok", F.coalesce("returned", F.lit(0))).alias("returned"),
            F.when(F.col("status") == "ok", F.coalesce("kept", F.lit(0))).alias("kept"),
        )
    )
    if only is not None:
        return rows
    none = F.lit(None)
    off = profiles.filter(~F.coalesce("enabled", F.lit(True))).select(
        F.col("id").alias("profile"), none.cast("string").alias("portal"), F.lit("disabled").alias("status"),
        none.cast("string").alias("detail"), none.cast("long").alias("returned"), none.cast("long").alias("kept"),
    )
    return rows.unionByName(off)


def by_profile(postings: DataFrame, order: Column) -> DataFrame:
    """Group sizes per profile, and the arrival of the first row for sorting."""
    name = F.coalesce(text.or_empty_as_null(F.col("profile")), F.lit(UNASSIGNED))
    return postings.groupBy(name.alias("profile")).agg(F.count(F.lit(1)).alias("jobs"), F.min(order).alias("first_arrival"))


def digest_rows(postings: DataFrame, escape: bool = True) -> DataFrame:
    """Display fields of a digest, defaults filled in, escaped for HTML when asked."""
    def shown(c: Column, default: str) -> Column:
        filled = F.coalesce(text.or_empty_as_null(c), F.lit(default))
        return text.escape_html(filled) if escape else filled

    names = F.array_join(
        F.transform("also_on", lambda a: F.coalesce(text.or_empty_as_null(a["portal"]), F.lit("?"))), ", "
    )
    note = F.when(F.size("also_on") > 0, F.concat(F.lit("also on "), names))
    url = F.coalesce("url", F.lit(""))
    return postings.withColumns({
        "profile": F.coalesce(text.or_empty_as_null(F.col("profile")), F.lit(UNASSIGNED)),
        "title": shown(F.col("title"), "(untitled)"),
        "company": shown(F.col("company"), NONE_MARK),
        "location": shown(F.col("location"), NONE_MARK),
        "portal": shown(F.col("portal"), NONE_MARK),
        "url": text.escape_html(url) if escape else url,
        "also_note": text.escape_html(note) if escape else note,
    })


def digest_line(c_title: Column, c_company: Column, c_location: Column, c_portal: Column) -> Column:
    """Plain-text line of one posting."""
    return F.concat(
        F.lit("  - "), c_title, F.lit(" — "), c_company, F.lit(" — "), c_location, F.lit(" ["), c_portal, F.lit("]")
    )


def heads(history: DataFrame) -> DataFrame:
    """One row per entry: further chunks of links left out."""
    return history.filter("chunk_no = 0") if "chunk_no" in history.columns else history


def per_portal(history: DataFrame) -> DataFrame:
    return heads(history).groupBy("portal").agg(F.count(F.lit(1)).alias("n"))


def top_companies(history: DataFrame, k: int = 10) -> DataFrame:
    """Companies with most postings, no name as one of them; equal counts in name order."""
    return (
        heads(history).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("company")).limit(k)
    )


def source_health(reports: DataFrame) -> DataFrame:
    """Sources that answer fine but return nothing, over the history of run reports."""
    silent = (F.col("status") == "ok") & (F.col("returned") == 0)
    return reports.groupBy("portal").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(silent).alias("silent"),
        F.count_if(F.col("status").isin("failed", "missing")).alias("broken"),
        F.max(F.when((F.col("status") == "ok") & (F.col("returned") > 0), F.col("date"))).alias("last_result"),
    )


def newest_first(history: DataFrame, k: int) -> DataFrame:
    return heads(history).orderBy(F.desc("first_seen"), F.asc("stored_key")).limit(k)


def shortlist(entries: DataFrame, k: int) -> DataFrame:
    """New entries that have no rank yet, newest first."""
    return newest_first(entries.filter(F.col("rank_score").isNull() & (F.col("status") == "new")), k)


def cap_per_request(postings: DataFrame, limit: int, order: Column, max_age: int | None = None, today: Column | None = None) -> DataFrame:
    """At most ``limit`` rows per (profile, portal), optionally not older than ``max_age`` days.

    Each task drops rows beyond the limit before the shuffle (group limit), so a request
    with very many rows stays cheap.
    """
    rows = postings
    if max_age is not None:
        rows = rows.filter(F.col("date") >= F.date_sub(today, max_age))
    window = Window.partitionBy("profile", "portal").orderBy(order)
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= limit)


def as_history(entries: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """History rows: nested values as JSON text, null where there is nothing.

    An entry with several chunks of links has several rows; ``chunk_no`` 0 stands for it.
    """
    chunk = F.coalesce("chunk_no", F.lit(0)) if "chunk_no" in entries.columns else F.lit(0)
    also = F.when(F.size("also_on") > 0, F.to_json("also_on")) if "also_on" in entries.columns else F.lit(None).cast("string")
    return entries.select(
        F.col("stored_key").alias("dedup_key"), "title", "company", "url", "portal", "first_seen", "status",
        F.to_json("fit").alias("fit") if dict(entries.dtypes)["fit"] not in ("string",) else F.col("fit"),
        also.alias("also_on"), chunk.cast("int").alias("chunk_no"),
    )


def upsert(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace rows of the same key whole; other rows stay."""
    return history.join(incoming.select("dedup_key"), "dedup_key", "left_anti").unionByName(incoming)


def keep_dates(rows: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Rows of runs at most ``days`` old; a partition filter on ``date``."""
    return rows.filter(F.col("date") >= F.date_sub(today, days))
