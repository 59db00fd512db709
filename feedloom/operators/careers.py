"""Application tracking: follow-ups, outcomes, skill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
NUDGE_DAYS = 10
STALE_DAYS = 30
MAX_FOLLOWUPS = 2
STAGES = ["Phone screen", "Technical interview", "Case interview", "Final round", "Offer received"]
OUTCOME_STATUSES = ["in_progress", "hired", "offer_declined", "rejected", "no_response", "interview_only"]
# --- end of fixed values ------------------------------------------------------------


def follow_ups(applications: DataFrame, today: Column) -> DataFrame:
    """Add ``days_quiet``, ``nudge_due`` and ``stale`` to open applications."""
    quiet = F.datediff(today, F.col("last_contact"))
    return applications.withColumns({
        "days_quiet": quiet,
        "nudge_due": (quiet >= NUDGE_DAYS) & (F.coalesce("followups", F.lit(0)) < MAX_FOLLOWUPS),
        "stale": quiet >= STALE_DAYS,
    })


def gap_sources(tracked: DataFrame, ranked: DataFrame) -> DataFrame:
    """Tracked applications and ranked postings as one list of gap holders.

    Both: company, role, gaps ARRAY<STRING>, provenance, weight DOUBLE.  One row per
    company and role, ignoring case; recorded gaps beat inferred ones, then tracked rows
    beat ranked ones.
    """
    both = tracked.withColumn("source", F.lit("tracked")).unionByName(ranked.withColumn("source", F.lit("ranked")))
    place = F.struct(
        F.when(F.col("provenance") == "recorded", 0).otherwise(1).alias("a"),
        F.when(F.col("source") == "tracked", 0).otherwise(1).alias("b"),
        F.col("company").alias("c"), F.col("role").alias("d"), F.array_join("gaps", "\x00").alias("e"),
        F.col("weight").alias("f"),
    )
    row = F.struct("company", "role", "gaps", "provenance", "weight", "source")
    return (
        both.groupBy(F.lower("company").alias("_c"), F.lower("role").alias("_r"))
        .agg(F.min_by(row, place).alias("r")).select("r.*")
    )


def tracked_weight(fit_rating: Column) -> Column:
    return (F.lit(100.0) - fit_rating) / 100


def ranked_weight(rank_score: Column) -> Column:
    return (F.lit(100.0) - rank_score) / 100


def skill_gaps(holders: DataFrame) -> DataFrame:
    """Per skill (ignoring case): summed weight, holders, provenance."""
    return (
        holders.select("weight", "provenance", F.explode("gaps").alias("skill"))
        .groupBy(F.lower("skill").alias("skill"))
        .agg(
            F.sum("weight").alias("weight"),
            F.count(F.lit(1)).alias("holders"),
            F.max((F.col("provenance") == "recorded").cast("int")).alias("recorded"),
            F.max((F.col("provenance") == "inferred").cast("int")).alias("inferred"),
        )
    )


def gap_header(holders: DataFrame) -> DataFrame:
    """How many rows of either source stand behind the gaps."""
    n = holders.agg(
        F.count_if(F.col("source") == "tracked").alias("tracked"), F.count_if(F.col("source") == "ranked").alias("ranked")
    )
    return n.withColumn("header", F.format_string("%d tracked, %d ranked", "tracked", "ranked"))


def outcome_funnel(outcomes: DataFrame) -> DataFrame:
    """Applications per status and how many of them reached each stage."""
    def reached(stage: str) -> Column:
        name = stage.lower().replace(" ", "_")
        return F.count_if(F.coalesce(F.try_element_at("stages", F.lit(stage)), F.lit(False))).alias(name)

    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("applications"), *[reached(s) for s in STAGES])
