"""Row filters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.cluster import bounded_broadcast
from feedloom.functions import names, text

# --- fixed values -----------------------------------------------------------------
MIN_SCORE = 30
MODERATE_FIT = 45
PROBLEM_STATUSES = ["failed", "missing"]
OPEN_STATUS = "in_progress"
RECENT_DAYS = 7
# --- end of fixed values ------------------------------------------------------------


def normalized_terms(terms: Column) -> Column:
    """Normalize a term list once, on the profile side."""
    return F.transform(terms, lambda t: text.normalize_title(t))


def blank_terms(terms: Column) -> Column:
    """Terms that normalize to nothing and therefore match every title."""
    return F.filter(terms, lambda t: text.normalize_title(t) == "")


def blocked(title_norm: Column, terms: Column) -> Column:
    """True when any normalized term is inside the normalized title."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(title_norm, t)), F.lit(False))


def allowed(title_norm: Column, terms: Column) -> Column:
    """True when there are no terms or any of them is inside the title."""
    return (F.coalesce(F.size(terms), F.lit(0)) <= 0) | blocked(title_norm, terms)


def flag_titles(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add ``keep`` to postings from the block and allow lists of their profile.

    ``postings.profile`` refers to ``profiles.id``.  Profiles are a configuration table,
    joined by broadcast when measured small enough, otherwise as Spark sees fit.
    """
    lists = profiles.select(
        F.col("id").alias("profile"),
        normalized_terms(F.col("exclude_titles")).alias("_out"),
        normalized_terms(F.col("require_any")).alias("_in"),
    )
    normed = postings.withColumn("_norm", text.normalize_title(F.col("title")))
    return (
        normed.join(bounded_broadcast(lists), "profile", "left")
        .withColumn("keep", ~blocked(F.col("_norm"), F.col("_out")) & allowed(F.col("_norm"), F.col("_in")))
        .drop("_norm", "_out", "_in")
    )


def _any_literal(title_norm: Column, terms: list[str]) -> Column:
    """Literal terms normalize to constants, so the plan holds plain ``contains``."""
    return reduce(or_, [F.contains(title_norm, text.normalize_title(F.lit(t))) for t in terms])


def keep_titles(postings: DataFrame, exclude: list[str] | None = None, require: list[str] | None = None) -> DataFrame:
    """The same two filters with literal term lists."""
    def kept(norm: Column) -> Column:
        out = ~_any_literal(norm, exclude) if exclude else F.lit(True)
        return out & _any_literal(norm, require) if require else out

    # As the argument of a lambda the title is normalized once, however many terms there are.
    return postings.filter(names.once(text.normalize_title(F.col("title")), kept))


def in_city(city: Column, wanted: Column) -> Column:
    """City contains the wanted text, as written or in plain spelling; "" = any."""
    have, want = F.lower(F.coalesce(city, F.lit(""))), F.lower(F.coalesce(wanted, F.lit("")))
    return (want == "") | F.contains(have, want) | F.contains(names.anglicize(have), names.anglicize(want))


def problems(report: DataFrame) -> DataFrame:
    """Report rows that need attention."""
    return report.filter(F.col("status").isin(PROBLEM_STATUSES))


def recent(history: DataFrame, today: Column, days: int = RECENT_DAYS) -> DataFrame:
    """First seen within the last days, newest first.

    ``first_seen`` is ISO text and compared as text, which is date order.
    """
    since = F.date_format(F.date_sub(today, days), "yyyy-MM-dd")
    return history.filter(F.col("first_seen") >= since).orderBy(F.desc("first_seen"))


def moderate_fit(ranked: DataFrame, floor: int = MODERATE_FIT) -> DataFrame:
    """Ranked entries worth learning from; unranked ones drop out."""
    return ranked.filter(F.col("rank_score") >= floor)


def resolved(outcomes: DataFrame) -> DataFrame:
    """Applications with a final status."""
    return outcomes.filter(F.col("status") != OPEN_STATUS)


def check_text_layer(
    df: DataFrame,
    expected_pages: int | None = None,
    min_chars: int = 1,
    required: tuple[str, ...] = (),
    text_col: str = "text",
    pages_col: str = "pages",
) -> DataFrame:
    """Add ``failure``: the first failed check of each text, null when all pass.

    Order: page count, number of characters, required phrases as given.
    """
    flat = df.withColumn("_flat", text.collapse_whitespace(F.coalesce(F.col(text_col), F.lit(""))))
    length = F.length("_flat")
    checks = []
    if expected_pages is not None:
        checks.append(F.when(
            ~F.col(pages_col).eqNullSafe(F.lit(expected_pages)),
            F.concat(F.lit(f"expected {expected_pages} page(s), found "), F.coalesce(F.col(pages_col).cast("string"), F.lit("none"))),
        ))
    checks.append(F.when(
        length < min_chars,
        F.concat(F.lit("text layer has "), length.cast("string"), F.lit(f" character(s); expected at least {min_chars}")),
    ))
    for phrase in required:
        wanted = " ".join(phrase.split())
        checks.append(F.when(
            ~F.contains(F.col("_flat"), F.lit(wanted)), F.lit(f"text layer is missing required text: {phrase!r}")
        ))
    return flat.withColumn("failure", F.coalesce(*checks)).withColumn("n_flat", length).drop("_flat")
