"""Mixing sources to target weights by Pareto order sampling (built-in functions only).

Every source has a target in words.  A source of ``S`` words with target ``t`` needs each of
its documents ``r = t / S`` times: ``floor(r)`` whole copies are certain, and the rest is one
more copy of some documents.  Which ones is a Pareto order sample: documents are ranked by

    (U / (1 - U)) / (p / (1 - p))

with ``U`` a uniform number from a hash of the document and ``p`` its inclusion probability,
and taken from the front until the words that are still due are reached.  ``p`` grows with
the length of the document (``size ** tilt``), so the samples have unequal probabilities; a
document whose ``p`` would pass 1 is certain too.

Nothing is ordered as a whole.  A histogram over the rank finds the interval in which a source
reaches its target, and only the rows of that interval are sorted.  The result is one row of
parameters per source, so whether a document is taken is an expression on its own row.

Defined cases: a null text has size 0; a document of size 0 takes no words; a null source is
a source of its own and comes last; equal rows get equal decisions; an empty table gives an
empty mix; columns of any name ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import WORD, attach, key_of, numbered, scratch

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
TILT = 0.5
SEED = 20_240
# Intervals of the rank; only the rows of one interval of a source are ever sorted.
INTERVALS = 4096
# Documents are weighed by their length to a quarter of an octave.
STEPS = 4


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Weights go round over the sources by code point, null last.  A target stops at
    ``max_copies`` times the source; what it can't take is shared again by weight until no
    target is above.  Each round is one aggregation over the sources.
    """
    totals = scratch(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = scratch(placed.select("source", "source_size", weight.alias("_weight")), "weights")
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    if whole["weight"] is None:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    due = share * whole["words"]
    unit, closed_before = due / whole["weight"], -1
    while True:
        closed = F.col("_weight") * F.lit(unit) > F.col("source_size") * max_copies
        now = weighed.agg(
            F.count_if(closed).alias("closed"),
            F.coalesce(F.sum(F.when(closed, F.col("source_size") * max_copies)), F.lit(0)).alias("full"),
            F.sum(F.when(~closed, F.col("_weight"))).alias("open"),
        ).first()
        if now["closed"] == closed_before or now["open"] is None:
            break
        unit, closed_before = (due - now["full"]) / now["open"], now["closed"]
    target = F.least(F.col("_weight") * F.lit(unit), F.col("source_size") * F.lit(float(max_copies)))
    return weighed.select("source", "source_size", target.alias("target"))


def _level(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * STEPS).cast("int")


def _measure(level: Column, tilt: float) -> Column:
    return F.pow(F.lit(2.0), level * F.lit(tilt / STEPS))


def _rank(params_scale: Column, size: Column, uniform: Column, tilt: float) -> Column:
    """The Pareto ratio q as q / (1 + q), which keeps its order and lies in 0..1."""
    p = F.least(F.lit(1.0), params_scale * _measure(_level(size), tilt))
    return uniform * (1 - p) / (uniform * (1 - p) + (1 - uniform) * p)


def _interval(rank: Column) -> Column:
    """Certain documents stand before the first interval."""
    return F.when(rank <= 0, F.lit(-1)).otherwise(
        F.least(F.floor(rank * INTERVALS), F.lit(INTERVALS - 1))).cast("int")


def mix_parameters(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0,
                   max_copies: int = MAX_COPIES, tilt: float = TILT) -> DataFrame:
    """One row per source from rows of ``source, size, uniform`` (a stored table).

    ``_key, source_size, target, _whole`` (certain copies), ``_scale`` (factor of the
    inclusion probability), ``_cut`` (interval of the rank in which the target is reached) and
    ``_last`` (rank of the last document taken there).
    """
    targets = source_targets(sizes.select("source", "size"), weights, share, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = scratch(
        targets.select(key_of("source").alias("_key"), "source_size", "target", F.floor(ratio).alias("_whole"))
        .withColumn("_due", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")

    # The factor of the probability: the longest levels are certain, the others share the rest.
    levels = (
        sizes.groupBy(key_of("source").alias("_key"), _level(F.col("size")).alias("_level"))
        .agg(F.sum("size").alias("_words"))
    )
    down = Window.partitionBy("_key").orderBy(F.desc("_level"))
    measure = _measure(F.col("_level"), tilt)
    longer = F.coalesce(F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(measure * F.col("_words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scales = (
        attach(levels, base.select("_key", "_due"), "_key")
        .withColumn("_longer", longer).withColumn("_rest", rest)
        .withColumn("_scale", F.when(F.col("_rest") > 0, (F.col("_due") - F.col("_longer")) / F.col("_rest")))
        .filter((F.col("_scale") >= 0) & (F.col("_scale") * measure <= 1))
        .groupBy("_key").agg(F.max_by("_scale", "_level").alias("_scale"))
    )
    scaled = scratch(
        base.join(scales, "_key", "left").withColumn("_scale", F.coalesce("_scale", F.lit(0.0))), "scales")

    # Where in the rank each source reaches its target; whole copies may do, and empty rows take no place.
    short = F.col("_due") > 0
    ranked = (
        attach(sizes.filter(F.col("size") > 0).select(key_of("source").alias("_key"), "size", "uniform"),
               scaled.filter(short).select("_key", "_scale"), "_key")
        .withColumn("_rank", _rank(F.col("_scale"), F.col("size"), F.col("uniform"), tilt))
        .withColumn("_interval", _interval(F.col("_rank")))
    )
    along = Window.partitionBy("_key").orderBy("_interval")
    reached = (
        ranked.groupBy("_key", "_interval").agg(F.sum("size").alias("_words"))
        .withColumn("_upto", F.sum("_words").over(along))
        .join(scaled.select("_key", "_due"), "_key")
        .filter(F.col("_upto") >= F.col("_due"))
        .groupBy("_key").agg(F.min_by(F.struct(
            F.col("_interval").alias("_cut"), (F.col("_due") - F.col("_upto") + F.col("_words")).alias("_left")),
            "_interval").alias("_at"))
        .select("_key", "_at.*")
    )
    cuts = scratch(
        scaled.join(reached, "_key", "left").withColumn(
            "_cut", F.when(short, F.coalesce("_cut", F.lit(INTERVALS))).otherwise(F.lit(-1))), "cuts")

    # Inside that interval the rows are sorted; the sum that comes nearest to the target wins.
    inside = Window.partitionBy("_key").orderBy("_rank", "uniform").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        attach(ranked, cuts.select("_key", F.col("_cut").alias("_interval"), "_left"), ["_key", "_interval"])
        .withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .filter(F.col("_before") + F.col("size") / 2 <= F.col("_left"))
        .groupBy("_key").agg(F.max("_rank").alias("_last"))
    )
    return scratch(
        cuts.join(last, "_key", "left")
        .select("_key", "source_size", "target", "_whole", "_scale", "_cut", "_last"), "mix")


def sized(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``row`` (all columns), ``source``, ``size`` and a uniform number for every document."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], F.lit(SEED)), 11)
    return docs.select(
        F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        ((bits.cast("double") + 0.5) / F.lit(2.0 ** 53)).alias("uniform"))


def apply_mix(rows: DataFrame, params: DataFrame, tilt: float = TILT) -> DataFrame:
    """``row, size, source_size, target, copies`` of every row of ``sized``."""
    joined = attach(rows.withColumn("_key", key_of("source")), params, "_key")
    rank = _rank(F.col("_scale"), F.col("size"), F.col("uniform"), tilt)
    extra = (_interval(rank) < F.col("_cut")) | ((_interval(rank) == F.col("_cut")) & (rank <= F.col("_last")))
    copies = F.col("_whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _decided(docs: DataFrame, text: str, source: str, tilt: float, **options) -> DataFrame:
    rows = sized(docs, text, source)
    table = scratch(rows.select("source", "size", "uniform"), "sizes")
    return apply_mix(rows, mix_parameters(table, tilt=tilt, **options), tilt)


def mix(docs: DataFrame, text: str = "text", source: str = "source", tilt: float = TILT, **options) -> DataFrame:
    """Every document with ``size, source_size, target`` and ``copies``, how often the mix takes it (0 too).

    Columns of ``docs`` with one of these names are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    kept = [c for c in docs.columns if c.lower() not in added]
    return _decided(docs, text, source, tilt, **options).select(*[F.col(f"row.`{c}`") for c in kept], *added)


def mixed(docs: DataFrame, text: str = "text", source: str = "source", tilt: float = TILT, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    taken = _decided(docs, text, source, tilt, **options).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
