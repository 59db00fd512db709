"""Collapse copies of one posting across sources.

The work is two aggregations, both with a map-side combine, so a key that holds a
third of all rows never gathers in one task:

1. ``collapse_links``  one row per (key, portal, url) - repeats of a link disappear
   before the shuffle, and the shuffle key includes the link.
2. ``pick_winners``    one row per key - each task sends at most one row per key.

The alternates of a posting stay a table of their own (``alternates``): the links that
aren't their key's winner, found by a join on the key.  The array form (``nest_alternates``) has one row per chunk of at most ``CHUNK`` alternates, numbered
from 0, so that a group of any size is complete and no task holds a whole one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.cluster import checkpointed
from feedloom.functions import text

# --- fixed values: source priority, best first ----------------------------------
PORTAL_PRIORITY = [
    "arbeitsagentur-search", "arbeitnow-search", "linkedin-search",
    "xing-search", "indeed", "freehire-search", "stepstone-search",
]
# --- end of fixed values ----------------------------------------------------------

# Alternates in one array.
CHUNK = 1000

# Alternates of a key that one task numbers; larger groups are numbered by ranges.
MOST = 200_000

# Large groups up to which they are told apart by a list of their keys, which works before any shuffle.
FEW_LARGE = 1000


def portal_rank(portal: Column, priority: list[str] | None = None) -> Column:
    """Position in the priority list; a name counts with or without ``-search``."""
    names = PORTAL_PRIORITY if priority is None else priority
    places: dict[str, int] = {}
    for at, known in enumerate(names):
        places.setdefault(known, at)
        places.setdefault(known.removesuffix("-search"), at)
    name = F.regexp_replace(F.coalesce(portal, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(places)), "map<string,int>"), name), F.lit(len(names)))


def with_key(df: DataFrame, strict: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Add ``dedup_key``; ``fields`` are the columns kept beside it (all, if not given).

    Written as separate projections so that each folding is evaluated once per row.
    """
    kept = df.columns if fields is None else fields
    title, company = F.coalesce("title", F.lit("")), F.coalesce("company", F.lit(""))
    return (
        df.withColumns({"_t": text.fold_letters(title), "_c": text.fold_letters(company)})
        .withColumns({"_t": text.fold_ligatures(F.col("_t")), "_c": text.fold_ligatures(F.col("_c"))})
        .withColumns({
            "_t": F.when(text.may_have_marker(F.col("_t")), text.title_rules(F.col("_t"), strict)).otherwise(F.col("_t")),
            "_c": text.company_rules(F.col("_c")),
        })
        .withColumn("dedup_key", F.concat(text.collapse(F.col("_c")), F.lit("|"), text.collapse(F.col("_t"))))
        .select(*kept, "dedup_key")
    )


def collapse_links(keyed: DataFrame, order: Column, priority: list[str] | None = None) -> DataFrame:
    """One row per (dedup_key, link): its place, the rest of its best record, and the rows behind it.

    ``order`` is the arrival order (any orderable column or struct).  A value travels once: the
    portal and the url as the link, the order - where it is a column of the rows, under its name -
    in the place, and only what is left in ``record``.  The portal's rank is looked up afterwards,
    as it is one for the whole link.
    """
    ordered = keyed.select(order)
    name = ordered.columns[0]
    name = name if name in keyed.columns and ordered.sameSemantics(keyed.select(name)) else "_order"
    rest = [c for c in keyed.columns if c not in ("dedup_key", "portal", "url", name)]
    first = F.struct(F.col("_order").alias(name), *([F.struct(*rest).alias("record")] if rest else []))
    return (
        keyed.withColumn("_order", order)
        .select("dedup_key", F.expr("struct(portal, url) AS link"), "_order", first.alias("_first"))
        .groupBy("dedup_key", "link")
        .agg(F.min_by("_first", "_order").alias("_first"), F.count(F.lit(1)).alias("n_rows"))
        .select(
            "dedup_key", "link",
            F.struct(portal_rank(F.col("link.portal"), priority).alias("rank"), F.col(f"_first.`{name}`").alias(name)).alias("place"),
            *(["_first.record"] if rest else []), "n_rows")
    )


def _order_name(links: DataFrame) -> str:
    return links.schema["place"].dataType.names[1]


def pick_winners(links: DataFrame) -> DataFrame:
    """One row per key: the record with the best source, first arrived among equals."""
    name, rest = _order_name(links), ["record"] if "record" in links.columns else []
    return (
        links.groupBy("dedup_key")
        .agg(
            F.min_by(F.struct("link", "place", *rest), "place").alias("best"),
            F.sum("n_rows").alias("n_rows"),
            (F.count(F.lit(1)) - 1).alias("n_alternates"),
        )
        .select(
            "dedup_key", *([] if name == "_order" else [F.col(f"best.place.`{name}`").alias(name)]),
            "best.link.portal", "best.link.url", *[f"best.{r}.*" for r in rest], "best.link", "n_rows", "n_alternates")
    )


def alternates(links: DataFrame, winners: DataFrame) -> DataFrame:
    """The other links of each key, one row each, with their place in the group.

    They meet the winners on the key alone, so numbering them within it moves nothing again.
    """
    taken = winners.select("dedup_key", F.col("link").alias("_taken"))
    return links.select("dedup_key", "link", "place").join(taken, "dedup_key", "left").filter(
        ~F.col("link").eqNullSafe(F.col("_taken"))
    ).select(
        "dedup_key", "link.portal", "link.url", "place.rank", F.col(f"place.`{_order_name(links)}`").alias("arrival")
    )


def number_in_group(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``place``: the position of a row within its key, from 0.

    The rows are range-partitioned by key and order and kept on shared storage.  A key may
    span several ranges; only such keys need the counts of earlier ranges, and there are at
    most as many of them as ranges, so they are broadcast.
    """
    keys = [F.col(key), *[F.col(c) for c in order]]
    ranged = checkpointed(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spanning = sizes.withColumn("_before", F.sum("_size").over(earlier)).filter("_before > 0").drop("_size")
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*keys[1:]))
    return (
        ranged.withColumn("_at", inside)
        .join(F.broadcast(spanning), [key, "_part"], "left")
        .withColumn("place", F.col("_at") - 1 + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_at", "_before")
    )


def _listed(numbered: DataFrame, key: str, chunk: int) -> DataFrame:
    return (
        numbered.groupBy(key, F.floor(F.col("place") / chunk).cast("int").alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "portal", "url"))).alias("_ordered"))
        .select(key, "chunk_no", F.transform(
            "_ordered", lambda a: F.struct(a["portal"].alias("portal"), a["url"].alias("url"))).alias("also_on"))
    )


def _chunked(rows: DataFrame, key: str, order: list[str], chunk: int) -> DataFrame:
    """Numbered and listed within one partitioning by key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return _listed(rows.withColumn("place", place), key, chunk)


def _by_size(hot: DataFrame, key: str) -> Callable[[DataFrame, bool], DataFrame] | None:
    """A function giving the rows of large groups, or all others; None where no group is large."""
    few = [r[0] for r in hot.limit(FEW_LARGE + 1).collect()]
    if not few:
        return None
    if len(few) > FEW_LARGE:
        return lambda df, large: df.join(F.broadcast(hot), key, "left_semi" if large else "left_anti")
    is_large = F.coalesce(F.col(key).isin(few), F.lit(False))
    return lambda df, large: df.filter(is_large if large else ~is_large)


def in_chunks(rows: DataFrame, key: str, order: list[str], chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """``key, chunk_no, also_on``: all links of a key in order, at most ``chunk`` per row.

    Keys of more than ``most`` links, of which there are few, are numbered by ranges; of all
    others a task holds whole keys, which takes a single shuffle.
    """
    rows = rows.select(key, *dict.fromkeys([*order, "portal", "url"]))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).filter(F.col(key).isNotNull())
    hot = checkpointed(sizes.select(key))
    part = _by_size(hot, key)
    if part is None:
        return _chunked(rows, key, order, chunk)
    large = number_in_group(part(rows, True), key, order)
    return _chunked(part(rows, False), key, order, chunk).unionByName(_listed(large, key, chunk))


def nest_alternates(winners: DataFrame, others: DataFrame, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """Winners with ``also_on`` as an array in (rank, arrival) order.

    A winner with more than ``chunk`` alternates has a row per chunk, ``chunk_no`` 0, 1, ...;
    every other winner has one row, with a null array where there is no alternate.  Which keys have
    more than ``most`` alternates (see ``in_chunks``) is known from the winners.
    """
    order = ["rank", "arrival", "portal", "url"]
    rows = others.select("dedup_key", *order)
    hot = checkpointed(winners.filter(F.col("n_alternates") > most).select("dedup_key"))
    first = lambda nested: nested.withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0)))
    part = _by_size(hot, "dedup_key")
    if part is None:
        return first(winners.join(_chunked(rows, "dedup_key", order, chunk), "dedup_key", "left"))
    small = _chunked(part(rows, False), "dedup_key", order, chunk)
    large = _listed(number_in_group(part(rows, True), "dedup_key", order), "dedup_key", chunk)
    return first(part(winners, False).join(small, "dedup_key", "left").unionByName(
        part(winners, True).join(large, "dedup_key", "left")))


def pool_stats(winners: DataFrame) -> DataFrame:
    """One row: input records, unique postings, collapsed, redundancy in percent.

    With an ``is_known`` column also how many are new and how many were seen before.
    """
    n_in, n_out = F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1))
    split = []
    if "is_known" in winners.columns:
        split = [F.count_if(~F.col("is_known")).alias("new"), F.count_if("is_known").alias("already_seen")]
    return with_redundancy(winners.agg(n_in.cast("long").alias("input_records"), n_out.alias("unique_jobs"), *split))


def with_redundancy(stats: DataFrame) -> DataFrame:
    """Add how many records were collapsed, and their share."""
    return (
        stats.withColumn("duplicates_collapsed", F.col("input_records") - F.col("unique_jobs"))
        .withColumn("redundancy_pct", redundancy_pct(F.col("duplicates_collapsed"), F.col("input_records")))
    )


def redundancy_pct(collapsed: Column, total: Column) -> Column:
    """Share in percent, one decimal, half to even; 0.0 for an empty pool."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * collapsed / F.nullif(total, F.lit(0)), 1))
