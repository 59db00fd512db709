"""Search profiles: checks, source fan-out, layered request parameters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.filters import blank_terms

# --- fixed values: parameter names per source ------------------------------------
LOGICAL_FIELDS = ["query", "location", "jobage", "limit"]
MAPPED_PORTALS = [
    "arbeitsagentur-search", "arbeitnow-search", "stepstone-search",
    "xing-search", "linkedin-search", "freehire-search",
]
LOCATION_FLAG = {"freehire-search": "--city"}
LOCATION_REQUIRED = ["linkedin-search"]
# --- end of fixed values -----------------------------------------------------------

PROFILE_SCHEMA = (
    "id STRING, enabled BOOLEAN, query STRING, location STRING, portals ARRAY<STRING>, "
    "portal_overrides MAP<STRING, MAP<STRING, VARIANT>>, exclude_titles ARRAY<STRING>, "
    "require_any ARRAY<STRING>, jobage INT, limit INT"
)


class ProfileError(ValueError):
    """The profile table cannot be used as written."""


def profile_issues(profiles: DataFrame) -> DataFrame:
    """Problems of a profile table as rows (id, severity, message)."""
    blank = F.coalesce("id", F.lit("")) == ""
    unusable = (F.coalesce("query", F.lit("")) == "") & (F.coalesce("location", F.lit("")) == "")
    loose = F.concat(
        F.coalesce(blank_terms(F.col("exclude_titles")), F.array().cast("array<string>")),
        F.coalesce(blank_terms(F.col("require_any")), F.array().cast("array<string>")),
    )
    def issue(severity: str, message: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), message.alias("message"))

    name = F.concat(F.lit("profile '"), F.coalesce("id", F.lit("")), F.lit("'"))
    single = profiles.select(
        "id",
        F.explode(F.array_compact(F.array(
            F.when(blank, issue("error", F.lit("every profile needs an 'id'"))),
            F.when(~blank & unusable, issue("error", F.concat(name, F.lit(" needs a 'query' or a 'location'")))),
            *([F.when(F.size("ill_typed") > 0, issue("error", F.concat(
                name, F.lit(" has a field of the wrong type: "), F.array_join("ill_typed", ", "))))]
              if "ill_typed" in profiles.columns else []),
            F.when(F.size(loose) > 0, issue("warning", F.concat(name, F.lit(" has a term that matches every title")))),
        ))).alias("i"),
    ).select("id", "i.severity", "i.message")
    repeated = (
        profiles.filter(~blank).groupBy("id").count().filter("count > 1")
        .select("id", F.lit("error").alias("severity"), F.concat(F.lit("duplicate profile id '"), F.col("id"), F.lit("'")).alias("message"))
    )
    return single.unionByName(repeated)


def require_valid(profiles: DataFrame) -> DataFrame:
    """Return the profiles, or raise for the first error."""
    first = profile_issues(profiles).filter("severity = 'error'").orderBy("id", "message").limit(1).collect()
    if first:
        raise ProfileError(first[0]["message"])
    return profiles


def select_profiles(profiles: DataFrame, only: str | None = None) -> DataFrame:
    """Enabled profiles, or the one named - regardless of its flag."""
    if only is None:
        return profiles.filter(F.coalesce("enabled", F.lit(True)))
    chosen = profiles.filter(F.col("id") == only)
    if chosen.limit(1).count() == 0:
        ids = [r["id"] for r in profiles.select("id").distinct().orderBy("id").collect()]
        raise ProfileError(f"no profile with id {only!r}. Available: " + ", ".join(map(str, ids)))
    return chosen


def resolve_portals(defaults: Column, requested: Column) -> Column:
    """Sources of a profile.

    No list: the defaults.  A list without prefixes replaces them.  With any ``+`` or
    ``-`` prefix the entries are edits, applied in order.
    """
    def edit(have: Column, entry: Column) -> Column:
        name = F.regexp_replace(entry, "^[+-]", "")
        return (
            F.when(F.startswith(entry, F.lit("-")), F.array_remove(have, name))
            .when(F.array_contains(have, name), have)
            .otherwise(F.array_append(have, name))
        )

    edited = F.aggregate(requested, F.coalesce(defaults, F.array().cast("array<string>")), edit)
    is_edit = F.exists(requested, lambda p: p.rlike("^[+-]"))
    return (
        F.when(F.coalesce(F.size(requested), F.lit(0)) <= 0, defaults)
        .when(is_edit, edited)
        .otherwise(requested)
    )


def fan_out(profiles: DataFrame, defaults: dict) -> DataFrame:
    """One row per (profile, source), ``place`` keeps the order."""
    base = F.array(*[F.lit(p) for p in defaults.get("portals", [])]).cast("array<string>")
    return profiles.select("*", F.posexplode(resolve_portals(base, F.col("portals"))).alias("place", "portal"))


def _layered(low: Column, high: Column) -> Column:
    """Union of two maps, the second one wins; independent of session settings."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def _typed(v: Column) -> Column:
    return F.schema_of_variant(v)


def merge_parameters(layers: list[Column]) -> Column:
    """Merge MAP<STRING, VARIANT> columns in rising precedence; null maps are empty."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    merged = F.coalesce(layers[0], empty)
    for layer in layers[1:]:
        merged = _layered(merged, F.coalesce(layer, empty))
    return merged


def requests(profiles: DataFrame, defaults: dict) -> DataFrame:
    """Request table (profile, portal, place, params, problem).

    ``params`` maps flag to text; a null value is a bare flag.  ``problem`` says why a
    request cannot be made.
    """
    shared = F.from_json(F.lit(json.dumps(defaults.get("portal_overrides") or {})), "map<string,map<string,variant>>")
    portal = F.col("portal")
    pairs = fan_out(profiles, defaults).withColumn(
        "_over",
        merge_parameters([F.try_element_at(shared, portal), F.try_element_at("portal_overrides", portal)]),
    )

    fallback = {
        "query": F.col("query"),
        "location": F.col("location"),
        "jobage": F.coalesce(F.col("jobage"), F.lit(defaults.get("jobage")).cast("int")).cast("string"),
        "limit": F.coalesce(F.col("limit"), F.lit(defaults.get("limit")).cast("int")).cast("string"),
    }
    for name, otherwise in fallback.items():
        given = F.map_contains_key("_over", name)
        value = F.try_element_at("_over", F.lit(name)).cast("string")
        pairs = pairs.withColumn(f"_{name}", F.when(given, value).otherwise(otherwise))

    flags = {name: F.lit(f"--{name}") for name in LOGICAL_FIELDS}
    for where, flag in LOCATION_FLAG.items():
        flags["location"] = F.when(portal == where, F.lit(flag)).otherwise(flags["location"])
    mapped = F.map_filter(
        F.create_map(*[x for name in LOGICAL_FIELDS for x in (flags[name], F.col(f"_{name}"))]),
        lambda _, v: F.coalesce(v, F.lit("")) != "",
    )
    passed = F.map_filter(
        F.col("_over"),
        lambda k, v: ~k.isin(LOGICAL_FIELDS) & ~F.is_variant_null(v) & v.isNotNull()
        & ~((_typed(v) == "BOOLEAN") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True))),
    )
    passed = F.transform_values(passed, lambda _, v: F.when(_typed(v) != "BOOLEAN", v.cast("string")))
    passed = F.transform_keys(passed, lambda k, _: F.when(F.startswith(k, F.lit("-")), k).otherwise(F.concat(F.lit("--"), k)))
    problem = (
        F.when(~portal.isin(MAPPED_PORTALS), F.concat(F.lit("portal '"), portal, F.lit("' has no parameter mapping")))
        .when(portal.isin(LOCATION_REQUIRED) & (F.coalesce("_location", F.lit("")) == ""),
              F.concat(F.lit("profile '"), F.col("id"), F.lit("': "), portal, F.lit(" requires a location")))
    )
    return pairs.select(
        F.col("id").alias("profile"), "portal", "place",
        _layered(mapped, passed).alias("params"),
        problem.alias("problem"),
    )


def require_possible(requested: DataFrame) -> DataFrame:
    """Return the requests, or raise for the first that cannot be made."""
    first = requested.filter("problem is not null").orderBy("profile", "place").limit(1).collect()
    if first:
        raise ProfileError(first[0]["problem"])
    return requested
