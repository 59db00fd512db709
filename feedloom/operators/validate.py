"""Checks of a company data set, reported as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (texts of reports) ---------------------------------------------
NOT_AN_OBJECT = " must be an object"
NO_COMPANY = ".company must be a non-empty string"
BAD_CITY = ".city must be a string when provided"
BAD_CATEGORIES = ".categories must be an object when provided"
BAD_CATEGORY = " must be an object with 'count' and/or 'index' (got "
BAD_COUNT = ".count must be a number (got "
BAD_INDEX = ".index must be a number or string (got "
DUPLICATE_NAME = "Duplicate company name '"
ROOT_NOT_AN_OBJECT = "top-level JSON value must be an object"
BAD_METADATA = "'metadata' must be an object when provided"
BAD_COMPANIES = "'companies' must be a list"
# --- end of fixed values ---------------------------------------------------------


class DatasetError(ValueError):
    """The data set breaks a hard rule."""


def _kind(v: Column) -> Column:
    """object, array, str, number, bool or null; null also when the field is absent."""
    shape = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True)), F.lit("null"))
        .when(F.startswith(shape, F.lit("OBJECT")), F.lit("object"))
        .when(F.startswith(shape, F.lit("ARRAY")), F.lit("array"))
        .when(shape == "STRING", F.lit("str"))
        .when(shape == "BOOLEAN", F.lit("bool"))
        .otherwise(F.lit("number"))
    )


def _type_name(v: Column) -> Column:
    """Type word used in messages."""
    kind = _kind(v)
    return (
        F.when(kind == "object", "dict").when(kind == "array", "list").when(kind == "null", "NoneType")
        .when(kind != "number", kind).when(F.schema_of_variant(v) == "BIGINT", "int").otherwise("float")
    )


def _issue(rule: int, path: Column, message: Column) -> Column:
    return F.struct(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), path.alias("path"), message.alias("message"))


def entry_issues(entries: DataFrame) -> DataFrame:
    """Hard errors of entries (pos BIGINT from 1, entry VARIANT), one row each."""
    at = F.concat(F.lit("companies["), F.col("pos").cast("string"), F.lit("]"))
    e = F.col("entry")
    company, city, cats = (F.try_variant_get(e, f"$.{n}", "variant") for n in ("company", "city", "categories"))
    typed = entries.select(
        "pos", "entry", _kind(e).alias("k"), _kind(company).alias("k_company"), _kind(city).alias("k_city"),
        _kind(cats).alias("k_cats"),
        F.try_variant_get(e, "$.company", "string").alias("company"),
        F.when(_kind(cats) == "object", cats.try_cast("map<string,variant>")).alias("cats"),
    )
    blank = (F.col("k_company") != "str") | (F.regexp_replace(F.coalesce("company", F.lit("")), r"(?U)[\s\x1c-\x1f]+", "") == "")
    is_object = F.col("k") == "object"

    def category(c: Column) -> Column:
        name, value = c["key"], c["value"]
        path = F.concat(at, F.lit(".categories."), name)
        count, index = F.try_variant_get(value, "$.count", "variant"), F.try_variant_get(value, "$.index", "variant")
        ok = _kind(value) == "object"
        return F.array(
            F.when(~ok, _issue(6, path, F.concat(path, F.lit(BAD_CATEGORY), _type_name(value), F.lit(")")))),
            F.when(ok & ~_kind(count).isin("null", "number", "bool"), _issue(
                7, F.concat(path, F.lit(".count")), F.concat(path, F.lit(BAD_COUNT), _type_name(count), F.lit(")")))),
            F.when(ok & ~_kind(index).isin("null", "number", "bool", "str"), _issue(
                8, F.concat(path, F.lit(".index")), F.concat(path, F.lit(BAD_INDEX), _type_name(index), F.lit(")")))),
        )

    found = F.array_compact(F.concat(
        F.array(
            F.when(~is_object, _issue(2, at, F.concat(at, F.lit(NOT_AN_OBJECT)))),
            F.when(is_object & blank, _issue(3, F.concat(at, F.lit(".company")), F.concat(at, F.lit(NO_COMPANY)))),
            F.when(is_object & ~F.col("k_city").isin("null", "str"), _issue(4, F.concat(at, F.lit(".city")), F.concat(at, F.lit(BAD_CITY)))),
            F.when(is_object & ~F.col("k_cats").isin("null", "object"), _issue(5, F.concat(at, F.lit(".categories")), F.concat(at, F.lit(BAD_CATEGORIES)))),
        ),
        F.coalesce(
            F.when(is_object, F.flatten(F.transform(F.map_entries("cats"), category))),
            F.array(F.when(F.lit(False), _issue(0, at, at))),
        ),
    ))
    return typed.select("pos", F.explode(found).alias("i")).select("pos", "i.*")


def duplicate_names(named: DataFrame) -> DataFrame:
    """Second and later rows of one name, with the position of the first.

    ``named``: pos, company.  The first position is an aggregate with a map-side combine;
    only names that repeat are joined back.
    """
    keyed = named.withColumn("_name", F.lower("company"))
    firsts = keyed.groupBy("_name").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keyed.join(firsts.drop("_n"), "_name").filter("pos > first_pos").select("pos", "company", "first_pos")


def collect_issues(entries: DataFrame) -> DataFrame:
    """Errors and duplicate-name warnings (severity, pos, rule, path, message)."""
    errors = entry_issues(entries)
    named = entries.select("pos", F.col("entry").alias("e")).filter(
        _kind(F.try_variant_get("e", "$.company", "variant")) == "str"
    ).select("pos", F.try_variant_get("e", "$.company", "string").alias("company"))
    named = named.filter(F.regexp_replace("company", r"(?U)[\s\x1c-\x1f]+", "") != "")
    warnings = duplicate_names(named).select(
        "pos", F.lit("warning").alias("severity"), F.lit(9).alias("rule"),
        F.concat(F.lit("companies["), F.col("pos").cast("string"), F.lit("].company")).alias("path"),
        F.concat(F.lit(DUPLICATE_NAME), F.col("company"), F.lit("' (companies["), F.col("first_pos").cast("string"),
                 F.lit("] and companies["), F.col("pos").cast("string"), F.lit("])")).alias("message"),
    )
    return errors.unionByName(warnings)


def root_issues(document: DataFrame) -> DataFrame:
    """Rules about the document itself; ``document``: doc VARIANT, one row."""
    doc = F.col("doc")
    meta, companies = F.try_variant_get(doc, "$.metadata", "variant"), F.try_variant_get(doc, "$.companies", "variant")
    is_object = _kind(doc) == "object"
    found = F.array_compact(F.array(
        F.when(~is_object, _issue(0, F.lit(""), F.lit(ROOT_NOT_AN_OBJECT))),
        F.when(is_object & ~_kind(meta).isin("null", "object"), _issue(0, F.lit("metadata"), F.lit(BAD_METADATA))),
        F.when(is_object & (_kind(companies) != "array"), _issue(1, F.lit("companies"), F.lit(BAD_COMPANIES))),
    ))
    return document.select(F.lit(0).cast("bigint").alias("pos"), F.explode(found).alias("i")).select("pos", "i.*")


def fail_fast(issues: DataFrame) -> None:
    """Raise for the first error in report order; warnings pass."""
    first = issues.filter("severity = 'error'").orderBy("pos", "rule", "path").limit(1).collect()
    if first:
        raise DatasetError(first[0]["message"])
