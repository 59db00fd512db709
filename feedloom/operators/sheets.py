"""Wide sheets to typed categories.

A sheet is a table (sheet, row, cells ARRAY<STRING>).  The header of each sheet becomes one
``layout`` row: where company and city are, and a list of categories with their columns.
Data rows then join their layout and build the category map from array look-ups alone: no
explode and no grouping of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.cluster import bounded_broadcast
from feedloom.functions import cells as C


def header_rows(sheets: DataFrame) -> DataFrame:
    """First of the leading rows of each sheet with a company header."""
    hit = F.exists("cells", lambda c: C.header_matches(c, C.COMPANY_WORDS))
    return (
        sheets.filter((F.col("row") <= C.HEADER_SEARCH_ROWS) & hit)
        .groupBy("sheet")
        .agg(F.min("row").alias("header_row"), F.min_by("cells", "row").alias("header"))
    )


def layouts(sheets: DataFrame) -> DataFrame:
    """One row per sheet: header_row, company_col, city_col, plan.

    ``plan`` lists the categories in output order: paired columns first, then single count,
    single index and untyped columns.  Column positions count from 0.
    """
    columns = header_rows(sheets).select(
        "sheet", "header_row", F.posexplode("header").alias("col", "raw")
    ).withColumn("head", C.strip(F.coalesce("raw", F.lit(""))))
    is_company = C.header_matches(F.col("head"), C.COMPANY_WORDS)
    is_city = ~is_company & C.header_matches(F.col("head"), C.CITY_WORDS)
    per_sheet = Window.partitionBy("sheet")
    typed = (
        columns.withColumns({
            "company_col": F.max(F.when(is_company, F.col("col"))).over(per_sheet),
            "city_col": F.max(F.when(is_city, F.col("col"))).over(per_sheet),
        })
        .withColumn("data", (F.col("head") != "") & (F.col("col") != F.col("company_col"))
                    & ~F.col("col").eqNullSafe(F.col("city_col")) & ~C.header_matches(F.col("head"), C.ID_WORDS))
        .withColumn("kind", F.coalesce(C.column_type(F.col("head")), F.lit("other")))
        .withColumn("cat", F.when(F.col("kind") == "count", C.strip_type_words(F.col("head"), C.COUNT_WORDS))
                    .when(F.col("kind") == "index", C.strip_type_words(F.col("head"), C.INDEX_WORDS)))
    )
    # Pairing in column order within equal names is a match on (name, number): columns of the
    # two kinds that agree on both form one group, every other column a group of its own.
    # All steps stay on the partitioning by sheet.
    nth = Window.partitionBy("sheet", "kind", "cat").orderBy("col")
    own = F.concat(F.lit("="), F.col("col").cast("string"))
    paired = F.concat_ws("#", "cat", F.row_number().over(nth).cast("string"))
    is_count = F.col("kind") == "count"
    groups = (
        typed.filter("data")
        .withColumn("pair", F.when(F.coalesce("cat", F.lit("")) != "", paired).otherwise(own))
        .groupBy("sheet", "pair")
        .agg(
            F.max(F.when(is_count, F.col("col"))).alias("count_col"),
            F.max(F.when(~is_count, F.col("col"))).alias("index_col"),
            F.max("cat").alias("cat"), F.max(F.lower("head")).alias("head"), F.max(F.col("kind") == "other").alias("untyped"),
        )
    )
    both = F.col("count_col").isNotNull() & F.col("index_col").isNotNull()
    entry = F.struct(
        F.when(both, 0).when(F.col("count_col").isNotNull(), 1).when(~F.col("untyped"), 2).otherwise(3).alias("group"),
        F.coalesce("count_col", "index_col").alias("col"),
        F.when(both, F.translate("cat", " -", "__")).otherwise(F.replace("head", F.lit(" "), F.lit("_"))).alias("name"),
        "count_col", "index_col",
    )
    plans = groups.groupBy("sheet").agg(F.array_sort(F.collect_list(entry)).alias("plan"))
    heads = typed.groupBy("sheet").agg(
        F.max("header_row").alias("header_row"), F.max("company_col").alias("company_col"), F.max("city_col").alias("city_col"),
    )
    return heads.join(plans, "sheet", "left")


def reshape(sheets: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Company rows (sheet, row, company, city, categories) of all sheets.

    ``categories``: MAP<STRING, STRUCT<count BIGINT, index DOUBLE>>.  A category without any
    numeric value in a row is left out; of equal names the last one with a value stays.
    """
    heads = (layouts(sheets) if layout is None else layout)
    cell = lambda at: F.when(at.isNotNull(), F.get("cells", F.coalesce(at, F.lit(0))))
    number = lambda at: C.parse_number(cell(at))
    rows = (
        sheets.join(bounded_broadcast(heads), "sheet")
        .filter((F.col("row") > F.col("header_row")) & (F.coalesce(cell(F.col("company_col")), F.lit("")) != ""))
    )
    values = F.filter(
        F.transform(
            F.coalesce("plan", F.expr("cast(array() as array<struct<group:int,col:int,name:string,count_col:int,index_col:int>>)")),
            lambda p: F.struct(
                p["name"].alias("name"),
                F.struct(
                    number(p["count_col"]).try_cast("bigint").alias("count"),
                    number(p["index_col"]).alias("index"),
                ).alias("value"),
            ),
        ),
        lambda v: v["value"]["count"].isNotNull() | v["value"]["index"].isNotNull(),
    )
    last = F.filter(
        "_v",
        lambda v, i: ~F.exists(F.slice("_v", i + 2, F.size("_v")), lambda later: later["name"] == v["name"]),
    )
    return (
        rows.withColumn("_v", values)
        .select(
            "sheet", "row",
            C.strip(cell(F.col("company_col"))).alias("company"),
            F.coalesce(C.strip(cell(F.col("city_col"))), F.lit("")).alias("city"),
            F.map_from_entries(last).alias("categories"),
        )
    )


def as_dataset(companies: DataFrame) -> DataFrame:
    """The data-set form the lookup reads: index as VARIANT, count as DOUBLE."""
    return companies.withColumn(
        "categories",
        F.transform_values("categories", lambda _, v: F.struct(
            v["count"].cast("double").alias("count"), v["index"].cast("variant").alias("index"))),
    )
