"""Views over the star-schema tables that play the roles of the data model.

``postings`` joins line items with parts and suppliers (title, company) and adds one board
fed from orders, so that names repeat across boards, carry markers and legal forms, and one
group - postings without title and company - is far larger than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.cluster import fits_broadcast, spread

PORTALS = ["stepstone", "arbeitsagentur-search", " linkedin ", "xing-search", "indeed", "freehire-search", "monster"]
MARKERS = ["", " (m/w/d)", "*", " (gn)", ":in", " (all genders)", " m/w/d"]
FORMS = ["", " GmbH", " AG", " GmbH & Co. KG", " Gruppe"]
ORDER_TITLES = {
    "2-HIGH": "System/Network Engineer (m/w/d)",
    "3-MEDIUM": "Softwareentwickler für Großsysteme",
    "4-NOT SPECIFIED": "Ingénieur logiciel (all genders)",
    "5-LOW": "Da­ta Engineer:in",
}
SPLIT_DAY = "1998-01-01"
# The board fed from orders has no profile of its own; reports list it under this one.
ORDERS_PROFILE = "orders board"
# Suppliers up to which, where their bytes allow it, line items meet them without being moved once more.
NEAR_SUPPLIERS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(at: str, values: list[str]) -> str:
    """SQL text for ``values[at]`` with positions from 0."""
    return f"get(array({', '.join(repr(v) for v in values)}), cast({at} AS int))"


def pick(at: Column, values: list[str]) -> Column:
    """``values[at]`` with positions from 0."""
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    suppliers = F.broadcast(suppliers) if fits_broadcast(suppliers, NEAR_SUPPLIERS) else suppliers
    items = (
        spread(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(suppliers, F.expr("l_suppkey = s_suppkey"))
    )
    from_items = items.selectExpr(
        "struct(l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_shipdate AS e, l_returnflag AS f) AS arrival",
        f"{_choice('l_linenumber - 1', PORTALS)} AS portal",
        f"concat(p_name, {_choice('l_linenumber - 1', MARKERS)}) AS title",
        f"concat(s_name, {_choice('l_partkey % 5', FORMS)}) AS company",
        "concat_ws('/', 'https://jobs.example', l_partkey, l_suppkey, l_orderkey % 10) AS url",
        "concat('NATION_', s_nationkey) AS location",
        "p_brand AS profile",
        "cast(l_shipdate AS date) AS date",
    )
    titles = " ".join(f"WHEN '{priority}' THEN '{title}'" for priority, title in ORDER_TITLES.items())
    from_orders = spread(table(spark, sf_dir, "orders"), ["o_orderkey"]).selectExpr(
        "struct(o_orderkey AS a, 0 AS b, o_custkey AS c, 0L AS d, o_orderdate AS e, o_orderstatus AS f) AS arrival",
        "'arbeitnow' AS portal",
        f"CASE o_orderpriority {titles} END AS title",
        "CASE WHEN o_orderpriority <> '1-URGENT' THEN concat('Kunde ', o_custkey, ' GmbH & Co. KG') END AS company",
        "concat('https://board.example/', o_orderkey) AS url",
        "cast(null AS string) AS location",
        "cast(null AS string) AS profile",
        "cast(o_orderdate AS date) AS date",
    )
    return from_items.unionByName(from_orders)


def brand_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search profile per brand, term lists taken from the names of its parts."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    return (
        table(spark, sf_dir, "part").groupBy("p_brand", number.alias("n"))
        .agg(F.min(first).alias("low"), F.max(last).alias("high"), F.min(last).alias("other"))
        .select(
            F.col("p_brand").alias("id"),
            (F.col("n") % 5 != 4).alias("enabled"),
            F.col("p_brand").alias("query"),
            F.lit(None).cast("string").alias("location"),
            F.when(F.col("n") % 3 != 0, F.array(F.concat(F.upper("low"), F.lit(" (m/w/d)")))).alias("exclude_titles"),
            F.when(F.col("n") % 2 == 0, F.array(F.concat("high", F.lit("*")), F.col("other"))).alias("require_any"),
        )
    )


def search_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search profile per customer, with all forms of source lists and overrides."""
    k = F.col("c_custkey")
    lists = [None, ["+xing-search"], ["-stepstone-search"], ["-arbeitsagentur-search", "+freehire-search", "+xing-search"],
             ["linkedin-search"], ["+stepstone-search", "indeed", "-indeed"]]
    requested = F
    for at, names in enumerate(lists):
        if names is not None:
            requested = requested.when(k % 6 == at, F.array(*map(F.lit, names)))
    overrides = [
        "{}",
        '{"freehire-search": {"country": "DE", "city": "Munich"}, "xing-search": {"remote": true, "radius": 30}}',
        '{"arbeitsagentur-search": {"location": null, "debug": false}, "linkedin-search": {"limit": 5}}',
    ]
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("id"),
        F.lit(True).alias("enabled"),
        F.col("c_mktsegment").alias("query"),
        F.when(k % 4 != 3, F.concat(F.lit("NATION_"), F.col("c_nationkey"))).alias("location"),
        requested.otherwise(F.lit(None)).alias("portals"),
        F.from_json(pick(k % 3, overrides), "map<string,map<string,variant>>").alias("portal_overrides"),
        F.when(k % 5 == 0, F.lit(1)).cast("int").alias("jobage"),
        F.lit(None).cast("int").alias("limit"),
    )


PROFILE_DEFAULTS = {
    "jobage": 7,
    "limit": 25,
    "portals": ["arbeitsagentur-search", "stepstone-search"],
    "portal_overrides": {"freehire-search": {"country": "AT", "lang": "de"}},
}


def old_pool_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings before and from the split day."""
    rows = postings(spark, sf_dir)
    day = F.lit(SPLIT_DAY).cast("date")
    return rows.filter(F.col("date") < day), rows.filter(F.col("date") >= day)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names with Nordic spelling, forms and places."""
    k = F.col("c_custkey")
    named = spread(table(spark, sf_dir, "customer")).join(
        table(spark, sf_dir, "part").select("p_partkey", "p_name"), k == F.col("p_partkey")
    )
    spelled = F.when(k % 3 == 0, F.replace(F.replace("p_name", F.lit("o"), F.lit("ø")), F.lit("ae"), F.lit("æ"))).otherwise(F.col("p_name"))
    forms = [" A/S", " Danmark ApS", "", " (VG) Holding", ", Nordic branch"]
    return named.select(
        F.col("c_custkey").alias("ord"),
        F.concat(
            F.initcap(spelled),
            F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), F.initcap("c_mktsegment"))),
            pick(k % 5, forms),
        ).alias("company"),
        F.when(k % 7 != 0, F.concat(F.lit("København "), F.col("c_nationkey"))).alias("city"),
    )


def company_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts, some of them short, some with a city."""
    k = F.col("s_suppkey")
    named = spread(table(spark, sf_dir, "supplier")).join(
        table(spark, sf_dir, "part").select("p_partkey", "p_name"), k == F.col("p_partkey")
    )
    return named.select(
        k.alias("query_id"),
        F.when(k % 5 == 0, F.concat("p_name", F.lit(" machinery A/S")))
        .when(k % 5 == 1, F.split("p_name", " ")[1])
        .when(k % 5 == 2, F.substring("p_name", 1, 3))
        .when(k % 5 == 3, F.concat(F.upper("p_name"), F.lit(" Household Gruppe")))
        .otherwise(F.col("p_name")).alias("query"),
        F.when(k % 4 == 0, F.concat(F.lit("kobenhavn "), F.col("s_nationkey"))).alias("city"),
    )
