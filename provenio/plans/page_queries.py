"""Paged sources as queries: captured pages made from customers (searches) and lines of orders (a listing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.plans.registry import register, table
from provenio.sources import pages

PAGE, LIMIT = 10, 25
LISTED, LISTED_LIMIT = 20, 150


def searches(spark, sf_dir: str) -> DataFrame:
    """A search for each nation, ten customers a page; of some a page is cut, missing, or says that it is incomplete."""
    nation = F.col("c_nationkey")
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    item = F.struct("at", F.struct(F.concat(F.lit("p/"), F.col("c_custkey").cast("string")).alias("path"), F.struct(F.lit("o/r").alias("full_name")).alias("repository")).alias("item"))
    numbered = table(spark, sf_dir, "customer").withColumn("at", at).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey")))
    grouped = numbered.groupBy("c_nationkey", (F.floor(F.col("at") / PAGE) + 1).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), (F.max("n") + F.when(nation % 3 == 0, 5).otherwise(0)).alias("total_count")
    )
    body = F.to_json(F.struct("total_count", ((nation % 7 == 1) & (F.col("page") == 2)).alias("incomplete_results"), F.transform("items", lambda x: x["item"]).alias("items")))
    cut = F.when((nation % 11 == 10) & (F.col("page") == 2), F.substring(body, 1, 60)).otherwise(body)
    return grouped.select("c_nationkey", "page", cut.alias("body")).filter(~((nation % 11 == 6) & (F.col("page") == 2)))


_SEARCHES = f"""
    WITH numbered AS (
        SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer
    ), scans AS (
        SELECT c_nationkey, any_value(n) AS n, any_value(n) + CASE WHEN c_nationkey % 3 = 0 THEN 5 ELSE 0 END AS total,
               any_value(n) > {PAGE} OR any_value(n) = {PAGE} AND c_nationkey % 3 = 0 AS second FROM numbered GROUP BY c_nationkey
    ), judged AS (
        SELECT *, CASE WHEN n > {PAGE} AND c_nationkey % 11 = 10 THEN 'a page does not parse' WHEN second AND (c_nationkey % 11 = 6 OR n = {PAGE}) THEN 'a page was not captured'
                       WHEN n IN ({2 * PAGE}) AND total > n THEN 'a page was not captured' END AS error FROM scans
    )
"""


@register(
    "search_page_rows",
    _SEARCHES
    + f"""
    SELECT c_nationkey, CAST(position // {PAGE} + 1 AS INTEGER) AS page, position, 'p/' || c_custkey AS path
    FROM numbered JOIN judged USING (c_nationkey) WHERE error IS NULL AND position < {LIMIT}
    """,
)
def search_page_rows(spark, sf_dir):
    found = pages.search_pages(searches(spark, sf_dir), ["c_nationkey"], pages.HIT, LIMIT, PAGE)
    return found.rows.select("c_nationkey", "page", "position", "path")


@register(
    "search_page_report",
    _SEARCHES
    + f"""
    SELECT c_nationkey,
           CAST(CASE WHEN error = 'a page does not parse' THEN 2 WHEN c_nationkey % 11 = 6 THEN 1 ELSE ceil(least(n, {LIMIT}) / {PAGE}) END AS INTEGER) AS pages_read,
           total, CASE WHEN error IS NULL THEN least(n, {LIMIT}) ELSE 0 END AS returned,
           error IS NOT NULL OR n > {PAGE} AND c_nationkey % 7 = 1 AS incomplete,
           error IS NOT NULL OR n > {PAGE} AND c_nationkey % 7 = 1 OR total > least(n, {LIMIT}) AS bounded, error
    FROM judged
    """,
)
def search_page_report(spark, sf_dir):
    return pages.search_pages(searches(spark, sf_dir), ["c_nationkey"], pages.HIT, LIMIT, PAGE).report


def listing(spark, sf_dir: str) -> DataFrame:
    """One listing: lines are dependencies, their orders versions, twenty lines a page by order and line."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey <= 2000").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    order = Window.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    at = F.row_number().over(order) - 1
    o = F.col("l_orderkey")
    dependency = F.struct("at", F.struct(F.col("at").alias("id"), o.alias("version_id"), F.lit("dep").alias("crate_id"), F.lit("^1").alias("req"), (o % 2 == 0).alias("optional")).alias("d"))
    version = F.struct(o.alias("id"), F.concat(F.lit("o"), o.cast("string")).alias("crate"), F.lit("1.0.0").alias("num"), (o % 5 == 0).alias("yanked"))
    numbered = lines.withColumn("at", at).withColumn("page", (F.floor(F.col("at") / LISTED) + 1).cast("int"))
    grouped = numbered.groupBy("page").agg(
        F.transform(F.array_sort(F.collect_list(dependency)), lambda x: x["d"]).alias("dependencies"), F.collect_set(version).alias("versions")
    )
    total = numbered.agg(F.struct(F.count(F.lit(1)).alias("total")).alias("meta"))
    return grouped.join(F.broadcast(total), F.lit(True)).select("page", F.to_json(F.struct("dependencies", "versions", "meta")).alias("body"))


_LISTING = f"""
    WITH numbered AS (
        SELECT l_orderkey AS o, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS place FROM lineitem WHERE l_orderkey <= 2000
    ), firsts AS (
        SELECT o, min(place) AS place FROM numbered GROUP BY o
    ), placed AS (
        SELECT o, place // {LISTED} + 1 AS page, row_number() OVER (ORDER BY place) - 1 AS position FROM firsts
    )
"""


@register(
    "listing_page_rows",
    _LISTING
    + f"""
    SELECT 'o' || o AS name, o AS version_id, position, CAST(page AS INTEGER) AS page, o % 5 = 0 AS yanked, '^1' AS requirement, o % 2 = 0 AS optional
    FROM placed WHERE position < {LISTED_LIMIT}
    """,
)
def listing_page_rows(spark, sf_dir):
    """A bounded listing: each release once, where it comes first."""
    rows = pages.listing_pages(listing(spark, sf_dir), LISTED, LISTED_LIMIT).rows
    return rows.select("name", "version_id", "position", "page", "yanked", "listed.requirement", "listed.optional")


@register(
    "listing_page_report",
    _LISTING
    + f"""
    , whole AS (SELECT count(*) AS total, CAST(ceil(count(*) / {LISTED}) AS INTEGER) AS pages, (SELECT count(*) FROM firsts) AS releases FROM numbered)
    SELECT 'all' AS scan, pages AS pages_read, total, releases AS returned, total > releases AS bounded FROM whole
    UNION ALL
    SELECT 'limited', coalesce((SELECT CAST(max(page) AS INTEGER) FROM placed WHERE position < {LISTED_LIMIT}), 0), total, least(releases, {LISTED_LIMIT}),
           total > least(releases, {LISTED_LIMIT}) FROM whole
    """,
)
def listing_page_report(spark, sf_dir):
    """Under a limit fewer pages are read."""
    captures = listing(spark, sf_dir)
    report = lambda name, limit: pages.listing_pages(captures, LISTED, limit).report.select(F.lit(name).alias("scan"), "pages_read", "total", "returned", "bounded")
    return report("all", None).unionByName(report("limited", LISTED_LIMIT))
