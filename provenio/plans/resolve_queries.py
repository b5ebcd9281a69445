"""From a query to a package, as queries: a catalog made from parts, with a repository for each first word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.operators.catalog import catalog_index, search_index
from provenio.plans import resolve
from provenio.plans.evidence_queries import _likeness
from provenio.plans.registry import register, table


def captures(spark, sf_dir: str) -> tuple[resolve.Captures, str, str]:
    """The captures, and the first and the last package's name; the last one lives in a repository of another name."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    crates = table(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.sum("p_size").alias("downloads"))
    ends = crates.agg(F.min("name"), F.max("name")).first()
    home = F.when(F.col("name") == ends[1], "https://github.com/solo/pack").otherwise(F.concat(F.lit("https://github.com/owner/"), F.split("name", "-")[0]))
    none = F.lit(None).cast("string")
    crates = crates.select("name", F.lit("1.0.0").alias("max_version"), home.alias("repository"), none.alias("homepage"), none.alias("description"), "downloads")
    manifest = [("Cargo.toml", "100644", 30, f'[package]\nname = "{ends[1]}"\n')]
    held = spark.createDataFrame(
        [("owner/cold", "cold", False, [], False), ("solo/pack", "pack", False, manifest, True)],
        "full_name string, name string, private boolean, manifests array<struct<path: string, mode: string, size: long, text: string>>, truncated boolean",
    )
    return resolve.Captures(crates, held, index=catalog_index(crates)), ends[0], ends[1]





@register(
    "resolved_packages",
    f"""
    WITH crates AS (
        SELECT replace(p_name, ' ', '-') AS name, CAST(sum(p_size) AS BIGINT) AS downloads FROM part GROUP BY 1
    ), ends AS (
        SELECT min(name) AS low, max(name) AS high FROM crates
    ), homes AS (
        SELECT name, downloads, replace(name, '-', '_') AS c, CASE WHEN name = high THEN 'pack' ELSE split_part(name, '-', 1) END AS repo, name = high AS solo FROM crates, ends
    ), likely AS (
        SELECT name, downloads, CASE WHEN by_repo > by_name THEN by_repo * 0.97 ELSE by_name END AS score FROM (
            SELECT *, {_likeness("'bolts'", 'c')} AS by_name, {_likeness("'bolts'", 'repo')} AS by_repo FROM homes WHERE contains(name, 'bolt'))
    ), best AS (
        SELECT * FROM likely ORDER BY score DESC, downloads DESC, name LIMIT 5
    )
    SELECT 'explicit' AS asked, 'explicit_crate' AS method, low AS selected, '' AS alternatives, false AS requires_selection, CAST(0 AS BIGINT) AS notes FROM ends
    UNION ALL SELECT 'exact', 'exact_crate', low, '', false, 0 FROM ends
    UNION ALL SELECT 'closest', 'accepted_closest', low, '', false, 0 FROM ends
    UNION ALL SELECT 'repository', 'repository_metadata_ambiguous', NULL, string_agg(name, '|' ORDER BY downloads DESC, name), true, 0 FROM homes WHERE repo = 'cold' AND NOT solo
    UNION ALL SELECT 'manifest', 'repository_metadata', high, '', false, 2 FROM ends
    UNION ALL SELECT 'name', 'repository_name_metadata', high, '', false, 2 FROM ends
    UNION ALL SELECT 'ranked', 'ranked_suggestions', NULL, string_agg(name || ' ' || printf('%.6f', score), '|' ORDER BY score DESC, downloads DESC, name), true, 0 FROM best
    """,
)
def resolved_packages(spark, sf_dir) -> DataFrame:
    """Every way in which a query can lead to a package."""
    held, first, last = captures(spark, sf_dir)
    asked = {
        "explicit": resolve.resolve(held, "anything", explicit=first.upper()),
        "exact": resolve.resolve(held, f" {first.replace('-', '_').upper()} "),
        "closest": resolve.resolve(held, f"{first}s", accept_closest=True),
        "repository": resolve.resolve(held, "https://github.com/Owner/Cold.git"),
        "manifest": resolve.resolve(held, "solo/pack"),
        "name": resolve.resolve(held, "Pack"),
        "ranked": resolve.resolve(held, "bolts", limit=5, accept_closest=True),
    }
    scored = F.col("resolution_method") == "ranked_suggestions"
    shown = F.transform("alternatives", lambda c: F.when(scored, F.concat(c["name"], F.lit(" "), F.format_string("%.6f", c["score"]))).otherwise(c["name"]))
    rows = [
        found.select(
            F.lit(name).alias("asked"), F.col("resolution_method").alias("method"), F.col("selected.name").alias("selected"), F.array_join(shown, "|").alias("alternatives"),
            "requires_selection", F.size("diagnostics").cast("long").alias("notes"),
        )
        for name, found in asked.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@register(
    "catalog_search",
    """
    WITH crates AS (
        SELECT replace(p_name, ' ', '-') AS name, any_value(lower(min_type)) AS description, CAST(sum(p_size) AS BIGINT) AS downloads
        FROM part JOIN (SELECT p_name AS n, min(p_type) AS min_type FROM part GROUP BY 1) ON n = p_name GROUP BY 1
    ), terms AS (
        SELECT DISTINCT unnest([split_part(p_name, ' ', 1), substr(p_name, 3, 4), substr(p_type, 1, 2), p_name, 'ZZ', upper(substr(p_type, 2, 5))]) AS term FROM part
    ), met AS (
        SELECT term, name, downloads, CASE WHEN c = t THEN 0 WHEN starts_with(c, t) THEN 1 WHEN contains(c, t) THEN 2 WHEN contains(description, lower(term)) THEN 3 END AS near
        FROM (SELECT *, replace(name, '-', '_') AS c FROM crates) x, (SELECT *, replace(lower(term), '-', '_') AS t FROM terms WHERE trim(term) <> '') y
    )
    SELECT term, rank, name FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY near, downloads DESC, name) AS rank FROM met WHERE near IS NOT NULL) WHERE rank <= 5
    """,
)
def catalog_search(spark, sf_dir) -> DataFrame:
    """Many terms over one index; the best five packages of each."""
    part = table(spark, sf_dir, "part")
    crates = part.groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).agg(F.lower(F.min("p_type")).alias("description"), F.sum("p_size").alias("downloads"))
    terms = F.array(
        F.split("p_name", " ")[0], F.substring("p_name", 3, 4), F.substring("p_type", 1, 2), F.col("p_name"), F.lit("ZZ"), F.upper(F.substring("p_type", 2, 5))
    )
    found = search_index(catalog_index(crates), part.select(F.explode(terms).alias("term")).distinct(), 5)
    return found.select("term", "rank", "name")
