"""Joins with guarantees: no row is lost in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.urls import ancestors, directory


def guard(df: DataFrame, broken: Column, message: Column | str) -> DataFrame:
    """df, or an error where a row is broken. As a filter it cannot be pruned away like a projected check."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(broken, F.raise_error(text).cast("boolean")).otherwise(True))


def strict_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on a key that must be there, once, on the right; many left rows may share it.

    Two right rows with one key that a left row has, or a left row without partner, are an error.
    """
    # one row a key, with its values in a struct: the right side is planned and shuffled once
    own = "_"
    while any(c.startswith(own) for c in [*left.columns, *right.columns]):
        own += "_"
    key, n, row = f"{own}key", f"{own}n", f"{own}right"
    values = [c for c in right.columns if c != right_key]
    per_key = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias(key)).agg(
        F.count(F.lit(1)).alias(n), F.any_value(F.struct(F.lit(True).alias(f"{own}there"), *values)).alias(row)
    )
    joined = left.join(per_key, F.col(left_key) == F.col(key), "left")
    asked = F.coalesce(F.col(left_key).cast("string"), F.lit("null"))
    once = guard(joined, F.coalesce(F.col(n), F.lit(1)) > 1, F.concat(F.lit(f"more than one {right_key} "), asked))
    found = guard(once, F.col(n).isNull(), F.concat(F.lit(f"no {right_key} for {left_key} "), asked))
    return found.select(*left.columns, *[F.col(key).alias(c) if c == right_key else F.col(f"{row}.{c}").alias(c) for c in right.columns])


def enrich(left: DataFrame, right: DataFrame, on: list[str], fallbacks: dict[str, Column], error: Column) -> DataFrame:
    """Left join; where no right row is found its columns are the fallbacks, and lookup_error says so."""
    found = right.withColumn("_there", F.lit(True))
    joined = left.join(found, on, "left")
    missing = F.col("_there").isNull()
    kept = [F.when(missing, fallbacks[c]).otherwise(F.col(c)).alias(c) for c in fallbacks]
    rest = [c for c in joined.columns if c not in fallbacks and c != "_there"]
    return joined.select(*rest, *kept, F.when(missing, error).alias("lookup_error"))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Ties must be broken by the order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def not_yet_known(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def nearest_root(members: DataFrame, roots: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """members (path, workspace?) with root_path: the workspace root that each belongs to, or null.

    roots: (root_path, root_position). A path given in workspace must be a root itself; else the root with the
    longest directory that contains the member counts, the last of equals. Each member is exploded to its
    ancestors, a handful, and equi-joined: no comparison of all members with all roots.
    """
    scope = scope or []
    one_each = roots.groupBy(*scope, directory(F.col("root_path")).alias("_dir")).agg(
        F.max_by("root_path", "root_position").alias("_root")
    )
    inner = members.filter(F.col("workspace").isNull())
    candidates = inner.select(*scope, "path", F.explode(ancestors(F.col("path"))).alias("_dir")).distinct()
    nearest = (
        candidates.join(one_each, [*scope, "_dir"])
        .groupBy(*scope, "path")
        .agg(F.max_by("_root", F.char_length("_dir")).alias("root_path"))
    )
    implicit = members.filter(F.col("workspace").isNull()).join(nearest, [*scope, "path"], "left")
    named = roots.select(*scope, F.col("root_path").alias("workspace"), F.col("root_path")).distinct()
    explicit = members.filter(F.col("workspace").isNotNull()).join(named, [*scope, "workspace"], "left")
    columns = [*members.columns, "root_path"]
    return implicit.select(columns).unionByName(explicit.select(columns))


def inherit_templates(members: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """members with the template's fields; a member's own `optional` stands before the template's.

    found tells whether there was a template.
    """
    base = templates.withColumnRenamed("optional", "_template_optional").withColumn("_there", F.lit(True))
    joined = members.join(base, keys, "left")
    optional = F.coalesce("optional", "_template_optional", F.lit(False))
    return (
        joined.withColumn("optional", optional)
        .withColumn("found", F.col("_there").isNotNull())
        .drop("_template_optional", "_there")
    )


def merge_on_identity(df: DataFrame, identity: str, position: str, sets: list[str], firsts: list[str]) -> DataFrame:
    """One row per identity: the sets united and sorted, and of the other columns the first non-null by position."""
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in firsts]
    return df.groupBy(identity).agg(*united, *first, F.min(position).alias(position), F.count(F.lit(1)).alias("merged"))
