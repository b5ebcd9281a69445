"""Aggregates over evidence: unknown is not false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.functions.semver import semver_key


def tri_state(flag: Column, force_unknown: Column | None = None) -> Column:
    """Any of nullable booleans, as text: true if one is; else unknown if forced, null or empty; else false."""
    forced = F.coalesce(F.bool_or(force_unknown), F.lit(False)) if force_unknown is not None else F.lit(False)
    return (
        F.when(F.coalesce(F.max(flag), F.lit(False)), "true")
        .when(forced | (F.count(F.lit(1)) == 0) | (F.count_if(flag.isNull()) > 0), "unknown")
        .otherwise("false")
    )


def tri_state_of(flags: Column, force_unknown: Column) -> Column:
    """tri_state over an array."""
    return (
        F.when(F.exists(flags, lambda x: F.coalesce(x, F.lit(False))), "true")
        .when(force_unknown | (F.size(flags) == 0) | F.exists(flags, lambda x: x.isNull()), "unknown")
        .otherwise("false")
    )


def optional_class(optional: Column, unknown: Column | None = None) -> Column:
    """all, mixed, none or unknown, over flags that say whether a dependency is optional."""
    some, other = F.coalesce(F.bool_or(optional), F.lit(False)), F.coalesce(F.bool_or(~optional), F.lit(False))
    unsure = F.coalesce(F.bool_or(unknown), F.lit(False)) if unknown is not None else F.lit(False)
    return F.when(some & other, "mixed").when(unsure | ~(some | other), "unknown").when(some, "all").otherwise("none")


def sorted_set(value: Column) -> Column:
    """Distinct non-null values in order."""
    return F.array_sort(F.collect_set(value))


def sorted_structs(keys: list[Column], cell: Column, where: Column | None = None) -> Column:
    """All cells in the order of the keys, nulls first; cells whose condition does not hold are left out."""
    item = F.struct(F.struct(*[F.struct(k.isNotNull().alias("there"), k.alias("value")).alias(f"k{i}") for i, k in enumerate(keys)]).alias("keys"), cell.alias("cell"))
    return F.transform(F.array_sort(F.collect_list(item if where is None else F.when(where, item))), lambda x: x["cell"])


def least_version(version: Column, position: Column, *carried: Column) -> Column:
    """struct(carried...) of the least full version, the first of equals; texts that are none do not count."""
    key = semver_key(version)
    return F.min_by(F.struct(*carried), F.when(key.isNotNull(), F.struct(key, position)))


def capture_set(df: DataFrame, keys: list[str], text_col: str, pattern: str, to: str = "captures") -> DataFrame:
    """(keys, to, unconditional): the sorted distinct captures of a pattern, and whether a text is missing."""
    found = df.select(*keys, F.col(text_col).alias("_text")).withColumn(
        "_hits", F.coalesce(F.regexp_extract_all("_text", F.lit(pattern), 1), F.array().cast("array<string>"))
    )
    flags = found.groupBy(*keys).agg(F.bool_or(F.col("_text").isNull()).alias("unconditional"))
    sets = found.select(*keys, F.explode("_hits").alias("_hit")).groupBy(*keys).agg(sorted_set(F.col("_hit")).alias(to))
    joined = flags.join(sets, keys, "left")
    return joined.select(*keys, F.coalesce(to, F.array().cast("array<string>")).alias(to), "unconditional")


def joined_errors(*codes: Column, separator: str = ";") -> Column:
    """Error codes in order, the nulls and blanks left out."""
    return F.concat_ws(separator, *[F.when(c != "", c) for c in codes])


def completeness(flag: Column, error_codes: Column) -> Column:
    """partial if flagged or an error is there, else complete."""
    return F.when(F.coalesce(flag, F.lit(False)) | (F.coalesce(error_codes, F.lit("")) != ""), "partial").otherwise("complete")


def resolved_counts(packages: DataFrame, key: str, name: str, version: str, default_source: str) -> DataFrame:
    """Per lockfile: occurrences of a package, those of the exact version, of the registry, of both; its versions."""
    mine = F.col("name") == name
    exact = mine & F.col("version").eqNullSafe(version)
    registry = mine & F.col("source").eqNullSafe(default_source)
    return packages.groupBy(key).agg(
        F.count_if(mine).alias("occurrences"),
        F.count_if(exact).alias("exact"),
        F.count_if(registry).alias("registry"),
        F.count_if(exact & registry).alias("exact_registry"),
        sorted_set(F.when(mine, F.col("version"))).alias("versions"),
        F.array_sort(F.collect_list(F.when(mine, F.struct("version", "source")))).alias("sources"),
    )
