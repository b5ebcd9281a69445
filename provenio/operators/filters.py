"""Filters on candidates, repositories and search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.functions.urls import final_component

SECONDS_A_DAY = 86_400


def kind_selected(kind: Column, kinds: list[str]) -> Column:
    """Whether a dependency kind is among those wanted; a blank kind is a normal one."""
    return F.when(kind == "", "normal").otherwise(kind).isin(kinds)


def optional_selected(optional: Column, mode: str) -> Column:
    """mode: include, exclude or only."""
    return {"include": F.lit(True), "exclude": ~optional, "only": optional}[mode]


def filter_candidates(
    df: DataFrame, kinds: list[str], optional_mode: str = "include", requirement_mode: str = "any"
) -> DataFrame:
    """Candidates (yanked, declarations, enrichment_error) worth a look; declarations are filtered as well.

    Yanked releases go, known or not. Of the rest the declarations of the wanted kinds stay; a candidate stays if
    one of them meets the requirement mode (any, accepts, exact) for certain, or if its lookup failed, when nothing
    is certain. Declarations: struct(kind, optional, accepts, exact_pin, ...).
    """
    unknown = F.col("enrichment_error").isNotNull()
    wanted = F.filter(
        "declarations", lambda d: kind_selected(d["kind"], kinds) & optional_selected(d["optional"], optional_mode)
    )
    certain = {
        "any": lambda d: F.lit(True),
        "accepts": lambda d: F.coalesce(d["accepts"], F.lit(False)),
        "exact": lambda d: F.coalesce(d["exact_pin"], F.lit(False)),
    }[requirement_mode]
    kept = df.filter(~F.col("yanked")).withColumn("declarations", wanted)
    return kept.filter(F.exists("declarations", certain) | unknown)


def activity(
    committed: Column, observed: Column, stale_days: int, wanted: str = "all", since: Column | None = None, before: Column | None = None
) -> Column:
    """struct(age_seconds, stale), or null where a repository is to be dropped.

    The UTC date of the commit must not lie before `since`, nor on or after `before`. A repository is stale at
    stale_days of whole seconds or more; wanted (all, active, stale) then chooses.
    """
    age = F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", committed, observed))
    stale = age >= F.lit(stale_days * SECONDS_A_DAY)
    day = F.to_date(committed)
    inside = F.lit(True)
    if since is not None:
        inside = inside & (day >= since)
    if before is not None:
        inside = inside & (day < before)
    chosen = {"all": F.lit(True), "active": ~stale, "stale": stale}[wanted]
    return F.when(inside & chosen, F.struct(age.alias("age_seconds"), stale.alias("stale")))


def disposition(fork: Column, archived: Column, include_forks: bool, include_archived: bool) -> Column:
    """fork, archived or keep; a fork that is archived counts as a fork."""
    return (
        F.when(fork & F.lit(not include_forks), "fork")
        .when(archived & F.lit(not include_archived), "archived")
        .otherwise("keep")
    )


def code_hits(df: DataFrame, file_name: Column) -> DataFrame:
    """Public code-search hits (path, private, ...) whose file has the very name."""
    return df.filter(~F.coalesce(F.col("private"), F.lit(False)) & (final_component(F.col("path")) == file_name))
