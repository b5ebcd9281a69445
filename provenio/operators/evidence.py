"""Evidence as a state that adds up: groups that turn out to be one repository are merged before anything is judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.functions.semver import evaluate_requirement
from provenio.functions.text import once

#: Counts of a state; of two groups they are added.
COUNTS = [
    "releases", "unenriched", "declared", "accepting", "accepting_unknown", "pinning", "pinning_unknown", "optional", "required",
]
#: Sorted sets of a state; of two groups they are united.
SETS = ["urls", "sources", "dependents", "versions", "kinds", "targets"]
#: Published declarations are a multiset: of two groups all are kept, in the order of these fields, absent ones first.
DECLARED_ORDER = ["dependent_crate", "dependent_version", "kind", "dependency_alias", "requirement", "target"]


def evaluated(candidates: DataFrame, target: str, version: str) -> DataFrame:
    """candidates with each declaration's package, and what its requirement says of the version: accepts and exact_pin.

    Declarations: struct(alias, requirement, kind, optional, target, registry), and package if it is known. A requirement
    that does not parse neither accepts nor rejects: its answers are null.
    """
    given = candidates.schema["declarations"].dataType.elementType.fieldNames()

    def declaration(d: Column) -> Column:
        answer = evaluate_requirement(d["requirement"], F.lit(version))
        package = F.coalesce(d["package"], F.lit(target)) if "package" in given else F.lit(target)
        return once(
            answer,
            lambda a: F.struct(
                d["alias"].alias("alias"), package.alias("package"), d["requirement"].alias("requirement"), d["kind"].alias("kind"),
                F.coalesce(d["optional"], F.lit(False)).alias("optional"), d["target"].alias("target"), d["registry"].alias("registry"),
                a["accepts"].alias("accepts"), a["exact_pin"].alias("exact_pin"),
            ),
        )

    return candidates.withColumn("declarations", F.transform("declarations", declaration))


def _cell(d: Column) -> Column:
    """The twelve fields of a published declaration."""
    return F.struct(
        F.col("name").alias("dependent_crate"), F.col("version").alias("dependent_version"), F.col("version_id").alias("dependent_version_id"),
        F.col("downloads").alias("dependent_downloads"), d["alias"].alias("dependency_alias"), d["package"].alias("dependency_package"),
        d["requirement"].alias("requirement"), d["kind"].alias("kind"), d["optional"].alias("optional"), d["target"].alias("target"),
        d["registry"].alias("registry"), F.col("enrichment_error").alias("enrichment_error"),
    )


def evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key. rows: (name, version, version_id, downloads, url, source, hint, position, enrichment_error,
    declarations) of releases, declarations as evaluated() gives them. Rows without a name come from searches: they only
    add their URL, source and hint (how the repository is spelled)."""
    none = F.array().cast("array<string>")
    published = F.col("name").isNotNull()
    several = lambda c: F.array_compact(F.array(c))
    size = lambda test: F.coalesce(F.size(F.filter("declarations", test)), F.lit(0))
    each = lambda f: F.array_compact(F.coalesce(F.transform("declarations", f), none))
    per_row = rows.select(
        *keys, "hint", "position", several("url").alias("urls"), several("source").alias("sources"), several("name").alias("dependents"),
        F.when(published, F.array(F.concat_ws("@", "name", "version"))).otherwise(none).alias("versions"),
        each(lambda d: d["kind"]).alias("kinds"), each(lambda d: d["target"]).alias("targets"),
        F.transform("declarations", _cell).alias("declarations"),
        published.cast("int").alias("releases"), (published & F.col("enrichment_error").isNotNull()).cast("int").alias("unenriched"),
        size(lambda d: F.lit(True)).alias("declared"),
        size(lambda d: d["accepts"]).alias("accepting"), size(lambda d: d["accepts"].isNull()).alias("accepting_unknown"),
        size(lambda d: d["exact_pin"]).alias("pinning"), size(lambda d: d["exact_pin"].isNull()).alias("pinning_unknown"),
        size(lambda d: d["optional"]).alias("optional"), size(lambda d: ~d["optional"]).alias("required"),
    )
    return merged_evidence(per_row, keys)


def merged_evidence(states: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """States of the same key added up: the same operation makes a group's state of rows and a repository's of groups."""
    return states.groupBy(*keys).agg(
        F.min_by("hint", F.when(F.col("hint").isNotNull(), F.struct(F.col("position").isNull(), "position", "hint"))).alias("hint"),
        F.min("position").alias("position"),
        *[F.sum(c).cast("long").alias(c) for c in COUNTS],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in SETS],
        F.flatten(F.collect_list("declarations")).alias("declarations"),
        *more,
    )


def ordered_declarations(declarations: Column) -> Column:
    """The multiset as an array in DECLARED_ORDER; equal declarations all stay."""
    keyed = F.transform(
        declarations,
        lambda c: F.struct(F.struct(*[F.struct(c[f].isNotNull().alias("there"), c[f].alias("value")).alias(f) for f in DECLARED_ORDER]).alias("order"), c.alias("cell")),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["cell"])


def _three_valued(yes: str, unknown: str) -> Column:
    return (
        F.when(F.col(yes) > 0, "true")
        .when((F.col("unenriched") > 0) | (F.col("declared") == 0) | (F.col(unknown) > 0), "unknown")
        .otherwise("false")
    )


def judgements() -> dict[str, Column]:
    """What a state says: whether any requirement accepts or pins the version, and how optional the dependency is.

    One certain yes is enough. Otherwise a release whose lookup failed, a requirement that does not parse and an empty
    state leave it unknown. Optional and required declarations together are `mixed`, whatever was not looked up.
    """
    some, other = F.col("optional") > 0, F.col("required") > 0
    return {
        "any_requirement_accepts": _three_valued("accepting", "accepting_unknown"),
        "any_exact_pin": _three_valued("pinning", "pinning_unknown"),
        "optional_declarations": F.when(some & other, "mixed")
        .when((F.col("unenriched") > 0) | (F.col("declared") == 0), "unknown")
        .when(some, "all")
        .otherwise("none"),
    }
