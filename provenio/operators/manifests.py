"""What manifests declare about a package, with workspace inheritance resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.functions.semver import evaluate_requirement
from provenio.functions.urls import directory, normalise_path
from provenio.operators.aggregates import least_version
from provenio.operators.joins import inherit_templates, nearest_root
from provenio.sources.documents import manifests
from provenio.sources.scratch import written

# The fields of a dependency that a template gives, and the order of kinds in reports.
SPEC = ("version", "package", "git", "local", "registry")
KIND_ORDER = {"normal": 0, "development": 1, "build": 2}


@dataclass
class ManifestAnalysis:
    """declarations of the target, an msrv row per manifest, and diagnostics; all keyed by scope and path."""

    declarations: DataFrame
    msrv: DataFrame
    diagnostics: DataFrame


def analyze_manifests(files: DataFrame, scope: str, target: str, version: str) -> ManifestAnalysis:
    """files: (scope, path, text). All manifests of all scopes at once: parse, find roots, inherit, filter, evaluate."""
    parsed = written(manifests(files, [scope, "path"]), "manifests")
    roots = parsed.filter("is_root").select(
        scope, F.col("path").alias("root_path"), F.lit(0).alias("root_position"), "templates", "root_rust_version"
    )
    named = F.when(
        F.col("workspace").isNotNull(),
        normalise_path(F.concat_ws("/", F.when(directory(F.col("path")) != "", directory(F.col("path"))), F.col("workspace"), F.lit("Cargo.toml"))),
    )
    members = nearest_root(
        parsed.filter("parsed").withColumn("workspace", named), roots.select(scope, "root_path", "root_position"), [scope]
    )
    spread = members.select(scope, "path", "root_path", F.col("package").alias("package_name"), F.explode("declarations").alias("d")).select(
        scope, "path", "root_path", "package_name", "d.*"
    )
    own = spread.filter(~F.col("inherited"))
    templates = roots.select(scope, "root_path", F.explode("templates").alias("t")).select(
        scope, "root_path", F.col("t.alias").alias("alias"), "t.optional", *[F.col(f"t.{c}").alias(f"base_{c}") for c in SPEC]
    )
    inherited = inherit_templates(spread.filter("inherited"), templates, [scope, "root_path", "alias"])
    taken = inherited.filter("found").select(
        scope, "path", "package_name", "alias", "kind", "target", "optional", F.lit(True).alias("inherited"), F.col("root_path").alias("inherited_from"),
        *[F.col(f"base_{c}").alias(f"spec_{c}") for c in SPEC],
    )
    plain = own.select(
        scope, "path", "package_name", "alias", "kind", "target", F.coalesce("optional", F.lit(False)).alias("optional"), "inherited",
        F.lit(None).cast("string").alias("inherited_from"), *[F.col(c).alias(f"spec_{c}") for c in SPEC],
    )
    everything = plain.unionByName(taken).filter(F.coalesce("spec_package", "alias") == target)
    requirement = evaluate_requirement(F.col("spec_version"), F.lit(version))
    declarations = everything.withColumn("requirement", F.when(F.col("spec_version").isNotNull(), requirement))
    lost = F.col("root_path").isNull()
    missing = inherited.filter(~F.col("found")).select(
        scope, "path", F.when(lost, "workspace_root_unresolved").otherwise("workspace_dependency_unresolved").alias("code"),
        F.when(lost, F.concat(F.lit("no workspace root was found for "), "alias")).otherwise(F.concat_ws(" ", F.col("root_path"), F.lit("has no template for"), "alias")).alias("message"),
    )
    noted = parsed.select(scope, "path", F.explode("diagnostics").alias("n")).select(scope, "path", "n.code", "n.message")
    msrv = members.join(roots.select(scope, "root_path", F.col("root_rust_version").alias("_shared")), [scope, "root_path"], "left").select(
        scope,
        "path",
        F.when(F.col("rust_inherited"), F.col("_shared")).otherwise(F.col("rust_version")).alias("msrv"),
        F.when(F.col("rust_version").isNotNull(), "package_field").when(F.col("rust_inherited"), "workspace_inherited").otherwise("not_declared").alias("source"),
    )
    return ManifestAnalysis(declarations, msrv, noted.unionByName(missing))


def effective_msrv(msrv: DataFrame, scope: str) -> DataFrame:
    """(scope, msrv, source): the least full version observed, with where it stands; a two-part version does not count."""
    least = least_version(F.col("msrv"), F.col("path"), F.col("msrv"), F.col("source"))
    return msrv.groupBy(scope).agg(least.alias("_m")).select(
        scope, F.col("_m.msrv").alias("msrv"), F.coalesce("_m.source", F.lit("not_declared")).alias("source")
    )
