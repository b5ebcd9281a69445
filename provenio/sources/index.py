"""Registry index files: one JSON document a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.text import canonical_name, once

LINE = (
    "name string, vers string, yanked boolean, deps array<struct<name: string, req: string, package: string, kind: string, "
    "optional: boolean, target: string, registry: string>>, _corrupt string"
)


def release_lines(files: DataFrame, keys: list[str], version_col: str) -> DataFrame:
    """(keys, line, error): the first line of each file (body) with the wanted version.

    Blank lines are passed over; lines after the match are not looked at; a line before it that does not parse is an
    error, and so is a version that no line has.
    """
    lines = F.filter(F.split("body", "\n"), lambda t: F.btrim(t) != "")
    parsed = lambda t: F.from_json(t, LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    corrupt = lambda line: line["_corrupt"].isNotNull() | line.isNull()
    decides = lambda line: corrupt(line) | line["vers"].eqNullSafe(F.col(version_col))
    # a file is one row, so nothing is shuffled; once a line has decided, no other is parsed
    nothing = F.lit(None).cast(f"struct<line: struct<{LINE}>>")
    first = F.aggregate(lines, nothing, lambda done, t: F.when(done.isNotNull(), done).otherwise(once(parsed(t), lambda line: F.when(decides(line), F.struct(line.alias("line"))))))
    found = once(first, lambda x: F.struct(x.isNull().alias("none"), (x.isNotNull() & corrupt(x["line"])).alias("bad"), x["line"].alias("line")))
    rows = files.select(*keys, found.alias("_found"))
    error = F.when(F.col("_found.none"), "no such release").when(F.col("_found.bad"), "malformed line")
    return rows.select(*keys, F.when(~F.col("_found.bad"), F.col("_found.line")).alias("line"), error.alias("error"))


def index_declarations(files: DataFrame, keys: list[str], version_col: str, target: str) -> DataFrame:
    """(keys, declarations, error): the dependencies of the release on the target, by canonical name.

    Declarations: alias, requirement, kind (normal if blank), optional, target, registry, in the line's order.
    """
    lines = release_lines(files, keys, version_col)
    wanted = canonical_name(F.lit(target))
    mine = F.filter("line.deps", lambda d: canonical_name(F.coalesce(d["package"], d["name"])) == wanted)
    cells = F.transform(
        mine,
        lambda d: F.struct(
            d["name"].alias("alias"),
            d["req"].alias("requirement"),
            F.when(F.coalesce(d["kind"], F.lit("")) == "", "normal").otherwise(d["kind"]).alias("kind"),
            F.coalesce(d["optional"], F.lit(False)).alias("optional"),
            d["target"].alias("target"),
            d["registry"].alias("registry"),
        ),
    )
    error = F.coalesce("error", F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, "release does not depend on the package"))
    return lines.select(*keys, F.when(error.isNull(), cells).alias("declarations"), error.alias("error"))


def with_fallback(candidates: DataFrame, declared: DataFrame, keys: list[str], fallback) -> DataFrame:
    """Candidates in their order, with the index's declarations or else the fallback one and the error's text."""
    return fallen_back(candidates.join(declared, keys, "left"), fallback)


def fallen_back(joined: DataFrame, fallback) -> DataFrame:
    """Candidates with the index's declarations and error beside them, where it has any."""
    error = F.when(F.col("declarations").isNull(), F.coalesce("error", F.lit("no index file")))
    return joined.withColumn("enrichment_error", error).withColumn("declarations", F.coalesce("declarations", F.array(fallback))).drop("error")


def page_rows(pages: DataFrame, scope: list[str]) -> DataFrame:
    """Dependencies of captured reverse pages (dependencies, versions), each with its version's row, in page order.

    The version must be on the page, once; several dependencies may share it.
    """
    from provenio.operators.joins import strict_join

    wanted = pages.select(*scope, "page", F.posexplode("dependencies").alias("position", "d"))
    wanted = wanted.select(*scope, "page", "position", "d.*").withColumn("_key", F.concat_ws("/", *scope, "page", "version_id"))
    offered = pages.select(*scope, "page", F.explode("versions").alias("v"))
    offered = offered.select(F.concat_ws("/", *scope, "page", "v.id").alias("_version_key"), F.col("v").alias("version"))
    return strict_join(wanted, offered, "_key", "_version_key").drop("_key", "_version_key")


def first_rows(rows: DataFrame, scope: list[str], limit: int | None = None) -> DataFrame:
    """The first row of each version_id in page order, at most limit."""
    order = Window.partitionBy(*scope, "version_id").orderBy("page", "position")
    first = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")
    return first if limit is None else first.orderBy("page", "position").limit(limit)
