"""Reports over an inventory of facts: sorted, grouped, as JSON or Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.semver import semver_or_text_key
from provenio.functions.text import json_cell, markdown_cell
from provenio.sources.scratch import written

# The columns a report may be grouped by, by the option's name, and those of the Markdown table.
GROUPS = {"msrv": "msrv_effective", "os": "os_observed_targets_json", "stale": "stale"}
TABLE = ["github_full_name", "head_sha", "head_committed_at", "msrv_effective", "os_observed_targets_json"]


def require_columns(df: DataFrame, names: list[str]) -> None:
    """An error that names the first column that is not there."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"the inventory has no column {name}")


def sort_keys(order: str, repository: str = "github_full_name", committed: str = "head_committed_at", msrv: str = "msrv_effective") -> list[Column]:
    """order: last-commit-desc, last-commit-asc (as text), msrv-asc or msrv-desc; ties by repository and commit."""
    keys = {
        "last-commit-desc": F.col(committed).desc(),
        "last-commit-asc": F.col(committed).asc(),
        "msrv-asc": semver_or_text_key(F.col(msrv)).asc(),
        "msrv-desc": semver_or_text_key(F.col(msrv)).desc(),
    }
    return [keys[order], F.col(repository), F.col(committed)]


def ranked(df: DataFrame, keys: list[Column], group: Column | None = None) -> DataFrame:
    """df with group and position: each group in order.

    No task sorts a whole group: rows are written in ranges of (group, keys), and the counts of each group's ranges
    give the positions at which they start.
    """
    labelled = df.withColumn("group", group if group is not None else F.lit(""))
    dealt = written(labelled.repartitionByRange("group", *keys).withColumn("_range", F.spark_partition_id()), "report-ranges")
    counted = dealt.groupBy("group", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        F.col("group").alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    placed = dealt.withColumn("_within", F.row_number().over(Window.partitionBy("group", "_range").orderBy(*keys)))
    joined = placed.join(F.broadcast(starts), F.col("group").eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return joined.select(*labelled.columns, (F.col("_start") + F.col("_within")).cast("int").alias("position"))


def json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(group, position, line): each row as a JSON object of texts."""
    texts = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    return df.select("group", "position", json_cell(texts).alias("line"))


def markdown_lines(df: DataFrame) -> DataFrame:
    """(group, position, line): each row as a line of the five-column table; a blank commit is a dash."""
    commit = F.when(F.coalesce("head_sha", F.lit("")) == "", "-").otherwise(F.substring("head_sha", 1, 10))
    cells = [markdown_cell(F.col("github_full_name")), commit, *[markdown_cell(F.coalesce(F.col(c), F.lit(""))) for c in TABLE[2:]]]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    label = F.when(F.col("group") == "", "unknown").otherwise(F.col("group"))
    return df.select(label.alias("group"), "position", line.alias("line"))


def _text(value: Column) -> Column:
    """A text as JSON writes it, quoted and escaped."""
    cell = json_cell(F.array(F.coalesce(value.cast("string"), F.lit(""))))
    return F.substr(cell, F.lit(2), F.char_length(cell) - 2)


def json_document(df: DataFrame, keys: list[Column], columns: list[str], group: Column | None = None) -> DataFrame:
    """(group, position, text): pieces that make one indented JSON document when they are put together in this order.

    With a group the document is `[{"group": ..., "rows": [...]}]`, groups by text; without one it is the rows. Fields
    are in the order of their names. Every row is a piece of its own, which opens its group if it is the first there
    and closes it if it is the last: no task and no driver holds a group, and the pieces can be written by ranges (see
    sinks.write_document, whose `empty` is what stands for no rows: `[]`).
    """
    placed = ranked(df, keys, F.coalesce(group.cast("string"), F.lit("")) if group is not None else None)
    sizes = placed.groupBy(F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.agg(F.min("_group").alias("_first"), F.max("_group").alias("_last"))
    whole = placed.join(sizes, F.col("group").eqNullSafe(F.col("_group"))).join(F.broadcast(ends), F.lit(True))  # one row
    deep = "      " if group is not None else "  "
    fields = [F.concat(F.lit(f'{deep}  "{c}": '), _text(F.col(c))) for c in sorted(columns)]
    row = F.concat(F.lit(f"{deep}{{\n"), F.concat_ws(",\n", *fields), F.lit(f"\n{deep}}}"))
    opens, closes = F.col("position") == 1, F.col("position") == F.col("_n")
    first, last = opens & (F.col("group") == F.col("_first")), closes & (F.col("group") == F.col("_last"))
    before = F.when(first, "[\n").otherwise("")
    after = F.when(last, "\n]").otherwise(",\n")
    if group is not None:
        before = F.concat(before, F.when(opens, F.concat(F.lit('  {\n    "group": '), _text(F.col("group")), F.lit(',\n    "rows": [\n'))).otherwise(""))
        after = F.concat(F.when(closes, "\n    ]\n  }").otherwise(""), after)
    return whole.select("group", "position", F.concat(before, row, after).alias("text"))


#: The Markdown report's table.
MARKDOWN_HEAD = "| Repository | Last Commit | MSRV | OS | Stale |\n|---|---|---|---|---|\n"


def markdown_document(df: DataFrame, keys: list[Column], group: Column | None = None) -> DataFrame:
    """(group, position, text): pieces of the Markdown report, a table for each group under its name; the last commit is
    shown as a day, and as a dash where there is none."""
    require_columns(df, ["github_full_name", "head_committed_at", "msrv_effective", "os_observed_targets_json", "stale"])
    placed = ranked(df, keys, F.coalesce(group.cast("string"), F.lit("")) if group is not None else None)
    sizes = placed.groupBy(F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    whole = placed.join(sizes, F.col("group").eqNullSafe(F.col("_group")))
    cell = lambda c: markdown_cell(F.coalesce(c, F.lit("")))
    day = F.substring(F.coalesce("head_committed_at", F.lit("")), 1, 10)
    cells = [cell(F.when(day == "", "-").otherwise(day)), *[cell(F.col(c)) for c in ("msrv_effective", "os_observed_targets_json", "stale")]]
    row = F.concat(F.lit("| `"), cell(F.col("github_full_name")), F.lit("` | "), F.concat_ws(" | ", *cells), F.lit(" |\n"))
    name = F.concat(F.lit("### "), cell(F.when(F.col("group") == "", "unknown").otherwise(F.col("group"))), F.lit("\n\n"))
    before = F.when(F.col("position") == 1, F.concat(name if group is not None else F.lit(""), F.lit(MARKDOWN_HEAD))).otherwise("")
    after = F.when((F.col("position") == F.col("_n")) & F.lit(group is not None), "\n").otherwise("")
    return whole.select("group", "position", F.concat(before, row, after).alias("text"))
