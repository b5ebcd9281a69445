"""Caps, budgets and bounded selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paged_rows(df: DataFrame, key: str, page: str, position: str, limit: int | None = None) -> DataFrame:
    """Rows of a paged scan in page order: the first of each key, at most limit."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(page, position)))
    first = ranked.filter("_rank = 1").drop("_rank")
    return first if limit is None else first.orderBy(page, position).limit(limit)


def has_next_page(page_length: Column, seen: Column, total: Column, page_size: int) -> Column:
    """A full page, and not all seen yet."""
    return (page_length >= page_size) & (seen < total)


def bounded(total: Column, returned: Column, incomplete: Column) -> Column:
    """Whether a search gave less than there is."""
    return (total > returned) | incomplete


def capped_files(df: DataFrame, group: str, is_lock: Column, order: list[Column], cap: int = 2000) -> DataFrame:
    """df with selected and over_cap: of each group at most cap files, locks first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(is_lock.desc(), *order))
    total = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("selected", rank <= cap).withColumn("over_cap", total > cap)


def reserved_bytes(size: Column, max_file: int, budget: int) -> Column:
    """Aggregate: what the locks may take, an unknown size at the most a file may have."""
    return F.least(F.sum(F.coalesce(size, F.lit(max_file))).cast("long"), F.lit(budget).cast("long"))


def greedy_budget(items: Column, budget: Column, max_file: int, consumed: Column | None = None) -> Column:
    """struct(consumed, hit, admitted, refused): files admitted one by one while they fit what is left of the budget.

    items: an array, in order, of struct(key, size, actual, fetched). One that does not fit is passed over, sets
    hit, and smaller ones after it may still get in. An unknown size gets in while anything is left. A file that was
    not fetched takes nothing. State depends on all decisions before, so this is a fold and not a running sum. The keys
    of those that did not fit are listed as well (refused).
    """
    empty = F.array().cast("array<string>")
    start = F.struct(
        (consumed if consumed is not None else F.lit(0)).cast("long").alias("consumed"),
        F.lit(False).alias("hit"),
        empty.alias("admitted"),
        empty.alias("refused"),
    )

    def step(state: Column, item: Column) -> Column:
        left = budget.cast("long") - state["consumed"]
        fits = F.when(item["size"].isNull(), left > 0).otherwise((item["size"] <= left) & (item["size"] <= max_file))
        taken = F.when(fits & item["fetched"], F.least(item["actual"], left)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (state["consumed"] + taken).alias("consumed"),
            (state["hit"] | ~fits).alias("hit"),
            F.when(fits & item["fetched"], F.concat(state["admitted"], F.array(item["key"].cast("string")))).otherwise(state["admitted"]).alias("admitted"),
            F.when(fits, state["refused"]).otherwise(F.concat(state["refused"], F.array(item["key"].cast("string")))).alias("refused"),
        )

    return F.aggregate(items, start, step)


def shallowest(df: DataFrame, group: str, path: str, most: int = 16) -> DataFrame:
    """Of each group the `most` paths with the fewest slashes, then by path."""
    depth = F.char_length(path) - F.char_length(F.replace(F.col(path), F.lit("/"), F.lit("")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(depth, path))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def overscan(
    groups: DataFrame, key: str, identity: str, private: str, most: int | None, jobs: int = 4, factor: int = 4
) -> DataFrame:
    """groups with position, held, considered and kept: a scan in key order until `most` public identities are held.

    At most factor * most groups are looked at, in batches of `jobs`; the last batch is the one in which the number
    of distinct public identities reaches `most`, and the first `most` of them are kept, with the later rows of a
    kept identity inside the scan; held is how many there are up to a row. Without `most` all public rows are. Only the
    rows that a bounded selection may look at go through an ordered window.
    """
    if most is None:
        found = groups.withColumn("position", F.lit(None).cast("int")).withColumn("held", F.lit(None).cast("long"))
        return found.withColumn("considered", F.lit(True)).withColumn("kept", F.col(identity).isNotNull() & ~F.col(private))
    cut = groups.orderBy(key).limit(factor * most)
    ordered = cut.withColumn("position", F.row_number().over(Window.orderBy(key)) - 1)
    public = F.col(identity).isNotNull() & ~F.col(private)
    first = F.row_number().over(Window.partitionBy(F.when(public, F.col(identity))).orderBy("position")) == 1
    news = ordered.withColumn("_new", (public & first).cast("int"))
    held = F.sum("_new").over(Window.orderBy("position"))
    counted = news.withColumn("held", held)
    last = F.min(F.when(F.col("held") >= most, F.floor(F.col("position") / jobs))).over(Window.partitionBy())
    scanned = counted.withColumn("considered", last.isNull() | (F.floor(F.col("position") / jobs) <= last) if most else F.lit(False))
    rank_of = F.min(F.when(public, F.col("held"))).over(Window.partitionBy(F.when(public, F.col(identity))))
    return scanned.withColumn("kept", F.col("considered") & public & (rank_of <= most)).drop("_new")
