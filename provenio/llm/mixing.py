"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.common import free_prefix, text_or_empty, word_count, written

#: Ties of (source, size) are dealt over so many buckets, so that a group of copies is not one task's work.
TIE_BUCKETS = 256


def _digits(name: str, first: int, length: int, *salt: str) -> Column:
    """A number from hexadecimal digits of the MD5 of a column as text."""
    salted = F.concat(*[F.lit(s) for s in salt], F.coalesce(F.col(name).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(salted), first, length), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, source_col: str, size_col: str, weights: Sequence[float], max_repeats: int
) -> DataFrame:
    """(source, source_size, target): a row per source, the targets sharing the sum of all sizes.

    Sources by code point, null last, take the weights in turn. A target stops at max_repeats times its source's
    size; what is over is shared again by weight until none is above. Sorted by the share at which they reach
    that limit, the limited sources are a prefix, so one running sum over the sources finds them all. There is a
    row per source here, not per document: it is the one ordered window over a whole (aggregated) table.
    """
    per_source = sizes.groupBy(source_col).agg(F.sum(size_col).alias("source_size"))
    ranked = per_source.withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy("_at", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    limited = (
        ranked.withColumn("_weight", weight)
        .withColumn("_limit", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("_at", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"))
        .withColumn("_used", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_share", (F.col("_total") - F.col("_used")) / F.col("_rest"))
        .withColumn("_open", F.col("_share") <= F.col("_at"))
        .withColumn("_level", F.min(F.when(F.col("_open"), F.struct("_at", "_rank", "_share"))).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(
        F.least(F.col("_limit"), F.col("_level._share") * F.col("_weight"))
    )
    return limited.select(F.col(source_col).alias("_source"), "source_size", target.alias("target"))


def ranked_in_source(sizes: DataFrame, source_col: str, size_col: str, id_col: str) -> DataFrame:
    """sizes with _position: 0, 1, ... within each source by size, then by a hash of the id, then by the id.

    No task sorts a whole source: documents are counted by (source, size) and by (source, size, tie bucket),
    running sums over those small tables give each bucket's first position, and only the rows of one bucket are
    sorted together.
    """
    bucketed = sizes.withColumn("_bucket", _digits(id_col, 1, 2) % TIE_BUCKETS)
    keys = [F.coalesce(F.xxhash64(F.col(source_col), F.lit(1)), F.lit(0)).alias("_source_key")]
    bucketed = bucketed.select("*", *keys)
    by_bucket = bucketed.groupBy("_source_key", size_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_size = by_bucket.groupBy("_source_key", size_col).agg(F.sum("_n").alias("_n"))
    before_size = Window.partitionBy("_source_key").orderBy(size_col).rowsBetween(Window.unboundedPreceding, -1)
    before_bucket = (
        Window.partitionBy("_source_key", size_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    size_start = by_size.select(
        "_source_key", size_col, F.coalesce(F.sum("_n").over(before_size), F.lit(0)).alias("_size_start")
    )
    starts = by_bucket.withColumn("_bucket_start", F.coalesce(F.sum("_n").over(before_bucket), F.lit(0))).drop("_n")
    starts = starts.join(size_start, ["_source_key", size_col]).withColumn(
        "_start", F.col("_size_start") + F.col("_bucket_start")
    )
    within = Window.partitionBy("_source_key", size_col, "_bucket").orderBy(F.col(id_col).asc_nulls_last())
    placed = bucketed.withColumn("_within", F.row_number().over(within) - 1)
    return (
        placed.join(starts.select("_source_key", size_col, "_bucket", "_start"), ["_source_key", size_col, "_bucket"])
        .withColumn("_position", F.col("_start") + F.col("_within"))
        .drop("_bucket", "_start", "_within", "_source_key")
    )


def mix_sources(
    df: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document.

    A document's size is its number of words (a null text has none). Each document of a source is expected
    target / source_size times. These expected copies are summed along the source's documents, which are in
    order of size so that every stretch of the order brings near its share of words, one offset is drawn from the
    seed and the source's name, and a document is taken once for each whole number that the sum plus the offset
    passes. Copies are therefore the expectation rounded down or up, at most max_repeats, and the same seed gives
    the same mix.

    Edge cases: no rows give no rows; null sources are one source, the last; a source without words has the
    target 0 and is not taken; rows that repeat an id are each placed by themselves; extra columns are not read.
    """
    sizes = written(
        df.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), word_count(text_or_empty(text_col)).alias("_size")
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, "_src", "_size", weights, max_repeats)
    placed = ranked_in_source(sizes, "_src", "_size", "_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _digits("_src", 1, 8, seed) / F.lit(4294967296.0)
    joined = placed.join(targets, F.col("_src").eqNullSafe(F.col("_source"))).withColumn("_rate", rate).withColumn("_offset", offset)
    copies = F.floor(F.col("_rate") * (F.col("_position") + 1) + F.col("_offset")) - F.floor(
        F.col("_rate") * F.col("_position") + F.col("_offset")
    )
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_src").alias(source_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.least(copies, F.lit(max_repeats)).cast("long").alias("copies"),
    )


def mixed_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_broadcast: int = 1_000_000, **options
) -> DataFrame:
    """The rows of df that the mix takes, each as often as it is taken.

    The copies (a narrow row for each document taken) are broadcast while there are at most max_broadcast, which
    is counted first; beyond that they are sort-merge joined. Rows that repeat an id are taken each by itself: those of
    one source and size are numbered, and the n-th gets the n-th of their copies. Other edge cases are those of
    mix_sources; columns of df are kept whatever their names.
    """
    own = free_prefix(df)
    key, copies, nth = f"{own}id", f"{own}copies", f"{own}nth"
    mixed = mix_sources(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    mixed = written(mixed.select(F.col(id_col).alias(key), F.col(source_col).alias(f"{own}src"), F.col("size").alias(f"{own}size"), F.col("copies").alias(copies)), "mix-copies")
    repeated = written(mixed.groupBy(F.col(key).alias(f"{own}again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated-ids")
    small = lambda d: F.broadcast(d) if d.count() <= max_broadcast else d
    if repeated.isEmpty():
        taken = small(mixed.filter(F.col(copies) > 0).select(key, copies))
        joined = df.join(taken, F.col(id_col).eqNullSafe(F.col(key)))
    else:
        again = small(repeated)
        one = mixed.join(again, F.col(key).eqNullSafe(F.col(f"{own}again")), "left_anti").filter(F.col(copies) > 0)
        single = df.join(small(one.select(key, copies)), F.col(id_col).eqNullSafe(F.col(key)))
        several = df.join(again, F.col(id_col).eqNullSafe(F.col(f"{own}again")), "left_semi")
        size = word_count(text_or_empty(text_col))
        order = Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_or_empty(text_col)))
        numbered = several.withColumn(nth, F.row_number().over(order)).withColumn(f"{own}words", size)
        each = Window.partitionBy(key, f"{own}src", f"{own}size").orderBy(F.col(copies).desc())
        dealt = mixed.join(again, F.col(key).eqNullSafe(F.col(f"{own}again")), "left_semi").withColumn(f"{own}k", F.row_number().over(each)).filter(F.col(copies) > 0)
        on = (
            F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).eqNullSafe(F.col(f"{own}src"))
            & (F.col(f"{own}words") == F.col(f"{own}size")) & (F.col(nth) == F.col(f"{own}k"))
        )
        joined = single.select(*df.columns, copies).unionByName(numbered.join(dealt, on).select(*df.columns, copies))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return joined.select(*df.columns, repeats.alias(copies)).drop(copies)
