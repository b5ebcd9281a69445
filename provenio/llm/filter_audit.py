"""What five filters remove in every order: survivors of all filter subsets by SQL CUBE, joined in pairs for each step."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import let, text_or_empty, word_array, written

# The filters and the characters that one of them looks for.
FILTERS = "ABCDE"
LATIN_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JUNK = "[#$%&*|]"

ALL = (1 << len(FILTERS)) - 1
COUNTS = ["docs", "good", "toxic"]


def text_flags(text: Column) -> list[Column]:
    """Failures of the filters that look at one text: A few words, B repeated words, C capitals, D junk characters."""
    sizes = let(word_array(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))
    capitals = F.char_length(text) - F.char_length(F.translate(text, LATIN_CAPITALS, ""))
    return [
        let(sizes, lambda s: F.struct((s["n"] < 50).alias("A"), (100 * s["different"].cast("long") < 65 * s["n"].cast("long")).alias("B"))),
        (100 * capitals.cast("long") > 5 * F.char_length(text).cast("long")).alias("C"),
        text.rlike(JUNK).alias("D"),
    ]


def document_facts(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, A, B, C, D) of every row: narrow, without the text."""
    words, capitals, junk = text_flags(F.col("text"))
    return (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
        .select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), words.alias("words"), capitals, junk)
        .select("id", "part", "digest", "words.A", "words.B", "C", "D")
    )


def failure_profiles(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, A, B, C, D, E, docs, good, toxic): how many documents fail which filters together, 32 rows a part at most.

    E fails where a smaller id has the same text. The least id of each text comes from one aggregate over digests,
    combined before its shuffle, and meets the rows by (id, digest), so that copies of one text are never gathered:
    however many there are, one row of them goes out again. Labels are one row an id before they are joined.
    """
    facts = written(document_facts(docs, id_col, text_col, part_col), "audit-facts")
    first = facts.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").select("id", "digest", F.lit(False).alias("later"))
    marked = (
        labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    )
    joined = facts.join(first, ["id", "digest"], "left").join(marked, "id", "left")
    later = F.col("id").isNotNull() & F.coalesce(F.col("later"), F.lit(True))
    counted = lambda name: F.sum(F.when(F.col(name), 1).otherwise(0)).alias(name)
    return (
        joined.select("part", "A", "B", "C", "D", later.alias("E"), "good", "toxic")
        .groupBy("part", *FILTERS)
        .agg(F.count(F.lit(1)).alias("docs"), counted("good"), counted("toxic"))
    )


def subset_survivors(profiles: DataFrame) -> DataFrame:
    """(part, subset, docs, good, toxic): what is left when the filters of a subset (its bits, A the lowest) have run.

    SQL CUBE over the flags and the part gives a grouping set for every subset of flags; its row in which all
    selected flags are false counts the survivors. Subsets without survivors have no row.
    """
    cubed = profiles.cube("part", *FILTERS).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("whole"), *[F.grouping(f).alias(f"no{f}") for f in FILTERS]
    )
    passed = reduce(Column.__and__, [~F.coalesce(F.col(f), F.lit(False)) for f in FILTERS])
    subset = reduce(Column.__add__, [(1 - F.col(f"no{f}")) * (1 << k) for k, f in enumerate(FILTERS)])
    return cubed.filter((F.col("whole") == 0) & passed).select("part", subset.cast("int").alias("subset"), *COUNTS)


def _rows(names: str, values: list[tuple]) -> Column:
    """Fixed rows as an array of structs, to be exploded beside each part."""
    fields = names.split()
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row, strict=True)]) for row in values])


def pair_effects(survivors: DataFrame) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost, orders) of each subset and a filter not in it.

    orders: in how many orders of all filters exactly this subset has run before the filter.
    """
    n = len(FILTERS)
    pairs = [
        (f, before, before | 1 << k, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count()))
        for k, f in enumerate(FILTERS)
        for before in range(ALL + 1)
        if not before >> k & 1
    ]
    parts = survivors.filter("subset = 0").select("part")
    steps = parts.select("part", F.inline(_rows("filter before after orders", pairs)))
    side = lambda key: survivors.select("part", F.col("subset").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in COUNTS])
    joined = steps.join(side("before"), ["part", "before"], "left").join(side("after"), ["part", "after"], "left").na.fill(0)
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    return joined.select(
        "part", "filter", "before", "orders", F.col("after_docs").alias("kept"),
        lost("docs").alias("removed"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Documents are counted once, by part and failures; everything after that is over 32 rows a part at most: the
    CUBE, the join of the survivors before and after a step, and the 600 steps of a part. No text or id is shuffled
    but the narrow rows that find equal texts and labels.

    Edge cases: no documents give no rows; a null text is empty (it fails A only, and E if an earlier empty text is
    there); texts of any length are judged whole; a null part is the part of the empty string, together with empty
    ones; rows that repeat an id are each a document, none of them earlier than the other; a null id is neither
    earlier nor later than any other, and has no label; several labels of an id count as good (toxic) if one does;
    other columns of either table are not read.
    """
    effects = written(pair_effects(subset_survivors(failure_profiles(docs, labels, id_col, text_col, part_col))), "audit-pairs")
    bit = F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)])[F.col("filter")]
    alone = effects.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == ALL - bit, F.col("removed"))).alias("unique_fails"),
    )
    orders = ["".join(order) for order in permutations(FILTERS)]
    steps = [(order, k + 1, order[k], sum(1 << FILTERS.index(f) for f in order[:k])) for order in orders for k in range(len(order))]
    listed = effects.filter((F.col("before") == 0) & (F.col("filter") == FILTERS[0])).select(
        "part", F.inline(_rows("filter_order step filter before", steps))
    )
    return listed.join(effects, ["part", "filter", "before"]).join(alone, ["part", "filter"]).select(
        "part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
