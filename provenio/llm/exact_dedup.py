"""Exact dedup by two passes over a Bloom filter of repeated hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import free_prefix, text_or_empty, written

WORD_BITS = 64
#: The filter is broadcast in at most so many pieces.
MAX_PIECES = 16


def _slots(hashed: Column, slots: int) -> list[Column]:
    """The two filter slots of a 64-bit hash."""
    return [F.pmod(hashed, F.lit(slots)), F.pmod(F.xxhash64(hashed, F.lit(7)), F.lit(slots))]


def repeat_filter(hashes: DataFrame, hash_col: str, slots: int) -> DataFrame:
    """Pass 1: (word, bits), the non-zero 64-bit words of a filter whose set bits are slots hit twice or more.

    A row per slot and task is shuffled at most: counts are combined before the exchange, so a hash that
    holds a third of all rows costs no more than any other.
    """
    hits = hashes.select(F.explode(F.array(*_slots(F.col(hash_col), slots))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 2")
    bit = F.expr(f"shiftleft(1L, cast(slot % {WORD_BITS} as int))")
    return twice.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots_per_row: int = 16,
    max_broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256 added.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id
    stays. Pass 1 builds the filter of repeated hashes; pass 2 tests each row against it. Rows that miss are
    unique and pass straight through; only those that hit are shuffled, by SHA-256, and a false hit merely
    joins them as a group of one.

    Both passes are joins and aggregates with map-side combining. The filter is broadcast in pieces of at most
    max_broadcast_rows words (16 bytes each), which are counted first; if it needs more than MAX_PIECES, all rows
    count as possible repeats. The table of groups (48 bytes a row) is broadcast while it has a quarter of that many
    rows, and beyond is sort-merge joined with the suspects, where adaptive execution splits a hot group.

    Edge cases: no rows give no rows; texts of any length are hashed whole; rows that repeat both id and text stay
    or go together; null ids are never the largest while there is another, and a group of null ids only has keep_id
    null and stays whole; columns of df named like the added ones are replaced, all others are kept whatever
    their names.
    """
    spark = df.sparkSession
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col)])
    own = free_prefix(rows)
    hash_col, suspect = f"{own}hash", f"{own}suspect"
    rows = rows.withColumn(hash_col, F.xxhash64(text_or_empty(text_col)))
    count = rows.count()
    slots = 1 << max(16, (slots_per_row * count - 1).bit_length())
    found = written(repeat_filter(rows.select(hash_col), hash_col, slots), "repeat-filter")
    pieces = max(1, -(-found.count() // max(max_broadcast_rows, 1)))

    sha = F.sha2(text_or_empty(text_col), 256)
    if pieces <= MAX_PIECES:
        tested, hits = rows, []
        for k, slot in enumerate(_slots(F.col(hash_col), slots)):
            at, held = F.shiftright(slot, 6), []
            for piece in range(pieces):
                word, bits = f"{own}word{k}_{piece}", f"{own}bits{k}_{piece}"
                side = found.filter(F.pmod("word", F.lit(pieces)) == piece) if pieces > 1 else found
                side = F.broadcast(side.select(F.col("word").alias(word), F.col("bits").alias(bits)))
                tested = tested.join(side, at == F.col(word), "left")
                held.append(F.col(bits))
            hits.append(F.coalesce(F.getbit(F.coalesce(*held), (slot % WORD_BITS).cast("int")), F.lit(0)) == 1)
        tested = tested.select(*[F.col(c) for c in rows.columns], (hits[0] & hits[1]).alias(suspect))
    else:
        tested = rows.withColumn(suspect, F.lit(True))

    straight = tested.filter(~F.col(suspect)).select(
        *rows.columns,
        F.col(id_col).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        sha.alias("text_sha256"),
    )
    suspects = tested.filter(suspect).withColumn("text_sha256", sha)
    groups = written(
        suspects.groupBy(F.col("text_sha256").alias(f"{own}sha"))
        .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "repeat-groups",
    )
    if groups.count() <= max_broadcast_rows // 4:
        groups = F.broadcast(groups)
    repeated = suspects.join(groups, F.col("text_sha256") == F.col(f"{own}sha")).select(
        *rows.columns,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
    return straight.unionByName(repeated).drop(hash_col)
