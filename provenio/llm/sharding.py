"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.llm.common import free_prefix, text_or_empty

# The multiplier of the published 64-bit generator, as its upper and lower 32 bits.
MULTIPLIER_HIGH = 2862933555777941757 >> 32
MULTIPLIER_LOW = 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Each shard is numbered in so many blocks at once.
BLOCKS = 1024


def _low_product(value: str, factor: int) -> str:
    """SQL for (value * factor) mod 2^32 of 32-bit operands, without leaving 64 bits."""
    upper = f"shiftleft((shiftright({value}, 16) * {factor}L) & 65535L, 16)"
    return f"(({upper} + ({value} & 65535L) * {factor}L) & {MASK}L)"


def _next_state(high: str, low: str) -> tuple[str, str]:
    """SQL for the halves of state * MULTIPLIER + 1 mod 2^64, in arithmetic that never overflows."""
    top = f"(shiftright({low}, 16) * {MULTIPLIER_LOW}L)"
    bottom = f"(({low} & 65535L) * {MULTIPLIER_LOW}L + 1L)"
    partial = f"(shiftleft({top} & 65535L, 16) + {bottom})"
    carry = f"(shiftright({partial}, 32) + shiftright({top}, 16))"
    new_high = f"(({_low_product(high, MULTIPLIER_LOW)} + {_low_product(low, MULTIPLIER_HIGH)} + {carry}) & {MASK}L)"
    return new_high, f"({partial} & {MASK}L)"


def jump_hash(high: str, low: str, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key given as two columns with its upper and lower 32 bits.

    The candidate only ever moves up, so that shards steps are always enough; a finished fold leaves its state
    as it is.
    """
    next_high, next_low = _next_state("s.high", "s.low")
    fold = f"""aggregate(
        sequence(1, {int(shards)}),
        named_struct('shard', -1L, 'next', 0L, 'high', cast({high} as bigint), 'low', cast({low} as bigint)),
        (acc, i) -> if(acc.next >= {int(shards)}, acc, get(transform(array(acc), s ->
            get(transform(array(named_struct('high', {next_high}, 'low', {next_low})), n ->
                named_struct('shard', s.next,
                    'next', cast(floor((s.next + 1) * (2147483648D / (shiftright(n.high, 1) + 1))) as bigint),
                    'high', n.high, 'low', n.low)), 0)), 0)),
        acc -> cast(acc.shard as int))"""
    return F.expr(fold)


def shard_by_key(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS
) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard added.

    The key is the first 64 bits of the MD5 of the id as text. The law is `key`: id and number of shards alone
    decide, and with one more shard a row stays or goes to the new one (grown_shard). Equal texts are therefore
    not kept together; text_crc32 names them. Slots number each shard's rows from 0 without gaps: rows
    are counted by (shard, block of the key), running sums over that small table give each block's first slot,
    and only one block's rows are sorted together.

    Edge cases: no rows give no rows; a null text has the size 1 and the CRC 0; texts of any length are read whole;
    null ids are one key; rows that repeat an id share the shard and get different slots, in the order of CRC and
    size; columns of df named like the added ones are replaced, all others are kept whatever their names.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col)])
    own = free_prefix(rows)
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    word = lambda first: F.conv(F.substring(digest, first, 8), 16, 10).cast("long")
    keyed = (
        rows.withColumn(f"{own}high", word(1))
        .withColumn(f"{own}low", word(9))
        .withColumn("size", F.octet_length(text_or_empty(text_col)).cast("long") + 1)
        .withColumn("text_crc32", F.crc32(text_or_empty(text_col).cast("binary")))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", jump_hash(f"{own}high", f"{own}low", shards))
        .withColumn("grown_shard", jump_hash(f"{own}high", f"{own}low", shards + 1))
        .withColumn(f"{own}block", F.col(f"{own}low") % blocks)
    )
    counted = keyed.groupBy("shard", f"{own}block").agg(F.count(F.lit(1)).alias(f"{own}n"))
    before = Window.partitionBy("shard").orderBy(f"{own}block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        F.col("shard").alias(f"{own}shard"), F.col(f"{own}block").alias(f"{own}its_block"), F.coalesce(F.sum(f"{own}n").over(before), F.lit(0)).alias(f"{own}start")
    )
    within = Window.partitionBy("shard", f"{own}block").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32", "size")
    numbered = keyed.withColumn(f"{own}within", F.row_number().over(within) - 1)
    # shards * blocks rows at most, whatever the size of the corpus: small enough to broadcast
    placed = numbered.join(F.broadcast(starts), (F.col("shard") == F.col(f"{own}shard")) & (F.col(f"{own}block") == F.col(f"{own}its_block")))
    return placed.withColumn("slot", F.col(f"{own}start") + F.col(f"{own}within")).select(*rows.columns, *added)
