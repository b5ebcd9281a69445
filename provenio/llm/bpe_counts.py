"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from provenio.llm.common import text_or_empty

SPACE = "▁"
#: Counts of so many distinct segments are remembered by a Python worker; then it starts over.
MEMORY = 600_000


class PieceRanks:
    """The merge ranks of a SentencePiece BPE model.

    ranks: piece -> rank, the best score first; pieces of equal score have equal rank. known: single characters
    that are pieces; others fall back to their UTF-8 bytes, a token each.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [
            (model.get_score(i), model.id_to_piece(i))
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        ]
        order = {score: rank for rank, score in enumerate(sorted({score for score, _ in pieces}, reverse=True))}
        self.ranks = {piece: order[score] for score, piece in pieces}
        self.known = {piece for _, piece in pieces if len(piece) == 1}
        crosses = re.compile(f"[^{SPACE}]{SPACE}")
        #: No piece goes on into the next space, so no merge does: words are merged each by itself.
        self.splits = not any(crosses.search(piece) for _, piece in pieces)

    def count(self, symbols: str) -> int:
        """Tokens of a normalised string: its initial symbols less the merges made."""
        size = len(symbols)
        initial = sum(1 if c in self.known else len(c.encode()) for c in symbols)
        if size < 2:
            return initial
        return initial - self.merges(symbols)

    def merges(self, symbols: str) -> int:
        """Pop the lowest-rank adjacent pair, the leftmost of equals, until none is left; the number popped.

        The list is linked by index: end[i] is where the symbol that starts at i ends (0 once it is merged
        away), before[i] where the one before it starts. A popped pair is stale if either symbol has changed
        since it was pushed, which the pair's end shows.
        """
        ranks, size = self.ranks, len(symbols)
        end = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            rank = ranks.get(symbols[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 1, i + 2))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, left, middle, stop = heapq.heappop(heap)
            if end[left] != middle or middle >= size or end[middle] != stop:
                continue
            merged += 1
            end[left] = stop
            end[middle] = 0
            if stop < size:
                before[stop] = left
                rank = ranks.get(symbols[left : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop, end[stop]))
            if left > 0:
                first = before[left]
                rank = ranks.get(symbols[first:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, first, left, stop))
        return merged


@lru_cache(maxsize=2)
def piece_ranks(model_file: str) -> PieceRanks:
    return PieceRanks(model_file)


def text_counter(model_file: str):
    """A function from a text to its number of tokens, which remembers the segments it has met."""
    model = piece_ranks(model_file)
    segment = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    memory: dict[str, int] = {}

    def count(text: str | None) -> int:
        if not text:
            return 0
        normal = SPACE + text.replace(" ", SPACE)
        if not model.splits:
            return model.count(normal)
        total = 0
        for part in segment.findall(normal):
            found = memory.get(part)
            if found is None:
                found = model.count(part)
                if len(memory) >= MEMORY:
                    memory.clear()
                if len(part) <= 64:
                    memory[part] = found
            total += found
        return total

    return count


def n_tokens(text: Column, model_file: str) -> Column:
    """The tokens of a text under a SentencePiece BPE model that keeps white space and adds a leading space.

    Texts go to Python in Arrow batches and only counts come back: no shuffle, and the memory of a task is one
    batch and the remembered segments.
    """

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = text_counter(model_file)
        for texts in batches:
            yield pd.Series([count(text) for text in texts], dtype="int64")

    counts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(counts, LongType())(text)


def token_counts(
    df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added.

    Edge cases: a null or empty text has no tokens; white space counts, as the model keeps it; strings that look
    like special tokens are ordinary text; columns of df named like the added ones are replaced.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col)])
    text = text_or_empty(text_col)
    counted = rows.select(
        "*", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, model_file).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
