"""Periodic runs of words, found lag by lag on big-integer bit planes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import WORD_CLASS, free_prefix, give_back, text_or_empty

#: Planes that are compared before a lag is first tested for long stretches; few lags outlive them.
FIRST_PLANES = 3
_WORDS = re.compile(f"{WORD_CLASS}+")


def bit_planes(words: Sequence[str]) -> list[int]:
    """Plane k has bit i set where the k-th bit of word i's id is set; equal words have equal ids."""
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # scattered ids, so that the first planes tell most words apart; odd factors keep them different
    bits = max(1, (len(numbers) - 1).bit_length())
    ids = (ids * 0x9E3779B1) & ((1 << bits) - 1)
    packed = (np.packbits(((ids >> k) & 1).astype(np.uint8), bitorder="little") for k in range(bits))
    return [int.from_bytes(plane.tobytes(), "little") for plane in packed]


def long_stretches(match: int, least: int) -> int:
    """The bits of match from which `least` bits in a row are set: AND with itself, shifted by doubled distances."""
    held = 1
    while held < least and match:
        step = min(held, least - held)
        match &= match >> step
        held += step
    return match


def stretches(starts: int, least: int) -> list[tuple[int, int]]:
    """(first, length) of each stretch, from the starts that long_stretches() gives."""
    row = np.unpackbits(np.frombuffer(starts.to_bytes(starts.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(row, prepend=0, append=0))
    return [(int(a), int(b - a) + least - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def word_runs(words: Sequence[str], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    A run is a stretch of words with smallest period q, no shorter than `least` and 2 * q, that cannot be extended.
    Words q apart differ where any plane differs from itself shifted by q; the zeros of those mismatches are
    stretches of equal words. A stretch is met first at its smallest period, later at multiples of it, which are
    left out: of two periods of one stretch, both at most half of it, the smaller divides the larger.
    """
    n = len(words)
    if n < max(least, 2):
        return []
    planes, found = bit_planes(words), {}
    for q in range(1, n // 2 + 1):
        need, whole, mismatch, starts = max(least - q, q), (1 << (n - q)) - 1, 0, 0
        for k in range(0, len(planes), FIRST_PLANES):
            for plane in planes[k : k + FIRST_PLANES]:
                mismatch |= plane ^ (plane >> q)
            starts = long_stretches(~mismatch & whole, need)
            if not starts:
                break
        if starts:
            for first, length in stretches(starts, need):
                found.setdefault((first, length + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def planted(words: list[str], key: str) -> list[str]:
    """Words of one in ten texts, chosen by the key's CRC-32, go round from some place on."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def without_repeats(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    covered = np.cumsum(change)
    return [w for w, c in zip(words, covered, strict=False) if not c]


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, plant: bool = False
) -> DataFrame:
    """df with n_words, runs (array of start, length, period; by start, then period) and collapsed added: the text's words
    joined by spaces, without those that a run holds after its first period.

    plant: let one in ten texts go round first (see planted), which gives runs of every length to find.

    Each text is a row of its own, in Arrow batches: no shuffle, and nothing is kept from one text to the next. A
    text of n words takes n / 2 lags, of a few passes over n bits each: 20,000 words take about a tenth of a second.

    Edge cases: no rows give no rows; a null text, and one without a word, has no run and collapses to an empty text;
    texts of any length are read whole; equal texts get equal results, unless planting, which goes by the id, tells
    them apart; a null id plants nothing; columns named like the added ones are replaced, all others are kept.
    """
    added = ["n_words", "runs", "collapsed"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col)])

    def search(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            made = []
            for key, text in zip(keys, texts, strict=True):
                words = _WORDS.findall(text)
                if plant and key is not None:
                    words = planted(words, key)
                runs = word_runs(words, least)
                kept = without_repeats(words, runs) if runs else words
                made.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(kept)))
            yield pd.DataFrame(made, columns=added)
        give_back()

    search.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    kind = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    own = free_prefix(rows)
    found = F.pandas_udf(search, kind)(F.col(id_col).cast("string"), text_or_empty(text_col))
    taken = [F.col(c) for c in rows.columns if c.lower() not in added]
    return rows.withColumn(f"{own}found", found).select(*taken, *[F.col(f"{own}found.{c}").alias(c) for c in added])
