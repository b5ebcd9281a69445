"""Removal of byte strings that also start earlier in the corpus, one bucket of suffixes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import text_or_empty, written

#: Bytes of the grams whose least hash in a window names the window's bucket.
GRAM = 32
# A difference cover; for any two residues modulo PERIOD there is a shift that takes both into COVER.
PERIOD = 32
COVER = (0, 1, 2, 3, 7, 11, 19)
#: Texts are read in pieces of so many starts; each piece carries the bytes that its last windows need.
PIECE = 1 << 20
#: Pieces are gathered up to so many bytes, and runs that such a block has twice are sent once.
BLOCK = 2 << 20
#: Bytes of runs in a bucket, on average, if their number follows the input; one with more than the limit is split.
BUCKET_BYTES = 4 << 20
BUCKET_LIMIT = 8 * BUCKET_BYTES
LAST_ID = np.iinfo(np.int64).max

_FACTOR = 0x5851F42D4C957F2D
_INVERSE = pow(_FACTOR, -1, 2**64)
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: [a, b]: the least shift that takes the residues a and b into the cover.
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)]
)
_BYTES = (np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, size: int) -> np.ndarray:
    found = np.empty(size, np.uint64)
    found[0] = 1
    done = 1
    while done < size:
        step = min(done, size - done)
        found[done : done + step] = found[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return found


class Rolling:
    """64-bit hashes of all windows of a byte array, of any width, from one running sum."""

    def __init__(self, data: np.ndarray):
        size = len(data)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_FACTOR, size), out=self.sums[1:])
        self.back = _powers(_INVERSE, size + 1)

    def windows(self, width: int) -> np.ndarray:
        raw = (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]
        return mixed(raw)

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.back[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    span, found = 1, values
    while span * 2 <= width:
        found = np.minimum(found[:-span], found[span:])
        span *= 2
    rest = width - span
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


def _runs(grams: np.ndarray, starts_ok: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, least gram) of the runs of windows with one least gram of `width` bytes."""
    least = window_minima(grams, length - width + 1)[: len(starts_ok)]
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (starts_ok[1:] != starts_ok[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(first, append=len(least))
    ok = starts_ok[first]
    return first[ok], count[ok], least[first[ok]]


def _may_hold_gram_twice(grams: np.ndarray, first: np.ndarray, count: np.ndarray, least: np.ndarray, places: int) -> np.ndarray:
    """False for a run that surely has its least gram at one place only: no window of it is there twice then.

    places: of grams in a window. Long runs have it twice; of the others the gram's places are counted by 16 bits of
    the hash, over the longest stretch that such a run has, so that a few more than those that have it twice are True.
    """
    reach = 2 * places - 1
    tags = np.zeros(len(grams) + reach, np.uint16)
    tags[: len(grams)] = grams.astype(np.uint16)
    windows = np.lib.stride_tricks.sliding_window_view(tags, reach)
    own = least.astype(np.uint16)[:, None]
    found = count > places
    for k in range(0, len(first), 1 << 14):
        hits = np.flatnonzero(windows[first[k : k + (1 << 14)]] == own[k : k + (1 << 14)]) // reach
        found[k : k + (1 << 14)] |= np.bincount(hits, minlength=min(1 << 14, len(first) - k)) > 1
    return found


def _pieces(batch: pd.DataFrame, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(id, offset, bytes) of the texts that have a window at all."""
    for doc, text in zip(batch["i"], batch["t"]):
        data = text.encode()
        for at in range(0, len(data) - length + 1, PIECE):
            yield doc, at, data[at : at + PIECE + length - 1]


def _blocks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for piece in _pieces(batch, length):
            held.append(piece)
            size += len(piece[2])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _packed(bucket: int, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, grams: np.ndarray | None = None, twice: np.ndarray | None = None, body: bytes | None = None) -> dict:
    order = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    row = {"bucket": bucket, "docs": order(docs, np.int64), "starts": order(starts, np.int64), "counts": order(counts, np.int32)}
    return row | {"grams": None if grams is None else order(grams, np.uint64), "twice": None if twice is None else order(twice, bool), "body": body}


def gram_widths(length: int) -> list[int]:
    """The widths of the grams that name a window's bucket, level by level: the last is the whole window."""
    return [width for width in (GRAM, 2 * GRAM) if width < length] + [length]


class Block:
    """The windows of a block of pieces, and the runs of them that go to one bucket.

    At the first level a window's bucket is named by its least gram of GRAM bytes. Windows of a bucket that is over
    its limit (hot: the numbers of such buckets by level, ascending) are named anew by wider grams, in the end by all
    their bytes. Equal windows have equal names at each level, so they meet wherever they go.
    """

    def __init__(self, block: list[tuple[int, int, bytes]], length: int, buckets: int, hot: list[np.ndarray]):
        self.pieces = sorted(block, key=lambda x: x[:2])
        self.length, self.buckets, self.hot = length, buckets, hot
        self.whole = b"".join(x[2] for x in self.pieces)
        self.data = np.frombuffer(self.whole, np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(x[2]) for x in self.pieces])])
        self.rolling = Rolling(self.data)

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(places of grams in a window, first starts, counts, least grams, buckets, all grams) of each level."""
        ok = np.ones(len(self.data) - self.length + 1, bool)
        for stop in self.base[1:-1]:
            ok[stop - self.length + 1 : stop] = False
        for level, width in enumerate(gram_widths(self.length)):
            grams = self.rolling.windows(width)
            first, count, least = _runs(grams, ok, width, self.length)
            bucket = level * self.buckets + (self.named(least) % np.uint64(self.buckets)).astype(np.int64)
            split = np.isin(bucket, self.hot[level]) if level < len(self.hot) else np.zeros(len(first), bool)
            stays = ~split
            yield self.length - width + 1, first[stays], count[stays], least[stays], bucket[stays], grams
            if not split.any():
                return
            change = np.zeros(len(ok) + 1, np.int64)
            change[first[split]] += 1
            change[first[split] + count[split]] -= 1
            ok = np.cumsum(change[:-1]) > 0

    def named(self, least: np.ndarray) -> np.ndarray:
        return mixed(least ^ np.uint64(self.length))

    def places(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts in the document) of some starts."""
        of = np.searchsorted(self.base, first, side="right") - 1
        docs = np.array([x[0] for x in self.pieces], np.int64)[of]
        return docs, first - self.base[of] + np.array([x[1] for x in self.pieces], np.int64)[of]

    def again(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the very bytes of a run are those of an earlier run of the block."""
        prints = self.rolling.spans(first, first + count + self.length - 1) ^ mixed(count.astype(np.uint64))
        order = np.argsort(prints, kind="stable")
        again = np.zeros(len(first), bool)
        cut = lambda r: self.whole[first[r] : first[r] + count[r] + self.length - 1]
        leader = None
        # equal prints: the earliest stays, those with the very same bytes are repeats of it
        for k in np.flatnonzero(prints[order][1:] == prints[order][:-1]) + 1:
            one, two = order[k - 1], order[k]
            if leader is None or prints[leader] != prints[one]:
                leader = one
            again[two] = count[leader] == count[two] and cut(leader) == cut(two)
        return again

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, bytes that the block sends them) of the first level whose hot buckets are not known yet."""
        for level, (_, first, count, _, bucket, _) in enumerate(self.levels()):
            if level == len(self.hot):
                left = ~self.again(first, count)
                found, which = np.unique(bucket[left], return_inverse=True)
                return found, np.bincount(which, count[left] + self.length - 1, len(found)).astype(np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)


def deal_runs(block: Block, turn: int, turns: int) -> list[dict]:
    """The runs of a block whose bucket is dealt in this turn, a row for each bucket.

    A run that the block has more than once goes out once, for its earliest place; the starts of its other
    places are repeats already and go out as such (bucket below 0). So a passage that is in every document is sent
    once a block, not once a document.
    """
    rows = []
    for places, first, count, least, bucket, grams in block.levels():
        mine = bucket % turns == turn
        first, count, least, bucket = first[mine], count[mine], least[mine], bucket[mine]
        if not len(first):
            continue
        named = block.named(least)
        twice = _may_hold_gram_twice(grams, first, count, least, places)
        docs, starts = block.places(first)
        again = block.again(first, count)
        if again.any():
            rows.append(_packed(-1 - int(docs[0] % block.buckets), docs[again], starts[again], count[again]))
        left = np.flatnonzero(~again)
        left = left[np.argsort(bucket[left], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[left], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(left))):
            part = left[a:b]
            body = b"".join([block.whole[f : f + c + block.length - 1] for f, c in zip(first[part].tolist(), count[part].tolist())])
            rows.append(_packed(int(bucket[part[0]]), docs[part], starts[part], count[part], named[part], twice[part], body))
    return rows


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each of some positions as a number that sorts as they do."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(np.uint64)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1; equals share a rank."""
    order = np.argsort(key)
    found = key[order]
    edge = np.ones(len(key), np.int64)
    edge[1:] = found[1:] != found[:-1]
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(edge)
    return ranks


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of pairs of ranks."""
    return _ranks(first * (second.max(initial=0) + 1) + second)


def cover_ranks(data: np.ndarray, size: int, depth: int, suffixes: np.ndarray) -> np.ndarray:
    """By position: the rank of its `depth` bytes or more among the positions of the cover, 0 elsewhere.

    Ranks by eight bytes are doubled: a position and the one PERIOD further on are both in the cover, or neither is.
    Only positions that the comparison of the given suffixes can look at are ranked. data has room for PERIOD bytes
    after `size`.
    """
    reach = 2 * depth + PERIOD
    seen = np.zeros(size + 1, np.int64)
    seen[suffixes + 1] = 1
    seen = np.cumsum(seen)
    near = seen[1:] > np.concatenate([np.zeros(min(reach, size), np.int64), seen[1 : max(size - reach, 0) + 1]])
    at = np.flatnonzero(near & np.tile(_IN_COVER, -(-size // PERIOD))[:size])
    found = _ranks(_words_at(data, at))
    for k in range(8, PERIOD, 8):
        found = _paired(found, _ranks(_words_at(data, at + k)))
    ranks = np.zeros(size + reach, np.int64)
    ranks[at] = found
    known = PERIOD
    while known < depth:
        ranks[at] = _paired(ranks[at], ranks[at + known])
        known *= 2
    return ranks


def _tied(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group starts) of the suffixes that tie with another on their first PERIOD bytes, in order.

    Eight bytes are sorted at a time; a suffix that is alone with what has been read of it goes.
    """
    group = np.zeros(len(at), np.int64)
    for k in range(0, PERIOD, 8):
        group = _paired(group, _ranks(_words_at(data, at + k)))
        kept = np.bincount(group)[group] > 1
        at, group = at[kept], group[kept]
        if not len(at):
            break
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    return at, np.diff(group, prepend=-1) != 0


def _sort_ties(at: np.ndarray, edge: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The positions of each group in the order of their suffixes, by three-way partition around pivots.

    Two suffixes that tie on PERIOD bytes are compared by one look at the cover ranks, at the shift that takes both
    into the cover. All groups are partitioned at once; those around a pivot that tie with it are done.
    """
    at, edge = at.copy(), edge.copy()
    done = np.zeros(len(at), bool)
    while True:
        group = np.cumsum(edge) - 1
        open_ = np.flatnonzero(~done & (np.bincount(group)[group] > 1))
        if not len(open_):
            return at
        own = group[open_]
        head = np.flatnonzero(np.diff(own, prepend=-1))
        count = np.diff(head, append=len(own))
        pivot = np.repeat(at[open_[head + count // 2]], count)
        mine = at[open_]
        shift = SHIFT[mine % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[mine + shift] - ranks[pivot + shift])
        order = np.lexsort((side, own))
        side = side[order]
        at[open_], done[open_] = mine[order], side == 0
        edge[open_] |= (np.diff(side, prepend=2) != 0)


def repeats_in_bucket(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, grams: np.ndarray, twice: np.ndarray, bodies: list[bytes], length: int):
    """(docs, starts, counts) of the runs of starts, among those given, whose window also starts earlier.

    Equal windows have one gram, so runs whose gram no other run has, and which surely hold it once themselves (twice:
    False), are left out. The suffixes of the rest are
    sorted by their first PERIOD bytes, and ties by the ranks of a difference cover's sample (Burkhardt and
    Karkkainen, 2003): memory is a few numbers a suffix, however long the ties are. Neighbours are then compared over
    `length` bytes, and the earliest of each class of equals is the one that stays.
    """
    none = (np.empty(0, np.int64),) * 3
    lengths = counts + length - 1
    offsets = np.cumsum(lengths) - lengths
    _, which, often = np.unique(grams, return_inverse=True, return_counts=True)
    shared = np.flatnonzero((often[which] > 1) | twice)
    if not len(shared):
        return none
    # the runs side by side, in the order of their places: a smaller index is an earlier place
    order = shared[np.lexsort((starts[shared], docs[shared]))]
    whole = memoryview(b"".join(bodies))
    body = b"".join([whole[a : a + n] for a, n in zip(offsets[order].tolist(), lengths[order].tolist())])
    docs, starts, counts, lengths = docs[order], starts[order], counts[order], lengths[order]
    size = len(body)
    data = np.frombuffer(body + bytes(2 * PERIOD), np.uint8)
    base = np.cumsum(lengths) - lengths
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, edge = _tied(data, np.repeat(base, counts) + inside)
    if not len(at):
        return none
    at = _sort_ties(at, edge, cover_ranks(data, size, length, at))
    same = np.zeros(len(at), bool)
    near = np.flatnonzero(~edge)
    for k in [*range(PERIOD, length - 7, 8), *([length - 8] if length % 8 else [])]:
        near = near[_words_at(data, at[near - 1] + k) == _words_at(data, at[near] + k)]
    same[near] = True
    classes = np.cumsum(~same) - 1
    earliest = np.minimum.reduceat(at, np.flatnonzero(~same))
    flagged = np.sort(at[at != earliest[classes]])
    if not len(flagged):
        return none
    # starts of one run that follow each other make an interval
    run = np.searchsorted(base, flagged, side="right") - 1
    head = np.flatnonzero((np.diff(flagged, prepend=-2) != 1) | (np.diff(run, prepend=-1) != 0))
    of = run[head]
    return docs[of], starts[of] + flagged[head] - base[of], np.diff(head, append=len(flagged))


RUNS = "bucket long, docs binary, starts binary, counts binary, grams binary, twice binary, body binary"
FOUND = "docs binary, starts binary, counts binary"


def hot_buckets(df: DataFrame, length: int, buckets: int, limit: int) -> list[np.ndarray]:
    """By level, the buckets that would get more than `limit` bytes of runs and are split for it; df: (i, t).

    Blocks send sums by bucket, which are combined where they are made. What comes back is a number for each `limit`
    bytes of runs at most. As a rule no bucket is over, and one look is all.
    """
    hot: list[np.ndarray] = []
    while len(hot) < len(gram_widths(length)) - 1:

        def sizes(batches: Iterator[pd.DataFrame], hot=tuple(hot)) -> Iterator[pd.DataFrame]:
            for block in _blocks(batches, length):
                found, size = Block(block, length, buckets, list(hot)).sizes()
                yield pd.DataFrame({"bucket": found, "size": size})

        summed = df.mapInPandas(sizes, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
        over = [row["bucket"] for row in summed.filter(F.col("size") > limit).select("bucket").toLocalIterator()]
        if not over:
            break
        hot.append(np.sort(np.array(over, np.int64)))
    return hot


def repeated_starts(df: DataFrame, length: int, buckets: int, turns: int, limit: int) -> DataFrame:
    """(id, at, n): intervals of starts whose window of `length` bytes also starts earlier; df: (i, t), no nulls.

    Each turn deals one share of the buckets: it ships the runs of these alone, sorts bucket by bucket, and its
    shuffle files are dropped before the next. A bucket is one group of one task, BUCKET_BYTES on average; those
    over the limit are split by wider grams.
    """
    hot = hot_buckets(df, length, buckets, limit)
    found = None
    for turn in range(turns):

        def deal(batches: Iterator[pd.DataFrame], turn=turn) -> Iterator[pd.DataFrame]:
            for block in _blocks(batches, length):
                rows = deal_runs(Block(block, length, buckets, hot), turn, turns)
                if rows:
                    yield pd.DataFrame(rows)

        def sort(group: pd.DataFrame) -> pd.DataFrame:
            parts = [[np.frombuffer(x, kind) for x in group[name]] for name, kind in (("docs", np.int64), ("starts", np.int64), ("counts", np.int32))]
            docs, starts, counts = (np.concatenate(x) for x in parts)
            counts = counts.astype(np.int64)
            if group["bucket"].iloc[0] >= 0:
                grams = np.concatenate([np.frombuffer(x, np.uint64) for x in group["grams"]])
                twice = np.concatenate([np.frombuffer(x, bool) for x in group["twice"]])
                docs, starts, counts = repeats_in_bucket(docs, starts, counts, grams, twice, list(group["body"]), length)
            row = _packed(0, docs, starts, counts)
            return pd.DataFrame([{k: row[k] for k in ("docs", "starts", "counts")}] if len(docs) else [], columns=["docs", "starts", "counts"])

        dealt = df.mapInPandas(deal, RUNS).groupBy("bucket").applyInPandas(sort, FOUND)
        dealt = written(dealt, "repeats")
        found = dealt if found is None else found.unionByName(dealt)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, s, c in zip(batch["docs"], batch["starts"], batch["counts"]):
                yield pd.DataFrame({"id": np.frombuffer(d, np.int64), "at": np.frombuffer(s, np.int64), "n": np.frombuffer(c, np.int32).astype(np.int64)})

    return found.mapInPandas(spread, "id long, at long, n long")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, _id, t): the documents with numbers in the order of their ids; a column `again` says that rows may share one.

    Integer ids that occur once are their own numbers. Otherwise the distinct pairs of id and SHA-256 of the text are
    sorted, and joined back to their rows.
    """
    plain = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("t"))
    whole_number = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ids = plain.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    if whole_number and ids.filter("n > 1").isEmpty():
        return plain.select(F.coalesce(F.col("_id").cast("long"), F.lit(int(LAST_ID))).alias("i"), "_id", "t")
    keyed = plain.withColumn("sha", F.sha2("t", 256))
    order = keyed.select(F.col("_id").alias("key"), F.col("sha").alias("key_sha")).distinct().orderBy(F.col("key").asc_nulls_last(), "key_sha")
    numbers = written(order.withColumn("i", F.monotonically_increasing_id()), "document-numbers")
    joined = keyed.join(numbers, F.col("_id").eqNullSafe(F.col("key")) & (F.col("sha") == F.col("key_sha")))
    return joined.select("i", "_id", "t", F.lit(True).alias("again"))


def suffix_dedup(
    df: DataFrame,
    length: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    turns: int = 2,
    buckets: int | None = None,
    with_text: bool = True,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_text) for each row of df.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller
    id, or before in the same. Strings are judged on the input; matches do not cross documents. spans lists the
    removed runs (start, length in bytes); kept_text is what is left, with broken UTF-8 sequences replaced (null
    without with_text).

    Windows are dealt to buckets by the least hash of the grams they hold, so that equal windows meet and
    neighbours travel together as bytes, some four bytes for each of the text. Buckets that would get more than
    bucket_limit bytes, as a gram with very many different surroundings makes them, are counted first and their
    windows dealt by wider grams, in the end by all their bytes. Each bucket is sorted by itself, with long ties
    resolved by the ranks of a difference cover's sample. Intervals of removed starts, not positions, come
    back and are joined to their documents.

    Edge cases: no rows give no rows; null and empty texts have nothing to remove; texts of any length are read in
    pieces; ids of any type are taken in their order, nulls last; of rows with one id and different texts the one
    whose text has the smaller SHA-256 comes first, and rows that repeat id and text are one document, whose result
    each of them gets; extra columns are not read.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    whole = _numbered(df, id_col, text_col)
    if buckets is None:
        total = whole.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        buckets = max(8, 1 + 4 * total // BUCKET_BYTES)
    judged = whole.select("i", "t") if "again" not in whole.columns else whole.select("i", "t").dropDuplicates(["i"])
    starts = repeated_starts(judged.filter(F.octet_length("t") >= length), length, buckets, turns, bucket_limit)
    of_doc = written(
        starts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("hits")), "repeats-of-doc"
    )

    def cut(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, hits):
            data = text.encode()
            spans: list[list[int]] = []
            for hit in found if found is not None else []:
                start, stop = hit["at"], hit["at"] + hit["n"] + length - 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            kept, at = [], 0
            for start, stop in spans:
                kept.append(data[at:start])
                at = stop
            kept.append(data[at:])
            rest = b"".join(kept)
            rows.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "bytes": b - a} for a, b in spans], rest.decode("utf-8", "replace") if with_text else None))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])

    cut.__annotations__ = {"texts": pd.Series, "hits": pd.Series, "return": pd.DataFrame}
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, bytes: long>>, kept_text string"
    joined = whole.join(of_doc, whole["i"] == of_doc["id"], "left")
    return joined.select(F.col("_id").alias(id_col), F.pandas_udf(cut, kind)("t", "hits").alias("_cut")).select(id_col, "_cut.*")
