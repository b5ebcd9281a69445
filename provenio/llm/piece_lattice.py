"""SentencePiece encoding and decoding over a relational lattice of words and pieces."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.llm.common import free_name, give_back, partitions_for, text_or_empty, written

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words of the dictionary that the lattice encodes once, for all tasks; the rest are encoded where they stand.
DICTIONARY_WORDS = 150_000
LONGEST_WORD = 48
#: Up to so many characters a plain list of symbols is merged faster than a heap.
SHORT_WORD = 40
#: Words that a Python worker remembers besides; then it starts over.
MEMORY = 100_000
#: Distinct words that a task counts before it sends what it has.
COUNTED = 150_000


@dataclass
class PieceTable:
    """The pieces of a model: piece -> (id, score), the ids of the 256 bytes, and the bytes of every id."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    output: list[bytes]

    @cached_property
    def costs(self) -> dict[str, float]:
        return {piece: -score for piece, (_, score) in self.pieces.items()}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {piece: i for piece, (i, _) in self.pieces.items()}

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    def beginnings(self) -> frozenset[str]:
        return frozenset(piece[:k] for piece in self.pieces for k in range(1, len(piece) + 1))

    def word_pattern(self) -> re.Pattern:
        """What parts a text into words such that no piece reaches from one into the next.

        A word is a stretch of letters or of other characters, with the space marks before it. Letters that some
        piece joins with a character of the other kind count as that kind; in the end no piece joins the two.
        """
        others: set[str] = set()
        letter = lambda c: c not in others and LETTER.match(c) is not None
        while True:
            joined = {
                c
                for piece in self.pieces
                for a, b in zip(piece.lstrip(SPACE), piece.lstrip(SPACE)[1:])
                if letter(a) != letter(b)
                for c in (a, b)
                if letter(c)
            }
            if not joined:
                break
            others |= joined
        also = re.escape("".join(sorted(others)))
        return re.compile(rf"{SPACE}*[^\W\d_{also}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{also}])+|{SPACE}+")

    @cached_property
    def splits(self) -> bool:
        """Whether no piece goes on into the next space, so that texts are encoded space by space."""
        return not any(SPACE in piece.lstrip(SPACE) for piece in self.pieces)

    def splitter(self) -> Callable[[str], list[str]]:
        """The words of a text, with the space mark put first; without a place to split, the whole text is one."""
        if not self.splits:
            return lambda text: [SPACE + text.replace(" ", SPACE)] if text else []
        find = self.word_pattern().findall
        return lambda text: find(SPACE + text.replace(" ", SPACE)) if text else []

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY

    @property
    def by_merging(self) -> bool:
        """Whether the scores are merge ranks (0, -1, -2 and so on), not log probabilities."""
        return all(score <= 0 and score == int(score) for _, score in self.pieces.values())


def piece_table(model_file: str) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids, output = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            output.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            output.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            output.append(piece.replace(SPACE, " ").encode())
    return PieceTable(pieces, byte_ids, output)


# ---- the lattice


def lattice_edges(words: DataFrame, pieces: DataFrame, table: PieceTable) -> DataFrame:
    """(word, start, stop, score, ids): every stretch of a word that is a piece, and single unknown characters.

    words: (word), distinct; pieces: (piece, id, score). The substrings of up to the longest piece's length are
    exploded and equi-joined to the piece table, which is the model's own (some ten thousand rows) and therefore
    broadcast whatever the corpus.
    """
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("start"))
    stops = F.sequence(F.col("start") + 1, F.least(F.char_length("word"), F.col("start") + table.longest))
    parts = starts.select("word", "start", F.explode(stops).alias("stop")).withColumn(
        "piece", F.expr("substring(word, start + 1, stop - start)")
    )
    joined = parts.join(F.broadcast(pieces), "piece", "left")
    octets = F.transform(
        F.sequence(F.lit(1), F.octet_length("piece")),
        lambda k: F.element_at(
            F.array(*[F.lit(i) for i in table.byte_ids]),
            F.conv(F.substring(F.hex(F.encode("piece", "UTF-8")), k * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1,
        ),
    )
    known = F.col("id").isNotNull()
    return joined.filter(known | (F.col("stop") - F.col("start") == 1)).select(
        "word",
        "start",
        "stop",
        F.coalesce("score", F.lit(table.unknown_score)).alias("score"),
        F.when(known, F.array("id")).otherwise(octets).alias("ids"),
    )


def best_paths(edges: DataFrame) -> DataFrame:
    """(word, ids): the path of greatest total score; of equals, the one whose last piece starts later.

    Edges are grouped by word, and a higher-order fold over the stops carries the best (score, ids) of every
    position so far.
    """
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("stop", "start", "score", "ids")).alias("edges"))
    fold = """aggregate(
        sequence(1, char_length(word)),
        array(named_struct('score', 0D, 'start', 0, 'ids', cast(array() as array<int>))),
        (best, stop) -> concat(best, array(array_max(transform(
            filter(edges, e -> e.stop = stop),
            e -> named_struct(
                'score', get(best, e.start).score + e.score,
                'start', e.start,
                'ids', concat(get(best, e.start).ids, e.ids)))))),
        best -> get(best, size(best) - 1).ids)"""
    return grouped.select("word", F.expr(fold).alias("ids"))


def merged_paths(edges: DataFrame) -> DataFrame:
    """(word, ids): the path that merging leaves, from single characters on.

    Of the edges that span two neighbours the one of the best score, the leftmost of equals, makes them one, until
    there is none. The fold carries for every position where the symbol that starts there stops, 0 once it is merged
    away.
    """
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("stop", "start", "score", "ids")).alias("edges"))
    fold = """aggregate(
        sequence(1, char_length(word)),
        sequence(1, char_length(word)),
        (ends, step) -> get(transform(
            array(array_max(transform(
                filter(edges, e -> e.stop > e.start + 1 and get(ends, e.start) > 0 and get(ends, get(ends, e.start)) = e.stop),
                e -> named_struct('score', e.score, 'left', -e.start, 'stop', e.stop, 'middle', get(ends, e.start))))),
            best -> if(best is null, ends, transform(ends, (stop, at) ->
                case when at = -best.left then best.stop when at = best.middle then 0 else stop end))), 0),
        ends -> flatten(transform(
            filter(sequence(0, char_length(word) - 1), at -> get(ends, at) > 0),
            at -> get(filter(edges, e -> e.start = at and e.stop = get(ends, at)), 0).ids)))"""
    return grouped.select("word", F.expr(fold).alias("ids"))


def _edges_of(spark: SparkSession, words: DataFrame, table: PieceTable) -> DataFrame:
    rows = [(piece, i, score) for piece, (i, score) in table.pieces.items()]
    pieces = spark.createDataFrame(rows, "piece string, id int, score double")
    return lattice_edges(words, pieces, table)


def merge_words(spark: SparkSession, words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) of distinct, non-empty words, by merging."""
    return merged_paths(_edges_of(spark, words, table))


def encode_words(spark: SparkSession, words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) of distinct, non-empty words, by the greatest total score."""
    return best_paths(_edges_of(spark, words, table))


def best_path(word: str, table: PieceTable, unknown: float, beginnings: frozenset[str]) -> list[int]:
    """The same path for one word, for words that the dictionary does not hold; beginnings: of all pieces."""
    pieces, size = table.pieces, len(word)
    score, back = [-math.inf] * (size + 1), [None] * (size + 1)
    score[0] = 0.0
    for start in range(size):
        so_far = score[start]
        if word[start] not in pieces and so_far + unknown >= score[start + 1]:
            score[start + 1], back[start + 1] = so_far + unknown, (start, -1)
        for stop in range(start + 1, size + 1):
            part = word[start:stop]
            if part not in beginnings:
                break
            found = pieces.get(part)
            if found is not None and so_far + found[1] >= score[stop]:
                score[stop], back[stop] = so_far + found[1], (start, found[0])
    parts, at = [], size
    while at:
        start, piece = back[at]
        parts.append([piece] if piece >= 0 else [table.byte_ids[b] for b in word[start:at].encode()])
        at = start
    return [i for part in reversed(parts) for i in part]


def merged_path(word: str, table: PieceTable) -> list[int]:
    """The path that merging leaves for one word: the rule of merged_paths, on a list of symbols, or for long words
    with a heap and a linked list."""
    costs, ids = table.costs.get, table.ids
    if len(word) > SHORT_WORD:
        symbols = _merged_long(word, costs)
    else:
        symbols = list(word)
        cost = [costs(word[i : i + 2], math.inf) for i in range(len(word) - 1)]
        while cost:
            least = min(cost)
            if least == math.inf:
                break
            at = cost.index(least)
            symbols[at] = both = symbols[at] + symbols.pop(at + 1)
            del cost[at]
            if at < len(cost):
                cost[at] = costs(both + symbols[at + 1], math.inf)
            if at:
                cost[at - 1] = costs(symbols[at - 1] + both, math.inf)
    try:
        return [ids[part] for part in symbols]
    except KeyError:
        return [i for part in symbols for i in ([ids[part]] if part in ids else [table.byte_ids[b] for b in part.encode()])]


def _merged_long(word: str, costs: Callable[[str], float | None]) -> list[str]:
    size = len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []

    def push(left: int, middle: int, stop: int) -> None:
        cost = costs(word[left:stop])
        if cost is not None:
            heapq.heappush(heap, (cost, left, middle, stop))

    for i in range(size - 1):
        push(i, i + 1, i + 2)
    while heap:
        _, left, middle, stop = heapq.heappop(heap)
        if end[left] != middle or end[middle] != stop:
            continue
        end[left], end[middle] = stop, 0
        if stop < size:
            before[stop] = left
            push(left, stop, end[stop])
        if left > 0:
            push(before[left], left, stop)
    return [word[at : end[at]] for at in range(size) if end[at]]


class WordCodes(dict):
    """word -> its piece ids, packed as 32-bit numbers; words outside the dictionary are encoded when first met.

    At most `room` such words are kept besides the dictionary, then they go.
    """

    def __init__(self, dictionary: dict[str, bytes], table: PieceTable, room: int):
        super().__init__(dictionary)
        self.dictionary, self.table, self.most = dictionary, table, len(dictionary) + room
        self.by_merging, self.split = table.by_merging, table.splitter()
        self.unknown, self.beginnings = table.unknown_score, frozenset() if self.by_merging else table.beginnings()

    def __missing__(self, word: str) -> bytes:
        if self.by_merging:
            path = merged_path(word, self.table)
        else:
            path = best_path(word, self.table, self.unknown, self.beginnings)
        ids = array("i", path).tobytes()
        if len(self) >= self.most:
            self.clear()
            self.update(self.dictionary)
        if len(word) <= LONGEST_WORD:
            self[word] = ids
        return ids

    def text(self, text: str) -> tuple[bytes, bool]:
        """A text's packed piece ids, and whether decoding them gives it again."""
        found = b"".join(map(self.__getitem__, self.split(text)))
        return found, decoded_bytes(array("i", found), self.table) == text.encode()


# ---- documents


def frequent_words(df: DataFrame, text_col: str, limit: int, table: PieceTable) -> DataFrame:
    """(word): the `limit` most frequent words of all texts, of up to LONGEST_WORD characters. Each task counts its
    own words first, COUNTED distinct ones at a time; those met once among them, most of all words and the least
    frequent, are not sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, met = table.splitter(), Counter()

        def counted() -> pa.RecordBatch:
            kept = {word: n for word, n in met.items() if n > 1 and len(word) <= LONGEST_WORD}
            met.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(kept.keys(), pa.string()), "n": pa.array(kept.values(), pa.int64())})

        for batch in batches:
            for k in range(0, len(batch), 200):
                for text in batch.column(0).slice(k, 200).to_pylist():
                    met.update(split(text))
                if len(met) >= COUNTED:
                    yield counted()
        yield counted()
        give_back()

    counted = df.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "word string, n long")
    summed = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.col("n").desc(), "word").limit(limit).select("word")


def encode(
    df: DataFrame, model_file: str, text_col: str = "text", dictionary_words: int = DICTIONARY_WORDS, remembered: int = MEMORY
) -> DataFrame:
    """df with piece_ids (array of int), n_pieces and round_trip added.

    White space is kept, spaces become the space mark and one is put before the text, as the model's normaliser
    does. Where the model's scores are merge ranks, each word is merged by them, which gives the library's ids;
    otherwise it takes its path of greatest total piece score. A character without a piece falls back to its bytes.
    round_trip: decoding the ids gives the text again (not if it holds the space mark itself).

    The most frequent words, at most dictionary_words, are encoded once by the relational lattice and broadcast
    (their number is the bound: some 60 bytes each). A word outside is encoded in its task by the same rules, so
    that no join of all words with all documents is needed, and nothing but the word counts is shuffled. A worker
    remembers at most `remembered` such words; both numbers only trade memory for time.

    Edge cases: no rows give no rows; null and empty texts have no pieces; texts and words of any length are read
    whole; repeated rows are each encoded, and equal texts get equal ids; of pieces that tie in score the leftmost
    merges first; columns of df named like the added ones are replaced, all others are kept.
    """
    spark = df.sparkSession
    added = ["piece_ids", "n_pieces", "round_trip"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c != text_col])
    table = piece_table(model_file)
    words = written(frequent_words(df, text_col, dictionary_words, table), "frequent-words")
    encoded = written((merge_words if table.by_merging else encode_words)(spark, words.repartition(partitions_for(spark), "word"), table), "dictionary")
    dictionary = spark.sparkContext.broadcast({r["word"]: array("i", r["ids"]).tobytes() for r in encoded.toLocalIterator()})

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = WordCodes(dictionary.value, table, remembered)
        for batch in batches:
            for k in range(0, len(batch), 200):
                found = [codes.text(text) for text in batch.slice(k, 200).to_pylist()]
                stops = np.cumsum([0, *[len(ids) // 4 for ids, _ in found]])
                values = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(values))
                columns = [lists, pa.array(np.diff(stops)), pa.array([same for _, same in found], pa.bool_())]
                yield pa.StructArray.from_arrays(columns, names=added)
        del codes
        give_back()

    ids_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(ids_of, "piece_ids array<int>, n_pieces long, round_trip boolean")
    found = free_name(rows, "_encoded")
    return rows.select("*", udf(text_or_empty(text_col)).alias(found)).select(*rows.columns, f"{found}.*")


def decoded_bytes(ids: array, table: PieceTable) -> bytes:
    """The bytes of piece ids in order, less the space that encoding puts first."""
    data = b"".join(map(table.output.__getitem__, ids))
    return data[1:] if data[:1] == b" " else data


def decode_ids(ids: list[int], table: PieceTable) -> str:
    """The text of piece ids; bytes that are no UTF-8 are replaced."""
    return decoded_bytes(ids, table).decode("utf-8", "replace")


def decode(df: DataFrame, model_file: str, ids_col: str = "piece_ids", to_col: str = "text") -> DataFrame:
    """df with to_col: the text of the ids; null ids give a null text, ids that the model lacks are an error."""
    table = piece_table(model_file)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if ids is None else decode_ids(list(ids), table) for ids in batch], dtype=object)

    texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to_col, F.pandas_udf(texts, "string")(ids_col))
