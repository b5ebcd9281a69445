"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import free_prefix, give_back, text_or_empty

UNDETERMINED = "und"
#: Bytes that the network reads from a zero state; texts are read as so many such stretches as they need.
STRETCH = 128
#: Bytes of a training piece that the fit reads.
PIECE_BYTES = 48
#: Stretches that are read side by side.
SIDE_BY_SIDE = 2048


@dataclass
class ByteNetwork:
    """Weights of one trained network: an input table, recurrent weights and bias for each direction."""

    labels: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    inner: list[np.ndarray]
    heads: list[np.ndarray]
    bias: np.ndarray

    def position_probabilities(self, stretches: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """(labels, length, n): the distribution at every byte of n stretches, given as (length, n) bytes.

        With sizes, a stretch ends after so many bytes: what comes after is padding, and the way back starts before it.
        """
        length, n = stretches.shape
        shorter = None if sizes is None or sizes.min(initial=length) >= length else sizes
        logits = np.zeros((length, len(self.labels), n), np.float32)
        for way in (0, 1):
            table, weights, inner, head = self.tables[way], self.recurrent[way], self.inner[way], self.heads[way]
            hidden = weights.shape[1]
            # sigmoid(x) = (1 + tanh(x / 2)) / 2: the gates' inputs are halved once, here
            halve = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), hidden)[:, None]
            table, weights, inner = table * halve, weights * halve, inner[:, None]
            state = np.zeros((hidden, n), np.float32)
            given, held = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                np.take(table, stretches[t], axis=1, out=given, mode="clip")
                np.matmul(weights, state, out=held)
                gates, fresh = given[: 2 * hidden], given[2 * hidden :]
                gates += held[: 2 * hidden]
                np.tanh(gates, out=gates)
                gates += 1.0
                gates *= 0.5
                recalled = held[2 * hidden :]
                recalled += inner
                recalled *= gates[hidden:]
                fresh += recalled
                np.tanh(fresh, out=fresh)
                state -= fresh
                state *= gates[:hidden]
                state += fresh
                if way and shorter is not None:
                    state *= t < shorter
                logits[t] += head @ state
        logits += self.bias[None, :, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(1, 0, 2)

    def document_probabilities(self, texts: Sequence[bytes]) -> np.ndarray:
        """(documents, labels): the mean over all bytes of each text; a text without bytes gets zeros."""
        sizes = np.array([len(x) for x in texts], np.int64)
        pieces = -(-sizes // STRETCH)
        starts = np.concatenate([[0], np.cumsum(pieces)])
        laid = np.zeros(starts[-1] * STRETCH, np.uint8)
        for text, start in zip(texts, starts):
            laid[start * STRETCH : start * STRETCH + len(text)] = np.frombuffer(text, np.uint8)
        laid = laid.reshape(-1, STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        left = sizes[owner] - (np.arange(len(owner)) - starts[owner]) * STRETCH
        sums = np.zeros((len(texts), len(self.labels)))
        for k in range(0, len(owner), SIDE_BY_SIDE):
            block = slice(k, k + SIDE_BY_SIDE)
            found = self.position_probabilities(np.ascontiguousarray(laid[block].T), np.minimum(left[block], STRETCH))
            found *= np.arange(STRETCH)[None, :, None] < left[block][None, None, :]
            for c in range(len(self.labels)):
                sums[:, c] += np.bincount(owner[block], found[c].sum(axis=0), len(texts))
        return sums / np.maximum(sizes, 1)[:, None]


class _Trainer:
    """Backpropagation through time for one direction; the other reads the stretches reversed."""

    def __init__(self, rng: np.random.Generator, hidden: int, width: int, labels: int):
        self.hidden = hidden
        scale = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[-1]), shape)).astype(np.float32)
        self.weights = {
            "embed": scale(256, width) * np.sqrt(width) * 0.5,
            "input": scale(3 * hidden, width),
            "bias": np.zeros((3 * hidden, 1), np.float32),
            "recurrent": scale(3 * hidden, hidden),
            "inner": np.zeros((hidden, 1), np.float32),
            "head": scale(labels, hidden),
        }

    def forward(self, stretches: np.ndarray) -> np.ndarray:
        """(length, labels, n) logits of (length, n) bytes; what the way back needs is kept."""
        h, w = self.hidden, self.weights
        table = w["input"] @ w["embed"].T + w["bias"]
        state = np.zeros((h, stretches.shape[1]), np.float32)
        self.read, self.steps = stretches, []
        logits = []
        for row in stretches:
            given, held = table[:, row], w["recurrent"] @ state
            update = 1 / (1 + np.exp(-(given[:h] + held[:h])))
            reset = 1 / (1 + np.exp(-(given[h : 2 * h] + held[h : 2 * h])))
            recalled = held[2 * h :] + w["inner"]
            fresh = np.tanh(given[2 * h :] + reset * recalled)
            after = fresh + update * (state - fresh)
            self.steps.append((state, update, reset, recalled, fresh, after))
            state = after
            logits.append(w["head"] @ state)
        return np.stack(logits)

    def backward(self, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights, from those of the logits."""
        h, w = self.hidden, self.weights
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        by_byte = np.zeros((256, 3 * h), np.float32)
        given = np.empty((3 * h, *self.read.shape), np.float32)
        later = np.zeros_like(self.steps[0][0])
        for t in range(len(self.steps) - 1, -1, -1):
            state, update, reset, recalled, fresh, after = self.steps[t]
            grads["head"] += slope[t] @ after.T
            d_after = w["head"].T @ slope[t] + later
            d_update = d_after * (state - fresh) * update * (1 - update)
            d_fresh = d_after * (1 - update) * (1 - fresh * fresh)
            d_recalled = d_fresh * reset
            d_reset = d_fresh * recalled * reset * (1 - reset)
            d_given = np.concatenate([d_update, d_reset, d_fresh])
            d_held = np.concatenate([d_update, d_reset, d_recalled])
            grads["recurrent"] += d_held @ state.T
            grads["inner"] += d_recalled.sum(axis=1, keepdims=True)
            given[:, t] = d_given
            later = d_after * update + w["recurrent"].T @ d_held
        for k in range(3 * h):
            by_byte[:, k] = np.bincount(self.read.ravel(), given[k].ravel(), 256)
        grads["bias"] += by_byte.sum(axis=0)[:, None]
        grads["input"] += by_byte.T @ w["embed"]
        grads["embed"] += by_byte @ w["input"]
        return grads


def train(
    samples: Sequence[tuple[bytes, str]],
    hidden: int = 8,
    width: int = 12,
    steps: int = 200,
    batch: int = 192,
    length: int = PIECE_BYTES,
    rate: float = 0.02,
    seed: int = 11,
) -> ByteNetwork:
    """Fit the network to (bytes, label) samples in numpy, by Adam on the cross-entropy of every position.

    Labels are drawn evenly, whatever their shares. The same samples give the same network.
    """
    labels = sorted({label for _, label in samples})
    rng = np.random.default_rng(seed)
    laid = np.zeros((len(samples), length), np.uint8)
    size = np.zeros(len(samples), np.int64)
    for k, (text, _) in enumerate(samples):
        size[k] = min(len(text), length)
        laid[k, : size[k]] = np.frombuffer(text[:length], np.uint8)
    of_label = [np.array([k for k, (_, label) in enumerate(samples) if label == name]) for name in labels]
    ways = [_Trainer(rng, hidden, width, len(labels)) for _ in (0, 1)]
    bias = np.zeros(len(labels), np.float32)
    weights = [way.weights for way in ways] + [{"out": bias}]
    first = [{k: np.zeros_like(v) for k, v in w.items()} for w in weights]
    second = [{k: np.zeros_like(v) for k, v in w.items()} for w in weights]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), batch)
        chosen = np.array([of_label[c][rng.integers(0, len(of_label[c]))] for c in target])
        block = laid[chosen].T
        valid = np.arange(length)[:, None] < size[chosen][None, :]
        logits = ways[0].forward(block) + ways[1].forward(block[::-1])[::-1] + bias[None, :, None]
        logits -= logits.max(axis=1, keepdims=True)
        slope = np.exp(logits)
        slope /= slope.sum(axis=1, keepdims=True)
        slope[:, target, np.arange(batch)] -= 1
        slope *= (valid / valid.sum())[:, None, :]
        slope = slope.astype(np.float32)
        grads = [ways[0].backward(slope), ways[1].backward(slope[::-1]), {"out": slope.sum(axis=(0, 2))}]
        slower = rate * min(1.0, 3 * (1 - (step - 1) / steps))
        for w, g, m, v in zip(weights, grads, first, second):
            for k in w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w[k] -= slower * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return ByteNetwork(
        labels,
        [(w["input"] @ w["embed"].T + w["bias"]).astype(np.float32) for w in weights[:2]],
        [w["recurrent"] for w in weights[:2]],
        [w["inner"][:, 0] for w in weights[:2]],
        [w["head"] for w in weights[:2]],
        bias,
    )


def held_out(id_col: str):
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_samples(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int, per_doc: int, length: int
) -> list[tuple[bytes, str]]:
    """At most max_docs * per_doc pieces with their labels, from documents not held out.

    A piece is the first PIECE_BYTES bytes of a stretch of `length` characters, which the stretch's place leaves room
    for. The documents are those with the smallest hash of the id among the labelled ones with a letter that are not
    held out, a fixed number whatever the corpus; a threshold on the hash, eight times as wide as those, counted
    first, need, spares each task from sending as many. The stretches start at places drawn by hash. Only the pieces
    come to the driver.
    """
    fit = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
    share = math.ceil(min(1.0, 8 * max_docs / max(fit.count(), 1)) * (1 << 20))
    place = lambda k: F.pmod(
        F.xxhash64(F.col("_id"), k), F.greatest(F.char_length("_text") - length + 1, F.lit(1)).cast("long")
    ).cast("int")
    rows = (
        fit.select(
            F.col(id_col).alias("_id"),
            F.col(lang_col).alias("_lang"),
            F.col(text_col).alias("_text"),
        )
        .withColumn("_order", F.xxhash64(F.col("_id"), F.lit("language")))
        .filter(F.pmod("_order", F.lit(1 << 20)) < share)
        .withColumn(
            "_pieces",
            F.transform(F.sequence(F.lit(1), F.lit(per_doc)), lambda k: F.substring(F.col("_text"), place(k) + 1, F.lit(length))),
        )
        .select("_order", "_id", "_lang", "_pieces")
        .orderBy("_order", "_id", "_lang", "_pieces")
        .limit(max_docs)
        .collect()
    )
    return [(piece.encode()[:PIECE_BYTES], row["_lang"]) for row in rows for piece in dict.fromkeys(row["_pieces"]) if piece.strip()]


def detect_language(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train_docs: int = 1500,
    pieces_per_doc: int = 6,
    network: ByteNetwork | None = None,
) -> DataFrame:
    """df with held_out, lang_pred and score added.

    The network is fitted, unless one is given, to at most max_train_docs labelled documents that are not held
    out; it then reads every byte of every text, and a document's probabilities are the means over its bytes.
    The weights (some 60 kB) travel with the function; texts go through in Arrow batches, with no shuffle.

    Edge cases: no rows give no rows; a null text and one without a letter are `und` with the score 0, and so are all
    texts if no labelled row is there to learn from; languages outside the bounded sample are not learned; texts of
    any length are read whole, and equal texts get equal results, so repeated rows are each judged alike; of labels
    that tie the first by name is predicted; columns of df named like the added ones are replaced, all others are
    kept whatever their names.
    """
    added = ["held_out", "lang_pred", "score"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col, lang_col)])
    if network is None:
        samples = training_samples(df, id_col, text_col, lang_col, max_train_docs, pieces_per_doc, 64)
        network = train(samples) if samples else None
        give_back()

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [], []
            for k in range(0, len(texts), 256):
                found = network.document_probabilities([t.encode() if t else b"" for t in texts[k : k + 256]])
                best = found.argmax(axis=1)
                names += [network.labels[c] for c in best]
                scores += found[np.arange(len(best)), best].tolist()
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(scores, 0.0, 1.0)})
        give_back()

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    if network is None:
        pred = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        pred = F.pandas_udf(judge, "lang_pred string, score double")(text_or_empty(text_col))
    own = free_prefix(rows)
    known = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    judged = rows.select("*", held_out(id_col).alias("held_out"), pred.alias(f"{own}judged"), known.alias(f"{own}known"))
    return judged.select(
        *rows.columns,
        "held_out",
        F.when(F.col(f"{own}known"), F.col(f"{own}judged.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col(f"{own}known"), F.col(f"{own}judged.score")).otherwise(0.0).alias("score"),
    )
