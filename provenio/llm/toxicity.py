"""Toxicity by weak supervision: voters, a generative label model of them, and a linear classifier on its posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.llm.common import free_prefix, give_back, partitions_for, text_or_empty, written

# Insults that two lexicon voters know before anything is learned.
CONTEMPT = "clown disgusting fool garbage pathetic scum trash vermin worthless".split()
STUPIDITY = "dumb idiot imbecile loser moron stupid".split()

#: Beginnings of words, of these lengths, are terms that can be learned; so are whole words.
SHORTEST, LONGEST = 3, 10
#: Uses of a term in one text count up to here while terms are chosen, so that no repetitive text chooses alone.
USES = 4
_NO_LETTERS = re.compile(r"[\W\d_]+")
_CAPITALS = re.compile("[A-Z]")


def normal(text: str) -> str:
    """Lower case, letters only: words between single spaces, one space before and after."""
    found = _NO_LETTERS.sub(" ", text.lower()).strip()
    return f" {found} " if found else ""


def terms_of(word: str) -> list[str]:
    """A word's terms: its beginnings, ' wor', and itself, ' word '."""
    return [f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [f" {word} "]


@dataclass
class Lexicon:
    """Terms to count in texts: learned ones, best first, then the given insults."""

    learned: list[str]
    given: list[str] = field(default_factory=lambda: [f" {w} " for w in CONTEMPT + STUPIDITY])

    def __post_init__(self):
        self.terms = list(dict.fromkeys(self.learned + self.given))
        #: Learned terms none of which is part of another: each is a voter.
        self.stems: list[int] = []
        for k, term in enumerate(self.learned):
            if not any(term.startswith(self.terms[s]) or self.terms[s].startswith(term) for s in self.stems):
                self.stems.append(k)

    def counter(self):
        """An automaton that finds all terms at once; it is built where it is used."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            machine.add_word(term, k)
        machine.make_automaton()
        return machine

    def counts(self, texts: Sequence[str], machine) -> tuple[np.ndarray, np.ndarray]:
        """(texts, terms) uses of each term, and (texts, 3) words, capitals and exclamation marks."""
        uses, shape = np.zeros((len(texts), len(self.terms)), np.float32), np.zeros((len(texts), 3), np.float32)
        for row, text in enumerate(texts):
            found = normal(text)
            shape[row] = max(0, found.count(" ") - 1), len(_CAPITALS.findall(text)), text.count("!")
            for _, k in machine.iter(found) if found else ():
                uses[row, k] += 1
        return uses, shape


def votes(lexicon: Lexicon, uses: np.ndarray, shape: np.ndarray, stem_voters: int = 40) -> np.ndarray:
    """(texts, voters): 1 toxic, -1 clean, 0 abstains. Lexicon voters, one for each stem and given list, then patterns."""
    words = np.maximum(shape[:, 0], 1)
    stems = uses[:, lexicon.stems]
    hits, different = stems.sum(axis=1), (stems > 0).sum(axis=1)
    share = hits / words
    of = lambda listed: uses[:, [lexicon.terms.index(f" {w} ") for w in listed]].sum(axis=1) / words
    say = lambda yes, no=None: np.where(yes, 1, 0 if no is None else np.where(no, -1, 0))
    found = [say(stems[:, k] / words >= 0.002) for k in range(min(stem_voters, len(lexicon.stems)))]
    found += [say(of(CONTEMPT) >= 0.002), say(of(STUPIDITY) >= 0.002)]
    found += [
        say(share >= 0.005, share < 0.001),
        say(share >= 0.02, hits == 0),
        say(different >= 2, different == 0),
        say(different >= 3, different <= 1),
        say(hits >= 3, hits == 0),
        say(shape[:, 1] >= np.maximum(20, 3 * words)),
        say(shape[:, 2] >= 3),
    ]
    return np.stack(found, axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """How voters vote on clean and on toxic texts, and how far each repeats what others say."""

    prior: float
    tables: np.ndarray  # (voters, 3 votes, 2 classes)
    correlations: np.ndarray  # (voters, voters), within classes
    weights: np.ndarray  # of each voter's evidence

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """The probability that a text is toxic, given its votes."""
        ratio = np.log(self.tables[:, :, 1]) - np.log(self.tables[:, :, 0])
        evidence = np.take_along_axis(ratio[None], (cast + 1).astype(np.int64)[:, :, None], axis=2)[:, :, 0]
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + evidence @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_label_model(cast: np.ndarray, known: np.ndarray, rounds: int = 30, trust: float = 6.0) -> tuple[LabelModel, np.ndarray]:
    """The model, and the posterior of each text; by expectation maximisation over votes. known is 1, 0, or -1 where a
    text has no label.

    A label is one more voter, of a fixed weight (`trust`, in log odds). Votes are taken as independent within a class
    at first; what is left of their correlation there is then measured, and a voter's evidence is divided by its
    summed correlations with all, so that voters who repeat one another count together as little more than one.
    """
    n, m = cast.shape
    label = np.where(known < 0, 0.0, np.where(known > 0, trust, -trust))
    score = np.where(known >= 0, known, _sigmoid(cast.sum(axis=1) - 0.5)).astype(float)
    one_hot = np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(float)
    model = None
    for _ in range(rounds):
        per_class = np.stack([1 - score, score], axis=1)
        tables = np.einsum("nmv,ny->mvy", one_hot, per_class) + 0.5
        tables /= tables.sum(axis=1, keepdims=True)
        correlations = np.zeros((m, m))
        for y in (0, 1):
            weight = per_class[:, y] / max(per_class[:, y].sum(), 1e-9)
            away = cast - weight @ cast
            spread = (away * weight[:, None]).T @ away
            deviation = np.sqrt(np.maximum(np.diag(spread), 1e-12))
            correlations += per_class[:, y].mean() * np.abs(spread / deviation[:, None] / deviation)
        np.fill_diagonal(correlations, 1)
        prior = float(np.clip(score.mean(), 0.01, 0.99))
        model = LabelModel(prior, tables, correlations, 1 / correlations.sum(axis=1))
        odds = model.posterior(cast)
        after = _sigmoid(np.log(np.clip(odds, 1e-12, 1)) - np.log(np.clip(1 - odds, 1e-12, 1)) + label)
        if np.abs(after - score).max() < 1e-6:
            break
        score = after
    return model, score


@dataclass
class ToxicityModel:
    """A linear classifier over uses of terms; `labels` is the label model that it was fitted to."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def scores(self, texts: Sequence[str], machine) -> np.ndarray:
        uses, shape = self.lexicon.counts(texts, machine)
        return _sigmoid(features(self.lexicon, uses, shape) @ self.weights + self.bias)


def features(lexicon: Lexicon, uses: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """How often each stem and each given insult is used, by text length and on a logarithmic scale, and sums of them."""
    words = np.maximum(shape[:, :1], 1)
    stems, given = uses[:, lexicon.stems], uses[:, [lexicon.terms.index(t) for t in lexicon.given]]
    sums = np.stack([stems.sum(axis=1), given.sum(axis=1)], axis=1)
    different = (stems > 0).sum(axis=1, keepdims=True)
    own = np.concatenate([stems, given], axis=1)
    return np.concatenate([np.log1p(500 * own / words), np.log1p(500 * sums / words), np.log1p(sums), np.log1p(different)], axis=1).astype(float)


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps, with squared weights (not the bias) held down by a penalty."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    hold = np.full(x1.shape[1], penalty)
    hold[-1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x1 @ w)
        slope = x1.T @ (p - target) + hold * w
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(hold)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(id_col: str) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_documents(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_toxic: int, max_clean: int, max_unlabelled: int
) -> DataFrame:
    """(id, text, toxic) of at most so many documents of each kind, none held out, chosen by a hash of the id; toxic is
    null for the unlabelled kind. The chosen ids are broadcast: their number is the bound."""
    order = F.xxhash64(F.col("id"), F.lit("toxicity"))
    labelled = (
        labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
        .select("id", "toxic", order.alias("place"))
    )
    others = df.filter(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("toxic"))
    first = lambda rows, most: rows.orderBy("place", "id").limit(most)
    chosen = (
        first(labelled.filter("toxic = 1"), max_toxic)
        .unionByName(first(labelled.filter("toxic = 0"), max_clean))
        .unionByName(first(others.select("id", "toxic", order.alias("place")), max_unlabelled))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = texts.join(F.broadcast(written(chosen, "toxicity-ids")), "id").select("id", "text", "toxic")
    most = max_toxic + max_clean + max_unlabelled
    return found.orderBy(F.xxhash64("id", F.lit("toxicity")), "id", "text").limit(most)


def learned_terms(train: DataFrame, most: int = 300, least_docs: int = 5, least_ratio: float = 20.0) -> list[str]:
    """Terms that labelled toxic texts use far more than clean ones: at least three times as often, and in so many more
    texts that a log-likelihood ratio of least_ratio says it is no chance; the greatest ratio of uses first. Spark counts
    them over the whole texts; only the best come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, rows in batch.groupby("toxic"):
                uses, docs = Counter(), Counter()
                for text in rows["text"]:
                    own: Counter = Counter()
                    for word, times in Counter(normal(text).split()).items():
                        for term in terms_of(word):
                            own[term] += times
                    docs.update(own.keys())
                    uses.update({term: min(times, USES) for term, times in own.items()})
                listed = list(docs)
                yield pd.DataFrame({"term": listed, "toxic": int(toxic), "uses": [uses[t] for t in listed], "docs": [docs[t] for t in listed]})
        give_back()

    labelled = train.filter("toxic IS NOT NULL").select("text", "toxic")
    sizes = {r["toxic"]: r["docs"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []
    counted = labelled.mapInPandas(count, "term string, toxic int, uses long, docs long").groupBy("term").agg(
        *[F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{y}") for c in ("uses", "docs") for y in (0, 1)]
    )
    rate = [(F.col(f"uses{y}") + 0.5) / (sizes[y] + 1) for y in (0, 1)]

    def ratio(what: str) -> Column:
        clean, toxic = F.col(f"{what}0"), F.col(f"{what}1")
        expected = (clean + toxic) * (sizes[1] / (sizes[0] + sizes[1]))
        return 2 * (toxic * F.log(toxic / expected) + F.when(clean > 0, clean * F.log(clean / (clean + toxic - expected))).otherwise(0.0))

    chosen = counted.filter((F.col("docs1") >= least_docs) & (rate[1] >= 3 * rate[0]) & (ratio("docs") >= least_ratio))
    best = chosen.orderBy(ratio("uses").desc(), F.length("term").desc(), "term")
    return [r["term"] for r in best.select("term").limit(most).collect()]


def fit_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_toxic: int = 1500, max_clean: int = 3000, max_unlabelled: int = 1500, max_terms: int = 300,
) -> ToxicityModel | None:
    """Learn terms from labelled texts, estimate the voters on labelled and unlabelled ones, and train the classifier on
    the posterior labels; None if there is no document to learn from. Of the texts only counts of terms come to the
    driver: a row of at most max_terms numbers for each of the documents that the three bounds allow."""
    train = written(
        training_documents(df, labels, id_col, text_col, label_col, max_toxic, max_clean, max_unlabelled).repartition(
            partitions_for(df.sparkSession), "id"
        ),
        "toxicity-train",
    )
    lexicon = Lexicon(learned_terms(train, max_terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.counter()
        for batch in batches:
            uses, shape = lexicon.counts(list(batch["text"]), machine)
            yield pd.DataFrame({"id": batch["id"].astype(str), "toxic": batch["toxic"].fillna(-1).astype(int), "uses": list(uses), "shape": list(shape)})
        give_back()

    rows = train.mapInPandas(count, "id string, toxic int, uses array<float>, shape array<float>").orderBy("id", "toxic", "uses").collect()
    if not rows:
        return None
    known = np.array([r["toxic"] for r in rows])
    uses, shape = (np.array([r[c] for r in rows], np.float32) for c in ("uses", "shape"))
    cast = votes(lexicon, uses, shape)
    model, posterior = fit_label_model(cast, known)
    return ToxicityModel(lexicon, *fit_linear(features(lexicon, uses, shape), posterior), model)


def score_toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7, model: ToxicityModel | None = None, **bounds: int,
) -> DataFrame:
    """df with held_out, score and predicted added.

    Unless a model is given, one is fitted to at most max_toxic, max_clean and max_unlabelled documents (see
    fit_toxicity) that are not held out. It then reads every text whole: terms are found by one automaton, and the
    score is a logistic function of how often they are used. Texts go through in Arrow batches, with no shuffle; the
    terms and weights travel with the function. Labels, ids and other columns are no inputs of a score.

    Edge cases: no rows give no rows; a null text is empty, and an empty one gets the score of no term at all; texts of
    any length are read whole; equal texts get equal scores; without labels the given lexicon's votes alone are learned
    from; if several labels of an id differ it is toxic; ids without a text, or texts without an id, are not learned
    from; where no document can be learned from all scores are 0; columns named like the added ones are replaced, all
    others are kept whatever their names.
    """
    added = ["held_out", "score", "predicted"]
    rows = df.drop(*[c for c in df.columns if c.lower() in added and c not in (id_col, text_col)])
    if model is None:
        model = fit_toxicity(df, labels, id_col, text_col, label_col, **bounds)

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = model.lexicon.counter()
        for texts in batches:
            parts = [model.scores(list(texts[k : k + 256]), machine) for k in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
        give_back()

    judge.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score = F.lit(0.0) if model is None else F.pandas_udf(judge, "double")(text_or_empty(text_col))
    own = f"{free_prefix(rows)}score"
    scored = rows.withColumn(own, score)
    return scored.select(
        *rows.columns, held_out(id_col).alias("held_out"), F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted")
    )
