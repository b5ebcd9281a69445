"""Periodic runs and the filter audit against brute force, toxicity on words that only labels tell; edge cases of each."""

import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenio.llm.filter_audit import filter_audit
from provenio.llm.periodic_runs import periodic_runs, planted, word_runs
from provenio.llm.toxicity import Lexicon, fit_label_model, score_toxicity, votes

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, source string, runs string, score string, part string, A string, later string, uses string"


def documents(spark, rows):
    """Rows of (id, text, source) with columns whose names clash with those that operators add or use."""
    return spark.createDataFrame([(i, t, s, *["clash"] * 6) for i, t, s in rows], DOCS).repartition(3)


def slow_runs(words, least=12):
    """Every maximal stretch with each smallest period, by trying all periods and places."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_word_runs(letters):
    draw = random.Random(letters)
    for _ in range(150):
        words = [str(draw.randrange(letters)) for _ in range(draw.randrange(0, 70))]
        for _ in range(draw.randrange(3)):
            at, size = draw.randrange(len(words) + 1), draw.randrange(1, 9)
            words[at:at] = words[at : at + size] * draw.randrange(2, 9)
        assert word_runs(words) == slow_runs(words)
        assert word_runs(words, 3) == slow_runs(words, 3)


def test_word_runs_of_long_texts():
    words = [f"w{k}" for k in range(30_000)]
    assert word_runs(words) == []
    assert word_runs(words[:7000] * 2 + ["end"]) == [(0, 14_000, 7000)]
    assert word_runs(["x"] * 20_000) == [(0, 20_000, 1)]


def test_planted():
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert 20 < len(ids) < 60
    for i in ids:
        words, g = [f"w{k}" for k in range(50)], zlib.crc32(str(i).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert planted(words, str(i)) == [words[k] if k < a else words[a + (k - a) % p] for k in range(50)]
    assert planted([], str(ids[0])) == []


def test_periodic_runs(spark):
    rows = [
        (1, "a b c " * 5 + "d", "s"), (2, None, "s"), (3, "", None), (4, " \n\t ", "s"), (5, "one", "s"), (6, "x " * 4000, "s"),
        (7, "A a " * 6 + "e\x00é　" + " q" * 12, "s"), (7, "A a " * 6 + "e\x00é　" + " q" * 12, "s"), (None, "z z " * 9, "s"),
    ]
    for plant in (False, True):
        found = periodic_runs(documents(spark, rows), plant=plant).collect()
        assert len(found) == len(rows)
        for r in found:
            words = WORD.findall(r.text or "")
            if plant and r.doc_id is not None:
                words = planted(words, str(r.doc_id))
            runs = slow_runs(words)
            dropped = {k for start, length, q in runs for k in range(start + q, start + length)}
            assert [tuple(x) for x in r.runs] == runs
            assert r.n_words == len(words) and r.collapsed == " ".join(w for k, w in enumerate(words) if k not in dropped)
            assert r.score == "clash" and r.A == "clash"
    assert periodic_runs(documents(spark, rows).limit(0)).count() == 0


def slow_audit(rows, marks):
    """The audit, by running every order over every document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    judged = []
    for i, t, s in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > first[text],
        }
        judged.append((s or "", fails, *marks.get(i, (0, 0))))
    found = {}
    for part in {x[0] for x in judged}:
        own = [x for x in judged if x[0] == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                out, alive = [x for x in alive if x[1][f]], [x for x in alive if not x[1][f]]
                failing = [x for x in own if x[1][f]]
                totals[f] += len(out)
                found[part, "".join(order), step] = [
                    len(alive), len(out), len(failing) - len(out), sum(sum(x[1].values()) == 1 for x in failing),
                    sum(x[2] for x in out), sum(x[3] for x in out), f,
                ]
        for key, row in found.items():
            if key[0] == part:
                row[-1] = totals[row[-1]]
    return found


def test_filter_audit(spark):
    draw = random.Random(5)
    some = lambda n, of: " ".join(f"{draw.choice('abAB')}{draw.randrange(of)}" for _ in range(n))
    texts = [some(draw.choice([3, 60, 90]), draw.choice([20, 5000])) + draw.choice(["", "", " #"]) for _ in range(60)]
    rows = [(k, draw.choice(texts), draw.choice(["a", "b", None, ""])) for k in range(150)]
    rows += [(1000 + k, texts[0], "hot") for k in range(300)]  # one group of copies holds most rows
    rows += [(3, rows[3][1], "b"), (7, None, "a"), (8, "", None), (8, "", None), (None, texts[0], "a"), (9, "w " * 50_000, "a")]
    marks = [(k, draw.randrange(2), draw.randrange(2)) for k in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (1000, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {}
    for i, q, t in marks:
        old = known.get(i, (0, 0))
        known[i] = (max(old[0], q or 0), max(old[1], t or 0))
    known.pop(None)
    expected = slow_audit(rows, known)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in filter_audit(documents(spark, rows), labels).collect()}
    assert found == expected
    assert len(found) == 4 * 600
    assert filter_audit(documents(spark, rows).limit(0), labels).count() == 0
    unlabelled = filter_audit(documents(spark, rows), labels.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()[:] == (0, 0, 2400)


def test_label_model_finds_the_voters_that_know():
    rng = np.random.default_rng(3)
    truth = (rng.random(1500) < 0.3).astype(int)
    right = lambda share: np.where(rng.random(1500) < share, truth, 1 - truth) * 2 - 1
    copied = right(0.6)
    cast = np.stack([right(0.95), right(0.9), right(0.9), copied, copied, copied, copied, np.zeros(1500, int)], axis=1).astype(np.int8)
    model, posterior = fit_label_model(cast, np.where(rng.random(1500) < 0.1, truth, -1))
    assert ((posterior > 0.5) == truth).mean() > 0.97
    agree = model.tables[:, 2, 1]
    assert agree[0] > agree[1] > agree[3]
    assert model.correlations[3, 4] > 0.9 > 0.3 > model.correlations[0, 1]
    assert model.weights[3] < 0.4 < model.weights[0]


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    """Texts of random words; toxic ones hold words that begin with 'grubol', or 'Scum##': (id, text, source), toxic ids."""
    draw = random.Random(11)
    plain = lambda n: [draw.choice("the and of to in is on".split()) + draw.choice("abcdefgh") * draw.randrange(4) for _ in range(n)]
    rows, bad = [], set()
    for k in range(900):
        words = plain(draw.randrange(5, 120))
        if k % 4 == 0:
            bad.add(k)
            for _ in range(2 + len(words) // 20):
                words.insert(draw.randrange(len(words)), draw.choice(["Grubol" + draw.choice("xyz") * 3, "Scum##"]))
        rows.append((k, " ".join(words) + ".", "s"))
    return rows, bad


def test_toxicity(spark, toxic_corpus):
    rows, bad = toxic_corpus
    odd = [(2000, None, "s"), (2001, "", "s"), (2002, "!!! 12 ##", "s"), (2003, "word " * 40_000, "s"), (5, rows[5][1], "s"), (None, "scum", "s")]
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(0, 900, 2)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    found = score_toxicity(documents(spark, rows + odd), labels).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.uses == "clash"
    judged = [r for r in found if r.held_out and r.doc_id < 2000]
    assert sum(r.predicted == (r.doc_id in bad) for r in judged) / len(judged) > 0.97
    assert not any(r.predicted for r in found if r.doc_id is not None and r.doc_id >= 2000)
    assert len({r.score for r in found if r.doc_id == 5}) == 1


def test_toxicity_reads_no_held_out_label(spark, toxic_corpus):
    rows, bad = toxic_corpus
    docs = documents(spark, rows)
    table = lambda flip: spark.createDataFrame(
        [(k, int((k in bad) ^ (flip and zlib.crc32(str(k).encode()) % 3 == 1))) for k in range(900)], "doc_id long, toxic int"
    )
    one, two = ({r.doc_id: r.score for r in score_toxicity(docs, table(flip)).collect()} for flip in (False, True))
    assert one == two


def test_toxicity_without_labels_or_rows(spark, toxic_corpus):
    rows, _ = toxic_corpus
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = score_toxicity(documents(spark, rows[:60] + [(5000, "idiot scum trash moron pathetic loser", "s")]), none).collect()
    assert len(found) == 61 and all(0 <= r.score <= 1 for r in found)
    assert score_toxicity(documents(spark, rows).limit(0), none).collect() == []


def test_voters_abstain():
    lexicon = Lexicon([" grub", " grubol", " blee "])
    assert [lexicon.terms[k] for k in lexicon.stems] == [" grub", " blee "]
    uses, shape = lexicon.counts(["Grubolx and blee!!! it", "", "clean words"], lexicon.counter())
    cast = votes(lexicon, uses, shape)
    assert cast[0, :2].tolist() == [1, 1] and cast[1, :4].tolist() == [0, 0, 0, 0] and cast[2, 5] == -1
