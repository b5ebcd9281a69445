"""Token counts, archives, pieces and language ID."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provenio.llm import archives
from provenio.llm.bpe_counts import text_counter, token_counts
from provenio.llm.common import scratch_path
from provenio.llm.language_id import UNDETERMINED, detect_language, held_out, train, training_samples
from provenio.llm.piece_lattice import best_path, decode, encode, encode_words, merge_words, merged_path, piece_table
from provenio.llm.registry import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "<s>", "</s>", "<0x0A>", "\x00", "aaaa", "1", ","]
ODD = [(1, None), (2, ""), (3, " "), (4, "<s> x"), (5, "a" * 20_000), (6, "日本 😀\n"), (7, "word " * 20_000), (7, "again"), (None, "null id")]


def mixed_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def test_counts_are_the_librarys():
    import sentencepiece

    library, count = sentencepiece.SentencePieceProcessor(model_file=MODEL), text_counter(MODEL)
    for text in [*mixed_texts(3000, 1), *[" " * n for n in range(60)], *[t for _, t in ODD if t]]:
        assert count(text) == len(library.encode(text)), repr(text[:50])


def test_token_counts(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, n_tokens string").repartition(3)
    found = token_counts(df, MODEL).collect()
    assert len(found) == len(ODD)
    for r in found:
        tokens = len(library.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), tokens, tokens > 4096)
    assert token_counts(df.limit(0), MODEL).count() == 0


def best_score(word, table):
    best = {0: 0.0}
    for stop in range(1, len(word) + 1):
        options = [best[k] + table.pieces[word[k:stop]][1] for k in range(stop) if word[k:stop] in table.pieces]
        best[stop] = max([*options, best[stop - 1] + table.unknown_score] if word[stop - 1] not in table.pieces else options)
    return best[len(word)]


def test_lattice_paths_are_the_best(spark):
    table = piece_table(MODEL)
    words = sorted({t[:20] for t in mixed_texts(300, 2) if t})
    found = {r.word: r.ids for r in encode_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    scores = {i: s for i, s in table.pieces.values()}
    assert set(found) == set(words)
    for word, ids in found.items():
        assert ids == best_path(word, table, table.unknown_score, table.beginnings()), word
        unknown = sum(c not in table.pieces for c in word)
        known = sum(scores[i] for i in ids if i in scores)
        assert known + unknown * table.unknown_score == pytest.approx(best_score(word, table)), word


def test_encoding_and_decoding(spark):
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(mixed_texts(60, 3))]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_pieces string")
    encoded = encode(df, MODEL, dictionary_words=50)
    again = decode(encoded.withColumnRenamed("text", "was"), MODEL).collect()
    assert len(again) == len(rows)
    for r in again:
        assert r.text == (r.was or "").replace("▁", " ")
        assert r.round_trip == ("▁" not in (r.was or "")) and r.n_pieces == len(r.piece_ids)
    assert encode(df.limit(0), MODEL).count() == 0
    assert decode(encoded.limit(1).withColumn("piece_ids", F.lit(None).cast("array<int>")), MODEL).first().text is None


def test_ids_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    prose = ["The quick brown foxes were rewriting unbelievable things, internationally. Überraschung!\n" * 2, "aaaaaaaaa ingthe theing"]
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate([*mixed_texts(200, 8), *prose])]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for words in (2, 10_000):
        for r in encode(df, MODEL, dictionary_words=words).collect():
            assert r.piece_ids == library.encode(r.text or ""), repr((r.text or "")[:50])


def test_words_part_only_where_no_piece_joins():
    import sentencepiece

    from provenio.llm.piece_lattice import WordCodes

    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_table(MODEL)
    rng, pool = random.Random(12), "aeinrtsé日カ²½١9_.,;:()!'\"{}=*-/\r\n\t▁ \u0301\u200d😀ßÇ"
    assert table.splits and table.word_pattern().findall("▁▁Mr.\nSmith2²") == ["▁▁Mr", ".\n", "Smith", "2²"]
    codes = WordCodes({}, table, 50)
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 24)))
        ids, same = codes.text(text)
        assert memoryview(ids).cast("i").tolist() == library.encode(text), repr(text)
        assert same == ("▁" not in text)


def test_merging_is_one_rule(spark):
    table = piece_table(MODEL)
    words = sorted({t[:20] for t in mixed_texts(300, 9) if t} | {"▁internationally", "▁unbelievable", "a" * 48, "ab" * 30})
    found = {r.word: r.ids for r in merge_words(spark, spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    assert found == {word: merged_path(word, table) for word in words}


PAGES = [
    (1, "http://a b/", "x"), (2, None, "x"), (3, "u", ""), (4, "u", None), (5, "v", "WARC/1.1\r\n\r\n\r\nhé"), (6, "v", "HTTP/1.1 200\r\n\r\nq"),
    (6, "v", "HTTP/1.1 200\r\n\r\nq"), (None, "w", "x"), (0, "z", "y" * 100_000), (8, "filedesc-like", "\n\n1 0 x\n"), (9, "v", "\r\n"),
]


def test_pages_through_both_formats(spark):
    df = spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, payload_digest string").repartition(3)
    found = archives.pages_through_archives(df, scratch_path(spark, "t"), archive_bytes=700).collect()
    assert len(found) == len(PAGES)
    first = {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(html or "", i)
    responses = 0
    for r in found:
        html = next(h for i, _, h in PAGES if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.refers_to is None) == (r.record_type == "response")
        assert r.record_type == "response" or r.refers_to == first[html]
        responses += r.record_type == "response"
    assert responses == len(first)
    assert archives.pages_through_archives(df.limit(0), scratch_path(spark, "t")).count() == 0


def test_arc_versions_and_broken_lengths():
    for version in "12":
        body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n\n\nhttp://x 1 2 3 4\n"
        data = archives.arc_header("n.arc", version) + archives.arc_record("n.arc", version, 9, "http://u/?a b", "20010203", body) + b"\n"
        (_, head, _), (at, fields, block) = archives.parse_arc(data * 1)
        assert head["url"] == "filedesc://n.arc" and block == body and fields["url"] == "http://u/?a b" and fields["date"] == "20010203"
        row = archives.warc_equivalent("n.arc", at, fields, block)
        assert row["date"] == "2001-02-03T00:00:00Z" and row["record_type"] == "response" and row["payload_bytes"] == len(body) - 25
        assert row == archives.warc_equivalent("n.arc", at, fields, block)
        with pytest.raises(ValueError, match="declares"):
            list(archives.parse_arc(data[:-5]))


LANGS = {"x": "abcab bca cab ", "y": "zxy yzx xyz ", "z": "éàü üéà "}


def test_language_id(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(LANGS[lang].split()) + " " for _ in range(30)), lang) for k in range(240) for lang in [rng.choice("xyz")]]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "12 !?", "x"), (1003, "abc " * 5000, None), (None, "abcab", None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    found = detect_language(df, max_train_docs=200).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0.0 <= r.score <= 1.0
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == (UNDETERMINED, 0.0)
    test = [r for r in found if r.held_out and r.lang and r.lang_pred != UNDETERMINED]
    assert len(test) > 20 and sum(r.lang_pred == r.lang for r in test) >= 0.95 * len(test)
    assert next(r for r in found if r.doc_id == 1003).lang_pred == "x"
    assert detect_language(df.limit(0)).count() == 0
    blank = detect_language(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in blank] == [UNDETERMINED]


def test_few_labels_in_a_large_table_are_all_used(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("é"), F.repeat(F.lit("öä "), 30), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 400 == 0, "x").alias("lang"),
    )
    eligible = df.filter(~held_out("doc_id") & F.col("lang").isNotNull()).count()
    assert 20 < eligible < 50
    found = training_samples(df, "doc_id", "text", "lang", 20, 1, 64)
    assert len(found) == 20 and all(len(piece) == 48 for piece, _ in found)
    assert len(training_samples(df, "doc_id", "text", "lang", 100, 1, 64)) == eligible


def test_gradients_are_those_of_the_loss():
    import numpy as np

    from provenio.llm.language_id import _Trainer

    way = _Trainer(np.random.default_rng(1), 3, 4, 2)
    way.weights = {k: v.astype(np.float64) for k, v in way.weights.items()}
    data = np.random.default_rng(2).integers(0, 256, (6, 5)).astype(np.uint8)
    pull = np.random.default_rng(3).normal(size=(6, 2, 5))
    way.forward(data)
    grads = way.backward(pull)
    for name in ("recurrent", "inner", "head", "bias", "input"):
        at = tuple(0 for _ in way.weights[name].shape)
        eps, was = 1e-6, way.weights[name][at]
        way.weights[name][at] = was + eps
        up = (way.forward(data) * pull).sum()
        way.weights[name][at] = was - eps
        down = (way.forward(data) * pull).sum()
        way.weights[name][at] = was
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-4), name


def test_reading_is_that_of_a_plain_network():
    import numpy as np

    from provenio.llm import language_id

    network = train([(b"abc abc", "x"), (b"xyz zyx", "y"), (b"123", "z")] * 20, steps=8)

    def plain(data):
        sums = np.zeros(3)
        for at in range(0, len(data), language_id.STRETCH):
            piece = data[at : at + language_id.STRETCH]
            logits = np.tile(network.bias.astype(float), (len(piece), 1))
            for way in (0, 1):
                state = np.zeros(network.recurrent[way].shape[1])
                h = len(state)
                for t in range(len(piece)) if way == 0 else reversed(range(len(piece))):
                    given, held = network.tables[way][:, piece[t]], network.recurrent[way] @ state
                    update, reset = (1 / (1 + np.exp(-(given[k : k + h] + held[k : k + h]))) for k in (0, h))
                    fresh = np.tanh(given[2 * h :] + reset * (held[2 * h :] + network.inner[way]))
                    state = fresh + update * (state - fresh)
                    logits[t] += network.heads[way] @ state
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            sums += (share / share.sum(axis=1, keepdims=True)).sum(axis=0)
        return sums / max(len(data), 1)

    texts = [b"", b"a", b"abc xyz 12", b"z" * 127, b"ab" * 64, bytes(range(256)) * 2, b"q" * 129]
    assert np.allclose(network.document_probabilities(texts), [plain(t) for t in texts], atol=1e-4)


def test_training_is_repeatable():
    samples = [(b"abc abc", "x"), (b"xyz zyx", "y")] * 20
    one, two = train(samples, steps=5), train(samples, steps=5)
    assert (one.tables[0] == two.tables[0]).all()
