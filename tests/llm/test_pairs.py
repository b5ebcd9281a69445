"""Similarity groups, suffix dedup and the pipeline against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from provenio.llm.components import connected_components
from provenio.llm.jaccard_join import one_of_each_group, part_enum, similarity_groups
from provenio.llm.suffix_dedup import Block, _blocks, deal_runs, hot_buckets, suffix_dedup


def feature_set(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_groups(rows, width, percent):
    sets = {i: feature_set(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, groups=6, size=25, words=60):
    rng, rows, at = random.Random(seed), [], 10
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([8, 30, words]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            rows.append((at, " ".join(copy)))
            at += 1
    return rows


ODD = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "two one"), (7, "A b c d"), (8, "a B c d"), (9, "x " * 20_000), (None, "one two")]


def test_similar_sets_share_a_signature():
    rng, scheme = np.random.default_rng(3), part_enum(85)
    for n in [*range(1, 80, 3), 150, 400, 1200]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            lost = rng.integers(0, int(0.17 * n) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**64, rng.integers(0, lost + 1), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_groups_are_those_of_all_pairs(spark):
    rows = [*ODD, *near_copies(1)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)
    for width, percent in ((4, 85), (5, 80)):
        found = similarity_groups(df, width=width, percent=percent).collect()
        assert len(found) == len(rows)
        wanted = brute_groups(rows, width, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == wanted
        assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = {r.doc_id for r in one_of_each_group(df, width=5, percent=80).collect()}
    assert kept == {None, *(c for i, (_, c) in wanted.items())}
    assert similarity_groups(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    s, base, other = words(40), words(60), words(30)
    near = base[:30] + ["new"] + base[31:]
    rows = [(1, s), (9, s), (9, s), (9, base), (12, near), (20, other), (None, s), (30, words(25)), (30, words(25))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    found = similarity_groups(df).collect()
    wanted = {1: 1, 9: 1, 12: 1, 20: 20, None: None, 30: 30}
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i}, n_shingles={len(feature_set(' '.join(t), 4))}, component_id={wanted[i]})" for i, t in rows)
    kept = sorted(str(r.doc_id) for r in one_of_each_group(df).collect())
    assert kept == ["1", "20", "30", "30", "None"]


def test_crowded_signatures_are_paired_in_blocks(spark, monkeypatch):
    from provenio.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
    # chains of documents in which each links with the next ones only, around one body that all share
    body = [f"b{k}" for k in range(70)]
    rows = [(k, " ".join(body + [f"t{g}_{k // 2 + d}" for d in range(9 + g)])) for g in range(3) for k in range(g * 40, g * 40 + 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 92):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_groups(df, percent=percent).collect()}
        assert found == brute_groups(rows, 4, percent)


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: 1 if n < 100 else 100 if n < 200 else 200 for e in edges for n in e}


def brute_suffixes(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rng = random.Random(2)
    parts = ["ab" * 30, "x" * 150, "hello world " * 12, "é" * 60, "q", "zz", "\n", "".join(rng.choice("abcdef") for _ in range(300))]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))) for k in range(50)]
    rows += [(-5, ""), (99, None), (None, "x" * 300), (70, "y" * 99), (71, "y" * 100), (72, "y" * 101), (73, "".join(rng.choice("abc") for _ in range(5000)))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(3)
    wanted = brute_suffixes(rows, 100)
    # with a limit of 300 bytes nearly all buckets are split twice, with 3,000 some
    for turns, limit in ((1, 1 << 20), (3, 300), (2, 3000)):
        found = suffix_dedup(df, turns=turns, buckets=16, bucket_limit=limit).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == wanted
    for r in found:
        assert sum(s["bytes"] for s in r.spans) == r.n_removed
    assert suffix_dedup(df.limit(0)).count() == 0


def test_a_gram_with_many_surroundings_is_split(spark):
    """Passages of 40 and of 80 bytes in 600 texts each: no bucket of the dealt runs holds them all."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    short, long = noise(40), noise(80)
    rows = [(k, noise(200) + (short if k % 2 else long) + noise(200)) for k in range(1200)]
    rows += [(2000 + k, rows[k][1][50:350]) for k in range(40)]
    limit, buckets = 40_000, 256
    df = spark.createDataFrame(rows, "i long, t string").repartition(4).cache()
    hot = hot_buckets(df, 100, buckets, limit)
    assert len(hot) == 2 and all(len(level) for level in hot)

    def most(hot):
        sizes = {}
        for block in _blocks([df.toPandas()], 100):
            for row in deal_runs(Block(block, 100, buckets, hot), 0, 1):
                if row["bucket"] >= 0:
                    sizes[row["bucket"]] = sizes.get(row["bucket"], 0) + len(row["body"])
        return max(sizes.values())

    # 256 buckets are some 10,000 bytes each beside what is hot
    assert most(hot) < most([]) / 2
    found = suffix_dedup(df, id_col="i", text_col="t", buckets=buckets, bucket_limit=limit).collect()
    assert {r.i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute_suffixes(rows, 100)


def test_suffixes_of_repeated_and_of_text_ids(spark):
    t, other = "q" * 40 + "abcdefghij" * 26, "z" * 20 + "abcdefghij" * 26
    rows = [(5, t), (5, t), (5, other), (9, t), (None, "k" * 150), (None, "k" * 150), (None, "l" * 150)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    order = sorted({*rows}, key=lambda r: (r[0] is None, r[0] or 0, sha(r[1])))
    wanted = brute_suffixes([(k, x) for k, (_, x) in enumerate(order)], 100)
    wanted = {r: wanted[k] for k, r in enumerate(order)}
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
        found = suffix_dedup(df).collect()
        assert len(found) == len(rows)
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
        assert got == sorted((str(i), *wanted[(i, x)]) for i, x in rows)


def test_a_lone_run_that_repeats_within_itself(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("ghijklmnop") for _ in range(n))
    far = noise(150)
    rows = [(1, noise(150) + "ab " * 100 + noise(150)), (2, "cd" * 90), (3, "cd" * 90), (4, noise(40) + "Der, " * 30), (5, far + noise(40) + far), (6, noise(120) + "e" * 101 + noise(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in ([1], [2, 3], [1, 2, 3, 4, 5, 6]):
        some = [r for r in rows if r[0] in part]
        wanted = brute_suffixes(some, 100)
        assert all(wanted[i][1] for i in part)
        found = suffix_dedup(df.filter(F.col("doc_id").isin(part)).coalesce(1)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == wanted


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    words = {"en": ["the", "thing", "wish", "and"], "fr": ["eau", "été", "que", "où"]}
    rows = [(k, " ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) for _ in range(40)), lang, f"s{k % 3}") for k in range(120) for lang in [rng.choice(["en", "fr"])]]
    rows += [(500 + k, rows[k][1], rows[k][2], "s0") for k in range(20)]
    rows += [(600 + k, rows[30 + k][1] + " end", rows[30 + k][2], "s1") for k in range(20)]
    rows += [(700, "12345 678", "en", "s0"), (701, None, None, None)]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert docs.columns == df.columns
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append({r.doc_id for r in docs.select("doc_id").collect()})
    known, exact, near, mixed, encoded = steps
    assert known == {r[0] for r in rows} - {700, 701}
    by_text = {}
    for i, t, _, _ in rows:
        if i in known:
            by_text[t] = max(i, by_text.get(t, i))
    assert exact == set(by_text.values())
    left = [(i, t) for i, t, _, _ in rows if i in exact]
    assert near == {c for i, (_, c) in brute_groups(left, 5, 80).items()}
    assert mixed <= near and encoded == mixed
    assert docs.filter(~F.col("round_trip")).count() == 0
