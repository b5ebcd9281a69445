"""Exact dedup, mixing, sharding and quality rules against brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from provenio.llm.exact_dedup import exact_dedup
from provenio.llm.mixing import mix_sources, mixed_rows
from provenio.llm.quality_rules import beta_prior, quality_rules
from provenio.llm.sharding import shard_by_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, n_words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    """Rows of (id, text, source) with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", s, 0, "clash", "clash", "clash") for i, t, s in rows], DOCS).repartition(3)


ODD = [
    (1, "same", "a"), (2, "same", "a"), (3, "same ", None), (4, None, None), (5, "", "b"), (6, "x" * 200_000, "b"),
    (7, "w " * 30_000, "c"), (9, "same", "c"), (9, "same", "c"), (None, "alone", "c"), (8, "　é\x00", "a"),
]


@pytest.mark.parametrize("limit", [1_000_000, 3, 0])
def test_exact_dedup(spark, limit):
    rows = [*ODD, *[(100 + k, f"copy {k % 7}", "h") for k in range(60)]]
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    found = exact_dedup(documents(spark, rows), max_broadcast_rows=limit).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.size == "clash"
    assert exact_dedup(documents(spark, rows).limit(0)).count() == 0


def test_unique_rows_pass_a_filter_in_pieces(spark, monkeypatch):
    from provenio.llm import exact_dedup as module

    rows = [(k, f"alone {k}", "h") for k in range(3000)] + [(5000 + k, f"copy {k % 20}", "h") for k in range(60)]
    shuffled = []
    real = module.written

    def watch(df, name):
        if name == "repeat-groups":
            shuffled.append(df.agg({"group_size": "sum"}).first()[0])
        return real(df, name)

    monkeypatch.setattr(module, "written", watch)
    found = exact_dedup(documents(spark, rows), max_broadcast_rows=40).collect()
    assert sum(not r.kept for r in found) == 40 and len(found) == len(rows)
    assert 60 <= shuffled[0] < 300


CLASHES = "_low _high _start _block _n _word0 _bits0 _sha _hash _suspect _taken_id _id _copies _encoded _judged _known".split()


def test_columns_of_any_name_are_kept(spark):
    from pyspark.sql import functions as F

    from provenio.llm.language_id import detect_language

    rows = [(k, f"text {k % 5}", "a") for k in range(20)]
    df = documents(spark, rows).select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])
    for result in (exact_dedup(df), shard_by_key(df), mixed_rows(df), detect_language(df, max_train_docs=20)):
        found = result.collect()
        assert found and all(r[c] == f"mine {c}" for r in found for c in CLASHES)


def test_mixed_rows_of_repeated_ids(spark):
    rows = [(k % 7, "w " * (10 + k % 3), "a" if k % 5 else "b") for k in range(60)] + [(None, "w w", "a"), (None, "w w", "a"), (50, "w", None)]
    df = documents(spark, rows)
    wanted = Counter()
    for r in mix_sources(df).collect():
        wanted[(r.doc_id, r.source, r["size"])] += r.copies
    there = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed_rows(df).collect())
    assert there == +wanted


def brute_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)


def test_mixing(spark):
    rows = [*ODD, *[(1000 + k, "w " * (k % 50), "hot" if k % 2 else f"s{k % 9}") for k in range(1500)]]
    df = documents(spark, rows)
    found = mix_sources(df).collect()
    assert sorted(map(str, found)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    taken, longest = Counter(), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(2 * longest[s], 0.02 * targets[s])
    assert len(found) == len(rows)
    assert mix_sources(df.limit(0)).count() == 0


def test_mixed_rows_repeats_documents(spark):
    rows = [(k, "w " * 20, "a" if k % 10 else "b") for k in range(400)]
    df = documents(spark, rows)
    copies = {r.doc_id: r.copies for r in mix_sources(df).collect()}
    there = Counter(r.doc_id for r in mixed_rows(df).collect())
    assert there == Counter({k: n for k, n in copies.items() if n})
    assert mixed_rows(df).columns == df.columns


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [*ODD, *[(10_000 + k, f"t{k}", "s") for k in range(3000)]]
    found = shard_by_key(documents(spark, rows)).collect()
    slots = defaultdict(list)
    for r in found:
        key = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "null").encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17))
        assert r.grown_shard in (r.shard, 16)
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = len(rows) / 16  # counts of a fair hash stay within five standard deviations
    assert all(abs(len(s) - mean) < 5 * mean**0.5 for s in slots.values())
    assert shard_by_key(documents(spark, rows).limit(0)).count() == 0


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), failed


def test_quality_rules(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        *ODD, (20, f"{text} a {text} b c d e f g", "a"), (21, f"{text}\n{text}\n \n\n{text}", "a"), (22, "#a* " * 25, "a"), (23, "é日 　x " * 8, "b"),
        (24, "a b c d e f g h " * 2 + "z", "b"), (25, "\t".join(str(k) for k in range(40)), "d"), (26, "x\x0by\x0cz\rw", None),
        *[(100 + k, f"short {k}", "bad host") for k in range(40)], (190, " ".join(map(str, range(50))), "bad host"),
        *[(200 + k, " ".join(str(k * n) for n in range(1, 60)), "good host") for k in range(40)],
    ]
    found = quality_rules(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {i: brute_counts(t) for i, t, _ in rows}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_id[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in found}
    assert not kept[190] and all(kept[200 + k] for k in range(40) if not by_id[200 + k][5])
    assert quality_rules(documents(spark, rows).limit(0)).count() == 0


def test_prior_of_equal_and_of_no_hosts(spark):
    hosts = spark.createDataFrame([("a", 100, 10), ("b", 100, 10)], "h string, docs long, failed long")
    alpha, beta = beta_prior(hosts)
    assert alpha / (alpha + beta) == pytest.approx(0.1)
    assert beta_prior(hosts.limit(0)) == (1.0, 1.0)
