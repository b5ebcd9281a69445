"""Captured trees and pages, one file with a commit, report documents, and likeness in the JVM."""

import json
import random

import pytest
from pyspark.sql import functions as F

from provenio.functions import text
from provenio.operators import resolution
from provenio.plans import report
from provenio.sources import pages, single_file
from provenio.sources.trees import read_trees, truncated


def test_trees(spark):
    entry = {"path": "a/Cargo.toml", "mode": "100644", "type": "blob", "sha": "x", "size": 3}
    texts = [
        {"sha": "t", "truncated": False, "tree": [entry, entry | {"path": "d", "type": "tree", "size": None}]}, {"sha": "t", "truncated": True, "tree": [entry]}, {"sha": "t"}, {"tree": []},
        {"sha": "t", "tree": [entry | {"size": -1}]}, {"sha": "t", "tree": [{"path": "p"}]}, [], {"sha": "t", "tree": "no"},
    ]
    rows = [(k, json.dumps(t)) for k, t in enumerate(texts)] + [(20, None), (21, ""), (22, '{"sha":"t","tree":[')]
    found = read_trees(spark.createDataFrame(rows, "k int, body string"), ["k"])
    states = {r.k: r.tree_state for r in found.states.collect()}
    assert {k for k, s in states.items() if s == "failed"} == {3, 4, 5, 6, 7, 20, 21, 22}
    assert (states[0], states[1], states[2]) == ("complete", "truncated", "complete")
    assert sorted((r.k, r.path, r.kind, r.size) for r in found.entries.collect()) == [(0, "a/Cargo.toml", "blob", 3), (0, "d", "tree", None), (1, "a/Cargo.toml", "blob", 3)]
    marks = {r.k: r.m for r in found.states.select("k", truncated(F.col("tree_state")).alias("m")).collect()}
    assert (marks[0], marks[1], marks[22]) == (False, True, None)


def search_page(total, names, incomplete=False):
    items = [{"path": n, "repository": {"full_name": f"o/{n}", "html_url": "u", "private": n.startswith("p")}} for n in names]
    return json.dumps({"total_count": total, "incomplete_results": incomplete, "items": items})


def test_search_pages(spark):
    full = [f"n{k}" for k in range(100)]
    rows = [
        ("a", 1, search_page(120, full)), ("a", 2, search_page(150, full[:30])), ("a", 3, search_page(150, ["never"])),
        ("short", 1, search_page(9, ["x", "p"], True)), ("cut", 1, search_page(900, full)), ("cut", 2, "{"), ("gap", 1, search_page(900, full)), ("gap", 3, search_page(900, full)),
        ("empty", 1, search_page(0, [])), ("late", 2, search_page(1, ["x"])),
    ]
    captures = spark.createDataFrame(rows, "query string, page int, body string")
    found = pages.code_hits(captures, 150)
    reports = {r.query: r for r in found.report.collect()}
    assert [(reports[q].pages_read, reports[q].total, reports[q].returned, reports[q].incomplete, reports[q].bounded) for q in ("a", "short", "empty")] == [
        (2, 150, 130, False, True), (1, 9, 2, True, True), (1, 0, 0, False, False),
    ]
    assert {q: reports[q].error for q in ("cut", "gap", "late", "a")} == {"cut": "a page does not parse", "gap": "a page was not captured", "late": "a page was not captured", "a": None}
    assert all(reports[q].incomplete and reports[q].returned == 0 for q in ("cut", "gap", "late"))
    hits = found.rows.orderBy("query", "position").collect()
    assert [h.path for h in hits] == full + full[:30] + ["x", "p"] and [h.private for h in hits[-2:]] == [False, True]
    few = pages.code_hits(captures, 40)
    assert {r.query: r.pages_read for r in few.report.collect()}["gap"] == 1 and few.rows.filter("query = 'gap'").count() == 40


def listing_page(total, ids, versions=None):
    deps = [{"id": k, "version_id": v, "crate_id": "dep", "req": "^1"} for k, v in enumerate(ids)]
    return json.dumps({"dependencies": deps, "versions": versions or [{"id": v, "crate": f"c{v}", "num": "1.0.0"} for v in sorted(set(ids))], "meta": {"total": total}})


def test_listing_pages(spark):
    rows = [(1, listing_page(6, [5, 5, 4])), (2, listing_page(6, [4, 9, 2])), (3, listing_page(6, [77, 78, 79]))]
    captures = spark.createDataFrame(rows, "page int, body string")
    found = pages.listing_pages(captures, 3)
    assert [(r.name, r.position, r.page, r.listed.kind) for r in found.rows.orderBy("position").collect()] == [("c5", 0, 1, "normal"), ("c4", 1, 1, "normal"), ("c9", 2, 2, "normal"), ("c2", 3, 2, "normal")]
    assert tuple(found.report.first())[:3] == (2, 6, 4)
    few = pages.listing_pages(captures, 3, 2)
    assert [r.name for r in few.rows.orderBy("position").collect()] == ["c5", "c4"] and few.report.first().pages_read == 1
    lost = spark.createDataFrame([(1, listing_page(1, [5], [{"id": 6, "crate": "x", "num": "1"}]))], "page int, body string")
    with pytest.raises(Exception, match="no _version_key"):
        pages.listing_pages(lost, 3).rows.collect()


def test_one_file_is_put_in_place_whole(spark, tmp_path):
    target = tmp_path / "deep" / "out.txt"
    lines = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("position"), F.concat((F.lit(4999) - F.col("id")).cast("string"), F.lit("\n")).alias("text")).repartition(7)
    single_file.write_document(lines, str(target), ["position"], head="start\n", tail="end\n")
    assert target.read_text() == "start\n" + "".join(f"{k}\n" for k in range(5000)) + "end\n"
    failing = lines.withColumn("text", F.when(F.col("position") == 4000, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        single_file.write_document(failing, str(target), ["position"])
    assert target.read_text().startswith("start") and [p.name for p in target.parent.iterdir()] == ["out.txt"]
    single_file.write_document(lines.limit(0), str(target), ["position"], head="h\n", empty="none", tail="t")
    assert target.read_text() == "h\nnone"


def test_one_csv_file(spark, tmp_path):
    import csv

    path = str(tmp_path / "facts.csv")
    rows = [(k, f'a"{k}', "x,\r\ny" if k % 2 else "é") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, one string, `two,` string")
    single_file.write_csv_file(df, path, ["k"])
    with open(path, newline="") as f:
        assert list(csv.reader(f)) == [["k", "one", "two,"], *[[str(k), a, b] for k, a, b in rows]]
    single_file.write_csv_file(df.limit(0), path, ["k"])
    assert open(path).read() == 'k,one,"two,"\n'


def test_report_documents(spark, tmp_path):
    rows = [(f"o/r{k}", f"2024-01-{k % 28 + 1:02d}T00" if k % 9 else "", f"1.{k % 7}.0" if k % 4 else "x|`\n", "[]", None if k % 5 == 0 else str(k % 2)) for k in range(700)]
    names = ["github_full_name", "head_committed_at", "msrv_effective", "os_observed_targets_json", "stale"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).repartition(3)
    path = tmp_path / "report.json"
    for group in (None, "stale"):
        pieces = report.json_document(df, report.sort_keys("msrv-asc"), names, F.col(group) if group else None)
        single_file.write_document(pieces, str(path), ["group", "position"], tail="\n", empty="[]\n")
        found = json.loads(path.read_text())
        if group:
            assert [g["group"] for g in found] == ["", "0", "1"] and sum(len(g["rows"]) for g in found) == 700
            assert all(r["stale"] == g["group"] for g in found for r in g["rows"])
            assert path.read_text() == json.dumps(found, indent=2, ensure_ascii=False) + "\n"
        else:
            least = sorted(f"o/r{k}" for k in range(700) if k % 7 == 0 and k % 4)
            assert [r["github_full_name"] for r in found[: len(least)]] == least and len(found) == 700 and list(found[0]) == sorted(names)
    empty = report.json_document(df.limit(0), report.sort_keys("msrv-asc"), names, F.col("stale"))
    single_file.write_document(empty, str(path), ["group", "position"], empty="[]")
    assert path.read_text() == "[]"
    lines = report.markdown_document(df, report.sort_keys("last-commit-desc"), F.col("stale"))
    single_file.write_document(lines, str(path), ["group", "position"])
    shown = path.read_text()
    assert shown.startswith("### unknown\n\n| Repository |") and shown.count("### ") == 3 and "| x\\|\\`  |" in shown and "| - |" in shown


def test_likeness_is_the_same_in_the_jvm(spark):
    draw = random.Random(2)
    some = lambda: "".join(draw.choice("abcé𝄞_") for _ in range(draw.randrange(0, 9)))
    pairs = [(some(), some()) for _ in range(400)] + [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), ("a", None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(2)
    for r in df.select("a", "b", text.jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect():
        wanted = None if r.a is None or r.b is None else text.jaro_winkler_text(r.a, r.b)
        assert r.s == (None if wanted is None else pytest.approx(wanted, abs=1e-12)), (r.a, r.b)
    for query in ("", "abcab", "é_a𝄞"):
        for r in df.filter("b is not null").select("b", text.jaro_winkler_bound(query, F.col("b")).alias("s")).collect():
            assert r.s >= text.jaro_winkler_text(query, r.b) - 1e-12


def test_best_candidates_are_those_of_the_whole_ranking(spark):
    draw = random.Random(4)
    syllables = ["ser", "de", "to", "kio", "rust", "log", "-", "_rs", "x"]
    names = sorted({"".join(draw.choice(syllables) for _ in range(draw.randrange(1, 5))) for _ in range(300)})
    rows = [(n, f"https://github.com/o/{draw.choice(names)}" if k % 3 else None, draw.randrange(50)) for k, n in enumerate(names)]
    crates = spark.createDataFrame(rows, "name string, repository string, downloads long").repartition(3)
    for query, limit in (("rust-serde", 7), ("tokio-rs", 1), ("zzz", 5)):
        whole = resolution.top_candidates(resolution.rank_candidates(crates, query), limit).orderBy("rank").collect()
        assert resolution.best_candidates(crates, query, limit).orderBy("rank").collect() == whole


def test_search_by_index_is_search_by_scan(spark):
    from provenio.operators.catalog import catalog_index, search_index
    from provenio.plans.resolve import search

    draw = random.Random(6)
    some = lambda n: "".join(draw.choice("ab-_é ") for _ in range(draw.randrange(n)))
    rows = sorted({some(7) or "a" for _ in range(200)})
    crates = spark.createDataFrame([(n, some(9) if k % 3 else None, k % 5) for k, n in enumerate(rows)], "name string, description string, downloads int")
    terms = ["a", "ab", "A-b", "aba_b", "é ", "zz", "", " ", "b é"]
    index = catalog_index(crates)
    found = search_index(index, spark.createDataFrame([(t,) for t in terms], "term string"), 4)
    scanned = search(crates, F.array(*[F.lit(t) for t in terms]), 4)
    kept = ["term", "rank", "name"]
    assert sorted(map(tuple, found.select(kept).collect())) == sorted(map(tuple, scanned.select(kept).collect()))
    assert search_index(index, spark.createDataFrame([], "term string"), 4).count() == 0
    assert search_index(catalog_index(crates.limit(0)), spark.createDataFrame([("a",)], "term string"), 4).count() == 0


def test_table_functions(spark):
    from provenio.sources.table_functions import register_table_functions

    register_table_functions(spark)
    lock = '[[package]]\nname = "a"\nversion = "1.0.0"\ndependencies = ["b"]\n[[package]]\nname = "b"\nversion = "2.0.0"\n'
    texts = spark.createDataFrame([(1, lock), (2, "["), (3, None)], "k int, text string")
    found = spark.sql("SELECT k, p.name, p.version FROM {t}, LATERAL lock_packages(text) p ORDER BY name", t=texts).collect()
    assert [tuple(r) for r in found] == [(1, "a", "1.0.0"), (1, "b", "2.0.0")]
    assert [tuple(r) for r in spark.sql("SELECT e.* FROM {t}, LATERAL lock_edges(text) e", t=texts).collect()] == [(0, 1)]
    notes = spark.sql("SELECT k, d.code FROM {t}, LATERAL manifest_diagnostics(text) d ORDER BY k", t=texts).collect()
    assert [tuple(r) for r in notes] == [(2, "manifest_parse_error")]
    with pytest.raises(Exception, match="a text is wanted"):
        spark.sql("SELECT * FROM lock_edges(3)").collect()
