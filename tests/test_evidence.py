"""Joins, parsers, graphs and the scan on small fixtures."""

import pytest
from pyspark.sql import functions as F

from provenio.operators import joins
from provenio.operators.graph import lock_relations
from provenio.operators.manifests import analyze_manifests, effective_msrv
from provenio.plans import report, scan
from provenio.plans.options import ScanOptions, bounded_int, exit_code
from provenio.sources import documents, index, sinks
from provenio.sources.documents import parse_lock, parse_manifest


def test_strict_join_does_not_lose_rows(spark):
    left = spark.createDataFrame([(1, 10), (2, 10)], "id int, key int")
    one = spark.createDataFrame([(10, "x")], "k int, v string")
    assert joins.strict_join(left, one, "key", "k").count() == 2
    with pytest.raises(Exception, match="no k for key"):
        joins.strict_join(left, one.limit(0), "key", "k").count()
    with pytest.raises(Exception, match="more than one k"):
        joins.strict_join(left, one.unionByName(one), "key", "k").count()
    named = left.select("id", F.col("key").alias("_key"))
    found = joins.strict_join(named, one.select(F.col("k").alias("_n"), F.col("v").alias("_there")), "_key", "_n")
    assert found.columns == ["id", "_key", "_n", "_there"] and sorted(map(tuple, found.collect())) == [(1, 10, 10, "x"), (2, 10, 10, "x")]


def relation(spark, edges, nodes, targets):
    n = spark.createDataFrame([(0, x, x in targets) for x in nodes], "scope int, node string, target boolean")
    e = spark.createDataFrame([(0, a, b) for a, b in edges], "scope int, src string, dst string")
    row = lock_relations(n, e, "scope").first()
    return row.relation, row.depth


def test_lock_relations(spark):
    assert relation(spark, [("r", "t")], "rt", "t") == ("direct", 1)
    assert relation(spark, [("r", "b"), ("b", "t")], "rbt", "t") == ("transitive", 2)
    assert relation(spark, [("r", "b"), ("r", "t"), ("b", "t")], "rbt", "t") == ("both", 1)
    assert relation(spark, [("r", "b")], "rbt", "t") == ("unclassified", 0)
    assert relation(spark, [("r", "b")], "rb", "") == ("not_recorded", None)
    assert relation(spark, [("r", "b"), ("b", "c"), ("c", "b"), ("c", "t")], "rbct", "t") == ("transitive", 3)


def test_manifest_inheritance(spark):
    root = '[workspace]\n[workspace.package]\nrust-version = "1.70.0"\n[workspace.dependencies]\ndep = { version = "=1.2.3", optional = true }\nunused = "1"\n'
    member = '[package]\nname = "m"\nrust-version.workspace = true\n[dependencies]\ndep.workspace = true\nother = { package = "dep", version = "^1" }\n[target."cfg(target_os = \\"linux\\")".dev-dependencies]\ndep = { workspace = true, optional = false }\n[build_dependencies]\nlost.workspace = true\n'
    files = spark.createDataFrame([("r", "Cargo.toml", root), ("r", "m/Cargo.toml", member), ("r", "bad/Cargo.toml", "[")], "scope string, path string, text string")
    found = analyze_manifests(files, "scope", "dep", "1.2.3")
    rows = {(r.alias, r.kind): r for r in found.declarations.collect()}
    assert len(rows) == 3
    assert rows["dep", "normal"].optional and rows["dep", "normal"].requirement.exact_pin
    assert rows["dep", "development"].optional is False and rows["dep", "development"].inherited
    assert rows["other", "normal"].requirement.accepts and not rows["other", "normal"].requirement.exact_pin
    assert {r.code for r in found.diagnostics.collect()} == {"manifest_parse_error", "workspace_dependency_unresolved"}
    assert effective_msrv(found.msrv, "scope").first()[1:] == ("1.70.0", "workspace_inherited")


def test_nearest_root_of_several(spark):
    members = spark.createDataFrame([("a/b/x/Cargo.toml", None), ("a/y/Cargo.toml", None), ("z/Cargo.toml", None), ("z/q/Cargo.toml", "a/Cargo.toml"), ("z/r/Cargo.toml", "none/Cargo.toml")], "path string, workspace string")
    roots = spark.createDataFrame([("a/Cargo.toml", 0), ("a/b/Cargo.toml", 1)], "root_path string, root_position int")
    found = {r.path: r.root_path for r in joins.nearest_root(members, roots).collect()}
    assert found == {"a/b/x/Cargo.toml": "a/b/Cargo.toml", "a/y/Cargo.toml": "a/Cargo.toml", "z/Cargo.toml": None, "z/q/Cargo.toml": "a/Cargo.toml", "z/r/Cargo.toml": None}


def test_texts_that_do_not_parse():
    assert parse_lock("[")["error"] and parse_lock(None)["packages"] == []
    missing = parse_lock('[[package]]\nname = "a"\nversion = "1.0.0"\ndependencies = ["gone"]\n')
    assert missing["error"] is None and not missing["buildable"]
    bad = parse_manifest('[dependencies]\na = 1\nb = { version = 2 }\n')
    assert [d["code"] for d in bad["diagnostics"]] == ["invalid_dependency_declaration", "invalid_dependency_field"]
    assert [d["alias"] for d in bad["declarations"]] == ["b"]


def test_index_lines_stop_at_the_match(spark):
    line = '{"name":"x","vers":"1.0.0","deps":[{"name":"d","package":"My-Dep","req":"^1"}]}'
    bodies = [(1, line + "\n{broken"), (2, "{broken\n" + line), (3, "\n\n"), (4, line.replace("My-Dep", "other"))]
    files = spark.createDataFrame([(i, "1.0.0", b) for i, b in bodies], "i int, v string, body string")
    found = {r.i: (r.declarations, r.error) for r in index.index_declarations(files, ["i"], "v", "my_dep").collect()}
    assert found[1][0][0].kind == "normal" and found[1][1] is None
    assert found[2] == (None, "malformed line") and found[3] == (None, "no such release")
    assert found[4][1] == "release does not depend on the package"


LOCK_A = '[[package]]\nname = "root"\nversion = "0.1.0"\ndependencies = ["bridge"]\n[[package]]\nname = "bridge"\nversion = "0.1.0"\ndependencies = ["dep"]\n[[package]]\nname = "dep"\nversion = "1.2.3"\nsource = "registry+https://github.com/rust-lang/crates.io-index"\n'
LOCK_B = '[[package]]\nname = "dep"\nversion = "1.2.3"\n'


def test_scan_of_two_candidates_in_one_repository(spark):
    declaration = "struct<alias: string, requirement: string, kind: string, optional: boolean, target: string, registry: string, accepts: boolean, exact_pin: boolean>"
    given = [("dep", "=1.2.3", "normal", False, None, None, True, True)]
    candidates = spark.createDataFrame(
        [("one", "0.1.0", "https://github.com/o/r", 0, False, given, None, "registry"), ("two", "0.2.0", "https://github.com/o/alias", 1, False, given, None, "registry"), ("three", "1.0.0", None, 2, False, given, None, "registry"), ("four", "1.0.0", "o/r", 3, True, given, None, "registry")],
        f"name string, version string, repository string, position int, yanked boolean, declarations array<{declaration}>, enrichment_error string, source string",
    )
    repo = (7, "o/r", "https://github.com/o/r", "main", False, False, False, False, None, "abc", "def", None, False)
    fields = "key string, repo_id long, full_name string, html_url string, default_branch string, fork boolean, archived boolean, disabled boolean, private boolean, pushed_at timestamp, head_sha string, tree_sha string, committed_at timestamp, truncated boolean"
    repositories = spark.createDataFrame([("github:o/r", *repo), ("github:o/alias", *repo)], fields).withColumn("committed_at", F.lit("2025-01-01").cast("timestamp"))
    manifest = '[package]\nname = "m"\nrust-version = "1.80.0"\n[dependencies]\nrenamed = { package = "dep", version = "=1.2.3" }\n'
    tree = spark.createDataFrame(
        [(7, "Cargo.toml", len(manifest), "100644", manifest, "m", True), (7, "a/Cargo.lock", len(LOCK_A), "100644", LOCK_A, "la", True), (7, "b/Cargo.lock", len(LOCK_B), "100644", LOCK_B, "lb", True)],
        "repo_id long, path string, size long, mode string, text string, sha string, fetched boolean",
    )
    options = ScanOptions(query="dep", version="1.2.3", observed_at="2025-06-01 00:00:00")
    done = scan.scan(candidates, repositories, tree, options, "dep")
    facts = done.facts
    assert facts.columns == scan.FACT_COLUMNS
    rows = {r.cargo_lock_path or r.error_code: r for r in facts.collect()}
    assert set(rows) == {"a/Cargo.lock", "b/Cargo.lock", "unsupported_repository"}
    a, b = rows["a/Cargo.lock"], rows["b/Cargo.lock"]
    assert (a.recorded_relation, a.shortest_dependency_depth, a.exact_crates_io_occurrence_count) == ("recorded_transitive", "2", "1")
    assert (b.recorded_relation, b.shortest_dependency_depth) == ("recorded_present_unclassified", "0")
    assert a.dependent_crates_json == '["one","two"]' and a.any_exact_pin == "true" and a.msrv_effective == "1.80.0"
    assert a.current_direct_status == "present" and a.stale == "false" and a.os_has_unconditional_declaration == "true"
    total = done.summary.first()
    assert len(done.summary.columns) == 36
    assert (total.output_rows, total.repositories_scanned, total.lockfiles_parsed, total.exact_occurrences, total.repositories_exact_confirmed) == (3, 1, 2, 2, 1)
    assert (total.candidate_release_records, total.candidate_crates, total.candidate_repositories, total.repositories_unsupported) == (3, 3, 3, 1)
    # a target that is its own root is unclassified, and the graph is complete all the same
    assert (b.evidence_completeness, b.inventory_status, b.error_code, b.error_message) == ("complete", "complete", "", "")
    assert rows["unsupported_repository"].error_message
    assert a.resolved_target_sources_json == '[{"version":"1.2.3","source":"registry+https://github.com/rust-lang/crates.io-index","is_crates_io":true}]'
    assert '"dependency_package":"dep"' in a.published_requirements_json and a.published_requirements_json.count("enrichment_error") == 2
    assert [r.cargo_lock_path for r in facts.collect()] == ["", "a/Cargo.lock", "b/Cargo.lock"]


def test_scan_with_seeds_and_broken_files(spark):
    declaration = "struct<alias: string, requirement: string, kind: string, optional: boolean, target: string, registry: string, accepts: boolean, exact_pin: boolean>"
    candidates = spark.createDataFrame([], f"name string, version string, repository string, position int, yanked boolean, declarations array<{declaration}>, enrichment_error string, source string")
    hits = spark.createDataFrame(
        [("lock", "x/Cargo.lock", "O/R", "https://github.com/O/R", False), ("lock", "not-Cargo.lock", "o/z", "u", False), ("manifest", "Cargo.toml", "o/r", "https://github.com/o/r", False), ("lock", "Cargo.lock", "o/p", "u", True), ("lock", "Cargo.lock", "odd", "u", False)],
        "query string, path string, full_name string, html_url string, private boolean",
    )
    fields = "key string, repo_id long, full_name string, html_url string, default_branch string, fork boolean, archived boolean, disabled boolean, private boolean, pushed_at timestamp, head_sha string, tree_sha string, committed_at timestamp, truncated boolean"
    repositories = spark.createDataFrame([("github:o/r", 7, "o/r", "https://github.com/o/r", "main", False, False, False, False, None, "abc", "def", None, True)], fields).withColumn("committed_at", F.lit("2025-01-01").cast("timestamp"))
    missing = '[[package]]\nname = "root"\nversion = "1.0.0"\ndependencies = ["gone"]\n[[package]]\nname = "dep"\nversion = "1.2.3"\n'
    tree = spark.createDataFrame(
        [(7, "Cargo.toml", 1, "100644", "[", "m", True), (7, "a/Cargo.lock", len(missing), "100644", missing, "la", True), (7, "b/Cargo.lock", 3, "120000", "x", "lb", True), (7, "c/Cargo.lock", 3, "100644", None, "lc", False), (7, "d/Cargo.lock", 3, "100644", "[", "ld", True)],
        "repo_id long, path string, size long, mode string, text string, sha string, fetched boolean",
    )
    options = ScanOptions(query="=dep", version="1.2.3", observed_at="2025-06-01 00:00:00", discovery="code")
    done = scan.scan(candidates, repositories, tree, options, "dep", hits, search_total=9)
    rows = {r.cargo_lock_path: r for r in done.facts.collect()}
    assert {k: r.lock_status for k, r in rows.items()} == {"a/Cargo.lock": "parsed", "b/Cargo.lock": "symlink_not_followed", "c/Cargo.lock": "fetch_failed", "d/Cargo.lock": "parse_failed"}
    a = rows["a/Cargo.lock"]
    assert a.error_code == "tree_truncated;manifest_inventory_partial;lock_graph_unclassified" and a.error_message.count(" | ") == 2
    assert (a.evidence_completeness, a.inventory_status, a.msrv_source, a.msrv_effective, a.os_has_unconditional_declaration) == ("partial", "partial", "unknown", "unknown", "unknown")
    assert (a.published_direct_status, a.any_requirement_accepts, a.optional_declarations) == ("not_observed", "unknown", "unknown")
    assert a.candidate_sources_json == '["code_search_lock_seed","code_search_manifest_seed"]' and a.input_query == "'=dep"
    total = done.summary.first()
    assert (total.partial, total.code_search_incomplete, total.code_search_results_returned, total.code_search_private_results_discarded) == (True, True, 5, 1)
    assert (total.lockfiles_found, total.lockfiles_parsed, total.repositories_partial, total.repositories_exact_confirmed, len(total.notes)) == (4, 1, 1, 0, 4)


def test_options_and_exit_codes():
    assert [exit_code(p, a, n, r) for p, a, n, r in [(True, False, True, True), (True, True, True, True), (False, False, True, False), (False, False, False, True)]] == [4, 3, 0, 0]
    assert bounded_int("64", "jobs") == 64
    with pytest.raises(ValueError):
        bounded_int("65", "jobs")


def test_files_are_replaced_whole(spark, tmp_path):
    target = tmp_path / "deep" / "out.json"
    sinks.write_json(str(target), {"a": None})
    assert target.read_text() == '{\n  "a": null\n}\n'
    with pytest.raises(RuntimeError):
        sinks.replace_file(str(target), (x for x in iter_and_fail()))
    assert target.read_text() == '{\n  "a": null\n}\n' and len(list(target.parent.iterdir())) == 1
    assert sinks.paths_conflict("a/../b", "./b") and not sinks.paths_conflict("-", "-")
    df = spark.createDataFrame([('x"y\nz', "")], "a string, b string")
    sinks.write_facts(df, str(tmp_path / "facts"))
    assert tuple(sinks.read_inventory(spark, str(tmp_path / "facts")).first()) == ('x"y\nz', "")


def iter_and_fail():
    yield "part"
    raise RuntimeError("stop")


def test_report_positions_without_one_task(spark):
    rows = [(f"o/r{k}", f"2024-01-{k % 28 + 1:02d}" if k % 9 else None, None if k % 5 == 0 else str(k % 2)) for k in range(3000)]
    df = spark.createDataFrame(rows, "github_full_name string, head_committed_at string, stale string").repartition(4)
    last = lambda r: tuple(-ord(c) for c in r[1] or "")
    in_order = lambda some: sorted(some, key=lambda r: (r[1] is None, last(r), r[0]))
    for group in (None, F.col("stale")):
        found = report.ranked(df, report.sort_keys("last-commit-desc"), group).collect()
        assert len(found) == len(rows)
        for label in {r.group for r in found}:
            mine = sorted([r for r in found if r.group == label], key=lambda r: r.position)
            assert [r.position for r in mine] == list(range(1, len(mine) + 1))
            wanted = in_order([r for r in rows if group is None or r[2] == label])
            assert [r.github_full_name for r in mine] == [r[0] for r in wanted]
    plan = report.ranked(df, report.sort_keys("last-commit-desc"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan, "rows are sorted in ranges, not as one group"
    assert report.ranked(df.limit(0), report.sort_keys("last-commit-desc")).count() == 0


def captures(spark, repositories=(), total=None):
    from provenio.plans.resolve import Captures

    crates = [
        ("serde", "1.0.0", "https://github.com/serde-rs/serde", 900), ("serde_derive", "1.0.0", "https://github.com/serde-rs/serde", 800),
        ("My-Tool", "0.3.0", "https://github.com/o/my-tool", 5), ("hidden-name", "0.1.0", "https://github.com/o/boxes", 7), ("boxed", "0.1.0", "https://github.com/else/boxes", 9),
        ("tokio", "1.0.0", None, 700), ("tokio-util", "0.7.0", None, 600),
    ]
    schema = "name string, max_version string, repository string, downloads long"
    catalog = spark.createDataFrame(crates, schema).withColumn("homepage", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    manifest = '[package]\nname = "hidden-name"\n'
    files = [("crate/Cargo.toml", "100644", None, manifest), ("link/Cargo.toml", "120000", None, '[package]\nname = "serde"\n'), ("big/Cargo.toml", "100644", 600 << 10, '[package]\nname = "tokio"\n')]
    rows = [(full, full.split("/")[1], private, files, False) for full, private in repositories]
    held = spark.createDataFrame(rows, "full_name string, name string, private boolean, manifests array<struct<path: string, mode: string, size: long, text: string>>, truncated boolean")
    return Captures(catalog, held, total)


def test_resolution(spark):
    from provenio.plans import resolve

    plain = captures(spark)
    row = resolve.resolve(plain, " my_tool ").first()
    assert (row.resolution_method, row.selected.name, row.requires_selection, row.alternatives) == ("exact_crate", "My-Tool", False, [])
    assert resolve.resolve(plain, "anything", explicit="SERDE").first().selected.match_reason == "explicit_crate"
    with pytest.raises(LookupError):
        resolve.resolve(plain, "x", explicit="absent")
    with pytest.raises(ValueError):
        resolve.resolve(plain, "  ")
    with pytest.raises(ValueError):
        resolve.resolve(plain, "https://u:p@github.com/a/b")
    serde = captures(spark, [("serde-rs/serde", False)])
    row = resolve.resolve(serde, "https://github.com/serde-rs/serde").first()
    assert (row.resolution_method, row.selected, [c.name for c in row.alternatives]) == ("repository_metadata_ambiguous", None, ["serde", "serde_derive"])
    assert all(c.score == 1.0 and c.match_reason == "repository_url" for c in row.alternatives)
    boxes = captures(spark, [("o/boxes", False), ("p/boxes", True)])
    row = resolve.resolve(boxes, "Boxes").first()
    assert (row.resolution_method, row.selected.name, row.requires_selection) == ("repository_name_metadata", "hidden-name", False)
    assert any("manifests" in note for note in row.diagnostics)
    with pytest.raises(PermissionError):
        resolve.resolve(boxes, "p/boxes")
    cut = resolve.resolve(captures(spark, [("o/boxes", False)], total=50), "boxes").first()
    assert cut.resolution_method == "ranked_suggestions" and len(cut.diagnostics) == 2 and cut.alternatives[0].name == "boxed"
    taken = resolve.resolve(plain, "my-toll", accept_closest=True).first()
    left = resolve.resolve(plain, "my-toll").first()
    assert left.selected is None and left.requires_selection and left.resolution_method == "ranked_suggestions"
    assert taken.selected is None or taken.resolution_method == "accepted_closest"


def test_ranking_reasons_and_the_clear_winner(spark):
    from provenio.operators.resolution import clear_winner, rank_candidates, top_candidates

    rows = [("rust-thing", None, 5), ("thing", "https://github.com/a/thing", 1), ("thing-rs", None, 9), ("far", "https://github.com/b/thingy", 3)]
    crates = spark.createDataFrame(rows, "name string, repository string, downloads long")
    found = {r.name: (r.match_reason, r.score) for r in rank_candidates(crates, "thing-rs").collect()}
    assert found["thing-rs"] == ("canonical_name", 1.0) and found["thing"] == ("repository_affix_normalization", 0.98)
    assert found["far"][0] == "repository_name_similarity" and found["far"][1] < 0.97
    same = {r.name: r.match_reason for r in rank_candidates(crates, "x", "B/Thingy").collect()}
    assert same["far"] == "repository_url"
    top = top_candidates(rank_candidates(crates, "thing-rs"), 3)
    assert [r.name for r in top.orderBy("rank").collect()][:2] == ["thing-rs", "thing"]
    assert clear_winner(top).first().selected is False
    scores = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.84)], "name string, rank int, score double")
    assert clear_winner(scores).first().selected and not clear_winner(scores.filter("rank = 2").withColumn("rank", F.lit(1))).first().selected


def test_index_fallback_and_first_rows(spark):
    candidates = spark.createDataFrame([("a", "1.0.0", 0), ("b", "1.0.0", 1), ("c", "1.0.0", 2)], "name string, version string, position int")
    declared = spark.createDataFrame(
        [("a", "1.0.0", [("x", "^1")], None), ("b", "1.0.0", None, "no such release")],
        "name string, version string, declarations array<struct<alias: string, requirement: string>>, error string",
    )
    spare = F.struct(F.lit("x").alias("alias"), F.lit("*").alias("requirement"))
    found = {r.name: r for r in index.with_fallback(candidates, declared, ["name", "version"], spare).collect()}
    assert {k: r.enrichment_error for k, r in found.items()} == {"a": None, "b": "no such release", "c": "no index file"}
    assert {k: [tuple(d) for d in r.declarations] for k, r in found.items()} == {"a": [("x", "^1")], "b": [("x", "*")], "c": [("x", "*")]}

    pages = spark.createDataFrame([(0, 2, 0, 7), (0, 1, 0, 7), (0, 1, 1, 8), (0, 1, 2, 9), (1, 1, 0, 7)], "scope int, page int, position int, version_id int")
    first = index.first_rows(pages, ["scope"])
    assert sorted(map(tuple, first.collect())) == [(0, 1, 0, 7), (0, 1, 1, 8), (0, 1, 2, 9), (1, 1, 0, 7)]
    assert {r.version_id for r in index.first_rows(pages.filter("scope = 0"), ["scope"], 2).collect()} == {7, 8}
    assert index.first_rows(pages.limit(0), ["scope"]).count() == 0


def test_next_page_and_excerpts(spark):
    from provenio.functions.text import excerpt
    from provenio.operators.selection import has_next_page

    pages = spark.createDataFrame([(100, 100, 250), (100, 250, 250), (50, 250, 300)], "n int, seen int, total int")
    more = pages.select("seen", "n", has_next_page(F.col("n"), F.col("seen"), F.col("total"), 100).alias("more"))
    assert [r.more for r in more.collect()] == [True, False, False]
    texts = spark.createDataFrame([("short",), ("x" * 513,), ("é" * 512,), (None,)], "t string")
    assert [r[0] for r in texts.select(excerpt(F.col("t"))).collect()] == ["short", "x" * 512 + "…", "é" * 512, None]


def test_lockfiles_in_the_tools_own_form_are_read_without_the_toml_parser(monkeypatch):
    """The plain form gives what the TOML parser gives; anything else still goes through it."""
    head, block = "# made by a tool\nversion = 3\n\n", '[[package]]\nname = "{}"\nversion = "{}"\n'
    plain = [
        head + block.format("a", "1.0.0") + 'source = "registry+x"\nchecksum = "00"\ndependencies = [\n "b 2.0.0",\n "c",\n]\n\n' + block.format("b", "1.0.0") + "\n" + block.format("b", "2.0.0") + block.format("c", "1.0.0") + "dependencies = []\n",
        block.format("a", "1.0.0") + 'dependencies = ["gone", "a"]\n',
    ]
    other = [block.format("a", "1.0.0") + more for more in ('name = "b"\n', "[metadata]\n", 'source = "a\\"b"\n', "[", "[root]\nname = 'r'\nversion = '1'\n")] + ["version = 03\n" + plain[1], "", None]
    found = [parse_lock(t) for t in plain + other]
    with monkeypatch.context() as patch:
        patch.setattr(documents, "_written_by_tool", lambda text: None)
        assert found == [parse_lock(t) for t in plain + other]
    assert [e["dst"] for e in found[0]["edges"]] == [2, 3] and found[0]["buildable"] and not found[1]["buildable"]
    monkeypatch.setattr(documents.tomllib, "loads", None)
    assert [parse_lock(t) for t in plain] == found[:2]


def test_lockfiles_as_columns(spark):
    texts = [(1, '[[package]]\nname = "a"\nversion = "1"\ndependencies = ["b"]\n[[package]]\nname = "b"\nversion = "2"\nsource = "s"\n'), (2, "["), (3, None)]
    rows = documents.lockfiles(spark.createDataFrame(texts, "id long, text string"), ["id"]).orderBy("id").collect()
    assert [tuple(p) for p in rows[0].packages] == [(0, "a", "1", None), (1, "b", "2", "s")] and [tuple(e) for e in rows[0].edges] == [(0, 1)]
    assert (rows[0].buildable, rows[0].error, rows[1].buildable, rows[1].packages, rows[2].packages, rows[2].buildable) == (True, None, False, [], [], True)
    assert rows[1].error.startswith("lockfile does not parse: ")


def test_an_index_file_is_one_row_from_end_to_end(spark):
    """No line is shuffled or parsed after the one that decides."""
    files = spark.createDataFrame([(1, "1", '\n{"vers":"0"}\n{"vers":"1","deps":[]}\n{cut'), (2, "1", '{cut\n{"vers":"1"}'), (3, "1", ""), (4, "1", None)], "id int, v string, body string")
    lines = index.release_lines(files, ["id"], "v")
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.line and r.line.vers, r.error) for r in lines.orderBy("id").collect()] == [
        (1, "1", None), (2, None, "malformed line"), (3, None, "no such release"), (4, None, "no such release"),
    ]
