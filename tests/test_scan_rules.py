"""The scan's rules case by case: aliases, failed captures, limits, budgets, texts that are no texts, index lookups."""

import json

import pytest
from pyspark.sql import functions as F

from provenio.operators.evidence import evaluated, judgements, merged_evidence, ordered_declarations
from provenio.plans import scan, scan_queries
from provenio.plans.options import ScanOptions

DECLARATION = "struct<alias: string, requirement: string, kind: string, optional: boolean, target: string, registry: string>"
CANDIDATE = f"name string, version string, repository string, position int, yanked boolean, declarations array<{DECLARATION}>, enrichment_error string, source string"
REPOSITORY = (
    "key string, repo_id long, private boolean, full_name string, html_url string, default_branch string, fork boolean, archived boolean, disabled boolean, "
    "pushed_at timestamp, head_sha string, tree_sha string, committed_at string, truncated boolean"
)
TREE = "repo_id long, path string, size long, mode string, kind string, sha string, text string, fetched boolean"
LOCK = '[[package]]\nname = "root"\nversion = "0.1.0"\ndependencies = ["dep"]\n[[package]]\nname = "dep"\nversion = "1.2.3"\n'


def options(**more):
    return ScanOptions(query="dep", version="1.2.3", observed_at="2025-06-01 00:00:00", **more)


def candidates(spark, rows):
    """Rows of (name, repository, requirement, optional) or with an error."""
    made = [
        (name, "1.0.0", repository, k, False, [("dep", requirement, "normal", optional, None, None)] if requirement else [], more[0] if more else None, "registry")
        for k, (name, repository, requirement, optional, *more) in enumerate(rows)
    ]
    return spark.createDataFrame(made, CANDIDATE)


def repository(key, repo_id, name=None, private=False, fork=False, archived=False, head="h", tree="t", truncated=False, branch="main", day="2025-05-01"):
    name = name or key
    return (f"github:{key}", repo_id, private, name, f"https://github.com/{name}", branch, fork, archived, False, None, head, tree, f"{day} 00:00:00" if head else None, truncated)


def repositories(spark, *rows):
    return spark.createDataFrame(list(rows), REPOSITORY).withColumn("committed_at", F.col("committed_at").cast("timestamp"))


def files(spark, *rows):
    return spark.createDataFrame([(i, p, s, m, "blob", "s", t, f) for i, p, s, m, t, f in rows], TREE)


def url(name):
    return f"https://github.com/{name}"


def test_aliases_are_added_up_before_they_are_judged(spark):
    rows = [("one", url("o/r"), "^2", True), ("two", url("o/alias"), "=1.2.3", False), ("two", url("o/alias"), "=1.2.3", False), ("three", url("o/x"), "not one", False)]
    groups = scan.candidate_groups(evaluated(candidates(spark, rows), "dep", "1.2.3"))
    alone = {r.key: r for r in groups.select("key", *[c.alias(k) for k, c in judgements().items()]).collect()}
    assert tuple(alone["github:o/r"])[1:] == ("false", "false", "all")
    assert tuple(alone["github:o/x"])[1:] == ("unknown", "unknown", "none")
    together = merged_evidence(groups.filter("key <> 'github:o/x'").withColumn("identity", F.lit(7)), ["identity"])
    row = together.select("*", *[c.alias(f"j_{k}") for k, c in judgements().items()], ordered_declarations(F.col("declarations")).alias("cells")).first()
    assert (row.j_any_requirement_accepts, row.j_any_exact_pin, row.j_optional_declarations) == ("true", "true", "mixed")
    # equal declarations all stay, in the order of their fields
    assert [(c.dependent_crate, c.requirement) for c in row.cells] == [("one", "^2"), ("two", "=1.2.3"), ("two", "=1.2.3")]
    assert (row.releases, row.hint, row.urls) == (3, "o/r", [url("o/alias"), url("o/r")])

    known = repositories(spark, repository("o/r", 7, "o/new"), repository("o/alias", 7, "o/new"))
    done = scan.scan(candidates(spark, rows), known, files(spark, (7, "Cargo.lock", 5, "100644", LOCK, True)), options(), "dep")
    facts = {r.github_full_name: r for r in done.facts.collect()}
    assert set(facts) == {"o/new", "o/x"}
    assert (facts["o/new"].any_requirement_accepts, facts["o/new"].any_exact_pin, facts["o/new"].optional_declarations) == ("true", "true", "mixed")
    assert (facts["o/x"].error_code, facts["o/x"].lock_status, facts["o/x"].repository_url) == ("repository_resolution_failed", "not_scanned", url("o/x"))
    total = done.summary.first()
    assert (total.repositories_failed, total.candidate_repositories, total.repositories_scanned) == (1, 3, 1)


def test_what_could_not_be_captured_is_not_absent(spark):
    names = ["a/headless", "a/branchless", "a/treeless", "a/cut", "a/empty", "a/archived", "a/fork", "a/old", "a/alias"]
    rows = [(n, url(n), "^1", False) for n in names] + [("nowhere", None, "^1", False), ("odd", "https://example.org/x", "^1", False)]
    known = repositories(
        spark, repository("a/headless", 1, head=None, tree=None), repository("a/alias", 1, "a/headless", head=None, tree=None), repository("a/branchless", 2, branch=""),
        repository("a/treeless", 3, truncated=None), repository("a/cut", 4, truncated=True), repository("a/empty", 5), repository("a/archived", 6, archived=True),
        repository("a/fork", 8, fork=True), repository("a/old", 9, day="2020-01-01"),
    )
    done = scan.scan(candidates(spark, rows), known, files(spark, (4, "x/Cargo.toml", 1, "100644", "", True)).limit(0), options(since="2025-01-01"), "dep")
    facts = {r.github_full_name or r.repository_url: r for r in done.facts.collect()}
    assert set(facts) == {"a/headless", "a/branchless", "a/treeless", "a/cut", "a/empty", "a/archived", "", "https://example.org/x"}
    headless = facts["a/headless"]
    assert (headless.error_code, headless.github_repository_id, headless.default_branch, headless.archived, headless.head_sha, headless.stale) == (
        "default_branch_head_failed", "1", "main", "false", "", "unknown",
    )
    treeless = facts["a/treeless"]
    assert (treeless.error_code, treeless.inventory_status, treeless.lock_status, treeless.head_sha, treeless.stale, treeless.tree_truncated) == (
        "tree_fetch_failed", "failed", "not_scanned", "h", "false", "unknown",
    )
    assert (facts["a/cut"].lock_status, facts["a/cut"].exact_resolution_status, facts["a/cut"].current_direct_status) == ("unknown_truncated", "unknown", "unknown")
    assert (facts["a/empty"].lock_status, facts["a/empty"].exact_resolution_status, facts["a/empty"].evidence_completeness) == ("not_found", "not_observed", "complete")
    assert facts["a/archived"].archived == "true" and facts[""].lock_status == "not_scanned"
    total = done.summary.first()
    assert (total.repositories_failed, total.repositories_scanned, total.repositories_filtered_as_forks, total.repositories_filtered_by_activity, total.repositories_unsupported) == (3, 3, 1, 1, 2)
    left = scan.scan(candidates(spark, rows), known, files(spark, (4, "x", 1, "1", "", True)).limit(0), options(exclude_archived=True), "dep").summary.first()
    assert (left.repositories_filtered_as_archived, left.repositories_filtered_by_activity) == (1, 0)


def test_bounded_lookups(spark):
    rows = [(f"n{k}", url(f"o/r{k:02d}"), "^1", False) for k in range(12)]
    there = [repository(f"o/r{k:02d}", k, private=k in (0, 1)) for k in range(12) if k != 2]
    tree = files(spark, (3, "Cargo.lock", 1, "100644", LOCK, True))
    run = lambda **more: scan.scan(candidates(spark, rows), repositories(spark, *there), tree, options(jobs=2, **more), "dep")
    # two private ones, a failure and the first public one, in batches of two
    one = run(max_repositories=1)
    total = one.summary.first()
    assert (total.repositories_scanned, total.repositories_filtered_as_private, total.repositories_failed, total.repository_limit_reached) == (1, 2, 1, True)
    assert not total.repository_resolution_budget_exhausted
    assert sorted(r.github_full_name for r in one.facts.collect()) == ["o/r02", "o/r03"]
    none = scan.scan(candidates(spark, rows), repositories(spark, *[repository(f"o/r{k:02d}", k, private=True) for k in range(12)]), tree, options(jobs=2, max_repositories=1), "dep")
    total = none.summary.first()
    assert (total.repositories_scanned, total.repositories_filtered_as_private, total.repository_resolution_budget_exhausted, total.partial, len(total.notes)) == (0, 4, True, True, 4)
    whole = run(max_repositories=50).summary.first()
    assert (whole.repositories_scanned, whole.repository_limit_reached, whole.repository_resolution_budget_exhausted) == (9, False, False)


def test_budgets_caps_and_texts(spark):
    rows = [("a", url("o/a"), "^1", False), ("b", url("o/b"), "^1", False)]
    known = repositories(spark, repository("o/a", 1), repository("o/b", 2))
    broken = '[[package]]\nname = "dep"\nversion = "1.2.3"\ndependencies = ["gone"]\n'
    tree = spark.createDataFrame(
        [(1, "Cargo.toml", 4, "100644", "blob", "m", b"\xff\xfe[[", True), (1, "a/Cargo.lock", None, "100644", "blob", "x", b"\xff", True),
         (1, "b/Cargo.lock", len(broken), "100644", "blob", "y", broken.encode(), True), (1, "c/Cargo.lock", 7, "100644", "tree", "z", None, False),
         (2, "a/Cargo.lock", 900, "100644", "blob", "x", b"", False), (2, "b/Cargo.lock", 90, "100644", "blob", "x", LOCK.encode(), True), (2, "Cargo.toml", 10, "100644", "blob", "m", b"", True)],
        TREE.replace("text string", "text binary"),
    )
    done = scan.scan(candidates(spark, rows), known, tree, options(max_file_bytes=400, byte_budget=300), "dep")
    facts = {(r.github_full_name, r.cargo_lock_path): r for r in done.facts.collect()}
    assert {k: r.lock_status for k, r in facts.items()} == {
        ("o/a", "a/Cargo.lock"): "non_utf8", ("o/a", "b/Cargo.lock"): "parsed", ("o/b", "a/Cargo.lock"): "too_large", ("o/b", "b/Cargo.lock"): "parsed",
    }
    b = facts["o/a", "b/Cargo.lock"]
    # an unknown size reserves what a file may have: nothing is left for the manifest
    assert b.error_code == "manifest_inventory_partial;lock_graph_unclassified" and b.error_message.startswith("Cargo.toml: did not fit the byte budget | a package depends")
    assert (b.recorded_relation, b.current_direct_status, b.msrv_source) == ("recorded_present_unclassified", "unknown", "unknown")
    good = facts["o/b", "b/Cargo.lock"]
    assert (good.recorded_relation, good.evidence_completeness, good.repository_matched_cargo_file_count) == ("recorded_direct", "complete", "3")
    total = done.summary.first()
    assert (total.repositories_byte_budget_exceeded, total.repositories_partial, total.lockfiles_found, total.lockfiles_parsed, total.repositories_exact_confirmed) == (1, 2, 4, 2, 1)


def test_index_lookups_inside_the_scan(spark):
    listing = spark.createDataFrame(
        [("ab", "1.0.0", url("o/a"), 0, False, "registry", ("^9", "dev", True, None)), ("ab", "2.0.0", url("o/a"), 1, False, "registry", ("^9", "dev", True, None)),
         ("no name", "1.0.0", url("o/c"), 2, False, "registry", ("^1", "normal", None, "cfg(unix)"))],
        "name string, version string, repository string, position int, yanked boolean, source string, listed struct<requirement: string, kind: string, optional: boolean, target: string>",
    )
    line = json.dumps({"name": "ab", "vers": "1.0.0", "deps": [{"name": "x", "package": "dep", "req": "=1.2.3"}, {"name": "dep", "req": "^1", "kind": "build", "registry": "r"}]})
    found = {(r.name, r.version): r for r in scan.published_candidates(listing, spark.createDataFrame([("2/ab", line)], "path string, body string"), "dep").collect()}
    assert [(d.alias, d.requirement, d.kind) for d in found["ab", "1.0.0"].declarations] == [("x", "=1.2.3", "normal"), ("dep", "^1", "build")] and found["ab", "1.0.0"].enrichment_error is None
    assert found["ab", "2.0.0"].enrichment_error == "no such release" and found["ab", "2.0.0"].declarations[0].requirement == "^9"
    assert found["no name", "1.0.0"].enrichment_error == "no index file" and found["no name", "1.0.0"].declarations[0].target == "cfg(unix)"


def test_manifest_cells_and_diagnostics(spark):
    root = '[workspace]\n[workspace.dependencies]\ndep = { version = "1.2.3", registry = "mine", git = "g", path = "p" }\nself.workspace = true\n'
    member = '[package]\nname = "m"\nrust-version.workspace = true\n[dependencies]\ndep = { workspace = true, optional = true }\n'
    lost = '[package]\nname = "l"\nworkspace = "../none"\n[dependencies]\nother.workspace = true\nbad = { package = "dep", version = "x y" }\n'
    rows = [(1, "w/Cargo.toml", 1, "100644", root, True), (1, "w/m/Cargo.toml", 1, "100644", member, True), (1, "l/Cargo.toml", 1, "100644", lost, True), (1, "s/Cargo.toml", 1, "120000", "w", True)]
    fact = scan.fact_rows(candidates(spark, [("a", url("o/a"), None, False, "lost")]), repositories(spark, repository("o/a", 1)), files(spark, *rows), options(), "dep").first()
    cells = json.loads(fact.current_direct_requirements_json)
    assert [(c["manifest_path"], c["package_name"], c["alias"], c["requirement"], c["requirement_accepts"], c["optional"], c["workspace_manifest_path"]) for c in cells] == [
        ("l/Cargo.toml", "l", "bad", "x y", None, False, None), ("w/m/Cargo.toml", "m", "dep", "1.2.3", True, True, "w/Cargo.toml"),
    ]
    assert cells[0]["requirement_error"] and (cells[1]["git"], cells[1]["path"], cells[1]["registry"]) == ("g", "p", "mine") and len(cells[0]) == 16
    assert fact.error_code == "manifest_inventory_partial;sparse_index_enrichment_partial"
    assert [m.split(": ")[:2] for m in fact.error_message.split(" | ")[:-1]] == [
        ["s/Cargo.toml", "is a symbolic link and was not followed"], ["l/Cargo.toml", "workspace_root_unresolved"], ["w/Cargo.toml", "invalid_workspace_dependency"],
    ]
    assert (fact.any_requirement_accepts, fact.optional_declarations) == ("unknown", "unknown")
    assert [o["source"] for o in json.loads(fact.msrv_observations_json)] == ["not_declared", "not_declared", "workspace_inherited"]


def test_policy():
    policy = options(kinds=["dev"], max_repositories=3, allow_partial=True).policy()
    assert list(policy)[:3] == ["requirement_filter", "discovery", "dependency_kinds"] and len(policy) == 21
    assert (policy["dependency_kinds"], policy["exclude_archived"], policy["repository_resolution_overscan_factor"], policy["allow_partial"]) == (["dev"], False, 4, True)


@pytest.mark.parametrize("seed", range(2))
def test_graphs_in_a_task_and_by_levels(spark, seed):
    import random

    from provenio.operators.graph import lock_relations

    draw = random.Random(seed)
    nodes, edges = [], []
    for scope in range(25):
        names = [f"n{k}" for k in range(draw.randrange(1, 9))]
        nodes += [(scope, n, draw.random() < 0.2) for n in names]
        edges += [(scope, draw.choice(names), draw.choice(names)) for _ in range(draw.randrange(12))]
    n = spark.createDataFrame(nodes, "scope int, node string, target boolean")
    e = spark.createDataFrame(edges, "scope int, src string, dst string")
    walked, joined = (sorted(map(tuple, lock_relations(n, e, "scope", in_task).collect())) for in_task in (1000, 8))
    assert walked == joined and len(walked) == 25
    assert lock_relations(n.limit(0), e.limit(0), "scope").count() == 0


def test_a_chain_of_thousands(spark):
    from provenio.operators.graph import lock_relations

    chain = spark.range(5000)
    nodes = chain.select(F.lit(1).alias("scope"), F.col("id").alias("node"), (F.col("id") == 4999).alias("target"))
    edges = chain.filter("id < 4999").select(F.lit(1).alias("scope"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert tuple(lock_relations(nodes, edges, "scope").first()) == (1, "transitive", 4999, 1)


def test_an_incomplete_search_stays_so_when_hits_outnumber_its_total(spark, tmp_path):
    """50,001 private hits of each kind: more than the total of 100,000 that the search reported."""
    spark.range(50_001).selectExpr("id * 24 AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(1, 1, "F"), (2, 2, "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    row = scan_queries.scan_summary(spark, str(tmp_path)).first()
    assert (row.code_search_results_returned, row.code_search_total_count) == (100_002, 100_000)
    assert row.code_search_incomplete and row.partial and row.notes.count("|") == 3
