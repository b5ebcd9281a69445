"""The scan: from captured candidates and repository snapshots to one fact row per lockfile, and a summary."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.functions.semver import semver_key
from provenio.functions.text import ascii_lower, csv_safe, json_cell
from provenio.functions.urls import final_component, index_path, parse_repository, repository_key, sanitise_url
from provenio.operators import aggregates, filters, selection
from provenio.operators.evidence import evaluated, evidence, judgements, merged_evidence, ordered_declarations
from provenio.operators.graph import confirms, relation_column
from provenio.operators.manifests import KIND_ORDER, analyze_manifests
from provenio.plans.options import OVERSCAN, SCOPES, ScanOptions
from provenio.sources.documents import lockfiles
from provenio.sources.index import fallen_back, index_declarations
from provenio.sources.scratch import written

# The columns of a fact row, in the order of the output.
FACT_COLUMNS = """
observed_at_utc input_query target_crate target_version target_repository_url globally_exhaustive candidate_scope
scan_policy_json candidate_sources_json dependent_crates_json dependent_versions_json published_requirements_json
dependency_kinds_json dependency_targets_json optional_declarations published_direct_status any_requirement_accepts
any_exact_pin original_repository_urls_json repository_url github_repository_id github_full_name default_branch head_sha
tree_sha head_committed_at repo_pushed_at archived fork disabled stale inventory_status tree_truncated
repository_matched_cargo_file_count repository_matched_file_limit repository_matched_file_bytes_downloaded
repository_matched_file_byte_budget cargo_lock_path cargo_lock_blob_sha lock_status resolved_target_versions_json
resolved_target_sources_json exact_resolution_status exact_occurrence_count exact_crates_io_occurrence_count
manifest_paths_json current_direct_status current_direct_requirements_json msrv_effective msrv_source
msrv_observations_json os_observed_targets_json os_has_unconditional_declaration recorded_relation
shortest_dependency_depth evidence_completeness error_code error_message
""".split()
# Columns that hold free text, which a spreadsheet could take for a formula.
GUARDED = [
    "input_query", "target_crate", "target_version", "target_repository_url", "repository_url", "github_full_name", "default_branch",
    "head_sha", "tree_sha", "cargo_lock_path", "cargo_lock_blob_sha", "msrv_effective", "msrv_source", "error_code", "error_message",
]
# Relations as the facts name them; the registry's source; targets that name an operating system.
RELATIONS = {
    "direct": "recorded_direct", "transitive": "recorded_transitive", "both": "recorded_direct_and_transitive",
    "unclassified": "recorded_present_unclassified", "not_recorded": "not_recorded",
}
REGISTRY = "registry+https://github.com/rust-lang/crates.io-index"
OS_PATTERN = 'target_os\\s*=\\s*"([^"]+)"'
SYMLINK = "120000"
NOTES = [
    "What searches and listings of dependents return is bounded, so facts that are not here may still exist.",
    "A lockfile says what was resolved. Which features and platforms were built, and what ran, it does not say.",
    "Repositories are confirmed by a path from a root of a recorded lock graph to the target. A target without such a path is listed and not confirmed.",
]
#: Columns of a repository's capture that its rows show; of aliases, those of the first group in key order.
SNAPSHOT = [
    "full_name", "html_url", "default_branch", "fork", "archived", "disabled", "pushed_at", "head_sha", "tree_sha", "committed_at", "truncated",
]
#: Columns that facts carry until the summary is made.
INNER = ["_outcome", "_repo", "_repo_partial", "_parsed", "_exact", "_confirmed"]


def address(repository: Column) -> Column:
    """A repository as a release names it, without what must not be shown; null if it names none."""
    url = F.btrim(sanitise_url(repository))
    return F.when(url != "", url)


def _has(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a capture may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def published_candidates(listing: DataFrame, index_files: DataFrame, target: str) -> DataFrame:
    """Candidates from a listing of dependents and the registry's index: the declarations that a release published.

    listing: (name, version, repository, position, yanked, source, listed), and version_id and downloads if they are
    known; listed is struct(requirement, kind, optional, target), what the listing itself shows. index_files: (path,
    body). A release whose index file is missing, malformed or without such a declaration keeps one from the listing,
    and the error in enrichment_error: it is not lost, and what it says is not certain.
    """
    path = F.when(F.col("name").rlike("^[A-Za-z0-9_-]+$"), index_path(F.col("name")))
    rows = listing.select(F.struct("*").alias("_row"), F.col("version").alias("_version"), path.alias("_path"))
    files = index_files.select(F.col("path").alias("_path"), "body", F.lit(True).alias("_held"))
    # each release goes beside its file, once
    declared = index_declarations(rows.join(files, "_path", "left"), ["_row", "_held"], "_version", target)
    known = declared.select("_row.*", "declarations", F.when(F.col("_held"), F.col("error")).alias("error"))
    shown = F.struct(
        F.lit(target).alias("alias"), F.col("listed.requirement").alias("requirement"), F.col("listed.kind").alias("kind"),
        F.coalesce("listed.optional", F.lit(False)).alias("optional"), F.col("listed.target").alias("target"), F.lit(None).cast("string").alias("registry"),
    )
    return fallen_back(known, shown).drop("listed")


def keyed_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with the key, url and hint (how the repository is spelled) of what they name."""
    url = address(F.col("repository"))
    parsed = candidates.withColumn("url", url).withColumn("_named", parse_repository(F.col("url")))
    known = F.col("_named").isNotNull()
    hint = F.when(known, F.concat_ws("/", "_named.owner", "_named.name"))
    key = (
        F.when(known, F.concat(F.lit("github:"), ascii_lower(F.concat_ws("/", "_named.owner", "_named.name"))))
        .when(F.col("url").isNotNull(), F.concat(F.lit("unsupported:"), F.lower("url")))
        .otherwise(F.concat(F.lit("missing:"), F.col("name"), F.lit("@"), F.col("version")))
    )
    return parsed.withColumn("key", key).withColumn("hint", hint).drop("_named")


def candidate_groups(candidates: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The evidence of each group of candidates, as a state that can be merged (operators/evidence.py).

    candidates: (name, version, repository, position, declarations, enrichment_error, source), declarations evaluated, and
    version_id and downloads if they are known. seeds: (key, hint, url, source), repositories found by code search:
    they add their URLs and sources to a group, or make one without publications. Candidates of one repository have
    one key; those without get one of their own.
    """
    number = lambda name: F.coalesce(_has(candidates, name, "long"), F.lit(0)).cast("long").alias(name)
    keyed = candidates if "key" in candidates.columns else keyed_candidates(candidates)
    rows = keyed.select(
        "key", "name", "version", number("version_id"), number("downloads"), "url", "source", "hint", F.col("position").cast("long").alias("position"),
        "enrichment_error", "declarations",
    )
    if seeds is not None:
        rows = rows.unionByName(seeds.select("key", "url", "source", "hint"), allowMissingColumns=True)
    return evidence(rows, ["key"])


def code_seeds(hits: DataFrame) -> DataFrame:
    """(key, hint, url, source): the repositories of code-search hits, each spelling once a source.

    hits: (query, path, full_name, html_url, private), query being `lock` or `manifest`. Private hits, files whose last
    path component is not the very file, and names that are no repository are left out.
    """
    wanted = F.when(F.col("query") == "lock", "Cargo.lock").otherwise("Cargo.toml")
    public = filters.code_hits(hits, wanted).withColumn("_named", parse_repository(F.col("full_name"))).filter("_named is not null")
    source = F.concat(F.lit("code_search_"), F.col("query"), F.lit("_seed"))
    hint = F.concat_ws("/", "_named.owner", "_named.name")
    return public.select(F.concat(F.lit("github:"), ascii_lower(hint)).alias("key"), hint.alias("hint"), F.col("html_url").alias("url"), source.alias("source")).distinct()


def captured_repositories(repositories: DataFrame) -> DataFrame:
    """Repository captures by key. A capture may name what was asked for (requested) in place of the key, and give a
    committer's and an author's time (committer_at, author_at): the committer's counts, the author's stands in."""
    found = repositories
    if "key" not in found.columns:
        found = found.withColumn("key", F.concat(F.lit("github:"), repository_key(F.col("requested"))))
    if "committed_at" not in found.columns:
        found = found.withColumn("committed_at", F.coalesce("committer_at", "author_at"))
    return found.select("key", "repo_id", "private", *SNAPSHOT)


def merged_repositories(looked: DataFrame, options: ScanOptions) -> DataFrame:
    """One row per public repository: the evidence of all groups that led to it, its snapshot, and its fate.

    fate: fork, archived, headless (no branch or head could be read), inactive, treeless (the head's tree could not be
    read), else scanned; the first that holds, in this order.
    """
    one = merged_evidence(
        looked.filter("kept").withColumn("position", F.col("first_position")), ["repo_id"], *[F.min_by(c, "key").alias(c) for c in SNAPSHOT]
    )
    act = filters.activity(
        F.col("committed_at"), F.lit(options.observed_at).cast("timestamp"), options.stale_days, options.activity,
        F.lit(options.since).cast("date") if options.since else None, F.lit(options.before).cast("date") if options.before else None,
    )
    head = (F.coalesce("default_branch", F.lit("")) != "") & F.col("head_sha").isNotNull() & F.col("committed_at").isNotNull()
    kept = filters.disposition(F.col("fork"), F.col("archived"), options.include_forks, not options.exclude_archived)
    fate = (
        F.when(kept != "keep", kept)
        .when(~head, "headless")
        .when(F.col("_activity").isNull(), "inactive")
        .when(F.col("tree_sha").isNull() | F.col("truncated").isNull(), "treeless")
        .otherwise("scanned")
    )
    return one.withColumn("_activity", act).withColumn("fate", fate)


def select_files(tree: DataFrame, options: ScanOptions) -> DataFrame:
    """(repo_id, matched, over_cap, bytes, budget_hit, files) per repository; files: struct(path, sha, size, is_lock, status).

    tree: (repo_id, path, size, mode, sha, length, fetched), and kind if entries other than blobs are there. Locks come
    first under the cap, then manifests, each by path. Under the byte budget manifests come first, less what the locks
    reserve; the locks then have all that is left. status: read, or why not. All is decided on one narrow array per
    repository, without any text: one shuffle.
    """
    name = final_component(F.col("path"))
    blobs = tree.filter(name.isin("Cargo.toml", "Cargo.lock") & (F.coalesce(_has(tree, "kind", "string"), F.lit("blob")) == "blob"))
    entry = F.struct("path", "sha", "size", "mode", "length", "fetched")
    listed = lambda lock: F.array_sort(F.collect_list(F.when(name == lock, entry)))
    per_repo = blobs.groupBy("repo_id").agg(listed("Cargo.lock").alias("locks"), listed("Cargo.toml").alias("manifests"))
    cap, most = F.lit(options.file_cap), options.max_file_bytes
    n_locks = F.least(F.size("locks"), cap)
    capped = per_repo.withColumns({"_locks": n_locks, "_manifests": F.least(F.size("manifests"), cap - n_locks)})
    plain = lambda e: (e["mode"] != SYMLINK) & (F.coalesce(e["size"], F.lit(0)) <= most)
    item = lambda e: F.struct(e["path"].alias("key"), e["size"].alias("size"), e["length"].alias("actual"), e["fetched"].alias("fetched"))
    usable = lambda files, n: F.transform(F.filter(F.slice(files, 1, F.col(n)), plain), item)
    budget = F.lit(options.byte_budget).cast("long")
    reserved = F.least(budget, F.aggregate("l", F.lit(0).cast("long"), lambda a, e: a + F.coalesce(e["size"], F.lit(most).cast("long"))))
    folded = (
        capped.withColumns({"m": usable("manifests", "_manifests"), "l": usable("locks", "_locks")})
        .withColumn("m", selection.greedy_budget(F.col("m"), budget - reserved, most))
        .withColumn("l", selection.greedy_budget(F.col("l"), budget, most, F.col("m.consumed")))
    )

    def judged(files: str, n: str, fold: str) -> Column:
        def one(e: Column, k: Column) -> Column:
            status = (
                F.when(k >= F.col(n), "repository_file_limit_exceeded")
                .when(e["mode"] == SYMLINK, "symlink_not_followed")
                .when(e["size"] > most, "too_large")
                .when(F.array_contains(F.col(f"{fold}.refused"), e["path"]), "repository_byte_budget_exceeded")
                .when(~e["fetched"], "fetch_failed")
                .otherwise("read")
            )
            return F.struct(e["path"].alias("path"), e["sha"].alias("sha"), e["size"].alias("size"), F.lit(fold == "l").alias("is_lock"), status.alias("status"))

        return F.transform(files, one)

    matched = F.size("locks") + F.size("manifests")
    return folded.select(
        "repo_id", matched.cast("long").alias("matched"), (matched > cap).alias("over_cap"), F.col("l.consumed").alias("bytes"),
        (F.col("m.hit") | F.col("l.hit")).alias("budget_hit"), F.concat(judged("locks", "_locks", "l"), judged("manifests", "_manifests", "m")).alias("files"),
    )


def read_texts(tree: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, path, is_lock, text) of the files whose status is `read`; a text that is not UTF-8 is null."""
    texts = tree.select("repo_id", "path", "text").join(files.filter("status = 'read'").select("repo_id", "path", "is_lock"), ["repo_id", "path"])
    if dict(tree.dtypes)["text"] != "binary":
        return texts.select("repo_id", "path", "is_lock", F.coalesce("text", F.lit("")).alias("text"))
    text = F.coalesce(F.col("text"), F.lit(b"")).cast("string")
    return texts.select("repo_id", "path", "is_lock", F.when(F.is_valid_utf8(text), text).alias("text"))


def lock_evidence(files: DataFrame, texts: DataFrame, options: ScanOptions, target: str) -> DataFrame:
    """A row per lockfile: what it records of the target, or why it could not be read. Counts come from the parsed
    packages where they stand; only the graphs of lockfiles that record the exact version are walked."""
    parsed = lockfiles(texts.filter("is_lock and text is not null").select("repo_id", "path", "text"), ["repo_id", "path"])
    mine = F.filter("packages", lambda p: p["name"] == target)
    is_registry = lambda p: F.coalesce(p["source"] == REGISTRY, F.lit(False))
    in_order = F.array_sort(
        F.transform(
            mine,
            lambda p: F.struct(
                semver_key(p["version"]).alias("key"), F.struct(p["source"].isNotNull().alias("there"), p["source"].alias("value")).alias("source"),
                F.struct(p["version"].alias("version"), p["source"].alias("source"), is_registry(p).alias("is_crates_io")).alias("cell"),
            ),
        )
    )
    counted = written(
        parsed.withColumn("_mine", in_order).select(
            "repo_id", "path", "packages", "edges", "legacy_root", "buildable", "error",
            F.transform("_mine", lambda x: x["cell"]).alias("occurrences"),
            F.array_distinct(F.transform("_mine", lambda x: x["cell"]["version"])).alias("versions"),
            F.size(F.filter("_mine", lambda x: x["cell"]["version"] == options.version)).alias("exact"),
            F.size(F.filter("_mine", lambda x: (x["cell"]["version"] == options.version) & x["cell"]["is_crates_io"])).alias("exact_registry"),
        ),
        "locks",
    )
    # a lockfile's graph is walked where it stands, in the task that has parsed it
    sound = counted.filter("error is null and buildable and not legacy_root and exact > 0")
    is_target = F.transform("packages", lambda p: (p["name"] == target) & (p["version"] == options.version))
    walked = relation_column(F.col("packages.node"), is_target, F.col("edges.src"), F.col("edges.dst"))
    relations = sound.select("repo_id", "path", walked.alias("w")).select("repo_id", "path", "w.relation", "w.depth")
    joined = (
        files.filter("is_lock")
        .join(counted.drop("packages", "edges"), ["repo_id", "path"], "left")
        .join(relations, ["repo_id", "path"], "left")
    )
    found = F.coalesce("exact", F.lit(0)) > 0
    status = (
        F.when(F.col("status") != "read", F.col("status"))
        .when(F.col("buildable").isNull(), "non_utf8")
        .when(F.col("error").isNotNull(), "parse_failed")
        .otherwise("parsed")
    )
    read = status == "parsed"
    relation = F.when(~read, "unknown").when(~found, "not_recorded").otherwise(F.coalesce("relation", F.lit("unclassified")))
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])[relation], relation)
    broken = read & found & (F.col("legacy_root") | ~F.col("buildable"))
    return joined.select(
        "repo_id", F.col("path").alias("cargo_lock_path"), F.col("sha").alias("cargo_lock_blob_sha"), F.col("size").alias("lock_size"),
        status.alias("lock_status"), F.when(read, F.col("versions")).alias("versions_resolved"), F.when(read, F.col("occurrences")).alias("occurrences"),
        F.when(read, F.col("exact")).otherwise(0).alias("exact"), F.when(read, F.col("exact_registry")).otherwise(0).alias("exact_registry"),
        F.when(~read, "unknown").when(found, "present").otherwise("absent").alias("exact_resolution_status"), named.alias("recorded_relation"),
        F.when(found, F.col("depth")).alias("shortest_dependency_depth"), F.coalesce(read & found & confirms(F.col("relation")), F.lit(False)).alias("confirmed"),
        F.coalesce("error", F.lit("")).alias("lock_error"),
        F.when(broken, F.when(F.col("legacy_root"), "the root of an old lockfile is not part of its graph").otherwise("a package depends on one that the lockfile does not record once")).alias("graph_error"),
    )


def manifest_evidence(files: DataFrame, texts: DataFrame, over: DataFrame, options: ScanOptions, target: str) -> DataFrame:
    """One row per repository with a manifest: paths, declarations of the target, MSRV, systems, and diagnostics.

    Everything a manifest has to say is a row (files, declarations, observations, diagnostics), and one group-by
    gathers all of them. over: repositories with more manifests than the cap lets in.
    """
    found = analyze_manifests(texts.filter("not is_lock and text is not null").select("repo_id", "path", "text"), "repo_id", target, options.version)
    kind_order = F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])[F.col("kind")]
    declaration = F.struct(
        F.col("path").alias("manifest_path"), "package_name", "alias", F.coalesce("spec_package", "alias").alias("dependency_package"), "kind", "target",
        F.col("spec_version").alias("requirement"), F.col("requirement.accepts").alias("requirement_accepts"),
        F.col("requirement.exact_pin").alias("explicit_exact_pin"), F.col("requirement.error").alias("requirement_error"), "optional",
        F.col("spec_git").alias("git"), F.col("spec_local").alias("path"), F.col("spec_registry").alias("registry"),
        F.col("inherited").alias("workspace_inherited"), F.col("inherited_from").alias("workspace_manifest_path"),
    )
    declared = found.declarations.select(
        "repo_id", F.struct("path", kind_order.alias("kind"), F.struct(F.col("target").isNotNull().alias("there"), "target").alias("target"), "alias").alias("d_order"), declaration.alias("d")
    )
    observed = found.msrv.select(
        "repo_id", F.struct(F.col("path").alias("manifest_path"), "msrv", "source").alias("o"), F.when(semver_key(F.col("msrv")).isNotNull(), F.struct(semver_key(F.col("msrv")).alias("key"), "path")).alias("o_order")
    )
    note = lambda rank, path, code, message: F.struct(F.lit(rank).alias("rank"), path.alias("path"), code.alias("code"), message.alias("message")).alias("n")
    says = {
        "symlink_not_followed": "is a symbolic link and was not followed", "too_large": "is larger than a file may be",
        "repository_byte_budget_exceeded": "did not fit the byte budget", "fetch_failed": "could not be fetched",
    }
    unread = files.filter(~F.col("is_lock") & F.col("status").isin(*says))
    said = F.create_map(*[F.lit(x) for pair in says.items() for x in pair])[F.col("status")]
    blank = F.lit("")
    garbled = texts.filter("not is_lock and text is null")
    rows = [
        files.filter("not is_lock").select("repo_id", F.col("path").alias("m")),
        declared,
        observed,
        over.select("repo_id", note(0, blank, blank, F.concat(F.col("left_out").cast("string"), F.lit(" manifests were not read: the repository has more files than the limit")))),
        unread.select("repo_id", note(1, F.col("path"), blank, said)),
        garbled.select("repo_id", note(1, F.col("path"), blank, F.lit("is not UTF-8"))),
        found.diagnostics.select("repo_id", note(2, F.col("path"), F.col("code"), F.col("message"))),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    told = lambda n: F.concat_ws(": ", *[F.when(n[c] != "", n[c]) for c in ("path", "code", "message")])
    os_of = lambda target: F.regexp_extract_all(F.coalesce(target, F.lit("")), F.lit(OS_PATTERN), 1)
    return together.groupBy("repo_id").agg(
        F.array_sort(F.collect_list("m")).alias("manifest_paths"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d_order", "d")))), lambda x: x["d"]).alias("current"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(os_of(F.col("d.target")))))).alias("os"),
        F.coalesce(F.bool_or(F.col("d").isNotNull() & F.col("d.target").isNull()), F.lit(False)).alias("unconditional"),
        F.array_sort(F.collect_list("o")).alias("observed"),
        F.min_by("o", "o_order").alias("least"),
        F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list("n")), told)).alias("diagnostics"),
    )


@dataclass
class Scan:
    """A scan's facts, ordered by repository, URL and lockfile, and one row of counts over all its stages."""

    facts: DataFrame
    summary: DataFrame


def fact_rows(candidates: DataFrame, repositories: DataFrame, tree: DataFrame, options: ScanOptions, target: str, hits: DataFrame | None = None) -> DataFrame:
    """The facts of a scan alone."""
    return scan(candidates, repositories, tree, options, target, hits).facts


def scan(
    candidates: DataFrame, repositories: DataFrame, tree: DataFrame, options: ScanOptions, target: str, hits: DataFrame | None = None,
    search_total: int = 0, search_incomplete: bool = False,
) -> Scan:
    """One row of FACT_COLUMNS per lockfile, one for a repository without, and one for a group without repository.

    candidates: releases as published_candidates() gives them. repositories: (key, repo_id, private, SNAPSHOT), see
    captured_repositories(); a head or tree that could not be captured is null (truncated is null for a tree that
    could not be read). tree: (repo_id, path, size, mode, sha, text, fetched) and kind, the entries of read_trees()
    with their blobs. hits: code-search hits as in code_seeds, of search_total reported. Groups that lead to one
    repository are one before anything is judged. No group and no failed lookup is lost: it is a row with an error code.
    """
    listed = candidates.orderBy("position").limit(options.max_candidates) if options.max_candidates is not None else candidates
    # requirements and repositories are parsed once, then read
    listed = written(evaluated(keyed_candidates(listed), target, options.version), "candidates")
    kept = filters.filter_candidates(listed, options.kinds, options.optional_mode, options.requirement_mode)
    groups = candidate_groups(kept, code_seeds(hits) if hits is not None else None).withColumnRenamed("position", "first_position")
    asked = written(groups.join(captured_repositories(repositories), "key", "left"), "groups")
    hosted = F.col("key").startswith("github:")
    found = selection.overscan(asked.filter(hosted), "key", "repo_id", "private", options.max_repositories, options.jobs, OVERSCAN)
    looked = asked.filter(~hosted).unionByName(found, allowMissingColumns=True)
    merged = written(merged_repositories(looked, options), "repositories")
    scanned = merged.filter("fate = 'scanned'")
    mine = tree.join(scanned.select("repo_id"), "repo_id", "left_semi")
    narrow = mine.select(*[c for c in mine.columns if c != "text"], F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"))
    selected = written(select_files(narrow, options), "files")
    files = selected.select("repo_id", F.inline("files"))
    texts = written(read_texts(mine, files), "texts")
    locks = lock_evidence(files, texts, options, target)
    left_out = F.size(F.filter("files", lambda f: ~f["is_lock"] & (f["status"] == "repository_file_limit_exceeded")))
    over = selected.select("repo_id", left_out.alias("left_out")).filter("left_out > 0")
    manifests = manifest_evidence(files, texts, over, options, target)
    whole = scanned.join(selected.drop("files"), "repo_id", "left").join(manifests, "repo_id", "left").join(locks, "repo_id", "left")
    facts = written(_project(whole, looked, merged, options, target), "facts")
    order = ["github_full_name", "repository_url", "cargo_lock_path"]
    stages = {"kept": kept, "listed": listed, "looked": looked, "asked": asked, "merged": merged, "selected": selected, "hits": hits}
    return Scan(facts.drop(*INNER).orderBy(*order), summary(facts, stages, options, target, search_total, search_incomplete))


def _flag(value: Column) -> Column:
    return F.when(value, "true").when(~value, "false").otherwise("unknown")


def _time(value: str) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _project(whole: DataFrame, looked: DataFrame, merged: DataFrame, options: ScanOptions, target: str) -> DataFrame:
    """All branches as rows of FACT_COLUMNS, texts throughout, and INNER."""
    context = {
        "observed_at_utc": options.observed_at, "input_query": options.query, "target_crate": target,
        "target_version": options.version, "target_repository_url": options.repository or "", "globally_exhaustive": "false",
        "candidate_scope": SCOPES[options.discovery], "scan_policy_json": json.dumps(options.policy(), separators=(",", ":")),
    }
    base = {k: F.lit(v) for k, v in context.items()} | {
        "candidate_sources_json": json_cell(F.col("sources")), "dependent_crates_json": json_cell(F.col("dependents")),
        "dependent_versions_json": json_cell(F.col("versions")), "published_requirements_json": json_cell(ordered_declarations(F.col("declarations"))),
        "dependency_kinds_json": json_cell(F.col("kinds")), "dependency_targets_json": json_cell(F.col("targets")),
        "published_direct_status": F.when(F.col("releases") > 0, "present").otherwise("not_observed"),
        "original_repository_urls_json": json_cell(F.col("urls")), "repository_url": F.get("urls", F.lit(0)), "github_full_name": F.col("hint"),
        "repository_matched_file_limit": F.lit(options.file_cap), "repository_matched_file_byte_budget": F.lit(options.byte_budget),
    } | judgements()
    base |= {c: F.lit("[]") for c in ("resolved_target_versions_json", "resolved_target_sources_json", "manifest_paths_json", "current_direct_requirements_json", "msrv_observations_json", "os_observed_targets_json")}
    base |= {c: F.lit("0") for c in ("repository_matched_cargo_file_count", "repository_matched_file_bytes_downloaded", "exact_occurrence_count", "exact_crates_io_occurrence_count")}
    base |= {c: F.lit("unknown") for c in ("archived", "fork", "disabled", "stale", "tree_truncated", "exact_resolution_status", "recorded_relation", "current_direct_status", "os_has_unconditional_declaration")}
    repository = {
        "repository_url": F.col("html_url"), "github_repository_id": F.col("repo_id"), "github_full_name": F.col("full_name"), "default_branch": F.col("default_branch"),
        "repo_pushed_at": _time("pushed_at"), "archived": _flag(F.col("archived")), "fork": _flag(F.col("fork")), "disabled": _flag(F.col("disabled")),
    }
    head = {"head_sha": F.col("head_sha"), "tree_sha": F.col("tree_sha"), "head_committed_at": _time("committed_at"), "stale": _flag(F.col("_activity.stale"))}
    inner = {"_outcome": F.lit("scanned"), "_repo": F.lit(None).cast("long"), "_repo_partial": F.lit(True), "_parsed": F.lit(False), "_exact": F.lit(0).cast("long"), "_confirmed": F.lit(False)}

    def row(df: DataFrame, values: dict[str, Column], marks: dict[str, Column]) -> DataFrame:
        cells = {c: F.lit("") for c in FACT_COLUMNS} | base | values
        texts = {c: F.coalesce(cells[c].cast("string"), F.lit("")) for c in FACT_COLUMNS}
        return df.select(*[(csv_safe(v) if c in GUARDED else v).alias(c) for c, v in texts.items()], *[c.alias(k) for k, c in (inner | marks).items()])

    def failed(df: DataFrame, code: str, outcome: str, message: Column, values: dict[str, Column] | None = None, repo: Column | None = None) -> DataFrame:
        unsupported = outcome == "unsupported"
        status = {
            "inventory_status": F.lit("unsupported_repository" if unsupported else "failed"), "evidence_completeness": F.lit("unavailable" if unsupported else "failed"),
            "lock_status": F.lit("not_scanned"), "error_code": F.lit(code), "error_message": message,
        }
        return row(df, status | (values or {}), {"_outcome": F.lit(outcome)} | ({} if repo is None else {"_repo": repo}))

    truncated, over, hit = (F.coalesce(c, F.lit(False)) for c in ("truncated", "over_cap", "budget_hit"))
    unread = F.coalesce(F.col("diagnostics") != "", F.lit(False))
    incomplete = truncated | unread
    lock = lambda status: F.coalesce(F.col("lock_status") == status, F.lit(False))
    errors = [
        ("tree_truncated", truncated, F.lit("the tree was cut short, so a file that is not listed may be there")),
        ("manifest_inventory_partial", incomplete, F.coalesce("diagnostics", F.lit(""))),
        ("sparse_index_enrichment_partial", F.col("unenriched") > 0, F.lit("some published releases have only what the listing shows of them")),
        ("repository_matched_file_limit", lock("repository_file_limit_exceeded"), F.concat(F.lit("the repository has "), F.col("matched").cast("string"), F.lit(f" matching files; the limit is {options.file_cap}"))),
        ("lockfile_symlink", lock("symlink_not_followed"), F.lit("the lockfile is a symbolic link; what it points to was not read")),
        ("lockfile_too_large", lock("too_large"), F.concat(F.lit("the lockfile has "), F.col("lock_size").cast("string"), F.lit(f" bytes; the limit is {options.max_file_bytes}"))),
        ("repository_matched_file_byte_budget", lock("repository_byte_budget_exceeded"), F.lit(f"the lockfile does not fit the repository's budget of {options.byte_budget} bytes")),
        ("lockfile_fetch_failed", lock("fetch_failed"), F.lit("the lockfile could not be fetched")),
        ("lockfile_non_utf8", lock("non_utf8"), F.lit("the lockfile is not UTF-8")),
        ("lockfile_parse_failed", lock("parse_failed"), F.col("lock_error")),
        ("lock_graph_unclassified", F.col("graph_error").isNotNull(), F.col("graph_error")),
    ]
    codes = aggregates.joined_errors(*[F.when(c, code) for code, c, _ in errors])
    messages = F.concat_ws(" | ", *[F.when(c, m) for _, c, m in errors])
    none = F.col("cargo_lock_path").isNull()
    some = F.coalesce(F.size("current") > 0, F.lit(False))
    quality = aggregates.completeness(F.lit(False), codes)
    cell = lambda c: F.coalesce(json_cell(F.col(c)), F.lit("[]"))
    scanned = row(
        whole,
        repository
        | head
        | {
            "tree_truncated": _flag(F.col("truncated")), "inventory_status": quality, "evidence_completeness": quality,
            "repository_matched_cargo_file_count": F.coalesce("matched", F.lit(0)), "repository_matched_file_bytes_downloaded": F.coalesce("bytes", F.lit(0)),
            "cargo_lock_path": F.col("cargo_lock_path"), "cargo_lock_blob_sha": F.col("cargo_lock_blob_sha"),
            "lock_status": F.when(none, F.when(truncated, "unknown_truncated").otherwise("not_found")).otherwise(F.col("lock_status")),
            "resolved_target_versions_json": cell("versions_resolved"), "resolved_target_sources_json": cell("occurrences"),
            "exact_resolution_status": F.when(none, F.when(truncated, "unknown").otherwise("not_observed")).otherwise(F.col("exact_resolution_status")),
            "exact_occurrence_count": F.coalesce("exact", F.lit(0)), "exact_crates_io_occurrence_count": F.coalesce("exact_registry", F.lit(0)),
            "manifest_paths_json": cell("manifest_paths"),
            "current_direct_status": F.when(some, "present").when(incomplete, "unknown").otherwise("absent"), "current_direct_requirements_json": cell("current"),
            "msrv_effective": F.coalesce("least.msrv", F.when(incomplete, "unknown").otherwise("not_declared")),
            "msrv_source": F.coalesce("least.source", F.when(incomplete, "unknown").otherwise("not_declared")),
            "msrv_observations_json": cell("observed"), "os_observed_targets_json": cell("os"),
            "os_has_unconditional_declaration": F.when(~some & incomplete, "unknown").otherwise(F.coalesce("unconditional", F.lit(False)).cast("string")),
            "recorded_relation": F.coalesce("recorded_relation", F.lit("unknown")), "shortest_dependency_depth": F.col("shortest_dependency_depth"),
            "error_code": codes, "error_message": messages,
        },
        {
            "_repo": F.col("repo_id"), "_repo_partial": (codes != "") | over | hit, "_parsed": lock("parsed"),
            "_exact": F.coalesce("exact", F.lit(0)).cast("long"), "_confirmed": F.coalesce("confirmed", F.lit(False)),
        },
    )
    no_url = F.size("urls") == 0
    unsupported = failed(
        looked.filter(~F.col("key").startswith("github:")), "unsupported_repository", "unsupported",
        F.when(no_url, "the release names no repository").otherwise("what the release names is no repository of the code host"),
    )
    unresolved = failed(looked.filter(lookup_failed(options)), "repository_resolution_failed", "unresolved", F.lit("the repository could not be looked up"))
    headless = failed(
        merged.filter("fate = 'headless'"), "default_branch_head_failed", "headless",
        F.lit("the head of the default branch could not be read"), repository, F.col("repo_id"),
    )
    treeless = failed(
        merged.filter("fate = 'treeless'"), "tree_fetch_failed", "treeless", F.lit("the tree of the head could not be read"), repository | head, F.col("repo_id")
    )
    return scanned.unionByName(unsupported).unionByName(unresolved).unionByName(headless).unionByName(treeless)


def lookup_failed(options: ScanOptions) -> Column:
    """Of groups that were looked up: no repository came back, and it was still wanted."""
    failed = F.coalesce("considered", F.lit(False)) & F.col("repo_id").isNull()
    return failed if options.max_repositories is None else failed & (F.col("held") < options.max_repositories)


def summary(
    facts: DataFrame, stages: dict[str, DataFrame | None], options: ScanOptions, target: str, search_total: int = 0, search_incomplete: bool = False
) -> DataFrame:
    """One row with the 36 fields of a scan's summary; a lost or partial row makes the whole partial."""
    outcome = lambda *names: F.count_if(F.col("_outcome").isin(*names))
    repos = lambda test: F.count_distinct(F.when((F.col("_outcome") == "scanned") & test, F.col("_repo")))
    of_facts = facts.agg(
        F.count(F.lit(1)).alias("output_rows"),
        repos(F.lit(True)).alias("repositories_scanned"),
        repos(F.col("_repo_partial")).alias("repositories_partial"),
        outcome("unresolved", "headless", "treeless").alias("repositories_failed"),
        outcome("unsupported").alias("repositories_unsupported"),
        F.count_if((F.col("_outcome") == "scanned") & (F.col("cargo_lock_path") != "")).alias("lockfiles_found"),
        F.count_if("_parsed").alias("lockfiles_parsed"),
        repos(F.col("_confirmed")).alias("repositories_exact_confirmed"),
        F.coalesce(F.sum("_exact"), F.lit(0)).alias("exact_occurrences"),
    )
    at_most, most = options.max_candidates, options.max_repositories
    of_candidates = stages["kept"].agg(F.count(F.lit(1)).alias("candidate_release_records"), F.count_distinct("name").alias("candidate_crates"))
    limited = stages["listed"].agg((F.lit(at_most is not None) & (F.count(F.lit(1)) >= (at_most or 0))).alias("candidate_limit_reached"))
    hosted = F.col("key").startswith("github:")
    total = stages["asked"].agg(F.count_if(hosted).alias("_asked"), F.count(F.lit(1)).alias("candidate_repositories"))
    gone = F.col("considered") & ~F.coalesce("kept", F.lit(False)) & ~F.coalesce("private", F.lit(False)) & ~F.coalesce(lookup_failed(options), F.lit(False))
    of_looked = stages["looked"].agg(
        F.count_distinct(F.when(F.col("considered") & F.col("private"), F.col("repo_id"))).alias("repositories_filtered_as_private"),
        F.count_if("considered").alias("_considered"),
        F.count_distinct(F.when(F.col("kept"), F.col("repo_id"))).alias("_held"),
        F.count_if(gone).alias("_passed_over"),
    )
    fate = lambda name: F.count_if(F.col("fate") == name)
    of_merged = stages["merged"].agg(
        fate("fork").alias("repositories_filtered_as_forks"), fate("archived").alias("repositories_filtered_as_archived"), fate("inactive").alias("repositories_filtered_by_activity")
    )
    added = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of_files = stages["selected"].agg(
        added("matched").alias("matched_cargo_files"), added("bytes").alias("matched_cargo_file_bytes_downloaded"),
        F.count_if("over_cap").alias("repositories_file_limit_exceeded"), F.count_if("budget_hit").alias("repositories_byte_budget_exceeded"),
    )
    hits = stages["hits"]
    found = facts.sparkSession.range(0).select(F.lit(False).alias("private")) if hits is None else hits.select("private")
    of_hits = found.agg(F.count(F.lit(1)).alias("code_search_results_returned"), F.count_if(F.coalesce("private", F.lit(False))).alias("code_search_private_results_discarded"))
    row = of_facts
    for part in (of_candidates, limited, total, of_looked, of_merged, of_files, of_hits):
        row = row.join(F.broadcast(part), F.lit(True))  # one row each
    budget = F.least(F.lit(OVERSCAN * (most or 0)), F.col("_asked"))
    bounded = F.lit(most is not None)
    row = row.withColumns({
        "repository_limit_reached": bounded & ((F.col("_considered") < F.col("_asked")) | (F.col("_passed_over") > 0)),
        "repository_resolution_budget_exhausted": bounded & F.lit(bool(most)) & (F.col("_held") < (most or 0)) & (F.col("_considered") >= budget) & (F.col("_considered") < F.col("_asked")),
        "code_search_incomplete": F.lit(search_incomplete) | (F.lit(search_total) > F.col("code_search_results_returned")),
    })
    partial = reduce(Column.__or__, [F.col(c) > 0 for c in ("repositories_partial", "repositories_failed", "repositories_unsupported")])
    extra = [
        F.when(F.col("code_search_incomplete"), "the code search was cut off or said it was incomplete; what it led to is an addition, not a whole"),
        F.when(F.col("repository_resolution_budget_exhausted"), f"lookups of repositories ended at {OVERSCAN} times the wanted number, before that number was found"),
    ]
    context = {
        "observed_at_utc": options.observed_at, "input_query": options.query, "target_crate": target, "target_version": options.version,
        "globally_exhaustive": False, "candidate_scope": SCOPES[options.discovery], "policy": json.dumps(options.policy(), separators=(",", ":")),
    }
    return row.select(
        *[F.lit(v).alias(k) for k, v in context.items()],
        "candidate_limit_reached", "repository_limit_reached", "repository_resolution_budget_exhausted", "candidate_release_records", "candidate_crates",
        "candidate_repositories", "repositories_scanned", "repositories_filtered_by_activity", "repositories_filtered_as_forks",
        "repositories_filtered_as_archived", "repositories_filtered_as_private", "repositories_unsupported", "repositories_partial", "repositories_failed",
        "lockfiles_found", "lockfiles_parsed", "repositories_exact_confirmed", "exact_occurrences", "matched_cargo_files",
        "matched_cargo_file_bytes_downloaded", "repositories_file_limit_exceeded", "repositories_byte_budget_exceeded", "code_search_results_returned",
        F.lit(search_total).cast("long").alias("code_search_total_count"), "code_search_incomplete", "code_search_private_results_discarded", "output_rows",
        (partial | F.col("repository_resolution_budget_exhausted") | F.col("code_search_incomplete")).alias("partial"),
        F.array_compact(F.array(*[F.lit(n) for n in NOTES], *extra)).alias("notes"),
    )
