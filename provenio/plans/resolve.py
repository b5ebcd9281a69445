"""Which package a query means: from the query's text to one selected package, or a ranked list of alternatives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.text import canonical_name, search_terms
from provenio.functions.urls import final_component, parse_repository, repository_key, sensitive_url
from provenio.operators.catalog import CatalogIndex, search_index
from provenio.operators.joins import not_yet_known
from provenio.operators.resolution import best_candidates, clear_winner, first_search_hits
from provenio.operators.selection import bounded, shallowest
from provenio.sources.documents import manifests
from provenio.sources.scratch import written

# Manifests read for package names, and bytes that each may have; candidates asked for at least.
MANIFEST_FILES, MANIFEST_BYTES = 16, 512 << 10
LEAST_PER_TERM, LEAST_FOR_REPOSITORY = 10, 100
SCORED = ["name", "max_version", "repository", "downloads", "score", "match_reason"]
FALL_BACK = "the sole repository of this very name holds no published package; falling back to names"


@dataclass
class Captures:
    """What was captured of the registry and the code host.

    crates: (name, max_version, repository, homepage, description, downloads), the catalog. repositories: (full_name, name,
    private, manifests array of struct(path, mode, size, text), truncated). search_total and search_incomplete are
    what the code host reported for the search of repositories by name, of which repositories holds the items returned.
    index: an index of the catalog, if it is searched more than once (operators/catalog.py).
    """

    crates: DataFrame
    repositories: DataFrame
    search_total: int | None = None
    search_incomplete: bool = False
    index: CatalogIndex | None = None


def validate_query(query: str, spark) -> str:
    """The trimmed query, or an error: it must not be empty, nor a URL of the code host with secrets in it."""
    trimmed = query.strip()
    if not trimmed:
        raise ValueError("the query for a package or repository must not be empty")
    if spark.range(1).select(sensitive_url(F.lit(trimmed))).first()[0]:
        raise ValueError("repository URLs must not have user information, a query string or a fragment")
    return trimmed


def lookup_exact(crates: DataFrame, name: str) -> DataFrame:
    """The package of this name, in which case and `-` against `_` make no difference; no row if there is none."""
    return crates.filter(canonical_name(F.col("name")) == canonical_name(F.lit(name))).orderBy("name").limit(1)


def search(crates: DataFrame, term: Column | str, limit: int) -> DataFrame:
    """(term, rank, ...) of at most `limit` packages a term whose name or description contains it.

    The nearer the match is to the whole name the better the rank; then by downloads and name. A text is one term, a
    column an array of them.
    """
    terms = F.array(F.lit(term)) if isinstance(term, str) else term
    wanted = crates.withColumn("term", F.explode(terms)).filter(F.btrim("term") != "")
    name, asked = canonical_name(F.col("name")), canonical_name(F.col("term"))
    near = F.when(name == asked, 0).when(name.startswith(asked), 1).when(name.contains(asked), 2).when(F.lower(F.coalesce("description", F.lit(""))).contains(F.lower("term")), 3)
    found = wanted.withColumn("_near", near).filter("_near is not null")
    parts = found.select("term", F.struct("_near", (-F.col("downloads")).alias("less"), "name").alias("key"), *[c for c in crates.columns])
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy("key")))
    return ranked.filter(F.col("rank") <= limit).drop("key")


def search_candidates(captures: Captures, query: str, per_term: int) -> DataFrame:
    """The hits of all search terms of a query, each package once: of the first term that found it."""
    terms = search_terms(F.lit(query))
    if captures.index is None:
        found = search(captures.crates, terms, per_term)
    else:
        found = search_index(captures.index, captures.crates.sparkSession.range(1).select(F.explode(terms).alias("term")), per_term)
    return first_search_hits(found).drop("term", "rank")


def exact_named(repositories: DataFrame, query: str) -> DataFrame:
    """Public repositories of the very name, ASCII case aside."""
    return repositories.filter(~F.col("private") & (F.lower("name") == F.lower(F.lit(query))))


def belongs_to(repository: Column, full_name: str) -> Column:
    """Whether a package's repository text names this repository."""
    return F.coalesce(repository_key(repository) == F.lower(F.lit(full_name)), F.lit(False))


def package_names(repository: DataFrame) -> DataFrame:
    """(name): packages that the shallowest MANIFEST_FILES plain manifests of a repository name."""
    files = repository.select("full_name", F.explode("manifests").alias("f")).select("full_name", "f.*")
    named = shallowest(files.filter(final_component(F.col("path")) == "Cargo.toml"), "full_name", "path", MANIFEST_FILES)
    plain = named.filter((F.col("mode") != "120000") & (F.coalesce(F.col("size"), F.octet_length("text").cast("long")) <= MANIFEST_BYTES))
    parsed = manifests(plain.select("full_name", "path", "text"), ["full_name", "path"])
    return parsed.filter("package is not null").select(F.col("package").alias("name")).distinct()


def envelope(query: str, selected: DataFrame, alternatives: DataFrame, method: Column | str, diagnostics: list[str]) -> DataFrame:
    """One row: input, selected, alternatives in order, resolution_method, requires_selection, globally_exhaustive, diagnostics."""
    cell = F.struct(*SCORED)
    one = selected.select(cell.alias("c")).agg(F.first("c").alias("selected"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("downloads")).alias("d"), "name")
    rest = alternatives.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), cell.alias("c")))), lambda x: x["c"]).alias("alternatives"))
    method = F.lit(method) if isinstance(method, str) else method
    notes = F.array(*[F.lit(d) for d in diagnostics]).cast("array<string>")
    return one.join(F.broadcast(rest), F.lit(True)).select(  # one row each
        F.lit(query).alias("input"), "selected", "alternatives", method.alias("resolution_method"), F.col("selected").isNull().alias("requires_selection"),
        F.lit(False).alias("globally_exhaustive"), notes.alias("diagnostics"),
    )


def _exact(query: str, found: DataFrame, method: str) -> DataFrame:
    scored = found.withColumn("score", F.lit(1.0)).withColumn("match_reason", F.lit(method))
    return envelope(query, scored, scored.limit(0), method, [])


def resolve_repository(captures: Captures, query: str, full_name: str, limit: int, prefix: str = "") -> DataFrame:
    """The packages of a repository: those found by its name that point to it, and those that its manifests name.

    One package is selected; several, or none, are alternatives to choose from.
    """
    repository = captures.repositories.filter(F.lower("full_name") == full_name.lower())
    state = repository.agg(F.count(F.lit(1)), F.bool_or("private"), F.first("name"), F.bool_or("truncated"), F.first("full_name")).first()
    if not state[0]:
        raise LookupError(f"the repository {full_name} could not be looked up")
    if state[1]:
        raise PermissionError("private repositories are outside a public inventory")
    name, truncated, canonical = state[2], state[3], state[4]
    mine = belongs_to(F.col("repository"), canonical)
    found = search_candidates(captures, name, max(limit, LEAST_FOR_REPOSITORY)).filter(mine)
    keyed = found.withColumn("identity", canonical_name(F.col("name")))
    names = package_names(repository).select(canonical_name(F.col("name")).alias("identity")).distinct()
    fresh = not_yet_known(names, keyed, "identity")
    catalog = captures.crates.filter(mine).withColumn("identity", canonical_name(F.col("name")))
    added = catalog.join(fresh, "identity", "left_semi").select(keyed.columns)
    notes = ["the tree in which manifests were looked for was truncated"] if truncated else []
    if more := added.count():
        notes.append(f"manifests of the default branch added {more} published package(s)")
    top = written(best_candidates(keyed.unionByName(added).drop("identity"), name, limit, canonical), "ranked")
    one = top.count() == 1
    method = f"{prefix}repository_metadata{'' if one else '_ambiguous'}"
    return envelope(query, top if one else top.limit(0), top.limit(0) if one else top, method, notes)


def resolve(captures: Captures, query: str, limit: int = 20, explicit: str | None = None, accept_closest: bool = False) -> DataFrame:
    """One row, as of envelope(): an explicit package, a repository's, the package of this name, that of the one
    repository of this name if the search for it was not bounded, or else packages ranked by likeness, of which the first
    is taken only if it is asked for and clearly ahead."""
    spark = captures.crates.sparkSession
    query = validate_query(query, spark)
    if explicit is not None:
        found = lookup_exact(captures.crates, explicit)
        if found.isEmpty():
            raise LookupError(f"the registry has no package named {explicit}")
        return _exact(query, found, "explicit_crate")
    named = spark.range(1).select(parse_repository(F.lit(query)).alias("r")).first()["r"]
    if named is not None:
        return resolve_repository(captures, query, f"{named['owner']}/{named['name']}", limit)
    found = lookup_exact(captures.crates, query)
    if not found.isEmpty():
        return _exact(query, found, "exact_crate")

    notes = []
    returned = captures.repositories.count()
    total = captures.search_total if captures.search_total is not None else returned
    cut = spark.range(1).select(bounded(F.lit(total), F.lit(returned), F.lit(captures.search_incomplete))).first()[0]
    if cut:
        notes.append(f"the search of repositories by name was bounded: {returned} of {total} results")
    same = [r["full_name"] for r in exact_named(captures.repositories, query).select("full_name").limit(2).collect()]
    if len(same) == 1 and not cut:
        result = resolve_repository(captures, query, same[0], limit, prefix="repository_name_")
        row = result.select("selected", F.size("alternatives").alias("n"), "diagnostics").first()
        if row["selected"] is not None or row["n"]:
            kept = F.concat(F.array(*[F.lit(n) for n in notes]).cast("array<string>"), F.col("diagnostics"))
            return result.withColumn("resolution_method", F.regexp_replace("resolution_method", "^repository_name_repository_", "repository_name_")).withColumn("diagnostics", kept)
        notes += [*row["diagnostics"], FALL_BACK]
    elif same and cut:
        notes.append("the bounded page of results has repositories of this very name, which need not be all; name owner/repo")
    elif len(same) > 1:
        notes.append("several public repositories have this very name; name owner/repo")
    top = written(best_candidates(search_candidates(captures, query, max(limit, LEAST_PER_TERM)), query, limit), "ranked")
    winner = clear_winner(top).first()
    taken = accept_closest and winner["selected"]
    chosen = canonical_name(F.col("name")) == canonical_name(F.lit(winner["name"])) if taken else F.lit(False)
    return envelope(query, top.filter(chosen), top.filter(~chosen), "accepted_closest" if taken else "ranked_suggestions", notes)
