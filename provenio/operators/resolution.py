"""Which package a query means: ranked candidates, and links for a search by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.text import canonical_name, encode_path_segment, form_encode, jaro_winkler, jaro_winkler_bound, pattern_escape, strip_language_affixes
from provenio.functions.urls import parse_repository, repository_key
from provenio.sources.scratch import written

# From which score, and with which lead, a candidate is clearly meant; why a candidate is listed.
HIGH_SCORE, CLEAR_LEAD = 0.85, 0.05
REASONS = ["repository_url", "canonical_name", "repository_affix_normalization", "repository_name_similarity", "crate_name_similarity"]


def _names(query: str, spark) -> tuple[str, str]:
    """A query's canonical name, and that without its affixes."""
    asked = canonical_name(F.lit(query))
    return tuple(spark.range(1).select(asked, strip_language_affixes(asked)).first())


def _judged(crates: DataFrame, query: str, expected_repository: str | None, likeness) -> DataFrame:
    """crates with score and match_reason; likeness(text, column) says how like names are."""
    asked, stem = _names(query, crates.sparkSession)
    # names are worked out once, in columns of their own; likenesses then read columns
    found = crates.withColumns({"_mine": canonical_name(F.col("name")), "_parsed": parse_repository(F.col("repository"))})
    found = found.withColumn("_theirs", canonical_name(F.col("_parsed.name")))
    found = found.withColumn("_core", strip_language_affixes(F.col("_theirs")))
    same = F.lit(False)
    if expected_repository is not None:
        key = F.lower(F.concat_ws("/", "_parsed.owner", "_parsed.name"))
        same = F.coalesce(F.col("_parsed").isNotNull() & (key == repository_key(F.lit(expected_repository))), F.lit(False))
    mine, theirs, core = F.col("_mine"), F.col("_theirs"), F.col("_core")
    found = found.withColumn("_certain", F.when(same, REASONS[0]).when(mine == asked, REASONS[1]).when(mine == stem, REASONS[2]))
    unsure = lambda score: F.when(F.col("_certain").isNull(), score)
    pairs = {"_n1": (asked, mine), "_n2": (stem, mine), "_r1": (asked, theirs), "_r2": (stem, core)}
    found = found.withColumns({k: unsure(likeness(text, c)) for k, (text, c) in pairs.items()})
    found = found.withColumns({"_name": F.greatest("_n1", "_n2"), "_repo": F.coalesce(F.greatest("_r1", "_r2"), unsure(F.lit(0.0)))})
    found = found.drop("_mine", "_parsed", "_theirs", "_core", *pairs)
    reason = F.coalesce("_certain", F.when(F.col("_repo") > F.col("_name"), REASONS[3]).otherwise(REASONS[4]))
    score = (
        F.when(F.col("match_reason").isin(REASONS[:2]), 1.0)
        .when(F.col("match_reason") == REASONS[2], 0.98)
        .when(F.col("match_reason") == REASONS[3], F.col("_repo") * 0.97)
        .otherwise(F.col("_name"))
    )
    return found.withColumn("match_reason", reason).withColumn("score", score)


def rank_candidates(crates: DataFrame, query: str, expected_repository: str | None = None) -> DataFrame:
    """crates (name, repository, downloads, ...) with score and match_reason.

    1.0 for the expected repository or the very name, 0.98 for the name without its affixes, and else the better of
    the names' similarity and, if that is greater, 0.97 of the repository name's.
    """
    judged = _judged(crates, query, expected_repository, lambda text, c: jaro_winkler(F.lit(text), c))
    return judged.drop("_name", "_repo", "_certain")


def best_candidates(crates: DataFrame, query: str, limit: int, expected_repository: str | None = None) -> DataFrame:
    """top_candidates of rank_candidates, without comparing every name: exact all the same.

    A name's score is at most what the characters that it shares with the query allow, which is cheap to tell. The
    `limit` candidates of the greatest bound are compared first; what their least score is, the others must be able to
    reach to be compared at all. The bounds are written once; one scan of them finds the first ones, another the rest.
    """
    most = _judged(crates, query, expected_repository, jaro_winkler_bound)
    # of the two likenesses the name's counts in full where the repository's is not greater
    bound = F.when(F.col("_certain").isNull(), F.greatest(F.col("_name"), F.col("_repo") * 0.97)).otherwise(F.col("score"))
    able = written(most.select(*crates.columns, bound.alias("_bound")), "bounds")
    first = able.orderBy(F.col("_bound").desc(), "name").limit(limit).drop("_bound")
    scores = rank_candidates(first, query, expected_repository).agg(F.min("score"), F.count(F.lit(1))).first()
    least = scores[0] if scores[1] == limit else 0.0
    # bounds are sums in another order than scores: a hair is left between them
    return top_candidates(rank_candidates(able.filter(F.col("_bound") >= least - 1e-9).drop("_bound"), query, expected_repository), limit)


def top_candidates(ranked: DataFrame, limit: int) -> DataFrame:
    """The best candidates in order, with rank."""
    best = ranked.orderBy(F.col("score").desc(), F.col("downloads").desc(), "name").limit(limit)
    order = Window.orderBy(F.col("score").desc(), F.col("downloads").desc(), "name")
    return best.withColumn("rank", F.row_number().over(order))


def clear_winner(top: DataFrame) -> DataFrame:
    """One row (name, selected): the first of ranked candidates, if it scores high and leads clearly."""
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    clear = (first >= HIGH_SCORE) & (second.isNull() | (first - second >= CLEAR_LEAD))
    return top.agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("name"), F.coalesce(clear, F.lit(False)).alias("selected"))


def first_search_hits(hits: DataFrame) -> DataFrame:
    """Hits of several terms (term, rank, name, ...), each package once, by its canonical name."""
    order = Window.partitionBy(canonical_name(F.col("name"))).orderBy("term", "rank")
    return hits.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")


def _search(query: Column) -> Column:
    return F.concat(F.lit("https://github.com/search?type=code&q="), form_encode(query))


def links(name: Column, version: Column, repository: Column) -> Column:
    """struct of search links for the lockfiles and manifests that name an exact version."""
    n, v, pin = pattern_escape(name), pattern_escape(version), pattern_escape(F.concat(F.lit("="), version))
    manifest = lambda wanted: F.concat(
        F.lit("path:/(^|\\/)Cargo\\.toml$/ /"), n, F.lit('\\s*=\\s*(?:\\"'), wanted, F.lit('\\"|\\{[^\\n]*version\\s*=\\s*\\"'), wanted, F.lit('\\")/ NOT is:fork')
    )
    lock = F.concat(F.lit('path:/(^|\\/)Cargo\\.lock$/ /name = \\"'), n, F.lit('\\"\\nversion = \\"'), v, F.lit('\\"/ NOT is:fork'))
    parsed = parse_repository(repository)
    page = F.concat(F.lit("https://github.com/"), parsed["owner"], F.lit("/"), parsed["name"], F.lit("/network/dependents?dependent_type=REPOSITORY"))
    return F.struct(
        name.alias("name"),
        version.alias("version"),
        _search(lock).alias("lockfile_search"),
        _search(manifest(v)).alias("declaration_search"),
        _search(manifest(pin)).alias("exact_pin_search"),
        F.concat(F.lit("https://crates.io/api/v1/crates/"), encode_path_segment(name), F.lit("/reverse_dependencies?page=1&per_page=100")).alias("dependents_api"),
        page.alias("dependents_page"),
        F.lit(False).alias("globally_exhaustive"),
    )
