"""Search over a catalog by an inverted index of grams: equal to looking for every term in every name and description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.text import canonical_name
from provenio.sources.scratch import written

#: Grams of up to so many characters: a term that is no longer is a gram itself.
GRAM = 3
FIELDS = ("name", "description")


def _field(field: str) -> Column:
    return canonical_name(F.col("name")) if field == "name" else F.lower(F.coalesce("description", F.lit("")))


def _grams(text: Column, shortest: Column | int) -> Column:
    """The distinct grams of a text, from the given length to GRAM."""
    starts = lambda k: F.sequence(F.lit(1), F.greatest(F.char_length(text) - (k - 1), F.lit(1)))
    of = lambda k: F.when(F.char_length(text) >= k, F.transform(starts(k), lambda at: F.substr(text, at, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    low = F.lit(shortest) if isinstance(shortest, int) else shortest
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(low <= k, of(k)).otherwise(none) for k in range(1, GRAM + 1)]))


@dataclass
class CatalogIndex:
    """postings: (field, gram, name), each once, and sizes: (field, gram, n), how many names have a gram."""

    crates: DataFrame
    postings: DataFrame
    sizes: DataFrame


def catalog_index(crates: DataFrame) -> CatalogIndex:
    """The index of a catalog (name, description, ...), names unique; written once, for any number of searches."""
    texts = [crates.select(F.lit(f).alias("field"), F.explode(_grams(_field(f), 1)).alias("gram"), "name") for f in FIELDS]
    postings = written(texts[0].unionByName(texts[1]), "catalog-postings")
    return CatalogIndex(crates, postings, written(postings.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n")), "catalog-sizes"))


def search_index(index: CatalogIndex, terms: DataFrame, limit: int) -> DataFrame:
    """(term, rank, ...) of at most `limit` packages a term (terms: (term)) whose name or description contains it.

    What contains a term has each of its grams, so the postings of one gram hold all that can match: of each term the
    rarest gram is taken, and a term that has one which no name has is done. Only packages of those postings are compared
    with the term. The nearer the match is to the whole name the better the rank; then by downloads and name.
    """
    asked = terms.select("term").filter(F.btrim("term") != "").distinct()
    spread = [asked.select("term", F.lit(f).alias("field"), (canonical_name(F.col("term")) if f == "name" else F.lower("term")).alias("wanted")) for f in FIELDS]
    wanted = spread[0].unionByName(spread[1])
    grams = wanted.select("term", "field", F.explode(_grams(F.col("wanted"), F.least(F.char_length("wanted"), F.lit(GRAM)))).alias("gram"))
    rarest = grams.join(index.sizes, ["field", "gram"], "left").groupBy("term", "field").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    )
    able = index.postings.join(rarest, ["field", "gram"]).select("term", "name").distinct().join(index.crates, "name")
    name, whole = canonical_name(F.col("name")), canonical_name(F.col("term"))
    near = F.when(name == whole, 0).when(name.startswith(whole), 1).when(name.contains(whole), 2).when(_field("description").contains(F.lower("term")), 3)
    found = able.withColumn("_near", near).filter("_near is not null")
    order = Window.partitionBy("term").orderBy("_near", F.col("downloads").desc(), "name")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("term", "rank", *index.crates.columns)
