"""Paged results as captured: which pages a bounded scan reads, their items in order, and what the whole says of itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenio.functions.urls import sanitise_url
from provenio.operators.selection import bounded, has_next_page
from provenio.sources.index import page_rows

_CORRUPT = "_corrupt string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
HIT = "path: string, repository: struct<full_name: string, html_url: string, private: boolean>"
LISTING = (
    "dependencies array<struct<id: long, version_id: long, crate_id: string, req: string, optional: boolean, target: string, kind: string, downloads: long>>, "
    "versions array<struct<id: long, crate: string, num: string, yanked: boolean, repository: string>>, meta struct<total: long>"
)


@dataclass
class Paged:
    """rows: items of the pages that were read, with page and position; report: (keys, pages_read, total, returned,
    incomplete, bounded, error), a row for each scan."""

    rows: DataFrame
    report: DataFrame


def _pages_read(metas: DataFrame, keys: list[str], page_size: int, limit: int | None) -> DataFrame:
    """metas: (keys, page, n, fresh, total, broken), a narrow row a page. Of each scan the pages from 1 on, up to the first
    after which there is no next one: it is not full, all that is reported has been seen, the limit is reached, or it is
    broken. n counts records, fresh those that count towards the limit."""
    order = Window.partitionBy(*keys).orderBy("page")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = metas.withColumns({
        "seen": F.sum("n").over(so_far), "held": F.coalesce(F.sum("fresh").over(earlier), F.lit(0)), "known": F.max("total").over(so_far), "in_row": F.row_number().over(order),
    })
    more = has_next_page(F.col("n"), F.col("seen"), F.col("known"), page_size) & ~F.col("broken")
    if limit is not None:
        more = more & (F.col("held") + F.col("fresh") < limit)
    stops = counted.withColumn("more", F.coalesce(more, F.lit(False)) & (F.col("page") == F.col("in_row")))
    gone_on = F.coalesce(F.min(F.col("more").cast("int")).over(earlier), F.lit(1)) == 1
    return stops.withColumn("_read", gone_on & (F.col("page") == F.col("in_row"))).filter("_read").drop("_read", "in_row")


def _report(scans: DataFrame, read: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """One row a scan; the page after the last one that says there are more is missing where the capture ends early."""
    last = read.groupBy(*keys).agg(
        F.max("page").alias("pages_read"), F.max("known").alias("total"), (F.max("held") + F.max_by("fresh", "page")).alias("returned"),
        F.bool_or("incomplete").alias("incomplete"), F.bool_or("broken").alias("broken"), F.max_by("more", "page").alias("more"),
    )
    whole = scans.join(last, keys, "left")
    error = F.when(F.col("broken"), "a page does not parse").when(F.col("pages_read").isNull() | F.col("more"), "a page was not captured")
    returned = F.coalesce(F.col("returned") if limit is None else F.least(F.col("returned"), F.lit(limit)), F.lit(0))
    kept = F.when(error.isNull(), returned).otherwise(0)
    known, incomplete = F.coalesce("total", F.lit(0)), F.coalesce("incomplete", F.lit(False)) | error.isNotNull()
    return whole.select(
        *keys, F.coalesce("pages_read", F.lit(0)).alias("pages_read"), known.alias("total"), kept.cast("long").alias("returned"), incomplete.alias("incomplete"),
        bounded(known, kept, incomplete).alias("bounded"), error.alias("error"),
    )


def search_pages(captures: DataFrame, keys: list[str], item: str, limit: int, most_on_a_page: int = 100) -> Paged:
    """The items (fields of `item`) of captured searches, at most limit each.

    captures: (keys, page, body), pages from 1, each a JSON object with total_count, incomplete_results and items. The
    total is the greatest that a page reports. Which pages are read is decided on the pages' sizes; the items of others
    are never parsed or moved. A search with a page that is broken or missing has no items, and is incomplete.
    """
    size = min(limit, most_on_a_page)
    heads = captures.select(*keys, "page", F.from_json("body", f"total_count long, incomplete_results boolean, items array<string>, {_CORRUPT}", _OPTIONS).alias("h"))
    broken = F.col("h").isNull() | F.col("h._corrupt").isNotNull() | F.col("h.total_count").isNull() | F.col("h.incomplete_results").isNull() | F.col("h.items").isNull()
    n = F.when(broken, 0).otherwise(F.size("h.items")).cast("long")
    metas = heads.select(
        *keys, "page", n.alias("n"), n.alias("fresh"), F.coalesce("h.total_count", F.lit(0)).alias("total"), F.coalesce("h.incomplete_results", F.lit(False)).alias("incomplete"), broken.alias("broken")
    )
    read = _pages_read(metas, keys, size, limit)
    report = _report(captures.select(*keys).distinct(), read, keys, limit)
    sound = read.join(report.filter("error IS NULL").select(*keys), keys, "left_semi").select(*keys, "page", "held")
    items = F.from_json("body", f"items array<struct<{item}>>")["items"]
    rows = captures.join(sound, [*keys, "page"]).select(*keys, "page", "held", F.posexplode(items).alias("at", "item"))
    position = (F.col("held") + F.col("at")).cast("long")
    return Paged(rows.select(*keys, "page", position.alias("position"), "item.*").filter(F.col("position") < limit), report)


def code_hits(captures: DataFrame, limit: int) -> Paged:
    """Code-search hits (query, path, full_name, html_url, private), as the scan takes them, of captures by query."""
    found = search_pages(captures, ["query"], HIT, limit)
    fields = [F.col(f"repository.{c}").alias(c) for c in ("full_name", "html_url")]
    private = F.coalesce("repository.private", F.lit(False)).alias("private")
    return Paged(found.rows.select("query", "page", "position", "path", *fields, private), found.report)


def listing_pages(captures: DataFrame, page_size: int, limit: int | None = None) -> Paged:
    """A registry's listing of dependents from captured pages (page, body): each release once, where it comes first.

    rows: (name, version, version_id, repository, yanked, downloads, position, page, listed), as published_candidates()
    takes them; listed is what the page shows of the dependency. The limit counts releases, the end of the listing
    records: pages after the one that fills the limit are not read. A dependency whose version is not on its page, or
    is there twice, is an error, and so is a page that is broken or missing.
    """
    parsed = captures.select(F.lit(0).alias("one"), "page", F.from_json("body", f"{LISTING}, {_CORRUPT}", _OPTIONS).alias("h"))
    broken = F.col("h").isNull() | F.col("h._corrupt").isNotNull() | F.col("h.dependencies").isNull() | F.col("h.meta.total").isNull()
    ids = parsed.select("page", F.explode("h.dependencies.version_id").alias("version_id")).groupBy("version_id").agg(F.min("page").alias("page"))
    new = ids.groupBy("page").agg(F.count(F.lit(1)).alias("_new"))
    metas = parsed.join(new, "page", "left").select(
        "one", "page", F.coalesce(F.size("h.dependencies"), F.lit(0)).cast("long").alias("n"), F.coalesce("_new", F.lit(0)).alias("fresh"),
        F.coalesce("h.meta.total", F.lit(0)).alias("total"), F.lit(False).alias("incomplete"), broken.alias("broken"),
    )
    read = _pages_read(metas, ["one"], page_size, limit)
    report = _report(parsed.sparkSession.range(1).select(F.lit(0).alias("one")), read, ["one"], limit)
    wanted = parsed.join(read.select("page"), "page", "left_semi").select("page", "h.dependencies", "h.versions")
    rows = page_rows(wanted, [])
    first = Window.partitionBy("version_id").orderBy("page", "position")
    once = rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    # within a page the first records of releases that no earlier page has are numbered; the pages before add up in `held`
    numbered = once.join(read.select("page", "held"), "page").withColumn("_in", F.row_number().over(Window.partitionBy("page").orderBy("position")) - 1)
    listed = F.struct(F.col("req").alias("requirement"), F.coalesce("kind", F.lit("normal")).alias("kind"), F.coalesce("optional", F.lit(False)).alias("optional"), "target")
    found = numbered.select(
        F.col("version.crate").alias("name"), F.col("version.num").alias("version"), "version_id", sanitise_url(F.col("version.repository")).alias("repository"),
        F.coalesce("version.yanked", F.lit(False)).alias("yanked"), F.coalesce("downloads", F.lit(0)).alias("downloads"), (F.col("held") + F.col("_in")).cast("long").alias("position"),
        "page", listed.alias("listed"),
    )
    return Paged(found if limit is None else found.filter(F.col("position") < limit), report.drop("one"))
