"""Queries over the joins, filters, aggregates and bounded selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenio.operators import aggregates, filters, joins, selection
from provenio.operators.evidence import judgements
from provenio.plans import scan
from provenio.plans.registry import register, table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_ORDER_SQL = ", ".join(LINE_ORDER)


@register(
    "tri_state_any",
    """
    SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'true'
        WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'unknown' ELSE 'false' END AS any_flag,
        CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'true'
        WHEN count(*) FILTER (l_returnflag = 'R') > 0 OR count(*) FILTER (l_linenumber = 7) > 0 THEN 'unknown' ELSE 'false' END AS forced
    FROM lineitem GROUP BY l_orderkey
    """,
)
def tri_state_any(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        aggregates.tri_state(flag).alias("any_flag"),
        aggregates.tri_state(flag, F.col("l_linenumber") == 7).alias("forced"),
    )


@register(
    "optional_class",
    """
    SELECT l_orderkey, CASE WHEN bool_or(o) AND bool_or(NOT o) THEN 'mixed' WHEN bool_or(u) THEN 'unknown'
        WHEN bool_or(o) THEN 'all' ELSE 'none' END AS class
    FROM (SELECT l_orderkey, l_linestatus = 'O' AS o, l_linenumber = 7 AS u FROM lineitem) GROUP BY l_orderkey
    """,
)
def optional_class(spark, sf_dir):
    flags = aggregates.optional_class(F.col("l_linestatus") == "O", F.col("l_linenumber") == 7)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flags.alias("class"))


@register(
    "activity_filter",
    """
    SELECT o_orderkey, (epoch_us(TIMESTAMP '2000-06-01 12:00:00') - epoch_us(o_orderdate)) // 1000000 AS age_seconds,
           (epoch_us(TIMESTAMP '2000-06-01 12:00:00') - epoch_us(o_orderdate)) // 1000000 >= 365 * 86400 AS stale
    FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '2000-06-01'
    """,
)
def activity_filter(spark, sf_dir):
    found = filters.activity(
        F.col("o_orderdate"), F.lit("2000-06-01 12:00:00").cast(dict(table(spark, sf_dir, "orders").dtypes)["o_orderdate"]), 365,
        since=F.lit("1996-01-01").cast("date"), before=F.lit("2000-06-01").cast("date"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", found.alias("a")).filter("a is not null")
    return orders.select("o_orderkey", "a.age_seconds", "a.stale")


@register(
    "staleness",
    """
    SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) // 1000000 AS age_seconds
    FROM events GROUP BY user_id HAVING (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) // 1000000 >= 2 * 86400
    """,
)
def staleness(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = dict(events.dtypes)["ts"]
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    found = filters.activity(F.col("last"), F.lit("2024-01-31 00:00:00").cast(kind), 2, wanted="stale")
    return last.select("user_id", found.alias("a")).filter("a is not null").select("user_id", "a.age_seconds")


@register(
    "strict_fk_join",
    """
    SELECT o_orderpriority, n_name, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY ALL
    """,
)
def strict_fk_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    homes = joins.strict_join(customers, nations, "c_nationkey", "n_nationkey")
    placed = joins.strict_join(orders, homes, "o_custkey", "c_custkey")
    joined = joins.strict_join(lines, placed, "l_orderkey", "o_orderkey")
    return joined.groupBy("o_orderpriority", "n_name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )


@register(
    "enrich_left_fallback",
    """
    SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic,
           CASE WHEN l.doc_id IS NULL THEN 'no label for ' || d.doc_id END AS lookup_error
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def enrich_left_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    error = F.concat(F.lit("no label for "), F.col("doc_id").cast("string"))
    return joins.enrich(docs, table(spark, sf_dir, "labels"), ["doc_id"], {"quality": F.lit(-1), "toxic": F.lit(0)}, error)


@register(
    "dedupe_first",
    """
    SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
    """,
)
def dedupe_first(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = joins.first_wins(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_type", "event_id", "value")


@register(
    "paged_scan",
    """
    SELECT event_id, user_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 100, event_id) AS r FROM events)
    WHERE r = 1 ORDER BY event_id // 100, event_id LIMIT 150
    """,
)
def paged_scan(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    return selection.paged_rows(events, "user_id", "page", "event_id", limit=150).select("event_id", "user_id")


@register(
    "group_candidates",
    """
    WITH c AS (
        SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS name, l_linenumber || '.0.0' AS version, l_partkey % 5 = 0 AS unknown,
               CASE WHEN l_suppkey % 3 = 0 THEN 'missing:s' || l_suppkey || '@' || l_linenumber || '.0.0'
                    ELSE 'github:o' || l_suppkey % 17 || '/r' || l_suppkey % 5 END AS key,
               CASE WHEN l_quantity > 25 THEN NULL ELSE l_partkey % 2 = 0 END AS accepts, l_linestatus = 'O' AS optional, l_returnflag AS kind
        FROM lineitem
    )
    SELECT key, count(*) AS releases, string_agg(DISTINCT name, '|' ORDER BY name) AS dependents,
           string_agg(DISTINCT name || '@' || version, '|' ORDER BY name || '@' || version) AS versions, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds,
           CASE WHEN bool_or(coalesce(accepts, false)) THEN 'true' WHEN bool_or(unknown) OR count(accepts) < count(*) THEN 'unknown' ELSE 'false' END AS any_requirement_accepts,
           CASE WHEN bool_or(optional) AND bool_or(NOT optional) THEN 'mixed' WHEN bool_or(unknown) THEN 'unknown' WHEN bool_or(optional) THEN 'all' ELSE 'none' END AS optional_declarations
    FROM c GROUP BY key
    """,
)
def group_candidates(spark, sf_dir):
    key = F.concat(F.lit("https://github.com/O"), (F.col("l_suppkey") % 17).cast("string"), F.lit("/R"), (F.col("l_suppkey") % 5).cast("string"))
    declaration = F.struct(
        F.lit("dep").alias("alias"), F.lit("dep").alias("package"), F.lit("^1").alias("requirement"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("optional"),
        F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("registry"),
        F.when(F.col("l_quantity") <= 25, F.col("l_partkey") % 2 == 0).alias("accepts"), F.lit(False).alias("exact_pin"),
    )
    candidates = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".0.0")).alias("version"),
        F.when(F.col("l_suppkey") % 3 != 0, key).alias("repository"), F.col("l_orderkey").alias("position"), F.array(declaration).alias("declarations"),
        F.when(F.col("l_partkey") % 5 == 0, "lookup failed").alias("enrichment_error"), F.lit("registry").alias("source"),
    )
    groups = scan.candidate_groups(candidates)
    judged = [judgements()[c].alias(c) for c in ("any_requirement_accepts", "optional_declarations")]
    return groups.select("key", "releases", *[F.array_join(c, "|").alias(c) for c in ("dependents", "versions", "kinds")], *judged)


@register(
    "merge_on_identity",
    """
    SELECT c_custkey % 100 AS identity, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments,
           first(c_name ORDER BY c_custkey) AS name, min(c_custkey) AS position, count(*) AS merged
    FROM customer GROUP BY 1
    """,
)
def merge_on_identity(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 100).alias("identity"), F.array("c_mktsegment").alias("segments"), F.col("c_name").alias("name"), F.col("c_custkey").alias("position")
    )
    merged = joins.merge_on_identity(customers, "identity", "position", ["segments"], ["name"])
    return merged.withColumn("segments", F.array_join("segments", "|"))


@register(
    "overscan_select",
    """
    WITH cut AS (SELECT c_custkey, c_nationkey AS identity, c_custkey % 7 = 0 AS private, row_number() OVER (ORDER BY c_custkey) - 1 AS position
                 FROM customer ORDER BY c_custkey LIMIT 80),
    firsts AS (SELECT identity, min(position) AS p FROM cut WHERE NOT private GROUP BY identity),
    ranked AS (SELECT identity, row_number() OVER (ORDER BY p) AS r, p FROM firsts),
    stop AS (SELECT max(p) // 4 AS last FROM ranked WHERE r = 20 HAVING count(*) > 0)
    SELECT cut.c_custkey, cut.position, coalesce(position // 4 <= last, true) AS considered,
           coalesce(position // 4 <= last, true) AND NOT private AND r <= 20 AS kept
    FROM cut LEFT JOIN ranked ON cut.identity = ranked.identity LEFT JOIN stop ON true
    """,
)
def overscan_select(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("identity"), (F.col("c_custkey") % 7 == 0).alias("private")
    )
    found = selection.overscan(customers, "c_custkey", "identity", "private", most=20, jobs=4)
    return found.select("c_custkey", "position", "considered", F.coalesce("kept", F.lit(False)).alias("kept"))


@register(
    "file_cap",
    f"""
    SELECT l_orderkey, count(*) FILTER (r <= 3) AS selected, count(*) FILTER (r <= 3 AND l_linestatus = 'O') AS locks, bool_or(n > 3) AS over_cap,
           CAST(sum(CASE WHEN r <= 3 THEN l_partkey ELSE 0 END) AS BIGINT) AS part_sum
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus = 'O' DESC, {_ORDER_SQL}) AS r,
                 count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey
    """,
)
def file_cap(spark, sf_dir):
    lock = F.col("l_linestatus") == "O"
    capped = selection.capped_files(table(spark, sf_dir, "lineitem"), "l_orderkey", lock, [F.col(c) for c in LINE_ORDER], cap=3)
    return capped.groupBy("l_orderkey").agg(
        F.count_if("selected").alias("selected"),
        F.count_if(F.col("selected") & lock).alias("locks"),
        F.bool_or("over_cap").alias("over_cap"),
        F.sum(F.when(F.col("selected"), F.col("l_partkey")).otherwise(0)).alias("part_sum"),
    )


@register(
    "greedy_budget",
    f"""
    WITH RECURSIVE items AS (
        SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) AS k, l_partkey % 9 <> 0 AS fetched,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS size, CAST(l_quantity AS BIGINT) AS actual
        FROM lineitem
    ), fold AS (
        SELECT o, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS consumed, false AS hit, CAST(0 AS BIGINT) AS admitted FROM (SELECT DISTINCT o FROM items)
        UNION ALL
        SELECT f.o, i.k,
               f.consumed + CASE WHEN fits AND fetched THEN least(actual, 60 - f.consumed) ELSE 0 END,
               f.hit OR NOT fits, f.admitted + CASE WHEN fits AND fetched THEN 1 ELSE 0 END
        FROM (SELECT f.*, i.k AS next, CASE WHEN i.size IS NULL THEN 60 - f.consumed > 0 ELSE i.size <= 60 - f.consumed AND i.size <= 45 END AS fits
              FROM fold f JOIN items i ON i.o = f.o AND i.k = f.k + 1) f JOIN items i ON i.o = f.o AND i.k = f.next
    )
    SELECT o AS l_orderkey, consumed, hit, admitted FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k DESC) AS r FROM fold) WHERE r = 1
    """,
)
def greedy_budget(spark, sf_dir):
    size = F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity").cast("long"))
    item = F.struct(
        *LINE_ORDER,
        F.col("l_linenumber").alias("key"),
        size.alias("size"),
        F.col("l_quantity").cast("long").alias("actual"),
        (F.col("l_partkey") % 9 != 0).alias("fetched"),
    )
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fold = selection.greedy_budget(F.col("items"), F.lit(60), 45)
    return orders.select("l_orderkey", fold.alias("f")).select(
        "l_orderkey", "f.consumed", "f.hit", F.size("f.admitted").cast("long").alias("admitted")
    )


@register(
    "lock_reservation",
    """
    SELECT l_orderkey, least(CAST(sum(coalesce(CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END, 45)) AS BIGINT), 120) AS reserved
    FROM lineitem GROUP BY l_orderkey
    """,
)
def lock_reservation(spark, sf_dir):
    size = F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(selection.reserved_bytes(size, 45, 120).alias("reserved"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1)"


@register(
    "nearest_root",
    f"""
    WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' ELSE 'c/d/e' END || '/' || page_id % 10 || '/Cargo.toml' AS path FROM pages),
    roots AS (SELECT * FROM (VALUES ('Cargo.toml', ''), ('a/Cargo.toml', 'a'), ('a/b/Cargo.toml', 'a/b'), ('c/d/e/4/Cargo.toml', 'c/d/e/4')) AS r(root_path, dir))
    SELECT page_id, p.path, arg_max(root_path, length(dir)) AS root_path
    FROM p JOIN roots ON dir = '' OR p.path LIKE dir || '/%' GROUP BY page_id, p.path
    """,
)
def nearest_root(spark, sf_dir):
    path = F.expr("CASE page_id % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' ELSE 'c/d/e' END || '/' || page_id % 10 || '/Cargo.toml'")
    members = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.lit(None).cast("string").alias("workspace"))
    rows = [("Cargo.toml", 0), ("a/Cargo.toml", 1), ("a/b/Cargo.toml", 2), ("c/d/e/4/Cargo.toml", 3)]
    roots = spark.createDataFrame(rows, "root_path string, root_position int")
    return joins.nearest_root(members, roots).select("page_id", "path", "root_path")


@register(
    "template_inherit",
    """
    SELECT p_partkey, p_brand, t.p_brand IS NOT NULL AS found, version,
           coalesce(CASE WHEN p_partkey % 3 = 0 THEN true END, t.optional, false) AS optional
    FROM part p LEFT JOIN (SELECT p_brand, min(p_type) AS version, count(*) % 2 = 0 AS optional FROM part WHERE p_size < 40 GROUP BY p_brand
                           HAVING count(*) % 3 <> 0) t USING (p_brand)
    """,
)
def template_inherit(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    templates = (
        part.filter("p_size < 40")
        .groupBy("p_brand")
        .agg(F.min("p_type").alias("version"), F.count(F.lit(1)).alias("n"))
        .filter("n % 3 <> 0")
        .select("p_brand", "version", (F.col("n") % 2 == 0).alias("optional"))
    )
    members = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, True).alias("optional"))
    return joins.inherit_templates(members, templates, ["p_brand"]).select("p_partkey", "p_brand", "found", "version", "optional")


@register(
    "regex_capture_set",
    """
    WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS hit FROM pages)
    SELECT p.page_id, coalesce(string_agg(DISTINCT hit, '|' ORDER BY hit), '') AS captures, bool_or(p.html IS NULL) AS unconditional
    FROM pages p LEFT JOIN c ON p.page_id = c.page_id GROUP BY p.page_id
    """,
)
def regex_capture_set(spark, sf_dir):
    found = aggregates.capture_set(table(spark, sf_dir, "pages"), ["page_id"], "html", 'href="/([A-Za-z]+)"')
    return found.withColumn("captures", F.array_join("captures", "|"))


@register(
    "candidate_filter",
    """
    WITH d AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'dev' ELSE '' END AS kind, l_linestatus = 'O' AS optional,
                      CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey % 2 = 0 END AS accepts FROM lineitem),
    g AS (SELECT l_orderkey, count(*) FILTER (kind <> 'dev' AND NOT optional) AS kept,
                 count(*) FILTER (kind <> 'dev' AND NOT optional AND accepts) AS sure FROM d GROUP BY l_orderkey)
    SELECT l_orderkey, kept FROM g WHERE l_orderkey % 11 <> 0 AND (sure > 0 OR l_orderkey % 13 = 0)
    """,
)
def candidate_filter(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "normal").when(F.col("l_returnflag") == "R", "dev").otherwise("")
    declaration = F.struct(
        kind.alias("kind"),
        (F.col("l_linestatus") == "O").alias("optional"),
        F.when(F.col("l_linenumber") != 1, F.col("l_partkey") % 2 == 0).alias("accepts"),
        F.lit(False).alias("exact_pin"),
    )
    candidates = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(declaration).alias("declarations"))
    candidates = candidates.withColumn("yanked", F.col("l_orderkey") % 11 == 0).withColumn(
        "enrichment_error", F.when(F.col("l_orderkey") % 13 == 0, "lookup failed")
    )
    kept = filters.filter_candidates(candidates, ["normal"], "exclude", "accepts")
    return kept.select("l_orderkey", F.size("declarations").cast("long").alias("kept"))


@register(
    "error_accumulate",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, e AS error_codes, CASE WHEN e <> '' OR l_linestatus = 'O' THEN 'partial' ELSE 'complete' END AS completeness
    FROM (SELECT *, concat_ws(';', CASE WHEN l_returnflag = 'R' THEN 'tree_truncated' END, CASE WHEN l_quantity > 40 THEN 'file_too_large' END,
                 CASE WHEN l_discount > 0.09 THEN 'lookup_failed' END) AS e FROM lineitem)
    """,
)
def error_accumulate(spark, sf_dir):
    codes = aggregates.joined_errors(
        F.when(F.col("l_returnflag") == "R", "tree_truncated"),
        F.when(F.col("l_quantity") > 40, "file_too_large"),
        F.when(F.col("l_discount") > 0.09, "lookup_failed"),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("error_codes", codes)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "error_codes",
        aggregates.completeness(F.col("l_linestatus") == "O", F.col("error_codes")).alias("completeness"),
    )


@register(
    "repository_disposition",
    """
    SELECT CASE WHEN c_custkey % 3 = 0 THEN 'fork' WHEN c_custkey % 5 = 0 THEN 'archived' ELSE 'keep' END AS disposition, count(*) AS n
    FROM customer GROUP BY 1
    """,
)
def repository_disposition(spark, sf_dir):
    kind = filters.disposition(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5 == 0, False, False)
    return table(spark, sf_dir, "customer").groupBy(kind.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "resolved_counts",
    """
    SELECT l_orderkey, count(*) FILTER (l_partkey % 5 = 0) AS occurrences, count(*) FILTER (l_partkey % 5 = 0 AND l_linenumber = 2) AS exact,
           count(*) FILTER (l_partkey % 5 = 0 AND l_returnflag = 'N') AS registry,
           count(*) FILTER (l_partkey % 5 = 0 AND l_linenumber = 2 AND l_returnflag = 'N') AS exact_registry,
           coalesce(string_agg(DISTINCT CASE WHEN l_partkey % 5 = 0 THEN l_linenumber || '.0.0' END, '|' ORDER BY CASE WHEN l_partkey % 5 = 0 THEN l_linenumber || '.0.0' END), '') AS versions,
           coalesce(string_agg(CASE WHEN l_partkey % 5 = 0 THEN l_linenumber || '.0.0@' || l_returnflag END, '|' ORDER BY l_linenumber || '.0.0', l_returnflag), '') AS sources
    FROM lineitem GROUP BY l_orderkey
    """,
)
def resolved_counts(spark, sf_dir):
    packages = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("name"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".0.0")).alias("version"),
        F.col("l_returnflag").alias("source"),
    )
    found = aggregates.resolved_counts(packages, "l_orderkey", "p0", "2.0.0", "N")
    cells = F.transform("sources", lambda s: F.concat_ws("@", s["version"], s["source"]))
    return found.withColumn("versions", F.array_join("versions", "|")).withColumn("sources", F.array_join(cells, "|"))
