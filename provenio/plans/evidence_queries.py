"""Queries over parsers, graphs, rankings, reports and the scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenio.functions.text import jaro_winkler
from provenio.operators import resolution
from provenio.operators.graph import confirms, lock_relations
from provenio.plans import report
from provenio.plans.registry import register, table
from provenio.sources import blobs, documents, index, table_functions


@register(
    "lock_relation",
    """
    WITH RECURSIVE e AS (
        SELECT DISTINCT l_orderkey % 300 AS scope, 'o' || l_orderkey AS src, 'p' || l_partkey % 40 AS dst FROM lineitem
        UNION
        SELECT DISTINCT s, 'p' || a, 'p' || a // 2 FROM (SELECT l_orderkey % 300 AS s, unnest([l_partkey % 40, l_partkey % 40 // 2, l_partkey % 40 // 4, l_partkey % 40 // 8, l_partkey % 40 // 16]) AS a FROM lineitem) WHERE a > 0
    ), nodes AS (SELECT scope, src AS node FROM e UNION SELECT scope, dst FROM e),
    roots AS (SELECT scope, node FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.scope = n.scope AND e.dst = n.node)),
    walk AS (
        SELECT scope, node AS root, node, 0 AS depth FROM roots WHERE node <> 'p2'
        UNION
        SELECT w.scope, w.root, e.dst, w.depth + 1 FROM walk w JOIN e ON e.scope = w.scope AND e.src = w.node WHERE w.node <> 'p2'
    ), hits AS (SELECT scope, bool_or(depth = 1) AS d, bool_or(depth > 1) AS t, min(depth) AS depth FROM walk WHERE node = 'p2' GROUP BY scope)
    SELECT s.scope, CASE WHEN NOT s.has THEN 'not_recorded' WHEN d AND t THEN 'both' WHEN d THEN 'direct' WHEN t THEN 'transitive' ELSE 'unclassified' END AS relation,
           h.depth, r.roots, coalesce(d OR t, false) AS confirmed
    FROM (SELECT scope, bool_or(node = 'p2') AS has FROM nodes GROUP BY scope) s LEFT JOIN hits h ON s.scope = h.scope
    LEFT JOIN (SELECT scope, count(*) AS roots FROM roots GROUP BY scope) r ON s.scope = r.scope
    """,
)
def lock_relation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("scope"), "l_orderkey", (F.col("l_partkey") % 40).alias("p"))
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    first = lines.select("scope", name("o", F.col("l_orderkey")).alias("src"), name("p", F.col("p")).alias("dst"))
    chain = lines.select("scope", F.explode(F.array(*[F.floor(F.col("p") / 2**k) for k in range(5)])).alias("a")).filter("a > 0").distinct()
    second = chain.select("scope", name("p", F.col("a")).alias("src"), name("p", F.floor(F.col("a") / 2)).alias("dst"))
    edges = first.unionByName(second)
    nodes = edges.select("scope", F.col("src").alias("node")).unionByName(edges.select("scope", F.col("dst").alias("node"))).distinct()
    found = lock_relations(nodes.withColumn("target", F.col("node") == "p2"), edges, "scope")
    return found.withColumn("confirmed", confirms(F.col("relation")))


@register(
    "lock_text_roundtrip",
    """
    SELECT l_orderkey, count(*) AS packages, count(*) - 1 AS edges, min(l_partkey) AS least, true AS buildable
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey
    """,
)
def lock_text_roundtrip(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ps"))
    package = lambda p, i: F.concat(
        F.lit('[[package]]\nname = "p'), p.cast("string"), F.lit('"\nversion = "1.0.0"\n'),
        F.when(i > 0, F.concat(F.lit('dependencies = ["p'), F.get(F.col("ps"), i - 1).cast("string"), F.lit('"]\n'))).otherwise(""),
    )
    texts = listed.select("l_orderkey", F.array_join(F.transform("ps", package), "\n").alias("text"))
    parsed = documents.lockfiles(texts, ["l_orderkey"])
    return parsed.select(
        "l_orderkey",
        F.size("packages").cast("long").alias("packages"),
        F.size("edges").cast("long").alias("edges"),
        F.array_min(F.transform("packages", lambda p: F.substring(p["name"], 2, 20).cast("long"))).alias("least"),
        "buildable",
    )


_FLATTEN_SQL = """
    SELECT p_partkey, replace(p_name, ' ', '_') AS alias, CASE p_partkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'development' ELSE 'build' END AS kind,
           CASE WHEN p_partkey % 4 = 0 THEN 'cfg(unix)' END AS target, '=' || p_size || '.0.0' AS version, p_partkey % 5 = 0 AS optional
    FROM part
"""


def _manifest_texts(spark, sf_dir):
    kind = "CASE p_partkey % 3 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'dev-dependencies' ELSE 'build_dependencies' END"
    head = f"CASE WHEN p_partkey % 4 = 0 THEN '[target.\"cfg(unix)\".' || {kind} || ']' ELSE '[' || {kind} || ']' END"
    spec = """CASE WHEN p_partkey % 5 = 0 THEN '{ version = "=' || p_size || '.0.0", optional = true }' ELSE '"=' || p_size || '.0.0"' END"""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr(f"{head} || '\\n' || replace(p_name, ' ', '_') || ' = ' || {spec}").alias("text")
    )


@register("manifest_flatten", _FLATTEN_SQL)
def manifest_flatten(spark, sf_dir):
    parsed = documents.manifests(_manifest_texts(spark, sf_dir), ["p_partkey"]).select("p_partkey", F.explode("declarations").alias("d"))
    return parsed.select(
        "p_partkey", "d.alias", "d.kind", "d.target", "d.version", F.coalesce("d.optional", F.lit(False)).alias("optional")
    )


@register("manifest_flatten_in_sql", _FLATTEN_SQL)
def manifest_flatten_in_sql(spark, sf_dir):
    """manifest_flatten as Spark SQL, with a table function beside each text."""
    table_functions.register_table_functions(spark)
    return spark.sql(
        "SELECT t.p_partkey, d.alias, d.kind, d.target, d.version, coalesce(d.optional, false) AS optional FROM {texts} t, LATERAL manifest_declarations(t.text) d",
        texts=_manifest_texts(spark, sf_dir),
    )


@register(
    "index_lines",
    """
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE '^' || CAST(json_extract(props, '$.k') AS VARCHAR) END AS requirement,
           CASE WHEN event_id % 7 = 0 THEN 'malformed line' WHEN event_id % 5 = 0 THEN 'no such release' END AS error
    FROM events
    """,
)
def index_lines(spark, sf_dir):
    line = lambda vers, dep, req: (
        f"""'{{"name":"x","vers":"{vers}","deps":[{{"name":"{dep}","req":"^' || {req} || '","optional":false,"kind":""}}]}}'"""
    )
    k = "get_json_object(props, '$.k')"
    body = f"""concat_ws('\n', CASE WHEN event_id % 7 = 0 THEN '{{oops' ELSE '' END, {line('0.9.0', 'my-dep', "'9'")},
        CASE WHEN event_id % 5 = 0 AND event_id % 7 <> 0 THEN '' ELSE {line('1.0.0', 'My-Dep', k)} END, {line('1.1.0', 'my_dep', "'8'")}, '')"""
    files = table(spark, sf_dir, "events").select("event_id", F.lit("1.0.0").alias("version"), F.expr(body).alias("body"))
    found = index.index_declarations(files, ["event_id"], "version", "my_dep")
    return found.select("event_id", F.get("declarations", F.lit(0))["requirement"].alias("requirement"), "error")


@register(
    "reverse_pages",
    """
    SELECT o_orderkey // 100 AS page, l_orderkey AS version_id, count(*) AS dependencies, any_value(o_orderstatus) AS status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def reverse_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("page", F.floor(F.col("l_orderkey") / 100))
    wanted = lines.groupBy("page").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("id"))).alias("dependencies"))
    orders = table(spark, sf_dir, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 100))
    offered = orders.groupBy("page").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("versions"))
    rows = index.page_rows(wanted.join(offered, "page"), [])
    return rows.groupBy("page", "version_id").agg(F.count(F.lit(1)).alias("dependencies"), F.first("version.status").alias("status"))


@register(
    "blob_contents",
    """
    SELECT doc_id, CASE WHEN size <= 100000 THEN CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '{' || text END END AS data,
           CASE WHEN doc_id % 4 = 3 THEN 'envelope does not decode' WHEN size > 100000 THEN 'over the size cap' END AS error
    FROM (SELECT doc_id, text, strlen(text) + CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS size FROM documents)
    """,
)
def blob_contents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    envelope = F.concat(F.lit('{"encoding":"base64","size":1,"content":"'), F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\\r\\n]", ""), F.lit('"}'))
    body = F.when(kind == 0, F.col("text")).when(kind == 1, envelope).when(kind == 2, F.concat(F.lit("{"), F.col("text"))).otherwise(F.lit('{"encoding":"hex"}'))
    declared = F.when(kind == 3, "application/json; charset=utf-8").otherwise("application/octet-stream")
    found = docs.select("doc_id", blobs.blob_bytes(declared, body.cast("binary"), 100_000).alias("b"))
    return found.select("doc_id", F.col("b.data").cast("string").alias("data"), "b.error")


def _likeness(a: str, b: str) -> str:
    """SQL of Jaro-Winkler, of which the prefix counts only over 0.7: DuckDB has the Jaro similarity."""
    prefix = "CASE " + " ".join(f"WHEN length({a}) >= {k} AND length({b}) >= {k} AND substr({a}, 1, {k}) = substr({b}, 1, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
    return f"(SELECT CASE WHEN j > 0.7 THEN j + ({prefix}) * 0.1 * (1 - j) ELSE j END FROM (SELECT jaro_similarity({a}, {b}) AS j))"


@register("name_similarity", f"SELECT name, round({_likeness("'blue small box'", 'name')}, 9) AS similarity FROM (SELECT DISTINCT p_name AS name FROM part)")
def name_similarity(spark, sf_dir):
    """Jaro-Winkler of distinct part names with one name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.round(jaro_winkler(F.lit("blue small box"), F.col("name")), 9).alias("similarity"))


def _ranked_sql(names: str, query: str, stem: str, repository: bool) -> str:
    """SQL of the ranking of names (name, downloads), canonical as `c`; a repository has its package's name."""
    repo = f"greatest({_likeness(f"'{query}'", 'c')}, {_likeness(f"'{stem}'", 'c')})" if repository else "0.0"
    return f"""
    SELECT name, downloads, reason, CASE reason WHEN 'canonical_name' THEN 1.0 WHEN 'repository_affix_normalization' THEN 0.98
                                               WHEN 'repository_name_similarity' THEN by_repo * 0.97 ELSE by_name END AS score FROM (
        SELECT *, CASE WHEN c = '{query}' THEN 'canonical_name' WHEN c = '{stem}' THEN 'repository_affix_normalization'
                       WHEN by_repo > by_name THEN 'repository_name_similarity' ELSE 'crate_name_similarity' END AS reason FROM (
            SELECT *, greatest({_likeness(f"'{query}'", 'c')}, {_likeness(f"'{stem}'", 'c')}) AS by_name, {repo} AS by_repo
            FROM (SELECT *, replace(lower(name), '-', '_') AS c FROM ({names}))))
    """


@register(
    "fuzzy_rank_topk",
    f"""
    SELECT row_number() OVER (ORDER BY score DESC, downloads DESC, name) AS rank, name, reason AS match_reason, round(score, 9) AS score
    FROM ({_ranked_sql("SELECT replace(p_name, ' ', '-') AS name, sum(p_size) AS downloads FROM part GROUP BY 1", 'rust_small_blue_box', 'small_blue_box', True)})
    ORDER BY 1 LIMIT 10
    """,
)
def fuzzy_rank_topk(spark, sf_dir):
    """The ten best packages for a query."""
    part = table(spark, sf_dir, "part")
    crates = part.groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).agg(F.sum("p_size").alias("downloads"))
    crates = crates.withColumn("repository", F.concat(F.lit("https://github.com/owner/"), "name"))
    top = resolution.best_candidates(crates, "rust-small-blue-box", 10)
    return top.select("rank", "name", "match_reason", F.round("score", 9).alias("score"))


@register(
    "clear_winner",
    f"""
    WITH ranked AS (
        SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS r
        FROM ({_ranked_sql("SELECT DISTINCT replace(p_name, ' ', '-') AS name, 0 AS downloads FROM part", 'small_blue_box', 'small_blue_box', False)})
    )
    SELECT max(name) FILTER (r = 1) AS name,
           coalesce(max(score) FILTER (r = 1) >= 0.85 AND (max(score) FILTER (r = 2) IS NULL OR max(score) FILTER (r = 1) - max(score) FILTER (r = 2) >= 0.05), false) AS selected
    FROM ranked
    """,
)
def clear_winner(spark, sf_dir):
    """The package that a query means, if one scores high and leads clearly."""
    names = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    crates = names.withColumn("downloads", F.lit(0)).withColumn("repository", F.lit(None).cast("string"))
    return resolution.clear_winner(resolution.best_candidates(crates, "small-blue-box", 2))


@register(
    "search_links",
    """
    SELECT p_partkey, 'https://github.com/search?type=code&q=' || replace(replace(url_encode(
               'path:/(^|\\/)Cargo\\.lock$/ /name = \\"' || n || '\\"\\nversion = \\"1\\.2\\.3\\"/ NOT is:fork'), '%20', '+'), '%2A', '*') AS lockfile_search,
           'https://crates.io/api/v1/crates/' || n || '/reverse_dependencies?page=1&per_page=100' AS dependents_api,
           'https://github.com/owner/' || n || '/network/dependents?dependent_type=REPOSITORY' AS dependents_page
    FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)
    """,
)
def search_links(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    found = resolution.links(F.col("n"), F.lit("1.2.3"), F.concat(F.lit("owner/"), F.col("n")))
    return part.select("p_partkey", found.alias("l")).select("p_partkey", "l.lockfile_search", "l.dependents_api", "l.dependents_page")


@register(
    "search_hits_first",
    """
    SELECT canonical, term, rank, name FROM (
        SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY term, rank) AS r FROM (
            SELECT replace(lower(replace(p_name, ' ', '-')), '-', '_') AS canonical, p_brand AS term, p_partkey AS rank, replace(p_name, ' ', '-') AS name FROM part))
    WHERE r = 1
    """,
)
def search_hits_first(spark, sf_dir):
    from provenio.functions.text import canonical_name

    hits = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("term"), F.col("p_partkey").alias("rank"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name")
    )
    return resolution.first_search_hits(hits).select(canonical_name(F.col("name")).alias("canonical"), "term", "rank", "name")


def _inventory(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    version = F.when(F.col("o_custkey") % 4 == 0, F.lit("not_declared")).otherwise(
        F.concat_ws(".", F.lit("1"), (F.col("o_custkey") % 90).cast("string"), F.lit("0"))
    )
    return orders.select(
        F.concat(F.lit("o/r"), F.col("o_orderkey").cast("string")).alias("github_full_name"),
        F.md5(F.col("o_orderkey").cast("string")).alias("head_sha"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("head_committed_at"),
        version.alias("msrv_effective"),
        F.lit("[]").alias("os_observed_targets_json"),
        F.col("o_orderstatus").alias("stale"),
    )


@register(
    "report_grouped",
    """
    SELECT g AS "group", position, line FROM (
        SELECT o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY bad DESC, CASE WHEN bad THEN 0 ELSE o_custkey % 90 END DESC,
                   'o/r' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d')) AS position,
               '| o/r' || o_orderkey || ' | ' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 10) || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | '
               || CASE WHEN bad THEN 'not_declared' ELSE '1.' || o_custkey % 90 || '.0' END || ' | [] |' AS line
        FROM (SELECT *, o_custkey % 4 = 0 AS bad FROM orders))
    """,
)
def report_grouped(spark, sf_dir):
    facts = _inventory(spark, sf_dir)
    report.require_columns(facts, report.TABLE)
    ordered = report.ranked(facts, report.sort_keys("msrv-desc"), F.col("stale"))
    return report.markdown_lines(ordered)


@register(
    "report_json",
    """
    SELECT '' AS "group", row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, 'o/r' || o_orderkey) AS position,
           '{"github_full_name":"o/r' || o_orderkey || '","head_committed_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' AS line
    FROM orders
    """,
)
def report_json(spark, sf_dir):
    facts = _inventory(spark, sf_dir)
    ordered = report.ranked(facts, report.sort_keys("last-commit-desc"))
    return report.json_lines(ordered, ["github_full_name", "head_committed_at"])


_REPORT_SQL = """
    facts AS (
        SELECT coalesce(o_orderstatus, '') AS g, 'o/r' || o_orderkey AS repo, strftime(o_orderdate, '%Y-%m-%d') AS day,
               CASE WHEN o_custkey % 4 = 0 THEN 'not_declared' ELSE '1.' || o_custkey % 90 || '.0' END AS msrv
        FROM orders
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY day, repo) AS position, count(*) OVER (PARTITION BY g) AS n,
               (SELECT min(g) FROM facts) AS first_group, (SELECT max(g) FROM facts) AS last_group FROM facts
    )
"""


@register(
    "report_json_grouped",
    f"""
    WITH {_REPORT_SQL}
    SELECT g AS "group", position,
           CASE WHEN position = 1 AND g = first_group THEN '[' || chr(10) ELSE '' END
           || CASE WHEN position = 1 THEN '  {{' || chr(10) || '    "group": "' || g || '",' || chr(10) || '    "rows": [' || chr(10) ELSE '' END
           || '      {{' || chr(10) || '        "github_full_name": "' || repo || '",' || chr(10) || '        "head_committed_at": "' || day || '",' || chr(10)
           || '        "msrv_effective": "' || msrv || '",' || chr(10) || '        "os_observed_targets_json": "[\\"linux\\"]",' || chr(10)
           || '        "stale": "' || g || '"' || chr(10) || '      }}'
           || CASE WHEN position = n THEN chr(10) || '    ]' || chr(10) || '  }}' ELSE '' END
           || CASE WHEN position = n AND g = last_group THEN chr(10) || ']' ELSE ',' || chr(10) END AS text
    FROM placed
    """,
)
def report_json_grouped(spark, sf_dir):
    facts = _inventory(spark, sf_dir).withColumn("os_observed_targets_json", F.lit('["linux"]')).drop("head_sha")
    return report.json_document(facts, report.sort_keys("last-commit-asc"), facts.columns, F.col("stale"))


@register(
    "report_markdown",
    f"""
    WITH {_REPORT_SQL}
    SELECT g AS "group", position,
           CASE WHEN position = 1 THEN '### ' || g || chr(10) || chr(10) || '| Repository | Last Commit | MSRV | OS | Stale |' || chr(10) || '|---|---|---|---|---|' || chr(10) ELSE '' END
           || '| `' || repo || '` | ' || day || ' | ' || msrv || ' | [] | ' || g || ' |' || chr(10) || CASE WHEN position = n THEN chr(10) ELSE '' END AS text
    FROM placed
    """,
)
def report_markdown(spark, sf_dir):
    return report.markdown_document(_inventory(spark, sf_dir), report.sort_keys("last-commit-asc"), F.col("stale"))


@register(
    "exit_code",
    """
    SELECT event_id, CASE WHEN event_id & 1 > 0 AND event_id & 2 = 0 THEN 4 WHEN event_id & 4 > 0 AND event_id & 8 > 0 THEN 3 ELSE 0 END AS code
    FROM events
    """,
)
def exit_codes(spark, sf_dir):
    from provenio.plans.options import exit_code

    bits = [tuple(bool(n & b) for b in (1, 2, 4, 8)) for n in range(16)]
    codes = F.array(*[F.lit(exit_code(*b)) for b in bits])
    return table(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 16).cast("int")).alias("code"))
