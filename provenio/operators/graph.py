"""How a lockfile's graph reaches a package."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenio.sources.scratch import scratch_path, written

RELATION = "relation string, depth int, roots long"


def relation_of(nodes: list, targets: list, edges: list[tuple]) -> tuple[str, int | None, int]:
    """(relation, depth, roots) of one graph: nodes, which of them are targets, and (src, dst) edges.

    From all nodes that nothing depends on, level by level, with targets never passed through: direct if an edge from a
    root leads to a target, transitive if a longer path does, both, or unclassified; not_recorded without a target. depth
    is the shortest, 0 for a target that is itself a root. Each node and edge is looked at once, however deep it lies.
    """
    wanted = {n for n, hit in zip(nodes, targets, strict=True) if hit}
    out: dict = {}
    for src, dst in edges:
        out.setdefault(src, []).append(dst)
    reached = {dst for dst in (d for some in out.values() for d in some)}
    roots = [n for n in dict.fromkeys(nodes) if n not in reached]
    if not wanted:
        return "not_recorded", None, len(roots)
    level = [n for n in roots if n not in wanted]
    seen, depth, direct, transitive = set(level), 0, False, False
    shortest = 0 if len(level) < len(roots) else None
    while level:
        depth += 1
        after = []
        for node in level:
            for dst in out.get(node, ()):
                if dst in wanted:
                    direct, transitive = direct or depth == 1, transitive or depth > 1
                    shortest = depth if shortest is None else shortest
                elif dst not in seen:
                    seen.add(dst)
                    after.append(dst)
        level = after
    relation = "both" if direct and transitive else "direct" if direct else "transitive" if transitive else "unclassified"
    return relation, shortest, len(roots)


def relation_column(nodes: Column, targets: Column, src: Column, dst: Column) -> Column:
    """struct(relation, depth, roots) of graphs that stand in arrays, one graph a row."""

    def walk(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for several in batches:
            found = [relation_of(list(n), list(t), list(zip(a, b, strict=True))) for n, t, a, b in zip(*several, strict=True)]
            made = pd.DataFrame(found, columns=["relation", "depth", "roots"])
            yield made.astype({"depth": "Int32", "roots": "int64"})

    walk.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(walk, RELATION)(nodes, targets, src, dst)


def lock_relations(nodes: DataFrame, edges: DataFrame, scope: str, in_task: int = 500_000) -> DataFrame:
    """(scope, relation, depth, roots) for each lockfile. nodes: (scope, node, target); edges: (scope, src, dst).

    A lockfile's graph is no larger than its text, which one task has parsed before: graphs of at most in_task nodes and
    edges are gathered, each into arrays, and walked side by side, a chain of thousands of packages as quickly as a
    bush of them. Graphs that are larger go level by level, all at once, by joins (see by_levels).
    """
    sizes = nodes.select(scope).unionAll(edges.select(scope)).groupBy(scope).agg(F.count(F.lit(1)).alias("_size"))
    large = written(sizes.filter(F.col("_size") > in_task).select(scope), "large-graphs")
    none_large = large.isEmpty()
    few = lambda df: df if none_large else df.join(F.broadcast(large), scope, "left_anti")
    rows = few(nodes).select(scope, F.struct("node", "target").alias("n")).unionByName(
        few(edges).select(scope, F.struct("src", "dst").alias("e")), allowMissingColumns=True
    )
    held = rows.groupBy(scope).agg(F.collect_list("n").alias("n"), F.collect_list("e").alias("e")).filter(F.size("n") > 0)
    walked = held.select(scope, relation_column(F.col("n.node"), F.col("n.target"), F.col("e.src"), F.col("e.dst")).alias("_walked"))
    found = walked.select(scope, "_walked.relation", "_walked.depth", "_walked.roots")
    if none_large:
        return found
    only = lambda df: df.join(F.broadcast(large), scope, "left_semi")
    return found.unionByName(by_levels(only(nodes), only(edges), scope))


def by_levels(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """As lock_relations, for graphs of any size: a join of the newest level a step, over all graphs at once.

    What has been reached is one table that grows by a level at a time, appended to one folder, so that a step's plan
    does not grow with the depth; lost executors cost one level. A root has no edge to it, so what is reached from one is
    a level below it from whichever root it is reached, and which root that is need not be carried.
    """
    spark = nodes.sparkSession
    targets = nodes.filter("target").select(scope, F.col("node").alias("dst"), F.lit(True).alias("hit")).distinct()
    plain = written(edges.select(scope, "src", "dst").distinct().join(targets, [scope, "dst"], "left"), "lock-edges")
    inner = nodes.join(plain.select(scope, F.col("dst").alias("node")).distinct(), [scope, "node"], "left_anti")
    roots = written(inner.groupBy(scope, "node").agg(F.bool_or("target").alias("target")), "lock-roots")
    # only the part of the graphs that has a target at all is walked
    first = roots.join(targets.select(scope).distinct(), scope, "left_semi").select(scope, "node", F.col("target").alias("hit"))
    folder = scratch_path(spark, "reached")
    level = first.withColumn("depth", F.lit(0))
    schema, depth = level.schema, 0
    level.write.parquet(folder)
    while True:
        reached = spark.read.schema(schema).parquet(folder)
        newest = reached.filter((F.col("depth") == depth) & ~F.col("hit"))
        if newest.isEmpty():
            break
        depth += 1
        after = newest.select(scope, F.col("node").alias("src")).join(plain, [scope, "src"]).select(scope, F.col("dst").alias("node"), F.coalesce("hit", F.lit(False)).alias("hit")).distinct()
        # a target may be met again a level deeper: that is how both relations show
        old = reached.filter(~F.col("hit")).select(scope, "node")
        after.join(old, [scope, "node"], "left_anti").withColumn("depth", F.lit(depth)).write.mode("append").parquet(folder)
    found = spark.read.schema(schema).parquet(folder).filter("hit").groupBy(scope).agg(
        F.bool_or(F.col("depth") == 1).alias("_direct"), F.bool_or(F.col("depth") > 1).alias("_transitive"), F.min("depth").alias("depth")
    )
    per_lock = nodes.groupBy(scope).agg(F.bool_or("target").alias("_has"))
    root_counts = roots.groupBy(scope).agg(F.count(F.lit(1)).alias("roots"))
    relation = (
        F.when(~F.col("_has"), "not_recorded")
        .when(F.col("_direct") & F.col("_transitive"), "both")
        .when(F.col("_direct"), "direct")
        .when(F.col("_transitive"), "transitive")
        .otherwise("unclassified")
    )
    joined = per_lock.join(found, scope, "left").join(root_counts, scope, "left")
    return joined.select(scope, relation.alias("relation"), "depth", F.coalesce("roots", F.lit(0)).cast("long").alias("roots"))


def confirms(relation):
    """Whether a relation shows that a package depends on the target; presence alone does not."""
    return relation.isin("direct", "transitive", "both")
