"""Recursive trees as captured: one JSON document a repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE = "sha string, truncated boolean, tree array<struct<path: string, mode: string, type: string, sha: string, size: long>>, _corrupt string"


@dataclass
class Trees:
    """states: (keys, tree_state, error), a row for every capture; entries: (keys, path, mode, kind, sha, size)."""

    states: DataFrame
    entries: DataFrame


def read_trees(captures: DataFrame, keys: list[str], body: str = "body") -> Trees:
    """The trees in captures (keys, body): `complete`, `truncated`, or `failed`, as data.

    A text that is no JSON object of this form, one without a sha, an entry without path, mode, type or sha, a negative
    size and a missing body are `failed`, and a failed tree has no entries: it is never an empty one. An empty list of
    entries is a complete tree without files; an absent one counts as empty, an absent mark as not truncated. Entries
    come from a typed parse and a lateral explode, in the order of the document.
    """
    parsed = captures.select(*keys, body).withColumn(
        "t", F.from_json(F.col(body), TREE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    odd = lambda e: e.isNull() | e["path"].isNull() | e["mode"].isNull() | e["type"].isNull() | e["sha"].isNull() | (e["size"] < 0)
    error = (
        F.when(F.col(body).isNull(), "no tree was captured")
        .when(F.col("t").isNull() | F.col("t._corrupt").isNotNull(), "the tree does not parse")
        .when(F.col("t.sha").isNull(), "the tree has no sha")
        .when(F.exists("t.tree", lambda e: F.coalesce(odd(e), F.lit(False))), "an entry of the tree is not whole")
    )
    judged = parsed.withColumn("error", error)
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("t.truncated"), "truncated").otherwise("complete")
    entries = judged.filter("error IS NULL").select(*keys, F.explode("t.tree").alias("e"))
    return Trees(
        judged.select(*keys, state.alias("tree_state"), "error"),
        entries.select(*keys, "e.path", "e.mode", F.col("e.type").alias("kind"), "e.sha", "e.size"),
    )


def truncated(state):
    """The scan's mark of a tree: null where it failed."""
    return F.when(state != "failed", state == "truncated")
