"""CSV, JSON and Markdown files, put in place whole."""

from __future__ import annotations

import json
import os
import sys
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of facts: a header, every field text, a ragged row an error."""
    options = {"header": "true", "multiLine": "true", "escape": '"', "mode": "FAILFAST", "enforceSchema": "false"}
    return spark.read.options(**options).csv(path).fillna("")


def write_facts(df: DataFrame, folder: str) -> None:
    """Facts as CSV part files in a folder, each with the header: as many as the data needs."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(folder)


def replace_file(path: str, chunks: Iterable[str]) -> None:
    """Write beside the target, flush to disk, rename; `-` is standard output. Folders are made."""
    if path == "-":
        sys.stdout.writelines(chunks)
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.writelines(chunks)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str, value) -> None:
    replace_file(path, [json.dumps(value, indent=2, ensure_ascii=False), "\n"])


def lines_of(df: DataFrame, column: str) -> Iterator[str]:
    """The texts of a column in order, a partition at a time."""
    for row in df.select(column).toLocalIterator():
        yield row[0] + "\n"


def output_identity(path: str, cwd: str) -> str:
    """What a path names, without looking at the disk."""
    return os.path.normpath(os.path.join(cwd, path))


def paths_conflict(a: str, b: str, cwd: str = ".") -> bool:
    """Whether two outputs would be one file; standard output never is."""
    return "-" not in (a, b) and output_identity(a, cwd) == output_identity(b, cwd)
