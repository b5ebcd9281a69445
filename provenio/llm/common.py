"""What the corpus operators share: word rules, the shared folder, and written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that parts words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Arrow batches of texts and feature sets: a Python worker holds one at a time, and the pools of the JVM keep a few of each size.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder is made and set if the master is local; on a cluster that
    would be another folder on each machine, and is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="provenio-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold within a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    The copy outlives lost executors; its shuffle files go as soon as it is written. Python stages on the way get
    small Arrow batches. What is not read any more can be given to discard().
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {_CLEANUP: "true"} | SMALL_BATCHES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() gave, once nothing that is still to be computed reads them.

    The driver's heap is collected as well: plans of jobs that are over are garbage, which rounds of jobs would otherwise
    pile up until the heap has grown to its limit and stays there.
    """
    spark = None
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            shared = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
            if path.toUri().getPath().startswith(shared.toUri().getPath() + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if spark is not None:
        spark._jvm.System.gc()


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(v) with v bound to value once, so that a lambda inside body does not evaluate it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text, in order; no words: an empty array."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WHITE_CLASS}+"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD_CLASS}+")).cast("long")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, for exchanges that are asked for by hand."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has: helper columns named with it clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def give_back() -> None:
    """At the end of a Python task: hand unused memory of Arrow and of the C library back to the system, as the
    worker lives on and would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
