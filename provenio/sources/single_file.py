"""One ordered file as a data source: tasks write parts, the commit puts the whole in place, an abort leaves the old file."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "single_file"
CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class SingleFileWriter(DataSourceWriter):
    """Parts go to a folder beside the target, one a task; whichever attempt of a task commits names its own part."""

    def __init__(self, target: str, head: str, empty: str, tail: str):
        self.target, self.head, self.empty, self.tail = target, head, empty, tail
        folder = Path(target).parent
        folder.mkdir(parents=True, exist_ok=True)
        self.parts = tempfile.mkdtemp(prefix=f".{Path(target).name}.", dir=folder)

    def write(self, rows) -> Part:
        task = TaskContext.get()
        path = f"{self.parts}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with open(path, "w", encoding="utf-8", newline="") as out:
            for row in rows:
                out.write(row[0])
        return Part(task.partitionId(), path)

    def commit(self, messages: list[Part | None]) -> None:
        """Parts in the order of their partitions, streamed into one file that takes the target's place when it is whole."""
        whole = f"{self.parts}/whole"
        try:
            with open(whole, "wb") as out:
                out.write(self.head.encode())
                start = out.tell()
                for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                    with open(part.path, "rb") as found:
                        shutil.copyfileobj(found, out, CHUNK)
                out.write((self.tail if out.tell() > start else self.empty).encode())
                out.flush()
                os.fsync(out.fileno())
            os.replace(whole, self.target)
        finally:
            shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class SingleFile(DataSource):
    """Options: path, and as JSON texts head, tail (after rows) and empty (in place of rows)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> SingleFileWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("one column of text is written")
        texts = [json.loads(self.options.get(k, '""')) for k in ("head", "empty", "tail")]
        return SingleFileWriter(self.options["path"], *texts)


def write_document(pieces: DataFrame, path: str, order: list[str], text: str = "text", head: str = "", empty: str = "", tail: str = "") -> None:
    """Put the texts of `pieces`, in the order of the columns `order`, into one file at path, whole or not at all.

    Rows are dealt by ranges of the order and sorted within them; each task writes its part to a hidden folder beside the
    target, and only when all have, the driver joins the parts, a megabyte at a time, and renames the result. path must
    be in a folder that the driver and all executors share. A failed job leaves what was there before.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(SingleFile)
    dealt = pieces.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    options = {k: json.dumps(v) for k, v in (("head", head), ("empty", empty), ("tail", tail))}
    dealt.write.format(FORMAT).mode("append").options(path=path, **options).save()


def write_csv_file(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header, rows in order, texts quoted where they must be; no rows: the header alone."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = [quoted(F.lit(c)) for c in df.columns]
    cells = [quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    line = lambda parts: F.concat(F.concat_ws(",", *parts), F.lit("\n"))
    head = df.sparkSession.range(1).select(line(names)).first()[0]
    # a lone empty cell is quoted, else its line would be blank
    only = F.when(F.lit(len(cells) == 1) & (cells[0] == ""), F.lit('""\n')).otherwise(line(cells))
    keys = [f"_order{k}" for k in range(len(order))]
    write_document(df.select(only.alias("text"), *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)]), path, keys, head=head)
