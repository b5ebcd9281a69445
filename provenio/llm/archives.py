"""ARC and WARC archives: a converter from the legacy format, a writer and readers.

An archive is one file of bounded size. Spark's text writer puts each in place whole, by its commit protocol, so
that a task that is lost and run again leaves no partial archive; the binary-file reader hands them out again.
Record blocks are cut by their declared lengths alone, never by searching for a separator.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.llm.common import written

#: An archive is closed when it has this many bytes; a longer record has an archive to itself.
ARCHIVE_BYTES = 16 << 20
#: Revisits are broadcast up to so many, which are counted first (some 200 bytes each).
MAX_BROADCAST_REVISITS = 200_000
DEFAULT_DATE = "20000101000000"

# The fields of an ARC record's header line, by version of the format.
ARC_FIELDS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, target_uri string, ip string, date string, "
    "content_type string, block binary, head_bytes long, payload_bytes long, block_digest string, "
    "payload_digest string, page_id long"
)
READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to_id string, "
    "payload_digest string, payload_bytes long, page_id long, refers_to long, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def field(value: str | None, default: str = "-") -> str:
    """A value for a space-parted header line: white space and control characters are percent-encoded."""
    if not value:
        return default
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def http_block(payload: bytes, page_id: int | None) -> bytes:
    """An HTTP response with the payload as its body."""
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload


def http_head(block: bytes) -> tuple[dict[str, str], int]:
    """The header fields of an HTTP response, by lower-case name, and where its body starts."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return {}, 0
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


# ---- ARC


def arc_header(name: str, version: str) -> bytes:
    """The version block that opens an ARC file."""
    about = f"{version} 0 provenio\n{ARC_TITLES[version]}\n".encode()
    values = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": DEFAULT_DATE, "type": "text/plain", "length": str(len(about))}
    values |= {"result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    return " ".join(values[k] for k in ARC_FIELDS[version]).encode() + b"\n" + about


def arc_record(name: str, version: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    values = {"url": url, "ip": "0.0.0.0", "date": date, "type": "text/html", "length": str(len(block))}
    values |= {"result": "200", "checksum": "-", "location": "-", "offset": str(offset), "filename": name}
    return b"\n" + " ".join(values[k] for k in ARC_FIELDS[version]).encode() + b"\n" + block


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an ARC file, its version block first.

    The version block's own line has the fields of either version; its body's first line says which one holds
    for the rest of the file. Several ARC files in a row are read as such.
    """
    at, version = 0, "1"
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes, of which {len(block)} are there")
        if values[0].startswith("filedesc://"):
            version = block.split(b" ", 1)[0].decode()
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        names = ARC_FIELDS[version]
        # a URL may hold spaces in old files: the fields are counted from the right
        fields = dict(zip(names, [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]))
        yield at, fields, block
        at = end + 1 + length


def warc_date(date: str) -> str:
    """An ARC date of up to 14 digits as a WARC date; digits that are missing are those of the year's start."""
    digits = (date if date.isdigit() else "")[:14]
    d = digits + DEFAULT_DATE[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_equivalent(archive: str, offset: int, fields: dict[str, str], block: bytes) -> dict:
    """What the WARC record of an ARC record has: identifier, type, date and digests.

    The identifier is a UUID of the archive's name, the offset and the URL: converting again gives it again.
    """
    head, start = http_head(block)
    url = fields["url"]
    if url.startswith("filedesc://"):
        kind, content_type = "warcinfo", "text/plain"
    elif start:
        kind, content_type = "response", "application/http; msgtype=response"
    else:
        kind, content_type = "resource", fields["type"]
    payload = block[start:]
    return {
        "archive": archive,
        "offset": offset,
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset} {url}')}>",
        "record_type": kind,
        "target_uri": url,
        "ip": fields["ip"],
        "date": warc_date(fields["date"]),
        "content_type": content_type,
        "block": block,
        "head_bytes": start,
        "payload_bytes": len(payload),
        "block_digest": base32_sha1(block),
        "payload_digest": base32_sha1(payload),
        "page_id": number(head.get("x-page-id")),
    }


def _inflated(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)


def _archives(records: Iterator[bytes], header, least: int) -> Iterator[pd.DataFrame]:
    """One row per archive: records are gathered until an archive has `least` bytes."""
    parts: list[bytes] = []
    size = number_of = 0
    for record in records:
        if not parts:
            parts = [header(number_of)]
            number_of += 1
        parts.append(record)
        size += len(record)
        if size >= least:
            yield pd.DataFrame({"archive": [b"".join(parts)]})
            parts, size = [], 0
    if parts:
        yield pd.DataFrame({"archive": [b"".join(parts)]})


def _put(archives: DataFrame, path: str, ending: str) -> None:
    """Write each row as one file; `ending` follows the last record."""
    (
        archives.select(F.col("archive").cast("string").alias("value"))
        .write.option("lineSep", ending)
        .option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .text(path)
    )


def write_arc(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = DEFAULT_DATE,
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write a row each as ARC records, in archives of version 1 and 2 by turns.

    A null payload is empty, a null URL becomes urn:page:<id>.
    """
    narrow = df.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(payload_col).alias("p"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        parts: list[bytes] = []
        size = count = 0
        for batch in batches:
            for page, url, payload in zip(batch["i"].astype(object), batch["u"], batch["p"]):
                page = None if pd.isna(page) else int(page)
                if not parts:
                    name, version = f"pages-{task:06d}-{count:06d}.arc", "12"[(task + count) % 2]
                    parts = [arc_header(name, version)]
                    size, count = len(parts[0]), count + 1
                block = http_block((payload or "").encode(), page)
                parts.append(arc_record(name, version, size, field(url, f"urn:page:{page}"), date, block))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [b"".join(parts)]})
                    parts = []
        if parts:
            yield pd.DataFrame({"archive": [b"".join(parts)]})

    _put(narrow.mapInPandas(pack, "archive binary"), path, "\n")


def convert_arc(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """The records of all ARC files under path with what their WARC equivalents have (RECORD_SCHEMA)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                name, rows, held = "", [], 0
                for offset, fields, block in parse_arc(_inflated(content)):
                    if fields["url"].startswith("filedesc://"):
                        name = fields["url"].removeprefix("filedesc://")
                    row = warc_equivalent(name, offset, fields, block)
                    held += len(block)
                    if not with_blocks:
                        row["block"] = None
                    rows.append(row)
                    if held >= ARCHIVE_BYTES:
                        yield _frame(rows, RECORD_SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, RECORD_SCHEMA)

    return files.mapInPandas(convert, RECORD_SCHEMA)


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    for name in ("page_id", "refers_to", "payload_bytes"):
        if name in frame:
            frame[name] = frame[name].astype("Int64")
    return frame


# ---- WARC


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [WARC_VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by lower-case name, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record starts at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(fields["content-length"])
        block = data[start : start + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes, of which {len(block)} are there")
        yield at, fields, block
        at = start + length


def find_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, first): the records with a payload that a record with a smaller page_id has as well.

    first is the one with the smallest page_id (page_id, record_id, target_uri, date). Payloads are equal when
    their digest and length are. A group is pre-aggregated to one row before its exchange; the join back is on
    the digest, where adaptive execution splits a hot one.
    """
    narrow = records.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)).select(
        "record_id", "page_id", "target_uri", "date", "payload_digest", "payload_bytes"
    )
    narrow = written(narrow, "arc-digests")
    first = F.min(
        F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "target_uri", "date")
    )
    groups = narrow.groupBy("payload_digest", "payload_bytes").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
    again = narrow.join(groups.filter("n > 1").drop("n"), ["payload_digest", "payload_bytes"])
    return again.filter(F.col("record_id") != F.col("first.record_id")).select("record_id", "first")


def write_warc(records: DataFrame, path: str, revisits: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write converted records as WARC; those named in revisits as revisit records, without their payload.

    A revisit keeps its HTTP head, with the payload's length, and the payload's digest. The revisits (narrow rows)
    are broadcast while there are few, which is counted first; beyond that the join is a sort-merge join.
    """
    found = written(revisits, "warc-revisits")
    if found.count() <= MAX_BROADCAST_REVISITS:
        found = F.broadcast(found)
    joined = records.filter("record_type <> 'warcinfo'").join(found, "record_id", "left").select(
        "record_id", "record_type", "target_uri", "ip", "date", "content_type", "block", "head_bytes",
        "block_digest", "payload_digest", "page_id",
        F.col("first.record_id").alias("first_id"), F.col("first.target_uri").alias("first_uri"),
        F.col("first.date").alias("first_date"), F.col("first.page_id").alias("first_page"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()

        def header(k: int) -> bytes:
            name = f"pages-{task:06d}-{k:06d}.warc.gz"
            body = b"software: provenio\r\nformat: WARC File Format 1.1\r\n"
            identifier = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", identifier), ("WARC-Date", warc_date("")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
            return warc_record(about, body)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.astype({"page_id": object, "first_page": object}).itertuples(index=False):
                    block = bytes(r.block)
                    headers = [
                        ("WARC-Record-ID", r.record_id),
                        ("WARC-Date", r.date),
                        ("WARC-Target-URI", r.target_uri),
                        ("WARC-IP-Address", r.ip),
                        ("WARC-Payload-Digest", f"sha1:{r.payload_digest}"),
                        ("Page-Id", None if pd.isna(r.page_id) else str(int(r.page_id))),
                        ("Content-Type", r.content_type),
                    ]
                    if r.first_id is None:
                        headers += [("WARC-Type", r.record_type), ("WARC-Block-Digest", f"sha1:{r.block_digest}")]
                    else:
                        block = block[: r.head_bytes]
                        headers += [
                            ("WARC-Type", "revisit"),
                            ("WARC-Profile", REVISIT_PROFILE),
                            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                            ("WARC-Refers-To", r.first_id),
                            ("WARC-Refers-To-Target-URI", r.first_uri),
                            ("WARC-Refers-To-Date", r.first_date),
                            ("Refers-To-Page-Id", None if pd.isna(r.first_page) else str(int(r.first_page))),
                        ]
                    yield b"\r\n\r\n" + warc_record(headers, block)

        yield from _archives(records(), header, archive_bytes)

    _put(joined.mapInPandas(pack, "archive binary"), path, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all WARC files under path but warcinfo (READ_SCHEMA).

    The digest of a block that is there is computed and must be the declared one; a revisit's payload length is
    that of its HTTP head.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for offset, fields, block in parse_warc(_inflated(content)):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    declared = fields.get("warc-block-digest", "").removeprefix("sha1:")
                    if declared and declared != base32_sha1(block):
                        raise ValueError(f"the block digest of {fields['warc-record-id']} does not hold")
                    head, start = http_head(block)
                    payload = block[start:]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append(
                        {
                            "record_id": fields["warc-record-id"],
                            "record_type": kind,
                            "target_uri": fields.get("warc-target-uri"),
                            "date": fields["warc-date"],
                            "refers_to_id": fields.get("warc-refers-to"),
                            "payload_digest": digest if kind == "revisit" else base32_sha1(payload),
                            "payload_bytes": number(head.get("content-length")) if kind == "revisit" else len(payload),
                            "page_id": number(fields.get("page-id")),
                            "refers_to": number(fields.get("refers-to-page-id")),
                            "payload": payload if with_payload and kind != "revisit" else None,
                        }
                    )
                if rows:
                    yield _frame(rows, READ_SCHEMA)

    return files.mapInPandas(parse, READ_SCHEMA)


def pages_through_archives(df: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages (page_id, url, html) written as ARC, converted to WARC, and read back from there.

    Edge cases: no pages give no archives and no rows; a null html is an empty payload; a null page_id stays null
    and comes last among equals; rows that repeat a page are records of their own, all but one of them revisits;
    extra columns are not read.
    """
    spark = df.sparkSession
    write_arc(df, f"{folder}/arc", archive_bytes=archive_bytes)
    revisits = find_revisits(convert_arc(spark, f"{folder}/arc", with_blocks=False), least_bytes)
    write_warc(convert_arc(spark, f"{folder}/arc"), f"{folder}/warc", revisits, archive_bytes)
    return read_warc(spark, f"{folder}/warc", with_payload=False)
