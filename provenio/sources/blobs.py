"""File contents as captured: raw bytes or a JSON envelope with base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenio.functions.text import base64_strict

ENVELOPE = "encoding string, content string, size long"


def blob_bytes(content_type: Column, body: Column, most: int) -> Column:
    """struct(data, error): the bytes of a blob of at most `most` bytes.

    A JSON body is an envelope: one declared by its content type must decode; one that merely starts like JSON and
    does not is raw. The cap holds for declared, decoded and raw sizes.
    """
    text = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    declared = F.coalesce(F.lower(content_type).rlike("^application/([a-z.+-]*\\+)?json\\b"), F.lit(False))
    sniffed = F.coalesce(text.rlike("^\\s*\\{"), F.lit(False))
    envelope = F.from_json(text, ENVELOPE)
    decoded = F.when(F.lower(envelope["encoding"]) == "base64", base64_strict(envelope["content"]))
    too_long = F.when(
        (envelope["size"] > most) | (F.octet_length(decoded) > most) | (decoded.isNull() & (F.octet_length(body) > most)), "over the size cap"
    )
    error = F.coalesce(too_long, F.when(declared & decoded.isNull(), "envelope does not decode"))
    data = F.when(declared | sniffed, F.coalesce(decoded, body)).otherwise(body)
    return F.struct(F.when(error.isNull(), data).alias("data"), error.alias("error"))
