"""Content-addressed WARC archive: payload bytes once, exact record headers beside them.

Writing a record stores its payload under the SHA-256 of its bytes, once however many
records carry it, and its header bytes as a row of their own with that address.
Among records with equal payloads of at least ``least`` bytes the one with the
largest page_id is a ``response``; the others are ``revisit`` records that refer
to it. Reading joins headers with payloads on the address, rebuilds every original record's bytes
and takes what it returns from those bytes; a payload whose bytes don't match its address or its record's SHA-1
digest, or a block of another length than its record says, is an error, not a row.

Defined results: a null html is an empty payload; a null url has no line of its own; line ends in a url are percent-encoded; record
ids differ between archives; a null page_id counts as the smallest; rows repeated with the same page_id and payload stay apart (one of them is
the response); an empty table gives an empty archive; other columns of the input
play no part. Equal payloads meet only in joins on their address, which Spark can
split, and in maxima, which are taken before the shuffle as well.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import materialize, table

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"


@dataclass(frozen=True)
class Archive:
    """headers (record_id, page_id, address, header bytes) and payloads (address, payload)."""

    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1: five hexadecimal digits make four base-32 digits."""
    digits = F.sha1(payload)
    out = []
    for block in range(8):
        bits = F.conv(F.substring(digits, 5 * block + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(row: Column, archive: str) -> Column:
    """A urn:uuid from the row's number and its archive's name."""
    h = F.md5(F.concat_ws("/", F.lit(archive), row.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def write_archive(pages: DataFrame, least: int = 0, name: str | None = None) -> Archive:
    """Archives (page_id, url, html) rows; record ids follow from ``name``, by default one drawn at random."""
    name = name or uuid.uuid4().hex
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload")
    ).withColumns({"address": F.sha2("payload", 256), "digest": base32_sha1(F.col("payload")), "size": F.length("payload").cast("long")})
    named = materialize(rows.drop("payload"), "warc-rows")
    payloads = materialize(
        pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("address"), "payload").dropDuplicates(["address"]),
        "warc-payloads",
    )
    latest = named.where(F.col("size") >= least).groupBy("address").agg(F.max(F.struct("page_id", "row")).alias("top"))
    joined = named.join(latest, "address", "left").withColumn("revisit", F.coalesce(F.col("top.row") != F.col("row"), F.lit(False)))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    body = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("row"), name)),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("top.row"), name))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page: "), F.col("page_id").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("X-Refers-To-Page: "), F.col("top.page_id").cast("string"))),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    header = F.concat(F.concat_ws(_EOL, *lines), F.lit(_EOL + _EOL))
    headers = materialize(joined.select(F.col("row").alias("record_id"), "page_id", "address", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    return Archive(headers, payloads)


def _field(header: Column, name: str) -> Column:
    """A header line's value; null where the line is absent."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains(header, F.lit(f"{_EOL}{name}: ")), value)


def verified(payloads: DataFrame) -> DataFrame:
    """Payloads, after checking that their bytes give their address."""
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload"))
    return payloads.select("address", F.coalesce(sound, F.raise_error(F.lit("a payload does not match its address")).cast("binary")).alias("payload"))


def records(archive: Archive) -> DataFrame:
    """(record_id, head, record, payload): the original records' bytes, how many of them are the header, and the payload meant.

    A revisit has no block of its own; its payload is that of the record it refers to.
    """
    block = F.when(F.contains(F.decode("header", "UTF-8"), F.lit("WARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    return archive.headers.join(verified(archive.payloads), "address").select(
        "record_id", F.length("header").alias("head"), F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload"
    )


def read_archive(archive: Archive) -> DataFrame:
    """One row per record, read from its rebuilt bytes."""
    text = F.decode(F.substring("record", F.lit(1), F.col("head")), "UTF-8")
    read = records(archive).select(
        "record_id",
        _field(text, "X-Page").cast("long").alias("page_id"),
        _field(text, "WARC-Target-URI").alias("url"),
        _field(text, "WARC-Type").alias("record_type"),
        F.regexp_replace(_field(text, "WARC-Payload-Digest"), "^sha1:", "").alias("said"),
        _field(text, "X-Refers-To-Page").cast("long").alias("refers_to"),
        _field(text, "Content-Length").cast("long").alias("length"),
        (F.length("record") - F.col("head") - 4).alias("held"),
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("digest"),
    )
    wrong = F.when(F.col("said") != F.col("digest"), "a record's digest does not match its payload").when(F.col("length") != F.col("held"), "a record's block is of another length than it says")
    digest = F.when(wrong.isNull(), F.col("digest")).otherwise(F.raise_error(wrong).cast("string"))
    return read.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "record_id")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    out = read_archive(write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
