"""Content-addressed web archive.

Two tables: ``payloads`` holds each payload once under its SHA-256, ``headers`` the exact
WARC header of every record with the digest of its payload.  A join rebuilds any record.
Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest page
id is a response and the others are revisits of it; smaller ones are all responses.

Null html counts as an empty payload, null urls as empty ones; control characters in a url
are percent-encoded, so that none can end a header line.  A null page id sorts below all
others and is written as "null"; rows that repeat both largest id and payload are all
responses.  Empty tables give empty archives; payloads of any size stay whole; other columns
are never read.  All of it is DataFrame expressions: the payload shuffles once to be stored
and once to be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

MIN_REVISIT = 1000
_CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _clean_url(url: Column) -> Column:
    out = F.coalesce(url.cast("string"), F.lit(""))
    for code in (13, 10):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(out, r"[\x00-\x1F\x7F]", "")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Write both tables to the shared folder; returns (headers, payloads) as read back."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    payloads = store.keep(rows.groupBy("digest").agg(F.any_value("payload").alias("payload")), "warc-payloads")
    # narrow rows only: digests and lengths, combined before they shuffle
    facts = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1"))
    owners = facts.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("owner"))
    typed = facts.join(owners, "digest", "left").withColumn("revisit", (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("owner")))
    header = F.concat(
        F.lit("WARC/1.1" + _CRLF),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Refers-To", _urn(F.col("owner"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")).cast("string")),
        _line("WARC-Target-URI", _clean_url(F.col("url"))),
        F.lit(_CRLF),
    )
    headers = store.keep(typed.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")), "warc-headers")
    return headers, payloads


def read(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record, payload): every record rebuilt; a digest that differs is an error."""
    sound = F.sha2("payload", 256) == F.col("digest")
    stored = payloads.select("digest", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from digest "), F.col("digest")))).alias("payload"))
    both = headers.join(stored, "digest", "left")
    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest"))))
    revisit = F.col("header").startswith(F.lit(b"WARC/1.1\r\nWARC-Type: revisit\r\n"))
    block = F.when(revisit, F.lit(b"")).otherwise(payload)
    return both.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), payload.alias("payload"))


def fields(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the records."""
    # the header ends at the first empty line; urls hold no control characters
    end = F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")
    head = F.decode(F.substring(F.col("record"), F.lit(1), end + 1), "UTF-8")
    kind = F.regexp_extract(head, r"\r\nWARC-Type: (\w+)\r\n", 1)
    length = F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n", 1).cast("int")
    parsed = records.select("record", "payload", kind.alias("record_type"), F.substring(F.col("record"), end + 4, length).alias("block"), F.regexp_extract(head, r"WARC-Record-ID: <urn:page:([^>]*)>", 1).alias("id"), F.regexp_extract(head, r"WARC-Refers-To: <urn:page:([^>]*)>", 1).alias("to"))
    full = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("block"))
    return parsed.select(
        F.expr("try_cast(id as long)").alias("page_id"),
        F.octet_length(full).cast("long").alias("payload_bytes"),
        F.sha1(full).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(`to` as long)").alias("refers_to"),
    )
