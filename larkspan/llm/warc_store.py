"""WARC as a content-addressed archive.

Payload bytes are stored once, under their SHA-256; the exact header of each record (WARC header and, in its block, the
HTTP header) is stored separately.  Equal payloads are found by digest and verified by length and a second digest.
Original records come back through a join of headers and payloads, whose bytes are digested again on reading: a response
is header plus payload, a revisit its header alone, which names the response it refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal string."""
    out = []
    for group in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


#: Date of the records where none is given.
DATE = "2020-01-01T00:00:00Z"


def _lines(*lines: Column) -> Column:
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def _record_id(page: Column, serial: Column) -> Column:
    """Unique in the archive, also where page ids repeat or are null."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), serial.cast("string"), F.lit(">"))


def _header(revisit: Column, date: str) -> Column:
    """The exact bytes of a record up to its payload: WARC header, empty line, and the HTTP header that opens the block."""
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=UTF-8"), F.concat(F.lit("Content-Length: "), F.col("n").cast("string")))
    only = lambda c: F.when(revisit, c)  # noqa: E731  concat_ws leaves nulls out
    url = F.replace(F.replace(F.coalesce("url", F.lit("urn:none")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    warc = _lines(
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("serial"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        only(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), only(F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first"), F.col("first_serial")))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
    )
    return F.encode(F.concat(warc, http), "UTF-8")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """Write (records, payloads) to the shared folder and return both as read back.

    records: id, header, digest, is_owner.  payloads: digest, payload.  Of records with equal payloads of at least
    ``least_bytes`` bytes, one with the least id is the response and the others revisit it, rows that repeat that id
    too; rows without an id come last.  A null payload is an empty one, a null URL is ``urn:none``, line ends in URLs
    are percent-encoded, and a character that UTF-8 lacks becomes a question mark.  Extra columns are ignored; empty
    tables give empty archives.
    """
    raw = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), raw.alias("payload"))
    rows = rows.select("id", "url", F.sha2("payload", 256).alias("digest"), base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    rows = materialise(rows.withColumn("serial", F.monotonically_increasing_id()), "warc-digests")  # written, so the serials stay
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "serial")).alias("f")
    same = rows.groupBy("digest").agg(least, F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"))
    verified = F.when((F.col("n0") == F.col("n1")) & (F.col("s0") == F.col("s1")), F.col("f.serial")).otherwise(F.raise_error(F.concat(F.lit("digest collision at "), F.col("digest"))).cast("long"))
    same = materialise(same.select("digest", F.col("f.id").alias("first"), verified.alias("first_serial")), "warc-firsts")
    told = rows.join(same, "digest")
    owner = F.col("serial") == F.col("first_serial")
    revisit = ~owner & (F.col("n") >= least_bytes)
    records = materialise(told.select("id", _header(revisit, date).alias("header"), "digest", owner.alias("is_owner")), "warc-records")
    again = pages.select(F.col(id_col).cast("long").alias("id"), raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    owners = same.select(F.col("digest").alias("_digest"), F.col("first").alias("_first"))
    mine = again.join(owners, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_first")), "left_semi")
    payloads = materialise(mine.select("digest", "payload"), "warc-payloads")
    if payloads.groupBy("digest").count().where("count > 1").limit(1).count():  # only where a page id was repeated
        payloads = materialise(payloads.dropDuplicates(["digest"]), "warc-payloads")
    return records, payloads


def restored(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, record_type, record, payload, digest_ok) of every record as archived.

    ``record`` has the exact bytes, which for a revisit end with the HTTP header; ``payload`` is the payload that the
    record has or refers to, digested again.
    """
    joined = record_fields(records.join(payloads, "digest"))
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    record = F.concat("header", own, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    return joined.select("id", "record_type", "refers_to", record.alias("record"), "payload", (F.sha2("payload", 256) == F.col("digest")).alias("digest_ok"))


def restored_payloads(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_digest) from the rebuilt records of the payloads' owners.

    The payload is cut out of the record's bytes by the lengths that its headers state.
    """
    owners = records.where("is_owner").select("digest", "header")
    joined = owners.join(payloads, "digest")
    text = F.decode("header", "UTF-8")
    block = F.regexp_extract(text, "\\r\\nContent-Length: (\\d+)\\r\\n\\r\\nHTTP/", 1).cast("long")
    head = F.octet_length(F.substring_index(text, "\r\n\r\n", 1)) + 4
    record = F.concat("header", "payload")
    http = F.octet_length("header") - head
    cut = F.substring(record, (head + http + 1).cast("int"), (block - http).cast("int"))
    good = (F.octet_length(record) == head + block) & (F.sha2(cut, 256) == F.col("digest"))
    checked = joined.select("digest", F.when(good, cut).otherwise(F.raise_error(F.lit("a record differs from its header")).cast("binary")).alias("payload"))
    return checked.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def record_fields(records: DataFrame) -> DataFrame:
    """Add record_type and refers_to, parsed from the stored headers."""
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(text, "\\r\\nWARC-Refers-To: <urn:page:(-?\\d+):\\d+>\\r\\n", 1)
    kind = F.regexp_extract(text, "\\r\\nWARC-Type: (\\w+)\\r\\n", 1)
    return records.withColumn("record_type", kind).withColumn("refers_to", F.when(refers != "", refers.cast("long")))
