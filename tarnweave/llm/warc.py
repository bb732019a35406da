"""A content-addressed archive of WARC records.

Payload bytes are stored once per SHA-256 digest, the exact header of every
record separately; records are put together again by a join on the digest, and
every stored payload is hashed again when it is read.

An archive is a folder with two Parquet tables: ``headers`` (seq, header,
payload_digest) and ``payloads`` (payload_digest, payload). ``write_warc`` puts
its records together and writes WARC files of them, ``read_warc`` reads WARC files,
and ``records`` says of each record read what its header and its true payload are.

All records of an archive begin with the version and one WARC-Warcinfo-ID, drawn at
random when they are written, so no payload can hold it: files are read record by
record by Spark's text reader with these lines as separator, never whole.

Defined cases: a null payload is empty; a null id sorts after all ids; ids may be of
any type and are read back as strings; rows with one id and one payload are told
apart by their place in the input, the first of them is the response; an empty table
makes an empty archive; columns other than the three named ones are ignored. Payloads
under ``min_bytes`` are never revisits. A record without its whole block, or with
another digest than its header says, fails the job.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnweave.session import broadcast_if_small, settle

#: Digests of repeated payloads up to which only these payloads are brought together.
FEW_REPEATED = 200_000

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def archive_line(archive: str) -> str:
    """The header line that all records of an archive begin with, after the version."""
    return f"WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def record_header(archive: str, kind: Column, record_id: Column, uri: Column, date: str, digest: Column, length: Column, refers_to: Column) -> Column:
    """The header of one record, with the empty line that ends it, as text."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.concat(line("WARC-Refers-To", refers_to), line("WARC-Profile", F.lit(REVISIT_PROFILE)))
    safe_uri = F.replace(F.replace(F.coalesce(uri, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(VERSION + CRLF + archive_line(archive)),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id),
        line("WARC-Target-URI", safe_uri),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.coalesce(revisit, F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def _urn(record: Column, seq: Column) -> Column:
    """A record's name: its id, percent-encoded after an equals sign (nothing where it is null), and its place."""
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.concat(F.lit("="), F.url_encode(record.cast("string"))), F.lit("")), F.lit(":"), seq.cast("string"), F.lit(">"))


def _id_in(urn: Column) -> Column:
    """The id in a record's name, or null."""
    found = F.regexp_extract(urn, r"<urn:record:(=[^:]*)?:", 1)
    return F.when(F.startswith(found, F.lit("=")), F.url_decode(F.substring(found, 2, 1 << 30)))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write one record per row; returns the archive's name. Of equal payloads the record of the smallest id is the response."""
    archive = str(uuid.uuid4())
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8") if dict(pages.dtypes)[payload_col] == "string" else F.col(payload_col), F.lit(b""))
    full = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    full = full.select("id", "uri", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"), "payload")

    keys = settle(full.select(F.monotonically_increasing_id().alias("seq"), "id", "uri", "digest", "n"), "warc-keys")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("seq"))
    repeated = keys.groupBy("digest").agg(F.count("*").alias("times"), F.min(order).alias("first"), F.max("n").alias("n")).where("times > 1")
    repeated = settle(repeated, "warc-repeated")
    first = broadcast_if_small(repeated.where(F.col("n") >= min_bytes).select("digest", "first"))
    again = F.col("first").isNotNull() & (F.col("seq") != F.col("first.seq"))
    header = record_header(
        archive, F.when(again, "revisit").otherwise("response"), _urn(F.col("id"), F.col("seq")), F.col("uri"), date,
        F.col("digest"), F.col("n"), F.when(again, _urn(F.col("first.id"), F.col("first.seq"))),
    )
    headers = keys.join(first, "digest", "left").select("seq", F.encode(header, "UTF-8").alias("header"), F.col("digest").alias("payload_digest"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")

    one = lambda rows: rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    if repeated.limit(FEW_REPEATED + 1).count() <= FEW_REPEATED:
        # payloads that occur once stay where they are
        several = F.broadcast(repeated.select("digest"))
        stored = full.join(several, "digest", "left_anti").select("digest", "payload").union(one(full.join(several, "digest", "left_semi")))
    else:
        stored = one(full)
    stored.withColumnRenamed("digest", "payload_digest").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return archive


def header_field(name: str, header: Column | None = None) -> Column:
    """The value of a header line, or null."""
    header = F.decode(F.col("header"), "UTF-8") if header is None else header
    value = F.regexp_extract(header, rf"(?i)\r\n{re.escape(name)}: *([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; the job fails if one isn't what its digest says."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("payload_digest")
    return stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_digest"))).cast("binary")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(seq, record): the bytes of each record as written. A revisit has no block, so only responses meet the payloads."""
    headers = spark.read.parquet(f"{path}/headers")
    revisit = header_field("WARC-Type") == "revisit"
    whole = headers.where(~revisit).join(verified_payloads(spark, path), "payload_digest").select("seq", F.concat("header", "payload").alias("record"))
    return whole.union(headers.where(revisit).select("seq", "header"))


def write_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 100_000) -> None:
    """Gzipped WARC files of an archive; the two empty lines after a record are the text sink's line separator."""
    lines = reconstruct(spark, path).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(out)


def read_warc(spark: SparkSession, out: str, archive: str | None = None, version: str = VERSION) -> DataFrame:
    """(header, block) of the records in WARC files, plain or compressed, as text and bytes.

    ``archive`` is the name that ``write_archive`` gave. Files of other writers
    are read without it; a block that itself holds a record's beginning then
    fails the job instead of being cut.
    """
    opening = version + CRLF + (archive_line(archive) if archive else "")
    lines = spark.read.option("lineSep", CRLF + CRLF + opening).text(out)
    rest = F.when(F.startswith("value", F.lit(opening)), F.substring(F.col("value").cast("binary"), len(opening) + 1, 1 << 30).cast("string")).otherwise(F.col("value"))
    lines = lines.where(F.trim("value") != "").select(rest.alias("rest"))
    head = F.substring_index("rest", CRLF + CRLF, 1)
    rows = lines.select("rest", head.alias("head"), F.concat(F.lit(opening), head, F.lit(CRLF + CRLF)).alias("header"))
    rows = rows.select("header", F.col("rest").cast("binary").alias("raw"), (F.octet_length("head") + 5).alias("at"), F.coalesce(header_field("Content-Length", F.col("header")).cast("int"), F.lit(0)).alias("size"))
    block = F.substring(F.col("raw"), F.col("at"), F.col("size"))
    short = F.octet_length(block) < F.col("size")
    return rows.select("header", F.when(short, F.raise_error(F.concat(F.lit("cut record "), F.col("header"))).cast("binary")).otherwise(block).alias("block"))


def records(spark: SparkSession, out: str, archive: str | None = None) -> DataFrame:
    """(record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to) of each record in WARC files.

    Size and digest are those of the payload's bytes as read; a revisit has those of the response with its digest.
    """
    field = lambda name: header_field(name, F.col("header"))
    said = F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "")
    rows = read_warc(spark, out, archive).select(
        _id_in(field("WARC-Record-ID")).alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"),
        said.alias("said"), F.sha2("block", 256).alias("own"), F.octet_length("block").cast("long").alias("n"), _id_in(field("WARC-Refers-To")).alias("refers_to"),
    )
    rows = settle(rows, "warc-records")
    wrong = F.when(F.col("own") != F.col("said"), F.raise_error(F.concat(F.lit("damaged payload "), F.col("said"))))
    whole = rows.where("record_type = 'response'")
    whole = whole.select("record_id", "record_type", "target_uri", F.coalesce(wrong.cast("string"), F.col("own")).alias("payload_digest"), F.col("n").alias("payload_bytes"), "refers_to")
    again = rows.where("record_type = 'revisit'")
    sizes = settle(rows.where("record_type = 'response'").groupBy("own").agg(F.max("n").alias("payload_bytes")).join(settle(again.select(F.col("said").alias("own")).distinct(), "warc-revisited"), "own", "left_semi"), "warc-sizes")
    again = again.join(broadcast_if_small(sizes), again["said"] == sizes["own"], "left")
    return whole.union(again.select("record_id", "record_type", "target_uri", F.col("said"), "payload_bytes", "refers_to"))
