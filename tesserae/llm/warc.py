"""WARC archives from legacy ARC archives: conversion by declared lengths, revisit records, reading back.

ARC files (versions 1 and 2) are parsed by the fields of their own version block and by declared lengths;
every record becomes an equivalent WARC/1.1 record with a name-based UUID, an ISO timestamp, a type (response for
http, metadata for dns, resource otherwise, warcinfo for the version block) and SHA-256 digests of block and payload.
Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page id stays a
response and the others become revisit records that name it.

Archives are written by Spark's text writer into the shared folder, record by record: an ARC record ends with a line
feed and a WARC record with two line ends, which are the writer's line separators. An ARC file is as large as a partition of the
pages, a WARC file holds about FILE_BYTES of payloads; reading parses the decompressed stream of one file record by record.
The payload is shuffled once, by record id.

Records that can't be read give a row of type rejected with the reason and end nothing: a header line without its fields or a
length is skipped up to the next line that is one, a record shorter than declared ends its file, and so does a WARC record
without a length; a digest that differs rejects the record alone. An ARC URL may hold blanks, for the other fields are counted
from the end, and header bytes that aren't UTF-8 are replaced. convert() returns what it rejected.

Defined cases: null html is an empty payload; a null url gets a urn; rows without a page id are archived, are never the
record that others refer to if one with an id exists, and read back with a null id; repeated rows are separate
records; an empty table gives empty archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import cleaned, fresh_path, partitions, stored

MIN_REVISIT, DATE = 100, "20260101000000"
#: The header fields of either version of the ARC format, in their order.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fixed value: the profile of a revisit of an identical payload, WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
BATCH, FILE_BYTES = 8 << 20, 256 << 20
#: The header of a record's own length of the payload, which revisits don't hold.
LENGTH = "X-Payload-Length"


def arc_header(version: int, values: dict[str, str]) -> str:
    return " ".join(values.get(f, "-") or "-" for f in ARC_FIELDS[version])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> None:
    """ARC files of pages, one for each partition; their versions alternate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"part-{part}.arc"
        about = f"{version} 0 tesserae\n{' '.join(ARC_FIELDS[version])}\n"
        first, offset = f"{arc_header(version, {'URL': f'filedesc://{name}', 'IP-address': '0.0.0.0', 'Archive-date': date, 'Content-type': 'text/plain', 'Result-code': '200', 'Offset': '0', 'Filename': name, 'Archive-length': str(len(about))})}\n{about}", 0
        for batch in batches:
            rows = [] if first is None else [first]
            offset += 0 if first is None else len(first) + 1
            first = None
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                body = (h or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n" + ("" if i is None else f"X-Page-Id: {i}\r\n") + "\r\n"
                values = {"URL": quote(u, safe="%/:=&?~#+!$,;'@()*[]") if u else f"urn:page:{i}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Offset": str(offset), "Filename": name, "Archive-length": str(len(head) + len(body))}
                line = arc_header(version, values)
                rows.append(f"{line}\n{head}{h or ''}")
                offset += len(line) + len(head) + len(body) + 2
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    # these files are read twice and thrown away: the quickest compression is the right one
    rows.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Rejected(ValueError):
    """A record that can't be read."""


def arc_fields(line: bytes, fields: tuple[str, ...]) -> dict[str, str] | None:
    """The fields of a header line, None where it isn't one. The first, the URL, may hold blanks."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    record = dict(zip(fields, values))
    right = len(values) == len(fields) and values[0] and re.fullmatch(r"[0-9]{8,14}", record["Archive-date"]) and re.fullmatch(r"[0-9]{1,18}", values[-1])
    return record if right else None


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes] | Rejected]:
    """(header fields, content) of each record of an ARC stream, the version block first; what can't be read as Rejected."""
    fields, skipped = ARC_FIELDS[1], b""
    while line := stream.readline():
        if not line.strip() and not skipped:
            continue
        first = line.startswith(b"filedesc:")
        if first:
            fields = ARC_FIELDS[2] if len(line.split(b" ")) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
        record = arc_fields(line, fields)
        if record is None:
            skipped = skipped or line
            continue
        if skipped:
            yield Rejected(f"no header line of {len(fields)} fields: {skipped[:80]!r}")
            skipped = b""
        try:
            content = _exactly(stream, int(record[fields[-1]]))
        except Rejected as e:
            yield e
            return
        if first:
            named = tuple(content.decode("utf-8", "replace").split("\n")[1:2])
            fields = tuple(named[0].split(" ")) if named and named[0].endswith("Archive-length") else fields
        yield record, content
    if skipped:
        yield Rejected(f"no header line of {len(fields)} fields: {skipped[:80]!r}")


def _exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    content = stream.read(n)
    if len(content) != n:
        raise Rejected(f"{n} bytes were declared and {len(content)} are there")
    return content


def timestamp(date: str) -> str:
    """An ARC date of 8, 12 or 14 digits as a WARC date."""
    d = (date + "000000")[:14] if len(date) < 14 else date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(header block with its empty line, payload) of a stored HTTP response; without a header all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (content, b"")


def http_field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


CONVERTED = "record_id string, type string, target string, date string, ip string, content_type string, page_id long, payload_digest string, payload_bytes long, reason string, head binary, payload binary"


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def converted(fields: dict[str, str], content: bytes, source: str, place: int) -> tuple:
    """The WARC equivalent of one ARC record, in the order of CONVERTED."""
    url = fields["URL"]
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if url.startswith(("http:", "https:")) or content.startswith(b"HTTP/") else "metadata" if url.startswith("dns:") else "resource"
    head, payload = split_http(content) if kind == "response" else (b"", content)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{source} {place} {url} {fields['Archive-date']}")
    page = http_field(head, b"X-Page-Id") if head else None
    mime = "application/http; msgtype=response" if kind == "response" else "application/warc-fields" if kind == "warcinfo" else fields.get("Content-type", "application/octet-stream")
    return (f"<urn:uuid:{name}>", kind, url, timestamp(fields["Archive-date"]), fields.get("IP-address"), mime, number(page), hashlib.sha256(payload).hexdigest(), len(payload), None, head, payload)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _parsed(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """One row for each record; rows_of(stream, path) yields (row, bytes held)."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                stream = io.BytesIO(content.as_buffer())
                for row, size in rows_of(gzip.GzipFile(fileobj=stream) if path.as_py().endswith(".gz") else stream, path.as_py()):
                    rows.append(row)
                    held += size
                    if held > BATCH or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    return files.mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The WARC equivalents of all records of the ARC files; without payload the last two columns are left out."""

    def rows_of(stream, source: str) -> Iterator[tuple]:
        for place, record in enumerate(arc_records(stream)):
            if isinstance(record, Rejected):
                row, size = (f"{source} {place}", "rejected", None, None, None, None, None, None, None, str(record), None, None), 0
            else:
                row, size = converted(*record, source, place), len(record[1])
            yield (row if payload else row[:-2]), size * payload + 200

    return _parsed(_files(spark, path), rows_of, CONVERTED if payload else CONVERTED.rsplit(", ", 2)[0])


def revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(record_id, refers_to, refers_target, refers_date) of each response whose payload an earlier one has."""
    rows = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("record_id").alias("refers_to"), F.col("target").alias("refers_target"), F.col("date").alias("refers_date"))
    first = stored(rows.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first.refers_to", "first.refers_target", "first.refers_date"), "warc")
    return rows.select("record_id", "payload_digest").join(first, "payload_digest").where("record_id <> refers_to").drop("payload_digest")


def write_warc(records: DataFrame, heads: DataFrame, marked: DataFrame, path: str) -> None:
    """WARC files of converted records; heads are the same without payloads; those in marked become revisit records."""
    # payloads are dealt to as many files as their bytes need, whatever the number of shuffle partitions
    size = heads.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    n = max(partitions(records.sparkSession), -(-size // FILE_BYTES))
    rows = records.where("reason is null").repartition(n, "record_id").join(marked.hint("shuffle_hash"), "record_id", "left")
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))

    def line(name: str, value: Column | str) -> Column:
        value = F.lit(value) if isinstance(value, str) else value
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    rows = rows.withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise(F.col("type"))), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        F.when(F.col("type") != "warcinfo", F.concat(line("WARC-Target-URI", F.col("target")), line("WARC-IP-Address", F.col("ip")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.when(F.col("type") == "response", F.concat(F.lit("sha256:"), F.col("payload_digest")))), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        F.when(again, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("refers_target")), line("WARC-Refers-To-Date", F.col("refers_date")))).otherwise(F.lit("")),
        line("Content-Type", F.col("content_type")), line(LENGTH, F.when(F.col("type") == "response", F.col("payload_bytes").cast("string"))), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("block")).cast("string")
    with cleaned(records.sparkSession):
        rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes] | Rejected]:
    """(header fields, block) of each record of a WARC stream, by declared lengths; what can't be read as Rejected."""
    skipped = b""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            skipped = skipped or line.strip()
            continue
        if skipped:
            yield Rejected(f"no WARC record begins with {skipped[:80]!r}")
            skipped = b""
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = number(fields.get("content-length"))
        if size is None:
            yield Rejected(f"{fields.get('warc-record-id')}: no length")
            continue
        try:
            yield fields, _exactly(stream, size)
        except Rejected as e:
            yield e
    if skipped:
        yield Rejected(f"no WARC record begins with {skipped[:80]!r}")


READ = "record_id string, type string, page_id long, payload_digest string, payload_bytes long, refers_to string, reason string"


def warc_row(fields: dict[str, str], block: bytes) -> tuple:
    """A record in the order of READ; digests of blocks and whole payloads are computed again and compared."""
    name, kind, digest = fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-payload-digest", "")
    stated = fields.get("warc-block-digest")
    if stated and stated.startswith("sha256:") and "sha256:" + hashlib.sha256(block).hexdigest() != stated:
        raise Rejected(f"{name}: the block's digest differs")
    head, payload = split_http(block) if kind in ("response", "revisit") else (b"", block)
    if kind == "response" and digest.startswith("sha256:") and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise Rejected(f"{name}: the payload's digest differs")
    size = len(payload) if kind != "revisit" else number(fields.get(LENGTH.lower()) or http_field(head, b"Content-Length"))
    return name, kind, number(http_field(head, b"X-Page-Id")), digest.partition(":")[2], size, fields.get("warc-refers-to"), None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ columns of each record, and of each that can't be read (type rejected, with the reason)."""

    def rows_of(stream, _: str) -> Iterator[tuple]:
        for record in warc_records(stream):
            try:
                if isinstance(record, Rejected):
                    raise record
                yield warc_row(*record), 300
            except Rejected as e:
                yield (None if isinstance(record, Rejected) else record[0].get("warc-record-id"), "rejected", None, None, None, None, str(e)), 300

    return _parsed(_files(spark, path), rows_of, READ)


def convert(spark: SparkSession, arc: str, warc: str, least: int = MIN_REVISIT) -> DataFrame:
    """WARC files in warc from the ARC files in arc; returns (record_id, reason) of what can't be read."""
    heads = stored(read_arc(spark, arc, payload=False), "warc")
    write_warc(read_arc(spark, arc), heads, stored(revisits(heads, least), "warc"), warc)
    return heads.where("reason is not null").select("record_id", "reason")


def archived(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Pages through ARC and WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, id_col, url, html)
    rejected = convert(spark, arc, warc, least).select("reason")
    rows = stored(read_warc(spark, warc).where("type in ('response', 'revisit', 'rejected')"), "warc")
    rejected = rejected.unionByName(rows.where("reason is not null").select("reason")).limit(3).collect()
    if rejected:  # these archives are this function's own, so nothing in them may be lost
        raise Rejected("; ".join(r["reason"] for r in rejected))
    used = rows.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    named = stored(rows.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first")).join(used, "refers_to").drop("n"), "warc")
    found = rows.join(named, "refers_to", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("first").alias("refers_to"))
