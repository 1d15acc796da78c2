"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, and WARC read back.

An ARC file begins with a record that names its version and the fields of all header lines: five in version 1, ten
in version 2. Each record is such a line and as many bytes as its last field declares; readers rely on that length
alone, so that payloads may hold anything. WARC records get what ARC lacks: an identifier (from the
file and the place in it, hence the same in a second run), a timestamp in ISO 8601 (from 14 digits), a type and
SHA-1 digests of block and payload. Of records with equal payloads the first in a given order is a response
(or resource), the others revisit it.

Archives are written and read by Spark's own sources, so that any file system it knows will do and a lost task is
repeated: one row of text is a record without its last line feed. Files have ``per_file`` records at most and begin with
the record that describes them. Parsing goes on while a file is decompressed and holds one record at a time.

Defined results: null payloads are empty; white space and control characters in URLs are percent-encoded; a null URL becomes
``urn:record:`` and the key. Records with equal keys and payloads: the one that stands first in the archives is the response. Records without a key come
last in the order. Broken archives (a line with too few fields, fewer bytes than declared, a digest that does not
match) raise ValueError with file and place. An empty table gives an archive without records; other columns are not written.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from base64 import b32encode
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, materialise

#: Fixed by the formats: the fields of a header line by version, what marks a revisit, the header that carries a record's key.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
NO_IP = "0.0.0.0"


@dataclass(frozen=True)
class Archives:
    per_file: int = 4000
    compression: str = "gzip"
    #: Smaller payloads never revisit another.
    least_bytes: int = 0
    software: str = "typeloom"


def _write_rows(rows: DataFrame, record: Column, first: Column, path: str, spec: Archives) -> None:
    """One file for each ``per_file`` rows of a partition, ``first`` before the first row's record."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    text = F.concat(F.when(row % spec.per_file == 0, first).otherwise(F.lit("")), record)
    options = {"compression": spec.compression, "maxRecordsPerFile": spec.per_file}
    rows.select(text.alias("value")).write.options(**options).text(path)


def url_text(url: Column) -> Column:
    """A URL without white space and control characters."""
    coded = url
    for code in (*range(0x21), 0x7F):
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), coded).otherwise(url)


def write_arc(rows: DataFrame, path: str, spec: Archives, version: Column | None = None) -> None:
    """Writes ``rows`` (key, url, date of 14 digits, payload string) as HTTP responses.

    ``version`` (1 or 2) has to be the same in all rows of a partition; by default partitions take turns.
    """
    v = version if version is not None else F.spark_partition_id() % 2 + 1
    payload = F.coalesce(F.col("payload"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit(f"{KEY_HEADER}: "), F.col("key").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    url = F.coalesce(url_text(F.col("url")), F.concat(F.lit("urn:record:"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    common = F.concat_ws(" ", url, F.lit(NO_IP), F.col("date"), F.lit("text/html"))
    later = F.when(F.col("v") == 1, F.lit(" ")).otherwise(F.lit(" 200 - - 0 - "))
    length = (F.octet_length(F.col("head")) + F.octet_length(payload)).cast("string")
    record = F.concat(common, later, length, F.lit("\n"), F.col("head"), payload)
    blocks = {n: f"{n} 0 {spec.software}\n{' '.join(FIELDS[n])}\n" for n in FIELDS}
    first = {n: f"filedesc://{spec.software}.arc {NO_IP} 19960101000000 text/plain {'200 - - 0 - ' if n == 2 else ''}{len(b)}\n{b}\n" for n, b in blocks.items()}
    _write_rows(rows.withColumns({"v": v, "head": head}), record, F.when(F.col("v") == 1, F.lit(first[1])).otherwise(F.lit(first[2])), path, spec)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


class Broken(ValueError):
    def __init__(self, path: str, at: int, what: str):
        super().__init__(f"{path}, record {at}: {what}")


def _taken(stream: io.BufferedIOBase, size: int, path: str, at: int) -> bytes:
    block = stream.read(size)
    if len(block) < size:
        raise Broken(path, at, f"{size} bytes are declared, {len(block)} are left")
    return block


def arc_records(path: str, stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Number, header fields and block of each record but the one that describes the file."""
    names, at = FIELDS[1], 0
    while line := stream.readline():
        if not (line := line.strip(b"\r\n")):
            continue
        described = at == 0 and line.startswith(b"filedesc://")
        # A URL may hold spaces in careless archives: fields are counted from the right. The length comes last in both versions.
        length = line.rsplit(b" ", 1)[-1]
        if not length.isdigit():
            raise Broken(path, at, "the header line has no length")
        block = _taken(stream, int(length), path, at)
        if described:
            lines = block.decode("latin-1").split("\n")
            version = lines[0].split(" ")[0]
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else FIELDS.get(int(version) if version.isdigit() else 1, names)
        else:
            values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise Broken(path, at, f"the header line has {len(values)} fields of {len(names)}")
            yield at, dict(zip(names, values)), block
        at += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with the empty line, and payload; without an HTTP head all is payload."""
    if block.startswith(b"HTTP/"):
        for end in (b"\r\n\r\n", b"\n\n"):
            cut = block.find(end)
            if cut >= 0:
                return block[: cut + len(end)], block[cut + len(end) :]
    return b"", block


def digest(data: bytes) -> str:
    return b32encode(sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """ISO 8601 of up to 14 digits; missing ones are those of the first moment."""
    full = re.sub(r"\D", "", date)[:14]
    full = full.ljust(4, "0") + "0101000000"[max(0, len(full) - 4) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(path: str, at: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit("/", 1)[-1]}#{at}')}"


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").rstrip() if found else None


def _parsed(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]], chunk: int = 16 << 20) -> DataFrame:
    """Rows of all files; ``rows`` yields (bytes held, row) of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for more, row in rows(path.as_py(), memoryview(content.as_buffer()).cast("B")):
                    held.append(row)
                    size += more + 100
                    if size > chunk:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    names = [part.strip().split(" ") for part in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, kinds[kind]) for (_, kind), values in zip(names, zip(*found))], names=[n for n, _ in names])

    return files.mapInArrow(run, schema)


RECORD = "id string, uri string, date string, ip string, mime string, http long, head binary, payload binary, payload_digest string, block_digest string, head_digest string"


def _full(path: str, content: bytes) -> Iterator[tuple]:
    for at, fields, block in arc_records(path, _opened(content)):
        head, payload = split_http(block)
        row = (record_id(path, at), fields["URL"].replace(" ", "%20"), warc_date(fields["Archive-date"]), fields["IP-address"], fields["Content-type"])
        yield len(block), (*row, int(bool(head)), head, payload, digest(payload), digest(block), digest(head))


def _listed(path: str, content: bytes) -> Iterator[tuple]:
    for at, fields, block in arc_records(path, _opened(content)):
        head, payload = split_http(block)
        key = header_value(head, KEY_HEADER)
        yield 0, (record_id(path, at), fields["URL"].replace(" ", "%20"), warc_date(fields["Archive-date"]), path, at, key, sha256(payload).digest(), len(payload))


def convert(spark: SparkSession, arc: str, warc: str, spec: Archives, order: Column | None = None) -> None:
    """Writes the records of a folder of ARC files as WARC files.

    ``order``: of records with equal payloads the least is the one that others revisit (columns date, uri, key; by
    default the oldest). Payloads are read twice and moved once; only (id, first id) is joined to them.
    """
    listed = materialise(_parsed(_files(spark, arc), "id string, uri string, date string, file string, at long, key string, sha binary, size long", _listed), "arc-list")
    by = order if order is not None else F.col("date")
    rank = F.struct(by.isNull().alias("none"), by.alias("by"), "file", "at", "id", "uri", "date")
    ranked = listed.filter(F.col("size") >= spec.least_bytes).withColumn("rank", rank)
    # Equal payloads: one row a task and payload is moved, however many records share it.
    firsts = ranked.groupBy("sha", "size").agg(F.min("rank").alias("first"))
    seen = ranked.select("id", "sha", "size").join(firsts, ["sha", "size"]).filter("id <> first.id")
    seen = materialise(seen.select("id", F.col("first.id").alias("to_id"), F.col("first.uri").alias("to_uri"), F.col("first.date").alias("to_date")), "arc-revisits")
    records = _parsed(_files(spark, arc), RECORD, _full).join(seen.hint("shuffle_hash"), "id", "left")
    again, http = F.col("to_id").isNotNull(), F.col("http") == 1

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    named = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).when(http, F.lit("response")).otherwise(F.lit("resource"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip"), F.col("ip") != NO_IP),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        line("WARC-Profile", F.lit(SAME_PAYLOAD), again),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("to_id"), F.lit(">")), again),
        line("WARC-Refers-To-Target-URI", F.col("to_uri"), again),
        line("WARC-Refers-To-Date", F.col("to_date"), again),
        line("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    ]
    # Binary from here on: payloads need not be UTF-8. The last line feed of a record is the writer's.
    record = F.concat(F.concat(*named).cast("binary"), block, F.lit("\r\n\r").cast("binary")).cast("string")
    info = f"software: {spec.software}\r\nformat: WARC File Format 1.1\r\n"
    first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 1996-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n"
    _write_rows(records, record, F.format_string(first, F.expr("uuid()")), warc, spec)


def warc_records(path: str, stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Number, headers (names in lower case) and block of each record."""
    at = 0
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise Broken(path, at, "no version line")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip(b"\r\n"):
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise Broken(path, at, "a header line has no name")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise Broken(path, at, "no length is declared")
        yield at, headers, _taken(stream, int(headers["content-length"]), path, at)
        at += 1


def _read_back(path: str, content: bytes) -> Iterator[tuple]:
    for at, headers, block in warc_records(path, _opened(content)):
        kind = headers.get("warc-type", "")
        if kind == "warcinfo":
            continue
        if headers.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            raise Broken(path, at, "the block's digest does not match")
        head, payload = split_http(block)
        stated = headers.get("warc-payload-digest", "")[5:]
        if kind != "revisit" and stated and stated != digest(payload):
            raise Broken(path, at, "the payload's digest does not match")
        own = (None, stated) if kind == "revisit" else (len(payload), digest(payload))
        yield 0, (headers["warc-record-id"].strip("<>"), kind, headers.get("warc-target-uri"), header_value(head, KEY_HEADER), *own, headers.get("warc-refers-to", "").strip("<>") or None)


def read_back(spark: SparkSession, warc: str) -> DataFrame:
    """id, type, uri, key, payload_bytes, payload_digest, refers_to (the key of the record revisited) of a folder of WARC files.

    A revisit has no payload of its own: its size is that of the record it refers to.
    """
    rows = materialise(_parsed(_files(spark, warc), "id string, type string, uri string, key string, payload_bytes long, payload_digest string, to_id string", _read_back), "warc-list")
    to = rows.filter("type <> 'revisit'").select(F.col("id").alias("to_id"), F.col("key").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"))
    out = rows.join(to, "to_id", "left")
    return out.select("id", "type", "uri", "key", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "refers_to")


def through_archives(rows: DataFrame, spec: Archives, order: Column | None = None) -> DataFrame:
    """``rows`` (key, url, date, payload) written as ARC files, converted to WARC files and read back."""
    spark = rows.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(rows, arc, spec)
    convert(spark, arc, warc, spec, order)
    return read_back(spark, warc)
