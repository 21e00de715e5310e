"""Legacy archives to WARC: ARC records are parsed by their declared lengths and rewritten.

An ARC file begins with a `filedesc:` record whose body names the version; that fixes the fields
of every later header line (five in version 1, ten in version 2). The body length is always the
last field, so records are cut by length and never by what their bodies look like. Each record
becomes a WARC record: an identifier derived from its place, URL, date and digest, an ISO timestamp,
a type (`response` for HTTP, `resource` else, `revisit` for a payload that another record holds),
and SHA-1 digests of block and payload.

Archives are written by Spark's own writer into the shared folder, so they can be on any file
system that Spark reaches, and are read back file by file as a stream of records: in memory are
one compressed file and one record. Input partitions bound the size of a file.

Defined cases: a null page is an empty payload; a row without a URL gets `unknown:`; blanks in
a URL are escaped; repeated rows give records of their own, and of rows that are alike in page and
payload one is the response; an empty table gives no archive. A file whose declared length runs
past its end fails with its name, because what follows cannot be told apart.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.session import materialize, scratch_path

#: Fields of an ARC header line, by version. Fixed by the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ORIGIN = "veritally"
DEFAULT_DATE = "19960101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_RECORD = "file string, place bigint, version int, url string, ip string, arc_date string, content_type string, result_code string, block binary"
WARC_RECORD = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to_id string, headers map<string,string>, block binary"


# ---- writing ARC ----------------------------------------------------------------------------


def arc_records(records: DataFrame, version: int = 2) -> DataFrame:
    """(url, ip, arc_date, content_type, block binary) -> one binary ARC record a row, each partition opened by its filedesc record."""
    fields = ARC_FIELDS[version]
    described = f"{version} 0 {ORIGIN}\n{' '.join(fields)}\n".encode()
    opening = {"URL": "filedesc://part.arc", "IP-address": "0.0.0.0", "Archive-date": DEFAULT_DATE, "Content-type": "text/plain", "Archive-length": str(len(described))}

    def line(values: dict[str, str]) -> bytes:
        return " ".join(values.get(f) or "-" for f in fields).encode() + b"\n"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = [] if opened else [line(opening) + described]
                opened = True
                for r in batch.slice(at, 64).to_pylist():
                    block = r["block"] or b""
                    url = "%20".join((r["url"] or "unknown:").split()) or "unknown:"
                    kind = (r["content_type"] or "application/octet-stream").split(";")[0].replace(" ", "")
                    values = {"URL": url, "IP-address": r["ip"], "Archive-date": r["arc_date"] or DEFAULT_DATE, "Content-type": kind}
                    values |= {"Result-code": "200", "Archive-length": str(len(block))}
                    out.append(line(values) + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records.select("url", "ip", "arc_date", "content_type", "block").mapInArrow(write, "record binary")


def write_binary(records: DataFrame, path: str, separator: str) -> None:
    """Each partition's `record` bytes, with a separator after each, as one gzip file."""
    # A string column is written byte for byte, so the cast carries any payload.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


# ---- reading --------------------------------------------------------------------------------


class Bytes:
    """Reads a plain or gzip-compressed file held in memory, piece by piece."""

    def __init__(self, content: bytes, name: str):
        self.content, self.name, self.at, self.ready = memoryview(content), name, 0, bytearray()
        self.inflate = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        piece = bytes(self.content[self.at : self.at + (1 << 16)])
        self.at += len(piece)
        while piece:
            if self.inflate is None:
                self.ready += piece
                break
            self.ready += self.inflate.decompress(piece)
            piece = self.inflate.unused_data if self.inflate.eof else b""
            if self.inflate.eof:  # the next member, if records were compressed one by one
                self.inflate = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        start = 0
        while (end := self.ready.find(b"\n", start)) < 0:
            start = len(self.ready)
            if not self._more():
                rest, self.ready = bytes(self.ready), bytearray()
                return rest or None
        found = bytes(self.ready[:end]).rstrip(b"\r")
        del self.ready[: end + 1]
        return found

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError(f"{self.name}: a record declares {n} bytes and {len(self.ready)} are left")
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found


def parse_arc(source: Bytes) -> Iterator[dict]:
    """The records of one ARC file after its filedesc record."""
    version, fields = None, None
    while (line := source.line()) is not None:
        if not line:
            continue  # the separator between records
        values = line.decode("utf-8", "replace").split(" ")
        try:
            length = int(values[-1])
        except ValueError as e:
            raise ValueError(f"{source.name}: not an ARC header line: {line[:200]!r}") from e
        body = source.take(length)
        if version is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError(f"{source.name}: does not begin with a filedesc record")
            version = int(body.split(b" ", 1)[0] or 0)
            if version not in ARC_FIELDS:
                raise ValueError(f"{source.name}: ARC version {version} is not known")
            fields = ARC_FIELDS[version]
            continue
        if len(values) < len(fields):
            raise ValueError(f"{source.name}: {len(values)} fields, version {version} has {len(fields)}")
        # Old writers left blanks in URLs: the fields are counted from the right.
        extra = len(values) - len(fields)
        named = dict(zip(fields, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=True))
        yield {"version": version, "url": named["URL"], "ip": named["IP-address"], "arc_date": named["Archive-date"], "content_type": named["Content-type"], "result_code": named.get("Result-code"), "block": body}


def parse_warc(source: Bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{source.name}: expected a WARC version line, found {line[:100]!r}")
        headers: dict[str, str] = {}
        while field := source.line():
            name, _, value = field.decode().partition(":")
            headers[name.strip()] = value.strip()
        yield headers, source.take(int(headers["Content-Length"]))


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    ready, size = [], 0
    for r in rows:
        ready.append(r)
        size += 500 + len(r["block"])
        if size >= limit:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def read_arc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per ARC record."""
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("version", pa.int32()), *((n, pa.string()) for n in ("url", "ip", "arc_date", "content_type", "result_code")), ("block", pa.binary())])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = parse_arc(Bytes(content.as_buffer(), name))
                yield from _batches(({"file": name, "place": i, **r} for i, r in enumerate(records)), schema)

    return files(spark, path).mapInArrow(read, ARC_RECORD)


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per WARC record."""
    schema = pa.schema([*((n, pa.string()) for n in ("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to_id")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = (
                    {
                        "record_id": h.get("WARC-Record-ID"),
                        "record_type": h.get("WARC-Type"),
                        "target_uri": h.get("WARC-Target-URI"),
                        "warc_date": h.get("WARC-Date"),
                        "payload_digest": h.get("WARC-Payload-Digest"),
                        "refers_to_id": h.get("WARC-Refers-To"),
                        "headers": list(h.items()),
                        "block": block,
                    }
                    for h, block in parse_warc(Bytes(content.as_buffer(), name))
                )
                yield from _batches(rows, schema)

    return files(spark, path).mapInArrow(read, WARC_RECORD)


# ---- converting -----------------------------------------------------------------------------


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP message, its blank line included, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(arc_date: str | None) -> str:
    """YYYYMMDDhhmmss, or what old archives left of it, as an ISO timestamp."""
    digits = "".join(c for c in arc_date or "" if c in "0123456789")[:14]
    d = digits + DEFAULT_DATE[len(digits) :] if len(digits) >= 4 else DEFAULT_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


CONVERTED = "record_id string, rank string, url string, ip string, warc_date string, payload_digest string, payload_bytes bigint, content_type string, head binary, payload binary"
_CONVERTED = pa.schema([*((n, pa.string()) for n in ("record_id", "rank", "url", "ip", "warc_date", "payload_digest")), ("payload_bytes", pa.int64()), ("content_type", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])
FACTS_ONLY = "record_id string, rank string, payload_digest string, payload_bytes bigint"
_FACTS_ONLY = pa.schema([("record_id", pa.string()), ("rank", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def http_header(head: bytes, name: str) -> str | None:
    wanted = name.lower().encode()
    for line in head.split(b"\n"):
        field, _, value = line.partition(b":")
        if field.strip().lower() == wanted:
            return value.strip().decode("latin-1")
    return None


def converted(arc: DataFrame, rank_header: str = "", facts_only: bool = False) -> DataFrame:
    """ARC records with what WARC needs: identifier, timestamp, digest, and the HTTP header apart from the payload.

    The identifier is made from the record and its place in its archive, so equal records have different ones. `rank` is the
    value of the named HTTP header, by which one of several equal payloads is chosen. With `facts_only` neither headers nor
    payloads leave the task.
    """
    schema = _FACTS_ONLY if facts_only else _CONVERTED
    names = schema.names

    def convert(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    head, payload = http_parts(r["block"])
                    digest = sha1(payload)
                    rank = http_header(head, rank_header) if rank_header else None
                    seed = "\n".join((r["file"].rsplit("/", 1)[-1], str(r["place"]), r["url"], r["arc_date"], digest, rank or ""))
                    record_id = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed.encode()).digest()[:16], version=4)}>"
                    facts = {"record_id": record_id, "rank": rank, "payload_digest": digest, "payload_bytes": len(payload)}
                    if not facts_only:
                        facts |= {"url": r["url"], "ip": r["ip"], "warc_date": iso_date(r["arc_date"]), "content_type": r["content_type"], "head": head, "payload": payload}
                    out.append(facts)
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in out], schema.field(n).type) for n in names], schema=schema)

    return arc.select("file", "place", "url", "ip", "arc_date", "content_type", "block").mapInArrow(convert, FACTS_ONLY if facts_only else CONVERTED)


def with_revisits(records: DataFrame, facts: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds `refers_to_id`: the record that holds the same payload and has the largest rank; null for that record itself.

    `facts` has the identifiers, ranks, digests and sizes of the same records, stored, so their payloads need not be read for
    it. Payloads under `least_bytes` are always kept. Ranks are whole numbers; a null rank is the smallest, and of
    equal ranks the largest identifier counts.
    """
    shared = facts.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    top = F.max(F.struct(F.col("rank").cast("bigint").alias("rank"), F.col("record_id").alias("top_id")))
    holders = shared.agg(top.alias("top"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("same"), "top.top_id")
    # Records carry their payloads: hashed holders, a narrow row per repeated payload, spare sorting those.
    joined = records.join(holders.hint("shuffle_hash"), F.col("payload_digest") == F.col("same"), "left")
    return joined.withColumn("refers_to_id", F.when(F.col("top_id") != F.col("record_id"), F.col("top_id"))).drop("same", "top_id")


def warc_records(records: DataFrame) -> DataFrame:
    """One binary WARC record a row."""

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    http = bool(r["head"])
                    kind = "revisit" if r["refers_to_id"] else "response" if http else "resource"
                    block = r["head"] if kind == "revisit" else r["head"] + r["payload"]
                    fields = {
                        "WARC-Type": kind,
                        "WARC-Record-ID": r["record_id"],
                        "WARC-Date": r["warc_date"],
                        "WARC-Target-URI": r["url"],
                        "WARC-IP-Address": None if r["ip"] in (None, "-", "0.0.0.0") else r["ip"],
                        "WARC-Block-Digest": f"sha1:{sha1(block)}",
                        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
                        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
                        "WARC-Refers-To": r["refers_to_id"],
                        "Content-Type": "application/http; msgtype=response" if http else r["content_type"],
                        "Content-Length": str(len(block)),
                    }
                    header = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
                    out.append(b"WARC/1.1\r\n" + header.encode() + b"\r\n" + block)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records.select("record_id", "url", "ip", "warc_date", "payload_digest", "content_type", "refers_to_id", "head", "payload").mapInArrow(write, "record binary")


def write_arc(records: DataFrame, path: str, version: int = 2) -> None:
    write_binary(arc_records(records, version), path, "\n")


def write_warc(records: DataFrame, path: str) -> None:
    write_binary(warc_records(records), path, "\r\n\r\n")


def convert_archives(spark: SparkSession, arc_path: str | list[str], warc_path: str, rank_header: str = "", least_bytes: int = 0) -> None:
    """ARC archives to WARC archives, equal payloads stored once."""
    arc = read_arc(spark, arc_path)
    facts = materialize(converted(arc, rank_header, facts_only=True), "arc_facts")
    write_warc(with_revisits(converted(arc, rank_header), facts, least_bytes), warc_path)


# ---- pages ----------------------------------------------------------------------------------

PAGE_HEADER = "X-Page-Id"
FACTS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, record_id string, refers_to_id string, target_uri string, warc_date string"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as HTTP responses, ready for `write_arc`; the page's id is an HTTP header."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    page_id = F.concat(F.lit(f"{PAGE_HEADER}: "), F.col(id_col).cast("string"), F.lit("\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(page_id, F.lit("")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(url_col).alias("url"),
        F.lit("127.0.0.1").alias("ip"),
        F.lit("20010203040506").alias("arc_date"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def page_facts(warc: DataFrame) -> DataFrame:
    """What the archived records say of each page; a response's digest and length are taken from its payload anew."""
    columns = [f.split(" ")[0] for f in FACTS.split(", ")]

    def read(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head, payload = http_parts(r["block"])
                page_id, length = http_header(head, PAGE_HEADER), http_header(head, "Content-Length")
                digest = r["payload_digest"].removeprefix("sha1:")
                if r["record_type"] != "revisit" and (sha1(payload) != digest or len(payload) != int(length)):
                    raise ValueError(f"{r['record_id']}: the payload is not the one that was archived")
                out.append((int(page_id) if page_id else None, int(length), digest, r["record_type"], r["record_id"], r["refers_to_id"], r["target_uri"], r["warc_date"]))
            types = [pa.int64() if c in ("page_id", "payload_bytes") else pa.string() for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(columns), types, strict=True)], names=columns)

    return warc.select("record_id", "record_type", "target_uri", "warc_date", "payload_digest", "refers_to_id", "block").mapInArrow(read, FACTS)


def archive_pages(pages: DataFrame, least_bytes: int = 0, version: int = 2) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back: one row per page."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(page_records(pages), arc, version)
    convert_archives(spark, arc, warc, PAGE_HEADER, least_bytes)
    # Stored: both sides of the join below need them, and the archives are to be read once.
    facts = materialize(page_facts(read_warc(spark, warc)), "page_facts")
    holders = facts.filter("record_type != 'revisit'").select(F.col("record_id").alias("held_id"), F.col("page_id").alias("refers_to"))
    joined = facts.join(holders, F.col("refers_to_id") == F.col("held_id"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date")
