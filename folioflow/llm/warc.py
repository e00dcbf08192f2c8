"""WARC archives with revisit records: headers meet by payload digest, payloads are never grouped.

1. Headers (id, address, digest, length) are summed per digest, map-side first, so a payload that a third of
   all pages share costs one row per task.
2. Digests of one large payload only are dropped; the rest are joined back to the headers, which
   names the revisit records and the response that each refers to.
3. Pages take their decision by id and digest and become whole records with fresh headers, each a gzip member. Members are
   put together to pieces of bounded size, which Spark's own text writer writes as they are; its line
   separator is an empty gzip member. So files reach any store Spark can write to, are bounded in bytes, and a task
   that is lost or run twice leaves no half or double archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, table

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes of a piece (one record more at most), and pieces of a file: files stay below what ``binaryFile`` reads.
PIECE_BYTES, PIECES = 8 << 20, 8
END = b"\r\n\r\n"
#: A gzip member that holds nothing; readers pass over it.
NOTHING = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, payload binary"


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null: empty), ``payload_bytes``, ``payload_digest``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})


def revisits(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``payload_digest``, ``refers_to``, ``refers_url`` of each record that revisits the largest id with its payload.

    Rows of one id and payload are decided alike: those at the largest id are all responses (of several, that with
    the last address is referred to). A null id is neither a revisit nor referred to.
    """
    large = rows.select("page_id", "url", "payload_digest", "payload_bytes").filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("last"), F.min("page_id").alias("least"))
    first = first.filter("least < last.page_id").select("payload_digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"))
    return large.join(first, "payload_digest").filter("page_id < refers_to").select("page_id", "payload_digest", "refers_to", "refers_url").distinct()


def _record_id(page_id: int | None, url: str, digest: str) -> str:
    """One id for one page, address and payload, wherever it is worked out; wholly repeated rows share it."""
    return uuid.UUID(bytes=hashlib.sha1(f"{page_id} {digest} {url}".encode()).digest()[:16], version=5).urn


def _address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", "", url or "")


def record(date: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """A record without its end: fresh headers, then the HTTP head and, for a response, the payload."""
    kind, extra = "response", []
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is not None:
        kind, head, payload = "revisit", b"HTTP/1.1 200 OK\r\n\r\n", b""
        extra = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to, refers_url or '', digest)}>", f"WARC-Refers-To-Target-URI: {_address(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    told = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_record_id(page_id, url or '', digest)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_address(url)}", *extra,
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Page-ID: {'none' if page_id is None else page_id}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}",
    ]
    return "\r\n".join(told).encode() + END + head + payload


def _information(date: str) -> bytes:
    body = b"software: folioflow\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d" % (uuid.uuid4().urn.encode(), date.encode(), len(body)) + END + body


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None, compressed: bool = True, piece_bytes: int = PIECE_BYTES, **cols: str) -> None:
    """Writes one record per row of ``pages`` below ``path``, and a ``warcinfo`` before each piece; an empty table gives no record.

    Null payloads are empty, repeated rows give a record each, payloads of any length are written whole, other
    columns aren't read. ``date``: of all records, now by default. Where revisits outgrow a broadcast, pages
    meet their decisions by a shuffle of id and digest that carries the payloads.
    """
    rows = headers(pages, **cols)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pack = (lambda x: gzip.compress(x + END, 6, mtime=0)) if compressed else (lambda x: x + END)

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            payloads = batch.column(2).cast(pa.large_binary())
            for i, (page_id, url, n, digest, refers_to, refers_url) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True)):
                if not held:
                    held.append(pack(_information(date)))
                held.append(pack(record(date, page_id, url, payloads[i].as_py(), n, digest, refers_to, refers_url)))
                size += len(held[-1])
                if size >= piece_bytes:
                    yield _piece(held, compressed)
                    held, size = [], 0
        if held:
            yield _piece(held, compressed)

    with Scratch(pages.sparkSession, "revisits") as scratch:
        again = scratch.cut(revisits(rows, least_bytes), "revisits")
        decided = rows.join(again, ["page_id", "payload_digest"], "left")
        payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload")
        pieces = decided.select("page_id", "url", payload, "payload_bytes", "payload_digest", "refers_to", "refers_url").mapInArrow(run, "value binary")
        writer = pieces.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", PIECES).option("encoding", "ISO-8859-1")
        writer.option("lineSep", (NOTHING if compressed else END).decode("latin-1")).text(path)


def _piece(held: list[bytes], compressed: bool) -> pa.RecordBatch:
    whole = b"".join(held)
    return pa.RecordBatch.from_arrays([pa.array([whole if compressed else whole.removesuffix(END)], pa.binary())], ["value"])


def _inflated(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of an archive in parts; a gzip file may hold one member or one for each record."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    member = None
    for at in range(0, len(data), step):
        part = data[at : at + step]
        while part:
            member = member or zlib.decompressobj(31)
            yield member.decompress(part)
            part, member = (member.unused_data, None) if member.eof else (b"", member)
    if member:
        raise ValueError("the archive ends inside a gzip member")


class _Window:
    """What is held of a stream: one record and a part more, whatever the archive's length."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, bytearray(), 0

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are held; reads on where they aren't yet."""
        while len(self.held) < n:
            part = next(self.parts, None)
            if part is None:
                return False
            self.held += part
        return True

    def head(self) -> int:
        """Where the blank line after the header begins."""
        begin = 0
        while (stop := self.held.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(self.held) - 3)
            if not self.fill(len(self.held) + 1):
                raise ValueError(f"the record at byte {self.at} has no header's end")
        return stop

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def _parse(parts: Iterator[bytes]) -> Iterator[tuple]:
    """The records of an archive, with payloads; raises where a digest, a length or the end of a record is wrong."""
    window = _Window(parts)
    while window.fill(1):
        stop, data, at = window.head(), window.held, window.at
        version, *lines = bytes(data[:stop]).split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}
        block = stop + 4
        after = block + int(head["content-length"])
        if not window.fill(after + 4) or data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        if head["warc-type"] not in ("response", "revisit"):
            window.drop(after + 4)
            continue
        start = data.index(b"\r\n\r\n", block, after) + 4
        algorithm, _, digest = head["warc-payload-digest"].partition(":")
        if len(digest) == 32 and algorithm == "sha1":  # the usual base 32
            digest = base64.b32decode(digest.upper()).hex()
        size, payload, kind = int(head.get("x-payload-length") or head["warc-payload-length"]), None, head["warc-type"]
        if kind == "response":
            payload = bytes(data[start:after])
            digest, size, told = hashlib.sha1(payload).hexdigest(), len(payload), (digest, size)
            if told != (digest, size):
                raise ValueError(f"the record at byte {at} has another payload than its header tells")
        ids = [head.get(own) or head.get(other, "none").removeprefix("<urn:page:").removesuffix(">") for own, other in (("x-page-id", "warc-record-id"), ("x-refers-to-page-id", "warc-refers-to"))]
        page, refers = (None if x == "none" else int(x) for x in ids)
        yield page, kind, refers, head["warc-target-uri"], digest, size, payload
        window.drop(after + 4)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record (``READ_SCHEMA``); a revisit's payload is null here, see ``resolve``."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    names = names if payloads else names[:-1]
    schema = READ_SCHEMA if payloads else READ_SCHEMA.rpartition(",")[0]
    types = pa.schema([(x, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for x, t in (y.split() for y in schema.split(", "))])

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in _parse(_inflated(data.as_py())):
                    rows.append(row[: len(names)])
                    held += len(row[-1] or b"") * payloads + 200
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, schema)


def resolve(records_read: DataFrame) -> DataFrame:
    """Gives revisits the payload of the response that they refer to (joined by id and digest)."""
    full = records_read.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("original")).dropDuplicates(["refers_to", "payload_digest"])
    joined = records_read.join(full, ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload", F.coalesce("payload", "original")).select(records_read.columns)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").folder("archives", keep=True)
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM m
"""
