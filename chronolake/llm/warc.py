"""WARC: records written one gzip member each, and a sequential reader.

``archives`` turns pages into archives, one row each, cut at about ``archive_bytes``: a warcinfo record, then
a record per page.  Of records with equal payloads the one with the largest id is a response and holds
the payload; the others are revisits that refer to it.  The table of archives is what is stored and read
back, since only Spark's writers reach every store; ``save`` and ``load`` exchange ``.warc.gz`` files with a
folder that all executors share.

``records`` reads archives in sequence: it inflates piece by piece, finds the header, then takes
Content-Length bytes as they come, digests them on the way, and compares both digests.  No more than one piece,
the header and (if wanted) the payload are held.

Nulls and edges: a null html is an empty payload; a null url leaves the header out, control characters in a url
are percent-encoded; a row with a null page_id revisits an equal payload with an id and is a response otherwise;
rows that repeat the largest id of a payload are all responses; other columns are ignored, so names cannot
clash; no pages, no archives.  A broken member, header or length raises ValueError; a digest that differs is
reported in block_ok and payload_ok.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored, table

ARCHIVE_BYTES, PIECE, MOST_HEADER = 2 << 20, 64 << 10, 1 << 20
DATE = "2026-01-01T00:00:00Z"
ARCHIVE = "archive string, content binary"
RECORD = "archive string, offset long, record_type string, record_id string, uri string, refers_to string, content_length long, payload_bytes long, payload_digest string, block_ok boolean, payload_ok boolean, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, html: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """The gzip member of a page: a response, or a revisit of the page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(html)}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _member(fields, http + (html if refers_to is None else b""), level)


def info_record(name: str, level: int = 6) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: the largest id of the pages with this payload, null for that page itself.

    Only payloads found more than once enter the join; payloads under ``least`` bytes never refer."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    sha = F.sha1("payload")
    several = stored(rows.where(F.octet_length("payload") >= least).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").drop("n"), "repeated")
    found = rows.withColumn("sha", sha).join(several, "sha", "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, least: int = 0, level: int = 6) -> DataFrame:
    """archive, content: the pages as WARC archives.  A task begins a new archive after ``archive_bytes``."""

    def write(batches):
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            return pa.RecordBatch.from_pydict({"archive": [name()], "content": [b"".join([info_record(name(), level), *parts])]})

        def name():
            return f"part-{task:06}-{number:06}.warc.gz"

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(n) for n in ("page_id", "url", "payload", "refers_to")), strict=True):
                parts.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), level))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield row()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield row()

    return with_originals(pages, least).mapInArrow(write, ARCHIVE)


class _Inflater:
    """Takes bytes of one gzip member at a time from a read function; knows where the member began."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.rest, self.at, self.held = read, b"", 0, b""
        self.packed: zlib._Decompress | None = None

    def next_member(self) -> bool:
        """Whether another member begins here."""
        self.rest = self.rest or self.read(PIECE)
        self.packed, self.held = zlib.decompressobj(31), b""
        return bool(self.rest)

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, none at the member's end."""
        while not self.held and not self.packed.eof:
            source = self.packed.unconsumed_tail or self.rest or self.read(PIECE)
            if not source:
                raise ValueError(f"the member at byte {self.at} is cut off")
            if not self.packed.unconsumed_tail:
                self.rest = b""
                self.seen = getattr(self, "seen", 0) + len(source)
            try:
                self.held = self.packed.decompress(source, PIECE)
            except zlib.error as e:
                raise ValueError(f"the member at byte {self.at} cannot be inflated: {e}") from None
            if self.packed.eof:
                self.rest = self.packed.unused_data
                self.seen -= len(self.rest)
        out, self.held = self.held[:most], self.held[most:]
        return out


def read_records(read: Callable[[int], bytes], keep_payload: bool = True) -> Iterator[dict]:
    """The records of an archive in order; ``read(n)`` gives its next bytes."""
    member = _Inflater(read)
    while member.next_member():
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            more = member.take(PIECE)
            if not more or len(head) > MOST_HEADER:
                raise ValueError(f"no header in the member at byte {member.at}")
            head += more
        member.held = head[cut + 4 :] + member.held
        version, *lines = head[:cut].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"the member at byte {member.at} is no WARC record")
        left = length = int(fields["content-length"])
        http = "http" in fields.get("content-type", "")
        block, payload, kept, start, count = hashlib.sha1(), hashlib.sha1(), [], b"", 0
        inside = not http
        while left:
            part = member.take(min(left, PIECE))
            if not part:
                raise ValueError(f"the record at byte {member.at} has {length - left} of {length} bytes")
            left -= len(part)
            block.update(part)
            if not inside:
                start += part
                if (cut := start.find(b"\r\n\r\n")) < 0:
                    continue
                inside, start, part = True, start[:cut], start[cut + 4 :]
            payload.update(part)
            count += len(part)
            if keep_payload:
                kept.append(part)
        tail = b""
        while more := member.take(PIECE):
            tail += more
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise ValueError(f"the record at byte {member.at} does not end after {length} bytes")
        said = {k: fields.get(f"warc-{k}-digest", "").rpartition(":")[2] for k in ("block", "payload")}
        own, revisit = base64.b32encode(payload.digest()).decode(), fields.get("warc-type") == "revisit"
        full = re.search(rb"(?im)^content-length: *(\d+)", start) if revisit else None
        yield {"offset": member.at, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "content_length": length, "payload_bytes": int(full[1]) if full else count, "payload_digest": said["payload"] if revisit else own, "block_ok": said["block"] in ("", base64.b32encode(block.digest()).decode()), "payload_ok": revisit or said["payload"] in ("", own), "payload": b"".join(kept) if keep_payload and not revisit else None}
        member.at = getattr(member, "seen", 0)


def records(stored_archives: DataFrame, keep_payload: bool = True, rows: int = 512) -> DataFrame:
    """A row per record of ``archive, content`` rows, in the order of each archive."""
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                held, size = [], 0
                for x in read_records(io.BytesIO(content.as_buffer()).read, keep_payload):
                    held.append(x | {"archive": name})
                    size += len(x["payload"] or b"")
                    if len(held) >= rows or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return stored_archives.select("archive", "content").mapInArrow(read, RECORD)


def save(archive_rows: DataFrame, folder: str) -> None:
    """Writes each archive as a file into a folder that all executors share."""

    def write(rows):
        for r in rows:
            Path(folder, r.archive).write_bytes(r.content)

    Path(folder).mkdir(parents=True, exist_ok=True)
    archive_rows.foreachPartition(write)


def load(spark: SparkSession, path: str) -> DataFrame:
    """archive, content of the files under ``path``, from any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(stored(archives(table(spark, sf_dir, "pages")), "archives"), keep_payload=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    checked = found.where("record_type != 'warcinfo'").withColumn("ok", F.when(~(F.col("block_ok") & F.col("payload_ok")), F.raise_error(F.concat(F.lit("digest differs in "), "record_id"))).otherwise(F.lit(True)))
    return checked.where("ok").select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(hex, i // 4 * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = largest OR largest IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest OR page_id IS NULL THEN largest END AS refers_to
FROM d
"""
