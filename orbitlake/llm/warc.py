"""WARC archives with a salvaging reader.

`write` turns pages into archives: gzip members of one record each, gathered up to about
`ARCHIVE_BYTES` and kept as rows (archive, content) of a Parquet table in a folder that all
machines share. Of pages with equal payloads of at least `least` bytes the one with the
largest id is the response and the others revisit it; shorter payloads are all responses.
Only pages whose digest repeats are looked up; the digests are counted with map-side sums.

`read` takes such a table, or real files by Spark's binaryFile source. A record is accepted if its
version line and length parse and its digest agrees, where that is sha1; of a member that does not inflate
to its end, so are the records in what it gives: all if the data end there, else those that a digest proves.
After a failed check the reader searches for the nearer of the next gzip member and the next version line
(inside a member, the next version line), goes on there, and logs the bytes between as a quarantined gap:
rows of kind `gap`, which for a gap inside a member have the member's place. Records of other types than
response and revisit return their block as payload.

Null html counts as empty. A null id is written and read back as null and neither revisits nor is
revisited. Ids are expected to be unique; of equal payloads, all rows of the largest id are responses. Line ends and other controls in a URL are percent-coded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

ARCHIVE_BYTES = 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Profile of revisits, and the fields that this module writes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
URN = "urn:orbitlake:page:"
RECORD = "kind string, archive string, offset long, length long, reason string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """One record: a revisit of `keeper`, or a response if that is None."""
    block = HTTP if keeper is not None else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if keeper is not None else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if keeper is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{keeper}>"), ("X-Payload-Length", str(len(payload)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def agrees(said: str, data: bytes) -> bool | None:
    """Whether a labelled digest is that of the data; None for other algorithms than sha1."""
    label, _, value = said.partition(":")
    if label.lower() != "sha1":
        return None
    return value.upper() == digest_of(data) or value.lower() == hashlib.sha1(data).hexdigest()


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that begins at `at` and where it ends; ValueError says what is wrong."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise ValueError("header does not end")
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        raise ValueError("no length")
    stop = end + 4 + int(fields["content-length"])
    block = data[end + 4 : stop]
    if len(data) < stop + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut or its end is missing")
    if agrees(fields.get("warc-block-digest", ""), block) is False:
        raise ValueError("block digest differs")
    return fields | {"block": block}, stop + 4


def _row(fields: dict, archive: str, offset: int, length: int, proof: bool = False) -> dict:
    number = lambda k: int(m[1]) if (m := re.fullmatch(rf"<{URN}(-?[0-9]+)>", fields.get(k, ""))) else None
    block, kind = fields["block"], fields.get("warc-type", "")
    said = fields.get("warc-payload-digest", "")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if kind == "response" else block
    same = agrees(said, payload) if kind == "response" else None
    if same is False:
        raise ValueError("payload digest differs")
    if proof and not same and not agrees(fields.get("warc-block-digest", ""), block):
        raise ValueError("no digest proves a record of a damaged member")
    size = len(payload) if payload is not None else int(m[0]) if (m := re.fullmatch("[0-9]+", fields.get("x-payload-length", ""))) else 0
    return {"kind": "record", "archive": archive, "offset": offset, "length": length, "reason": None, "page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said.removeprefix("sha1:"), "payload": payload}


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(f"member: {e}") from e
    if not d.eof:
        raise ValueError("member is cut")
    return out, len(data) - len(d.unused_data)


def _beginning(data: bytes, at: int) -> bytes:
    """What a damaged or cut member gives before its fault."""
    d, out = zlib.decompressobj(31), []
    for a in range(at, len(data), 1 << 14):
        before = d.copy()
        try:
            out.append(d.decompress(data[a : a + (1 << 14)]))
        except zlib.error:
            try:
                for i in range(a, len(data)):
                    out.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                break
    return b"".join(out)


def _inside(archive: str, text: bytes, offset: int, length: int, proof: bool, ends: bool):
    """Rows of the records of an inflated member, and of the gaps in it; the end of a cut member is no gap of its own."""
    at, gap, why = 0, None, ""
    between = lambda: {"kind": "gap", "archive": archive, "offset": offset, "length": length, "reason": f"{why} (bytes {gap} to {at} of the inflated member)"}
    while at < len(text):
        try:
            fields, stop = parse(text, at)
            row = _row(fields, archive, offset, length, proof)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            m = VERSION.search(text, at + 1)
            at = m.start() if m else len(text)
            continue
        if gap is not None:
            yield between()
            gap = None
        yield row
        at = stop
    if gap is not None and ends:
        yield between()


def salvage(archive: str, data: bytes):
    """Rows of the records of one archive in order, and of the gaps between them."""
    at, gap, why = 0, None, ""

    def following() -> int:
        m = VERSION.search(data, at + 1)
        plain = m.start() if m else len(data)
        zipped = data.find(b"\x1f\x8b\x08", at + 1, plain)
        return zipped if zipped >= 0 else plain

    while at < len(data):
        fault = None
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                # a member is inflated from a bounded window first, so that many members do not copy the archive each time
                try:
                    text, end = _window(data, at)
                except ValueError as e:
                    fault, text, end = str(e), _beginning(data, at), following()
                rows = list(_inside(archive, text, at, end - at, fault not in (None, "member is cut"), fault is None))
                if not any(r["kind"] == "record" for r in rows):
                    raise ValueError(fault or (rows[0]["reason"] if rows else "member is empty"))
            else:
                fields, end = parse(data, at)
                rows = [_row(fields, archive, at, end - at)]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = following()
            continue
        if gap is not None:
            yield {"kind": "gap", "archive": archive, "offset": gap, "length": at - gap, "reason": why}
            gap = None
        yield from rows
        if fault:
            gap, why = at, fault
        at = end
    if gap is not None:
        yield {"kind": "gap", "archive": archive, "offset": gap, "length": len(data) - gap, "reason": why}


def _window(data: bytes, at: int) -> tuple[bytes, int]:
    size = 1 << 16
    while True:
        try:
            text, used = _inflated(data[at : at + size], 0)
            return text, at + used
        except ValueError as e:
            if str(e) != "member is cut" or at + size >= len(data):
                raise
            size *= 8


def _archived(batches):
    """Archives of about ARCHIVE_BYTES from the rows of a task."""
    held: list[bytes] = []
    size = 0
    full = lambda: pa.RecordBatch.from_pydict({"archive": [f"{uuid.uuid4().hex}.warc.gz"], "content": [b"".join(held)]})
    for batch in batches:
        for page_id, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(member(record(page_id, url, html, keeper)))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield full()
                held, size = [], 0
    if held:
        yield full()


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages, as a Parquet table of (archive, content) at `path`."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("html"))
    keyed = p.withColumn("key", F.when((F.length("html") >= least) & F.col("page_id").isNotNull(), F.sha2("html", 256)))
    keepers = keyed.where("key is not null").groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("key", "keeper")
    roles = keyed.join(keepers, "key", "left").select("page_id", "url", "html", F.when(F.col("keeper") != F.col("page_id"), F.col("keeper")).alias("keeper"))
    roles.mapInArrow(_archived, "archive string, content binary").write.option("compression", "none").parquet(path)


def _salvaged(batches):
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in RECORD.split(", "))])
    for batch in batches:
        for archive, content in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[dict] = []
            for row in salvage(archive.as_py(), content.as_py() or b""):
                rows.append(row)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives given as rows (archive, content)."""
    return archives.select("archive", "content").mapInArrow(_salvaged, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of .warc or .warc.gz files at any path that Spark reads; a file (under 2 GiB, the source's limit) is one task's work."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads these back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    return read(spark.read.parquet(path))
