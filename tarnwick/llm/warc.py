"""WARC archives: written by tasks, read back, and assembled into captures.

Every page gives three records: a request, a response or (for a payload that
another page holds) a revisit, and a metadata record; request and metadata name the
response or revisit in WARC-Concurrent-To. Archives are gzipped record by record
and cut at ``file_bytes``. Reading parses the archives in parallel, joins the
records of a transaction through their concurrent-to identifiers and gives one
nested row per capture; a revisit finds its payload through WARC-Refers-To.

The holder of a payload is the largest page_id of an aggregation by digest,
combined map-side; the join back keeps pages on its streamed side, which adaptive
execution splits where one payload is hot.

Edge cases: a null html is an empty payload, a null url has no target; a null
page_id ranks below all others and is read back as null. Identical rows give
identical records: each is written and read back. Only page_id, url and html are
read, whatever else the table holds. No pages, no archives, and no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.llm.batches import slices, texts, tidied
from tarnwick.llm.files import put

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


_PIECE = 1 << 14


def holders(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages plus digest, size, holder: the page whose record keeps the payload, null for itself."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select("page_id", "url", "html").withColumns({"digest": F.sha1(payload), "size": F.octet_length(payload).cast("long")})
    kept = named.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("times")).where("times > 1").drop("times")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("size") >= least_bytes)
    return named.join(kept, "digest", "left").withColumn("revisits", other)


def capture_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.UUID(hashlib.md5(f'{page_id}|{digest}'.encode()).hexdigest()).urn}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisits: bool, date: str) -> Iterator[bytes]:
    target, me = _target(url), capture_id(page_id, digest)
    common = [("WARC-Date", date), *([("WARC-Target-URI", target)] if target else [])]
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    host = re.sub(r"^[a-z+.-]+://|[/?#].*$", "", target)
    path = re.sub(r"^[a-z+.-]+://[^/?#]*|#.*$", "", target) or "/"
    tied = [("WARC-Concurrent-To", me)]
    yield _record([("WARC-Type", "request"), ("WARC-Record-ID", me[:-1] + "-request>"), *tied, *common, ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    same = [("WARC-Record-ID", me), *common, ("WARC-Payload-Digest", sha), ("Content-Type", "application/http; msgtype=response")]
    if revisits:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", capture_id(refers_to, digest))]
        yield _record([("WARC-Type", "revisit"), *same, *profile], _HTTP % 0)
    else:
        yield _record([("WARC-Type", "response"), *same], _HTTP % len(payload) + payload)
    fields = b"" if page_id is None else b"page-id: %d\r\n" % page_id
    yield _record([("WARC-Type", "metadata"), ("WARC-Record-ID", me[:-1] + "-metadata>"), *tied, *common, ("Content-Type", "application/warc-fields")], fields)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 1000, file_bytes: int = 16 << 20, date: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) below folder; returns the manifest (file, n_records)."""
    scratch.make_folder(spark, folder)
    ready = holders(pages, least_bytes).select("page_id", "url", F.when(~F.col("revisits"), F.col("html")).alias("html"), "digest", "holder", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        files: list[tuple[str, int]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                name = f"part-{TaskContext.get().partitionId():08d}-{len(files):06d}.warc.gz"
                put(f"{folder}/{name}", b"".join(held))
                files.append((name, len(held)))
                held.clear()
                size = 0

        for batch in batches:
            for part in slices(batch, "html"):
                rest = [part.column(n).to_pylist() for n in ("page_id", "url", "digest", "holder", "revisits")]
                for payload, page, url, digest, holder, again in zip(texts(part.column("html")), *rest, strict=True):
                    for record in records(page, url, payload, digest, holder, again, date):
                        held.append(record)
                        size += len(record)
                    if size >= file_bytes:
                        flush()
        flush()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files]), pa.array([n for _, n in files], pa.int64())], names=["file", "n_records"])

    return scratch.table(spark, ready.mapInArrow(tidied(run), "file string, n_records long"), "archives")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased headers, block) of each record of an archive, gzipped member by member or plain."""
    view, at = memoryview(data), 0
    while at < len(view):
        if view[at : at + 2] == b"\x1f\x8b":
            member, parts = zlib.decompressobj(31), []
            while at < len(view) and not member.eof:  # in pieces, as what follows a member is copied
                parts.append(member.decompress(view[at : at + _PIECE]))
                at += _PIECE
            at = min(at, len(view)) - len(member.unused_data)
            record = b"".join(parts)
        else:
            record, at = bytes(view[at:]), len(view)
        place = 0
        while (end := record.find(b"\r\n\r\n", place)) >= 0:
            head = record[place:end].lstrip(b"\r\n")
            if not head:
                break
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
            size = int(headers.get("content-length", len(record) - end - 4))
            yield headers, record[end + 4 : end + 4 + size]
            place = end + 4 + size + 4  # two line ends close a record


_RECORD = pa.schema([("record_id", pa.string()), ("concurrent_to", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("head", pa.string()), ("payload", pa.binary())])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def rows(data: bytes) -> Iterator[dict]:
        for headers, block in parse(data):
            http = headers.get("content-type", "").startswith("application/http")
            head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            yield {
                "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"), "type": headers.get("warc-type"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                "refers_to": headers.get("warc-refers-to"), "stated_digest": base64.b32decode(stated).hex() if stated else None, "payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload), "head": head.decode("utf-8", "replace"), "payload": payload,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += row["payload_bytes"]
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORD)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD)

    return found.mapInArrow(tidied(run), "record_id string, concurrent_to string, type string, target_uri string, date string, refers_to string, stated_digest string, payload_digest string, payload_bytes long, head string, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata tied to it.

    Records are parsed once and meet in one aggregation by the identifier that ties
    them, combined map-side; columns that nobody reads never enter it. A capture that
    was written n times is n rows.
    """
    main, tied = ("type", "refers_to", "stated_digest", "payload_digest", "payload_bytes", "head", "payload"), {"request": ("record_id", "head"), "metadata": ("record_id", "payload")}
    own = F.col("type").isin("response", "revisit")
    columns = [F.max(F.when(own, F.col(c))).alias(f"response_{c}") for c in main]
    for kind, names in tied.items():
        columns += [F.max(F.when(F.col("type") == kind, F.col(c))).alias(f"{kind}_{c}") for c in names]
    key = F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")
    met = records.where(own | F.col("type").isin(*tied)).groupBy(key, "target_uri", "date").agg(F.sum(own.cast("long")).alias("times"), *columns).where("times > 0")
    response = F.struct(F.col("capture_id").alias("record_id"), "target_uri", "date", *[F.col(f"response_{c}").alias(c) for c in main]).alias("response")
    sides = [F.when(F.col(f"{kind}_record_id").isNotNull(), F.struct(*[F.col(f"{kind}_{c}").alias(c) for c in names])).alias(kind) for kind, names in tied.items()]
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("capture_id", response, *sides)


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture.

    The metadata is named once, else its nested row is built before it is taken apart
    and the payloads of all responses are shuffled with it.
    """
    page = F.regexp_extract(F.col("metadata.payload").cast("string"), r"page-id: (-?\d+)", 1).try_cast("long")
    r = "response."
    flat = captures.select("capture_id", page.alias("page_id"), F.col(r + "type").alias("record_type"), F.col(r + "refers_to").alias("target"), F.col(r + "stated_digest").alias("stated_digest"), F.col(r + "payload_bytes").alias("own_bytes"), F.col(r + "payload_digest").alias("own_digest"))
    spark = captures.sparkSession
    flat = scratch.table(spark, flat, "captures")
    held = scratch.table(spark, flat.where("record_type = 'response'").groupBy(F.col("capture_id").alias("target")).agg(F.first("page_id").alias("refers_to"), F.first("own_bytes").alias("held_bytes")), "payload-holders")
    revisit = F.col("record_type") == "revisit"
    return flat.join(held, "target", "left").select("page_id", F.when(revisit, F.col("held_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), F.when(revisit, F.col("stated_digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to")
