"""WARC archives: writing pages, reading records back, putting segments together.

A page becomes a response record whose block is an HTTP message with its body in chunks.
Of pages with equal payloads the one with the smallest id keeps the payload, the others
become revisit records that name it. A block longer than a segment is cut: the first
part stays a response record, the rest follow as continuation records that carry its
identifier, their number and, at last, the total length.

Archives are gzip files of one member per record, in a folder that all executors reach.
A task that is run again writes files of other names; only those in the manifest, which
Spark commits as a whole, count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.llm import common

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 64 << 20
# Shorter payloads are kept by every record that has them.
LEAST_SHARED = 100

_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = pa.schema([("path", pa.string()), ("segmented", pa.bool_()), ("n_records", pa.int64())])
MANIFEST_DDL = "path string, segmented boolean, n_records long"
_RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("target_uri", pa.string()),
        ("refers_to_id", pa.string()),
        ("stated_digest", pa.string()),
        ("origin", pa.string()),
        ("segment", pa.int32()),
        ("total_length", pa.int64()),
        ("body", pa.binary()),
        ("problem", pa.string()),
    ]
)
_RECORDS_DDL = (
    "record_id string, record_type string, page_id long, target_uri string, refers_to_id string, "
    "stated_digest string, origin string, segment int, total_length long, body binary, problem string"
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK_BYTES] for i in range(0, len(body), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: dict[str, object], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def page_records(page_id, url, body: bytes, digest: str, refers_to) -> list[bytes]:
    """The records of one page, several if its block is cut."""
    own = record_id(page_id, digest)
    uri = None if url is None else "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in url)
    base = {"WARC-Date": _DATE, "WARC-Target-URI": uri, "X-Page-ID": page_id}
    head = {"WARC-Type": "response", "WARC-Record-ID": own, **base, "WARC-Payload-Digest": f"sha256:{digest}"}
    head["Content-Type"] = "application/http; msgtype=response"
    if refers_to is not None:
        more = {"WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": _PROFILE}
        return [record({**head, "WARC-Type": "revisit", **more}, _HTTP)]
    block = _HTTP + chunked(body)
    if len(block) <= SEGMENT_BYTES:
        return [record(head, block)]
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = [record({**head, "WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}/{n}')}>"
        more = {"WARC-Segment-Number": n, "WARC-Segment-Origin-ID": own, "WARC-Segment-Total-Length": total}
        out.append(record({"WARC-Type": "continuation", "WARC-Record-ID": name, **base, **more}, part))
    return out


class _Archives:
    """The archives a task writes, of whole records and of cut ones apart."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.open, self.done = {}, []

    def add(self, records: list[bytes]) -> None:
        cut = len(records) > 1
        if cut not in self.open:
            name = f"{self.folder}/{self.name}-{len(self.done) + len(self.open)}-{'cut' if cut else 'whole'}.warc.gz"
            self.open[cut] = [self.store.open_output_stream(name, compression=None), name, 0]
        place = self.open[cut]
        place[0].write(b"".join(records))
        place[2] += len(records)
        if place[0].tell() >= ARCHIVE_BYTES:
            self.close(cut)

    def close(self, cut: bool) -> None:
        stream, name, n = self.open.pop(cut)
        stream.close()
        self.done.append((name, cut, n))


def _write(folder: str):
    def run(batches):
        out = _Archives(folder)
        for rows in common.columns_of(batches, "page_id", "url", "body", "digest", "refers_to"):
            for row in zip(*rows):
                out.add(page_records(*row))
        for cut in list(out.open):
            out.close(cut)
        cols = list(zip(*out.done)) or [()] * 3
        yield common.batch({f.name: list(c) for f, c in zip(_MANIFEST, cols)}, _MANIFEST)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all of ``pages`` (page_id, url, html) to archives in ``folder``; returns the
    manifest (path, segmented, n_records), which is kept there too.

    A null html is an empty payload. Payloads of at least 100 bytes are kept once, by
    the smallest page id; rows that repeat that id and payload all keep it, and so do
    rows with a null id. Other columns are ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))

    shared = rows.filter(F.octet_length("body") >= LEAST_SHARED).select("page_id", "digest")
    keepers = shared.groupBy("digest").agg(F.min("page_id").alias("keeper"))
    # Written, so that Spark can split the join below at a payload of many pages.
    keepers = common.written(keepers, "payload-keepers")
    revisits = shared.join(keepers, "digest").filter("page_id <> keeper").distinct()
    revisits = revisits.select("page_id", "digest", F.col("keeper").alias("refers_to"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to")

    manifest = common.bounded_batches(rows).mapInArrow(_write(folder), MANIFEST_DDL)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{folder}/manifest")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record of a plain or gzipped
    archive, read in order."""
    stream = io.BufferedReader(stream, 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {headers.get('warc-record-id')} cut short")
        yield headers, block


def http_body(block: bytes) -> bytes:
    """The body of an HTTP message, out of its chunks and gzip coding."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (x.lower().partition(b":") for x in head.split(b"\r\n")[1:])
    headers = {k.strip(): v.strip() for k, _, v in lines}
    if headers.get(b"transfer-encoding") == b"chunked":
        body = dechunked(body)
    if headers.get(b"content-encoding") in (b"gzip", b"x-gzip"):
        body = zlib.decompress(body, 31)
    return body


def _payload(block: bytes, stated: str | None) -> tuple[bytes | None, str | None]:
    """The body and what is wrong with it, if anything."""
    try:
        body = http_body(block)
    except (ValueError, zlib.error) as e:
        return None, str(e)
    kind, _, value = (stated or "").partition(":")
    if kind == "sha256" and hashlib.sha256(body).hexdigest() != value.lower():
        return body, "payload digest differs"
    return body, None


def _row(headers: dict[str, str], block: bytes) -> tuple:
    get = headers.get
    kind, number = get("warc-type"), get("warc-segment-number")
    body, problem = block, None
    if number is None and kind == "response" and get("content-type", "").startswith("application/http"):
        body, problem = _payload(block, get("warc-payload-digest"))
    own = get("warc-record-id")
    total = get("warc-segment-total-length")
    page = get("x-page-id")
    return (
        own,
        kind,
        None if page is None else int(page),
        get("warc-target-uri"),
        get("warc-refers-to"),
        get("warc-payload-digest"),
        None if number is None else get("warc-segment-origin-id", own),
        None if number is None else int(number),
        None if total is None else int(total),
        body,
        problem,
    )


def _batches(rows: list[tuple]):
    return common.batch({f.name: list(c) for f, c in zip(_RECORDS, zip(*rows))}, _RECORDS)


def _read(segments: bool):
    """Records that are whole, or those that are segments."""

    def run(batches):
        for (paths,) in common.columns_of(batches, "path"):
            for path in paths:
                store, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for headers, block in records_in(stream):
                        if ("warc-segment-number" in headers) != segments:
                            continue
                        rows.append(_row(headers, block))
                        size += len(rows[-1][9] or b"")
                        if size > common.BATCH_BYTES or len(rows) >= common.BATCH_ROWS:
                            yield _batches(rows)
                            rows, size = [], 0
                if rows:
                    yield _batches(rows)

    return run


def _reassembled(table: pa.Table) -> pa.Table:
    """The records of one origin: its parts in order, as often as the first part is there."""
    rows = sorted((tuple(r.values()) for r in table.to_pylist()), key=lambda r: r[7])
    parts = {r[7]: r for r in rows}
    first, last = parts.get(1), rows[-1]
    block = b"".join(r[9] for _, r in sorted(parts.items()))
    body, problem = None, None
    if first is None or sorted(parts) != list(range(1, len(parts) + 1)):
        problem = "segment missing"
    elif last[8] is None or last[8] != len(block):
        problem = f"{len(block)} bytes of {last[8]}"
    else:
        body, problem = _payload(block, first[5])
    head = first or rows[0]
    whole = (*head[:6], head[6], None, len(block), body, problem)
    copies = max(1, sum(r[7] == 1 for r in rows))
    return pa.Table.from_batches([_batches([whole] * copies)])


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives in ``manifest`` (path, segmented): record_id,
    record_type, page_id, target_uri, refers_to_id, stated_digest, total_length, body,
    problem.

    Chunked bodies are decoded and cut blocks put together first. ``body`` is the
    payload of a response and the block of other records. A record whose segments, total
    length, framing or payload digest are wrong keeps its row with the ``problem``. Only
    cut records are shuffled. No archive, no rows.
    """
    places = manifest.select("path", "segmented").repartition("path")
    whole = common.bounded_batches(places).mapInArrow(_read(False), _RECORDS_DDL)
    parts = places.filter("segmented").mapInArrow(_read(True), _RECORDS_DDL)
    joined = parts.groupBy("origin").applyInArrow(_reassembled, _RECORDS_DDL)
    return whole.unionByName(joined).drop("origin", "segment")


def page_summary(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages``, read the archives back, and return (page_id, payload_bytes,
    payload_digest, record_type, refers_to) of each; a revisit's payload is that of the
    record it refers to."""
    records = read_archives(write_archives(pages, folder))
    problem = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "record_id", "problem")))
    rows = records.select(
        "page_id",
        "record_id",
        "record_type",
        "refers_to_id",
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.coalesce(problem.cast("string"), F.sha2("body", 256)).alias("payload_digest"),
    )
    rows = common.written(rows, "warc-summary")
    responses = rows.filter("record_type = 'response'")
    revisits = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id")
    kept = responses.select(
        F.col("record_id").alias("refers_to_id"),
        "payload_bytes",
        "payload_digest",
        F.col("page_id").alias("refers_to"),
    ).distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns)
    return responses.unionByName(revisits.join(common.written(kept, "warc-kept"), "refers_to_id").select(columns))
