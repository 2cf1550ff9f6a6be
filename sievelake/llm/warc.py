"""WARC archives, index first.

Writing: each task streams its pages into gzip-per-record archives of a bounded
size in the shared folder and returns an index row for each record: archive,
offset, length, URL, digest. The index is what counts: a task that is repeated
writes a new file under a new name, and records that no index row names are never
read. Of equal payloads the smallest id becomes the response and the others
revisit records that refer to it; first ids come from a pre-aggregated minimum by
digest, kept only for digests that repeat.

Reading: the selected index rows are dealt by archive and block of offsets to as
many tasks as their lengths call for (the index rows' own size says nothing), sorted,
and neighbouring ranges are joined into single reads; each record is unzipped,
parsed and checked against its digest.

Files are opened with pyarrow.fs by the URI of the shared folder, so it may be
local, HDFS or an object store.

Edge cases: a null html is an empty payload; a null url leaves the target URI
out; empty and small payloads are always responses; a repeated id with one
payload is a response each time if it is the smallest (a null id only if no other
has the payload); line breaks and percent signs in ids are escaped in the archive,
line breaks in URLs too; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import cut, remove, shared_dir, slices

MIN_REVISIT = 100
#: An archive is closed at this size; a task reads a sixteenth of it, about; reads join ranges up to READ bytes over gaps of GAP bytes at most.
ARCHIVE, READ, GAP = 256 << 20, 8 << 20, 64 << 10
#: Repeated digests (about 100 bytes each) up to this number are broadcast; more are joined by a shuffle.
SMALL = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset bigint, length bigint, url string, digest string, id string, type string, refers_to string"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")
    return where, path


def _field(value: str) -> str:
    """A header value that holds no line break and keeps its outer blanks; unquote() gives it back."""
    return re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP header, which has the payload's length, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-Id", _field(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", _field(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields and the payload of one uncompressed record; its digest is checked where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} differs from its digest")
    page, first = (unquote(x, errors="strict") if (x := fields.get(k)) is not None else None for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
    return {"id": page, "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": first, "payload": payload}


def first_ids(pages: DataFrame, id_col: str, html_col: str, least: int = MIN_REVISIT) -> DataFrame:
    """first_digest and first (the smallest id) of payloads that occur more than once."""
    rows = pages.select(F.col(id_col).alias("id"), F.encode(F.col(html_col), "utf-8").alias("b")).where(F.octet_length("b") >= least)
    return rows.groupBy(F.sha2("b", 256).alias("first_digest")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives into `folder` and the index, as Parquet, into its `index`; returns the index."""
    spark = pages.sparkSession
    firsts = cut(first_ids(pages, id_col, html_col))
    few = firsts.count() <= SMALL
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    rows = rows.join(F.broadcast(firsts) if few else firsts, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _filesystem(folder)
        sink = name = None
        at = 0
        try:
            for b in slices(batches, 2):
                out = {k: [] for k in ("archive", "offset", "length")}
                refers = b.column(4).to_pylist()
                for i, url, payload, digest, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), refers):
                    if sink is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = where.open_output_stream(f"{top}/{name}", compression=None)
                    press = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = press.compress(record(i, url, payload, digest, refers_to)) + press.flush()
                    sink.write(data)
                    for k, v in (("archive", name), ("offset", at), ("length", len(data))):
                        out[k].append(v)
                    at += len(data)
                    if at >= ARCHIVE:
                        sink.close()
                        sink = None
                kinds = pa.array(["response" if x is None else "revisit" for x in refers], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(out["archive"], pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64()), b.column(1), b.column(3), b.column(0), kinds, b.column(4)], ["archive", "offset", "length", "url", "digest", "id", "type", "refers_to"])
        finally:
            if sink is not None:
                sink.close()

    where, top = _filesystem(folder)
    where.create_dir(top, recursive=True)
    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def ranges(offsets: list[int], lengths: list[int], most: int = READ, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(first row, end row, offset, length) of the reads for sorted records."""
    out, i = [], 0
    while i < len(offsets):
        end, j = offsets[i] + lengths[i], i + 1
        while j < len(offsets) and offsets[j] - end <= gap and max(end, offsets[j] + lengths[j]) - offsets[i] <= most:
            end, j = max(end, offsets[j] + lengths[j]), j + 1
        out.append((i, j, offsets[i], end - offsets[i]))
        i = j
    return out


def read(selected: DataFrame, folder: str, payloads: bool = True, block: int = ARCHIVE // 16) -> DataFrame:
    """The records that the given index rows name: id, url, type, payload_bytes, payload_digest, refers_to and payload."""
    names = ["id", "url", "type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _filesystem(folder)
        open_name = source = None
        try:
            for b in batches:
                archive, offset, length = (b.column(k).to_pylist() for k in range(3))
                i = 0
                while i < len(archive):
                    j = i
                    while j < len(archive) and archive[j] == archive[i]:
                        j += 1
                    if archive[i] != open_name:
                        if source is not None:
                            source.close()
                        source, open_name = where.open_input_file(f"{top}/{archive[i]}"), archive[i]
                    for a, e, at, n in ranges(offset[i:j], length[i:j]):
                        data, found = source.read_at(n, at), []
                        for k in range(i + a, i + e):
                            found.append(parse(zlib.decompress(data[offset[k] - at : offset[k] - at + length[k]], 31)))
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kinds[c]) for c in names], names)
                    i = j
        finally:
            if source is not None:
                source.close()

    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    kinds = {c: kinds.get(c, pa.string()) for c in names}
    schema = "id string, url string, type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * payloads
    part = F.floor(F.col("offset") / block)
    tasks = max(1, -(-(selected.agg(F.sum("length")).first()[0] or 0) // block))
    dealt = selected.select("archive", "offset", "length").repartition(tasks, "archive", part).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to. The archives go when they are read."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType
    try:
        back = cut(read(write(pages, folder, id_col, url_col, html_col), folder, payloads=False))
    finally:
        remove(spark, folder)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
