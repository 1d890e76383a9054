"""WARC archives of Zstandard frames.

An archive starts with a skippable frame that holds the compression dictionary, followed by
one frame for each record, so a record can be read without the ones before it. Archives are
written and read by executors through the store's own interface (pyarrow.fs), one file after
another, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.store import work_path, written

# Format constants.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD_ID = "<urn:corpusmill:page:{}>"
DATE = "2024-01-01T00:00:00Z"
#: Payloads from this size on are written once.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 20
SAMPLE_PAGES = 256
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. Without a payload it is a revisit: the HTTP headers only, which tell the payload's length."""
    kind = "revisit" if payload is None else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"\s", "%20", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {RECORD_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def page_number(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:corpusmill:page:(-?\d*)>", urn)
    if not found:
        raise WarcError(f"not a page's record id: {urn[:80]!r}")
    return int(found[1]) if found[1] else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes]:
    """page_id, payload length, digest, type, refers_to, url and payload of a record; checks headers, lengths and digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not gap or version.decode("latin-1") != VERSION:
        raise WarcError(f"not a {VERSION} record")
    h = headers(fields)
    if missing := [k for k in REQUIRED if k not in h]:
        raise WarcError(f"headers are missing: {missing}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block's length is not its Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = headers(http.partition(b"\r\n")[2]).get("content-length", "")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if not gap or not length.isdigit():
        raise WarcError("the block is no HTTP message with a length")
    kind = h["warc-type"]
    if kind == "response":
        if len(payload) != int(length):
            raise WarcError("the payload's length is not the HTTP Content-Length")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload does not have its digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in h:
        raise WarcError(f"not a record of a known type: {kind[:40]!r}")
    refers = page_number(h["warc-refers-to"]) if kind == "revisit" else None
    return page_number(h["warc-record-id"]), int(length), digest, kind, refers, h.get("warc-target-uri"), payload


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def read_records(stream) -> Iterator[bytes]:
    """Decompressed records of an archive, one frame at a time. stream: read(n)."""
    buffer = stream.read(READ_BYTES)
    dictionary = None
    if len(buffer) >= 8 and struct.unpack("<I", buffer[:4])[0] == SKIPPABLE_MAGIC:
        size = struct.unpack("<I", buffer[4:8])[0]
        while len(buffer) < 8 + size:
            if not (more := stream.read(READ_BYTES)):
                raise WarcError("the dictionary's frame is cut short")
            buffer += more
        body, buffer = buffer[8 : 8 + size], buffer[8 + size :]
        if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body) if body else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        buffer = buffer or stream.read(READ_BYTES)
        if not buffer:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise WarcError(f"not a frame: {e}") from e
            if frame.eof:
                buffer = frame.unused_data
                break
            if not (buffer := stream.read(READ_BYTES)):
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of at most SAMPLE_PAGES pages, chosen by hash; empty if they are too few."""
    keyed = pages.withColumn("k", F.xxhash64("page_id", "url"))
    # The keys alone are sorted out first, so that tasks do not send pages that are not chosen.
    most = keyed.select("k").orderBy("k").limit(SAMPLE_PAGES).agg(F.max("k")).first()[0]
    if most is None:
        return b""
    rows = sorted(keyed.where(F.col("k") <= most).where("html <> ''").select("k", F.substring("html", 1, SAMPLE_BYTES).alias("h")).limit(2 * SAMPLE_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.h.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary, null for revisits), length, digest, refers_to (null for pages to be written whole).

    Only ids and digests meet by digest, so a payload that many pages have lies in no task
    twice; payloads move only where the table of revisits is too large to be sent to all tasks.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"length": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    keys, _ = written(rows.where(F.col("length") >= REVISIT_BYTES).select("page_id", "url", "length", "digest"), "digests")
    firsts, _ = written(keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    # Both sides are plain tables, so adaptive execution can split a hot digest.
    met = keys.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits, _ = written(met.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "length", "digest", F.col("first_id").alias("refers_to")), "revisits")
    known = revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).distinct()
    whole = rows.join(known, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left_anti")
    return whole.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits)


def write_archives(pages: DataFrame, path: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write a record for each page into archives under `path`, a URI of a store that all executors share.

    pages: page_id, url, html and any others, which are ignored; null html is an empty
    payload. Among equal payloads of at least REVISIT_BYTES the smallest page_id is the
    response and others are revisits of it; rows that repeat that page_id are responses too.
    Returns path, records of the archives. A file gets its name when it is whole, and a task
    that runs again writes files of its own, so the returned paths hold each page once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
        out, name, size, records, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                store.move(f"{root}/{name}.open", f"{root}/{name}")
                done.append((f"{path}/{name}", records))
                out = None

        for b in batches:
            for page_id, url, payload, length, digest, refers in zip(*(c if k == 2 else c.to_pylist() for k, c in enumerate(b.columns)), strict=True):
                if out is None:
                    name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    out, size, records = store.open_output_stream(f"{root}/{name}.open", compression=None), 0, 0
                    out.write(dictionary_frame(dictionary))
                frame = squeeze.compress(record(page_id, url, payload.as_py(), length, digest, refers))
                out.write(frame)
                size += len(frame)
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return written(with_originals(pages).mapInArrow(run, "path string, records bigint"), "archives")[0]


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """path of every archive below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(path).select("path")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives named in the column `path`.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and with
    with_payload also url and payload (binary; null for revisits). Archives are streamed, a
    frame at a time. Any record with bad headers, lengths or digest fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in read_records(stream):
                        row = parse(raw)
                        rows.append(row)
                        size += len(row[6]) if with_payload else 100
                        if size >= 8 << 20:
                            yield records_batch(rows, with_payload)
                            rows, size = [], 0
                yield records_batch(rows, with_payload)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", url string, payload binary" if with_payload else "")
    tasks = max(1, min(archives.count(), 10_000))
    return archives.select("path").repartition(tasks).mapInArrow(run, schema)


def records_batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    n = 7 if with_payload else 5
    cols = [[r[k] for r in rows] for k in range(n)]
    if with_payload:
        cols[6] = [None if r[3] == "revisit" else r[6] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[:n])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back."""
    path = work_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path, train_dictionary(pages)))
