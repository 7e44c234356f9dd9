"""WARC archives as a chunked record table: payloads stream through as (record id, chunk number) rows with running digests.

Writing: each page becomes one gzip member holding a WARC/1.1 record, in files of the shared folder; a payload is hashed and
compressed chunk by chunk. Of pages with equal payloads the one with the largest id is a response, the others are revisits
of it: digests and ids alone are exchanged to tell which, then each payload goes to a writer by its page id, so the copies of a
common page are spread. A written manifest lists the records of committed tasks only, so files of lost attempts are never read.
Reading: members are decompressed in bounded pieces and leave as chunk rows; no record is ever held whole beyond the row
that it came from. A response whose content does not give the digest in its header is an error.

Defined cases: a null or empty html is an empty payload (equal to other empty ones); a null url gives no target URI; a null
page id is written as `none`, is always a response and reads back as null; rows that repeat the id and payload of a response
are responses too; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, staged, text_buffers, whole_ids

CHUNK_BYTES = 1 << 20
#: Compressed bytes of a file that one reading task takes at a time.
SPLIT_BYTES = 16 << 20
MANIFEST = "file string, start long, length long"
CHUNKS = "record_id string, chunk_no int, record_type string, target_uri string, refers_to string, declared_bytes long, declared_digest string, data binary, running_digest string, last boolean, file string, start long"
_ID = "urn:x-page:"
_DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def base32_sha1(payload_sha1: bytes) -> str:
    return base64.b32encode(payload_sha1).decode()


def _header_value(value: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_pieces(page_id, url, payload: memoryview, sha1: bytes, refers_to, chunk: int):
    """The bytes of one record in pieces of at most a chunk."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'none' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    yield "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    if not revisit:
        for k in range(0, len(payload), chunk):
            yield payload[k : k + chunk]
    yield b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives and return the manifest, a written table of (file, start, length): one row a record."""
    folder = folder or shared_folder(pages.sparkSession)
    whole_ids(pages, "page_id")
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    small = staged(keyed.where("page_id is not null").select("page_id", "sha1", F.octet_length("html").alias("n")).distinct())
    heads = staged(small.groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1"))
    later = small.where(F.col("n") >= min_revisit_bytes).join(heads, "sha1").where("head <> page_id").select("page_id", "sha1", F.col("head").alias("refers_to"))
    # Rows without an id are responses and refer to nothing; the others meet by id and digest. Hashed on the small side, so that
    # payloads are not sorted on their way to the writer.
    rows = keyed.where("page_id is not null").join(later.hint("shuffle_hash"), ["page_id", "sha1"], "left").select("page_id", "url", "html", "sha1", "refers_to")
    rows = rows.unionByName(keyed.where("page_id is null").select("page_id", "url", "html", "sha1", F.lit(None).cast("long").alias("refers_to")))

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            starts, lengths = [], []
            ids, urls, sums, refer = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            data, offsets = text_buffers(batch.column(2))
            whole = memoryview(data)
            for i in range(batch.num_rows):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                pack, start = zlib.compressobj(1, zlib.DEFLATED, 31), at
                check = hashlib.sha1()
                payload = whole[offsets[i] : offsets[i + 1]]
                for k in range(0, len(payload), chunk):
                    check.update(payload[k : k + chunk])
                if check.digest() != sums[i]:
                    raise ValueError(f"page {ids[i]}: the payload does not give its digest")
                for piece in record_pieces(ids[i], urls[i], payload, sums[i], refer[i], chunk):
                    packed = pack.compress(piece)
                    at += out.write(packed) if packed else 0
                at += out.write(pack.flush())
                starts.append(start)
                lengths.append(at - start)
            yield pa.RecordBatch.from_pydict({"file": pa.array([f"{folder}/{name}"] * len(starts), pa.string()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})
        if out:
            out.close()

    return staged(rows.mapInArrow(write, MANIFEST))


class _Member:
    """One gzip member read in bounded pieces."""

    def __init__(self, stream, length: int, chunk: int):
        self.chunk, self.stream, self.left, self.unpack, self.ready = chunk, stream, length, zlib.decompressobj(31), bytearray()

    def fill(self, n: int) -> None:
        while len(self.ready) < n and not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed and self.left:
                packed = self.stream.read(min(self.chunk, self.left))
                self.left -= len(packed)
            got = self.unpack.decompress(packed, self.chunk)
            if not got and not packed:
                break
            self.ready += got

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        size = 4096
        while True:
            self.fill(size)
            at = self.ready.find(mark)
            if at >= 0:
                return self.take(at + len(mark))[: -len(mark)]
            if len(self.ready) < size:
                raise ValueError("a record ends within its header")
            size *= 2


def _fields(block: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def record_chunks(stream, length: int, chunk: int):
    """The chunk rows of one record."""
    member = _Member(stream, length, chunk)
    head = _fields(member.until(b"\r\n\r\n"))
    http_raw = member.until(b"\r\n\r\n")
    http = _fields(http_raw)
    left = int(head["content-length"]) - len(http_raw) - 4
    name = lambda key: head[key][1 + len(_ID) : -1] if key in head else None
    fixed = (head["warc-type"], head.get("warc-target-uri"), name("warc-refers-to"), int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"))
    number, running = 0, hashlib.sha1()
    while True:
        data = member.take(min(chunk, left))
        if left and not data:
            raise ValueError(f"record {name('warc-record-id')} is cut short")
        left -= len(data)
        running.update(data)
        digest = base32_sha1(running.digest())
        if not left and fixed[0] == "response" and digest != fixed[4]:
            raise ValueError(f"record {name('warc-record-id')}: its payload does not match its headers")
        yield (name("warc-record-id"), number, *fixed, data, digest, left == 0)
        number += 1
        if not left:
            break
    if member.take(4) != b"\r\n\r\n":
        raise ValueError(f"record {name('warc-record-id')} has no end mark")


def _splits(manifest: DataFrame) -> DataFrame:
    """Records dealt out by file and stretch of a file, each read front to back.

    The number of tasks follows the archives' bytes, of which the manifest's own size says nothing.
    """
    stretch = F.floor(F.col("start") / SPLIT_BYTES)
    total = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // SPLIT_BYTES))
    return manifest.repartition(tasks, "file", stretch).sortWithinPartitions("file", "start")


def _records(batches):
    """(stream, length, file, start) of each record of the manifest rows, keeping one file open."""
    name, stream = None, None
    for batch in batches:
        for file, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            if file != name:
                if stream:
                    stream.close()
                store, path = open_store(file)
                name, stream = file, store.open_input_file(path)
            stream.seek(start)
            yield stream, length, file, start
    if stream:
        stream.close()


def read_warc_chunks(manifest: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives; a record's payload is its chunks' data in order."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("data", pa.binary()), ("running_digest", pa.string()), ("last", pa.bool_()), ("file", pa.string()), ("start", pa.int64())])

    def read(batches):
        rows, held = [], 0
        for stream, length, file, start in _records(batches):
            for row in record_chunks(stream, length, chunk):
                rows.append((*row, file, start))
                held += len(row[7]) + 200
                if held > 4 * chunk:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=kinds)

    return _splits(manifest).mapInArrow(read, CHUNKS)


def read_warc_records(manifest: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row a record from its chunk rows: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    A response's size is the sum of its chunks, its digest the running one of its last chunk. A revisit carries no payload; its
    size and digest are those that its headers state. A record is named by its file and place, so tied ids stay apart.
    """
    chunks = read_warc_chunks(manifest, chunk)
    fields = ("record_id", "record_type", "target_uri", "refers_to", "declared_bytes", "declared_digest")
    last = F.max(F.struct("chunk_no", "running_digest", *fields)).alias("x")
    rows = chunks.groupBy("file", "start").agg(F.sum(F.octet_length("data").cast("long")).alias("bytes"), last)
    number = lambda c: F.when(c != "none", c.cast("long"))
    response = F.col("x.record_type") == "response"
    size = F.when(response & (F.col("bytes") != F.col("x.declared_bytes")), F.raise_error(F.lit("a payload is not as long as its headers state"))).otherwise(F.col("x.declared_bytes"))
    return rows.select(
        number(F.col("x.record_id")).alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        F.when(response, F.col("x.running_digest")).otherwise(F.col("x.declared_digest")).alias("payload_digest"),
        F.col("x.record_type").alias("record_type"),
        number(F.col("x.refers_to")).alias("refers_to"),
        F.col("x.target_uri").alias("target_uri"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return read_warc_records(write_warc(read_table(spark, sf_dir, "pages"))).drop("target_uri")
