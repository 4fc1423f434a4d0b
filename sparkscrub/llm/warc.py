"""WARC archives: writing, normalising whole-file gzip streams to one member per record with an offset index, reading back.

1. `write` makes one archive per partition as a single gzip stream, the monolithic form. Of the pages with equal payloads the one with the
   largest id is a response, the others are revisits that name it.
2. `normalise` has one task per archive: it inflates the stream once, chunk by chunk, writes every record as a gzip member of its own and
   beside it an index of JSON lines (offset, length, id, type). Memory holds one record.
3. `read` seeks the members by the index.

Files are named by task attempt, and only those that a finished task reported are used, so a lost executor leaves at most unused files.
Folders are any place that pyarrow.fs opens and all executors share.

A null page has an empty payload; empty payloads are equal payloads like others when `revisit_from` is 0. A null id never is the largest;
pages without ids are responses. Rows that repeat the id of a response with its payload are responses too. Null URLs are left out."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

LEVEL = 3
CHUNK = 1 << 20
_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(uri: str, mode: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit of page `keeper` with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = keeper is not None and keeper != page_id
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}",
            f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_VISIBLE)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{keeper}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = LEVEL) -> DataFrame:
    """Write page_id, url, html as monolithic archives; (path, records) of each.

    The largest id per payload is a combined maximum over digests; the payloads move once, by page id, to meet it."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    slim = pages.select("page_id", "digest").filter((F.octet_length("html") >= revisit_from) & F.col("page_id").isNotNull())
    keepers = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least")).filter("keeper <> least").select("digest", "keeper")
    repeats = slim.join(keepers, "digest").filter("page_id <> keeper").distinct()
    flagged = pages.join(repeats, ["page_id", "digest"], "left").select("page_id", "url", "html", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/raw/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, packer, count = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for page_id, url, html, keeper in zip(*[batch[c] for c in ("page_id", "url", "html", "keeper")]):
                out = out or open_file(path, "w")
                out.write(packer.compress(record(page_id.as_py(), url.as_py(), html.as_py().encode(), keeper.as_py(), date)))
                count += 1
        if out:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return stored(flagged.mapInArrow(run, "path string, records long"), "archives")


class Records:
    """Splits a stream of bytes into WARC records (header fields, bytes of the whole record)."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer, self.at = chunks, bytearray(), 0

    def _fill(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        del self.buffer[:self.at]
        self.at = 0
        self.buffer += chunk
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
                if not self._fill():
                    if self.buffer[self.at:].strip():
                        raise ValueError("the archive ends inside a record header")
                    return
            fields = header(bytes(self.buffer[self.at:end]))
            size = end + 4 - self.at + int(fields["content-length"]) + 4
            while len(self.buffer) - self.at < size:
                if not self._fill():
                    raise ValueError("the archive ends inside a record")
            yield fields, bytes(self.buffer[self.at:self.at + size])
            self.at += size


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, in chunks."""
    unpack = zlib.decompressobj(31)
    while chunk := source.read(CHUNK):
        held = False
        while chunk or held:
            data = unpack.decompress(chunk, 4 * CHUNK)
            if data:
                yield data
            chunk, held = unpack.unconsumed_tail, len(data) == 4 * CHUNK  # output may wait inside after all input is taken
            if unpack.eof:
                chunk, held, unpack = unpack.unused_data, False, zlib.decompressobj(31)


def _each(archives: DataFrame) -> DataFrame:
    """One task for each archive, whose size its writer's partition bounds."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite archives (path) to one gzip member per record with an index beside each; (path, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for value in batch["path"]:
                source = value.as_py()
                name = source.rpartition("/")[2].partition(".")[0]
                path = f"{folder}/members/{name}-{attempt}.warc.gz"
                offset = count = 0
                with open_file(source, "r") as whole, open_file(path, "w") as out, open_file(path + ".idx", "w") as index:
                    for fields, raw in Records(inflated(whole)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        line = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset += len(member)
                        count += 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path + ".idx"]), pa.array([count], pa.int64())], names=["path", "index", "records"])

    return stored(_each(archives).mapInArrow(run, "path string, index string, records long"), "normalised")


def page_number(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header(head)
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")[1:]
    return fields, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, sought by the indexes (path, index).

    A response's digest and size are taken from its payload and must agree with its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"]):
                with open_file(index.as_py(), "r") as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                with open_file(path.as_py(), "r") as archive:
                    for at in range(0, len(entries), 1000):
                        yield _rows(archive, entries[at:at + 1000])

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def _rows(archive, entries: list[dict]) -> pa.RecordBatch:
        rows = []
        for entry in entries:
            archive.seek(entry["offset"])
            fields, http, payload = parse(zlib.decompress(archive.read(entry["length"]), 31))
            digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
            if fields["warc-type"] == "response" and (size, digest) != (len(payload), base32(hashlib.sha1(payload).digest())):
                raise ValueError(f"{entry['id']}: payload and header disagree")
            rows.append((page_number(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], page_number(fields.get("warc-refers-to"))))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _each(archives).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write, normalise and read back; one row per page."""
    return read(normalise(write(pages, folder), folder))
