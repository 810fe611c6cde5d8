"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

The writer puts each record into a gzip member of its own. The reader streams an archive:
it inflates member after member in small steps, frames records by their content length and
verifies the digests, so that its memory is that of one record.

Archives lie in a folder that all executors see. Each is written under a name of its own
task attempt, and only the names that finished tasks report are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import shared, stage

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
#: Payloads below this many bytes are never revisits.
LEAST = 100
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


def plan_records(pages: DataFrame, least: int = LEAST, payload: str = "html", id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each record will be.

    Of the rows with one payload of at least ``least`` bytes, those with the smallest id hold it
    (several only if that id itself repeats) and the others refer to them. A null payload is
    empty; rows without an id hold their payload unless an id of their group does.
    The smallest id is found by a combining aggregate. Only payloads that occur twice are kept;
    they are written, so that the join is of two plain shuffles, whose large partitions Spark splits.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= least)
    first = stage(long.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    other = (F.octet_length("payload") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", F.when(~other, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"), "digest", F.when(other, F.col("first")).alias("refers_to")
    )


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    clean = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {clean}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def write(records: DataFrame, folder: str, archive_bytes: int = 64 << 20, level: int = 6) -> DataFrame:
    """Write ``records`` (see ``plan_records``) below ``folder``; (path, records, bytes) of each archive.

    An archive closes once it has ``archive_bytes``. The list is staged, so the archives are
    written once; a task that runs again leaves files that no list names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        store.create_dir(root, recursive=True)
        out, path, done = None, "", []

        def close() -> None:
            out.close()
            done.append((path, count, size))

        count = size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                member = _member(_record(row["page_id"], row["url"], row["payload"], row["size"], row["digest"], row["refers_to"]), level)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return stage(records.mapInArrow(run, "path string, records long, bytes long"))


class Reader:
    """Iterates over the records of a stream of gzip members."""

    def __init__(self, stream: BinaryIO, step: int = STEP) -> None:
        self.stream, self.step = stream, step
        self.inflate = zlib.decompressobj(31)
        self.raw, self.ready, self.begun = b"", bytearray(), False

    def _more(self) -> bool:
        """Inflate one more step; False at the end of the archive, which must be that of a member, its trailer included."""
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data + self.raw, zlib.decompressobj(31)
            self.begun = False
            return True
        if not self.raw:
            self.raw = self.stream.read(self.step)
            if not self.raw:
                if self.begun:
                    raise ValueError("the archive ends inside a gzip member")
                return False
        self.begun = True
        self.ready += self.inflate.decompress(self.raw, self.step)
        self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def _until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                if self.ready.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        found = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return found

    def _take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record's block")
        found = bytes(self.ready[:n])
        del self.ready[:n]
        return found

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while (head := self._until(b"\r\n\r\n")) is not None:
            version, *lines = head.decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            block = self._take(int(headers["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record's block is longer than its content length")
            yield headers, block


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def parse(headers: dict[str, str], block: bytes) -> tuple:
    """A record as the columns of ``READ``; the payload's digest is computed anew where there is a payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    said = headers["warc-payload-digest"].removeprefix("sha256:")
    sound = headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    size, digest = int(http["content-length"]), said
    if headers["warc-type"] == "response":
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        sound = sound and digest == said and size == int(http["content-length"])
    uri = headers.get("warc-target-uri")
    url = uri if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return _page(headers["warc-record-id"]), url, headers["warc-type"], _page(headers.get("warc-refers-to")), size, digest, sound


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives named in ``path``, one row each, with ``payload`` if asked for.

    A broken archive raises an error; a record whose digests do not hold has ``verified`` false.
    """
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for headers, block in Reader(stream):
                        rows.append((*parse(headers, block), *([block.partition(b"\r\n\r\n")[2]] if payload else [])))
                        held += len(block) if payload else 500
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * (len(names) + payload)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.binary()])], names=[*names, *(["payload"] if payload else [])])

    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, READ + (", payload binary" if payload else ""))


def op2(spark, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(write(plan_records(pages), shared(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS verified
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
