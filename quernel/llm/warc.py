"""WARC archives as a chunked record table.

Writing: every payload is cut into chunks, rows of (record id, chunk number, bytes), which stream through the
writer; so no worker ever builds a whole record.  A record's header needs the payload's length and digest,
which Spark computes over the column.  Each task writes one archive (one gzip member a record, or
plain) into a shared folder and returns a manifest row for each record; what a lost or repeated
attempt has written stands in no manifest and is ignored.

Reading: archives named by a manifest are parsed as streams; a payload comes back as chunk rows that carry
the running SHA-256 up to and including each chunk, so the digest of a record stands in its last row.

Equal payloads of at least ``min_bytes`` are written once, as a response of the smallest id; the others are
revisit records that refer to it.

Defined cases: a null payload is an empty one; null ids are written with an empty id, read back as null, and
are never referred to unless no other id has the payload; records that share the smallest id and the payload
are all responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import lean, scratch, small, written

CHUNK_BYTES = 1 << 18
MIN_REVISIT_BYTES = 100
MANIFEST = "record_id long, archive string, archive_offset long, record_type string, refers_to long, payload_bytes long"
CHUNKS = "record_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, chunk_no int, chunk binary, chunk_end long, running_sha256 string, is_last boolean"


@contextmanager
def opened(path: str, mode: str):
    """A local path or file: URI, or what pyarrow's file systems open (hdfs:, s3:, gs:)."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        local = parts.path or path
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, mode) as handle:
            yield handle
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        if "w" in mode:
            system.create_dir(os.path.dirname(inner), recursive=True)
        with system.open_output_stream(inner) if "w" in mode else system.open_input_stream(inner) as handle:
            yield handle


def records(pages: DataFrame, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """record_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each row."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # Only digests that several records share are joined back, as a table of their own: a hot one is one row there, and a
    # skewed join of two tables that Spark splits.
    shared = small(
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.min("record_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    joined = rows.join(shared, F.col("payload_digest") == F.col("__digest"), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("__first"))
    return joined.select("*", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__first")).alias("refers_to")).drop("__digest", "__first")


def chunked(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """records() as chunk rows, those of a record in order; a revisit carries no bytes."""
    carried = F.when(F.col("record_type") == "revisit", F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    count = F.greatest(F.ceil(carried / chunk_bytes), F.lit(1)).cast("int")
    numbered = rows.select("*", carried.alias("carried"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    part = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return numbered.withColumn("chunk", part).drop("payload")


def _header(kind: str, url: str | None, record_id: int | None, refers_to: int | None, digest: str, size: int, carried: int) -> bytes:
    name = lambda i: f"<urn:quernel:page:{'' if i is None else i}>"
    labelled = base64.b32encode(bytes.fromhex(digest)).decode().rstrip("=")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(record_id)}", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{labelled}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {carried}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def write_archives(chunks: DataFrame, folder: str, compress: bool = True) -> DataFrame:
    """Write chunk rows as one archive a task below folder; the manifest, a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        context = TaskContext.get()
        # a name of this attempt alone
        path = f"{folder}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc" + (".gz" if compress else "")
        manifest: list[tuple] = []
        offset = 0
        with opened(path, "wb") as out:
            packer = None

            def put(data: bytes) -> None:
                nonlocal offset
                data = packer.compress(data) if packer else data
                offset += out.write(data) or 0

            def finish() -> None:
                nonlocal offset, packer
                put(b"\r\n\r\n")
                if packer:
                    offset += out.write(packer.flush()) or 0

            def stream() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for batch in stream():
                cells = [batch.column(n).to_pylist() for n in ("chunk_no", "record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "carried")]
                data = batch.column("chunk")
                for i, (number, record, url, kind, refers, digest, size, carried) in enumerate(zip(*cells, strict=True)):
                    if number == 0:
                        if manifest:
                            finish()
                        manifest.append((record, path, offset, kind, refers, size))
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31) if compress else None
                        put(_header(kind, url, record, refers, digest, size, carried))
                    put(data[i].as_buffer())
            finish()
        columns = list(zip(*manifest, strict=True))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    return chunks.mapInArrow(lean(run), MANIFEST)


class _Plain(io.RawIOBase):
    """The concatenated gzip members of a stream, inflated as they are read."""

    def __init__(self, handle):
        self.handle, self.inflater, self.rest = handle, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            data = self.rest or self.handle.read(1 << 16)
            if not data:
                return 0
            if self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            out = self.inflater.decompress(data, len(target))
            self.rest = self.inflater.unconsumed_tail or self.inflater.unused_data
            if out:
                target[: len(out)] = out
                return len(out)


def parse(handle, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Chunk rows of an archive's records, from a stream of its bytes."""
    number = lambda text: int(text) if (text := text.removeprefix("<urn:quernel:page:").removesuffix(">")) else None
    while line := handle.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := handle.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.lower()] = value.strip()
        record, refers = number(fields["warc-record-id"]), number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        encoded = fields["warc-payload-digest"].removeprefix("sha256:")
        digest = base64.b32decode(encoded + "=" * (-len(encoded) % 8)).hex()
        left, count, at, running = int(fields["content-length"]), 0, 0, hashlib.sha256()
        while True:
            data = handle.read(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError("a record ends early")
            running.update(data)
            left, at = left - len(data), at + len(data)
            yield record, fields["warc-type"], refers, fields["warc-target-uri"], int(fields["x-payload-length"]), digest, count, data, at, running.copy().hexdigest(), not left
            count += 1
            if not left:
                break


def read_archives(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_bytes: bool = True) -> DataFrame:
    """The chunk rows of the archives in column ``archive``; without bytes, the chunk column is null."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                with opened(path, "rb") as handle:
                    stream = io.BufferedReader(_Plain(handle), 1 << 18) if path.endswith(".gz") else io.BufferedReader(handle, 1 << 18)
                    rows, held = [], 0
                    for row in parse(stream, chunk_bytes):
                        held += len(row[7]) if with_bytes else 0
                        rows.append(row if with_bytes else (*row[:7], None, *row[8:]))
                        if len(rows) >= 4096 or held >= 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    # Names are small, so their number, not their bytes, must decide how many tasks read.
    listed = archives.select("archive").distinct()
    return listed.repartition(max(1, listed.count())).mapInArrow(lean(run), CHUNKS)


def archive_pages(pages: DataFrame, folder: str | None = None, compress: bool = True, **options) -> DataFrame:
    """Write pages as archives and return the manifest as a written table."""
    spark = pages.sparkSession
    return written(spark, write_archives(chunked(records(pages, **options)), folder or scratch(spark, "warc"), compress), "manifest")


def op4_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives have them."""
    spark = pages.sparkSession
    manifest = archive_pages(pages)
    back = read_archives(spark, manifest, with_bytes=False).where("is_last")
    # A response's digest is that of the bytes read back; a revisit's, that of its record.
    digest = F.when(F.col("record_type") == "response", F.col("running_sha256")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.col("chunk_end")).otherwise(F.col("payload_bytes"))
    return back.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), sized AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM rows
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN firsts USING (payload_digest)
"""
