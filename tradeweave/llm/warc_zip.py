"""WARC records in ZIP-packaged archives: written by partition, read back by byte range.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, a gzip member
per record, and ``indexes/index.cdxj``, a line per record with its offset and length.
The reader parses central and ZIP64 directories from the end of each file, finds the
stored members, reads only the index, deals the records out as contiguous byte ranges
over all tasks, and range-reads and parses those; nothing is extracted.

Of records with equal payloads (SHA-256) of at least ``MIN_REVISIT`` bytes, the one with
the smallest id is a response and the others are revisits that point to it.

Files are written through ``pyarrow.fs`` under the given folder, which all executors must
share (local path, ``file://``, ``hdfs://``, ``s3://``, ``gs://``). Names are unique per
attempt and only those of finished tasks are in the manifest, which is itself written
once, so a retried task leaves at most an unreferenced file.

Defined results: null html is an empty payload; a null id is always a response without
an id line; repeated rows of the smallest id are all responses; a null url is recorded as
``urn:none``; an empty table writes and reads nothing. Extra columns are not recorded.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import python_ready, shared_dir, staged
from .zip_ranges import data_start, members

MIN_REVISIT = 100
HOT = 1000
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def with_record_types(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """key, url, payload, payload_digest, payload_bytes, record_type, refers_to; a revisit's payload is null."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # slim, and combined before the shuffle
    first = rows.filter((F.col("payload_bytes") >= min_revisit) & F.col("key").isNotNull()).groupBy("payload_digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    first = staged(first.filter("n > 1"), "first")
    # a digest that many pages share is not a key that payloads are dealt by: at most HOT digests have one in HOT of all
    # repeated pages, and these go to every task
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * HOT >= total
    rows = rows.join(F.broadcast(first.filter(hot).select("payload_digest", F.col("first").alias("hot_first"))), "payload_digest", "left")
    place = F.when(F.col("hot_first").isNotNull(), F.concat(F.lit("page "), F.xxhash64("key", "url").cast("string"))).otherwise(F.col("payload_digest"))
    others = first.filter(~hot).select(F.col("payload_digest").alias("place"), "first")
    rows = rows.withColumn("place", place).join(others, "place", "left").withColumn("first", F.coalesce("hot_first", "first"))
    revisit = F.coalesce(F.col("key") != F.col("first"), F.lit(False))
    return rows.select(
        "key", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}')}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def warc_record(key, url: str | None, payload: bytes | None, digest: str, size: int, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url) if url else 'urn:none'}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """(WARC headers, payload, HTTP headers) of one record; header names in lower case."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode("latin-1").split("\r\n")[1:])}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (columns of ``with_record_types``) and return the staged manifest: path, records, bytes."""
    python_ready(rows.sparkSession, batch_rows=500)
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            nonlocal data, index
            path = f"{top}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(DATA, data.getvalue())
                z.writestr(INDEX, "".join(index))
            size = store.get_file_info(path).size
            done = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])
            data, index = io.BytesIO(), []
            return done

        for batch in batches:
            for key, url, payload, digest, size, kind, refers_to in zip(*(batch.column(i).to_pylist() for i in range(7))):
                raw, at = _gzip(warc_record(key, url, payload, digest, size, kind, refers_to)), data.tell()
                data.write(raw)
                index.append(f"{_line(url) if url else 'urn:none'} 20240101000000 {json.dumps({'offset': at, 'length': len(raw), 'filename': DATA})}\n")
                if data.tell() >= archive_bytes:
                    yield close()
        if index:
            yield close()

    wanted = rows.select("key", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to")
    return staged(wanted.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def locate_records(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Contiguous byte ranges of whole records in archives (column path): path, start, lengths."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple[str, int, list[int]]] = []
                with store.open_input_file(path) as file:
                    inside = {m.name: m for m in members(file, file.size())}
                    for m in (m for name, m in inside.items() if name.startswith("indexes/") and name.endswith(".cdxj")):
                        file.seek(data_start(file, m))
                        starts = {}
                        for line in file.read(m.size).decode().splitlines():
                            where = json.loads(line.split(" ", 2)[2])
                            base = starts.setdefault(where["filename"], data_start(file, inside[where["filename"]]))
                            at, n = base + int(where["offset"]), int(where["length"])
                            if out and out[-1][1] + sum(out[-1][2]) == at and len(out[-1][2]) < 4096 and sum(out[-1][2]) + n <= range_bytes:
                                out[-1][2].append(n)
                            else:
                                out.append((path, at, [n]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    return archives.select("path").repartition(F.xxhash64("path")).mapInArrow(locate, "path string, start long, lengths array<long>")


RECORD = T.StructType([
    T.StructField("record_key", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to_id", T.StringType()), T.StructField("stated_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """The records of all archives: record_key, record_id, record_type, target_uri, refers_to_id, stated_digest, payload (null for a revisit)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(path) as file:
                    file.seek(start)
                    data, at, out = file.read(sum(lengths)), 0, []
                for n in lengths:
                    fields, payload, _ = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    kind = fields["warc-type"]
                    out.append((fields.get("x-record-key"), fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                                fields.get("warc-payload-digest", "").removeprefix("sha256:"), None if kind == "revisit" else payload))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary() if i == 6 else pa.string()) for i in range(7)], names=RECORD.fieldNames())

    ranges = locate_records(archives, folder).repartition(F.xxhash64("path", "start"))
    return ranges.mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back: key, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Size and digest are those of the payload read back; a revisit takes them from the response it refers to.
    """
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_record_types(pages, key, url, html), folder)
    slim = read_records(manifest, folder).select(
        "record_key", "record_id", "record_type", "target_uri", "refers_to_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    )
    slim = staged(slim, "records")
    responses = slim.filter("record_type = 'response'")
    # repeated rows share a record id; one of them stands for all
    targets = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("record_key").alias("refers_to"), F.min("payload_bytes").alias("bytes"), F.min("payload_digest").alias("digest"))
    revisits = slim.filter("record_type = 'revisit'").join(targets, "refers_to_id")
    kind = pages.schema[key].dataType
    return responses.select(
        F.col("record_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to"), "target_uri",
    ).unionByName(revisits.select(
        F.col("record_key").cast(kind).alias(key), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "target_uri",
    ))
