"""WARC archives of pages: a deterministic sharded writer, and a reader.

Pages are dealt into ranges of page_id of about `shard_bytes` of payload, by
bounds that follow from the rows alone, and sorted; each range is a task. A task
rolls its files at `file_bytes` of compressed size. Each record is a gzip member
of its own with regenerated headers and digests; nothing depends on clock, host
or partitioning, so equal tables give equal files. Files are written under
temporary names, listed by a manifest that Spark commits, then renamed to
`part-<shard>-<file>.warc.gz`; renaming can be repeated.

Of pages with equal payloads of at least `least_bytes`, the one with the largest
page_id is a response and the others are revisits. Equal payloads are found by
SHA-256, in a table of ids and digests; a revisit's verdict is sorted in with
its page, so that pages are shuffled once.

Defined results: null html is an empty payload; a null url is
`urn:page:<page_id>`; characters that no header may hold are percent-encoded; a
page without id is a response without the header WARC-Page-ID and comes first;
rows that repeat an id are all written, and if they are equal too, all but one
count as revisits of that id; an empty table gives no file and no rows; other
columns are ignored.
"""

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.files import (
    filesystem, one_task_each, publish, range_bounds, temporary_name, with_shards,
)
from postmill.session import materialize

MANIFEST = "shard int, file int, path string, n_records bigint, n_bytes bigint"
MANIFEST_ARROW = pa.schema(
    [("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string,"
    " payload binary, sound boolean"
)


def record_id(page_id: int | None, digest: bytes, copy: int = 0) -> str:
    name = f"page:{page_id}:{digest.hex()}" + (f":{copy}" if copy else "")
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """A WARC/1.1 record with its HTTP headers; a revisit has no body but states the body's length."""
    digest = hashlib.sha1(payload).digest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = header_text(url) if url is not None else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *(
            [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
            if revisit
            else []
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member, without time and name."""
    return gzip.compress(data, compresslevel=6, mtime=0)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that are not their payload's last.

    `pages`: (page_id, payload). Digests are counted map-side, so that a payload
    that a third of the pages share is a few rows.
    """
    long = pages.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    digests = materialize(long.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest")), "digests")
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = shared.where("n > 1").select("digest", "refers_to")
    return digests.join(shared, "digest").select("page_id", "digest", "refers_to")


def write_warc(
    pages: DataFrame, folder: str, least_bytes: int = 1000, shard_bytes: int = 32 << 20, file_bytes: int = 8 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives of `pages` (page_id, url, html); returns the manifest, one row per file."""
    spark = pages.sparkSession
    pages = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    weights = pages.where("page_id IS NOT NULL").select(F.col("page_id").alias("key"), (F.octet_length("payload") + 500).cast("bigint").alias("weight"))
    bounds = range_bounds(weights, shard_bytes)
    nothing = F.lit(None)
    verdicts = revisits(pages, least_bytes).select(
        "page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind")
    )
    rows = pages.select(
        "page_id", "url", "payload", nothing.cast("binary").alias("digest"), nothing.cast("bigint").alias("refers_to"), F.lit(1).alias("kind")
    ).unionByName(verdicts)
    dealt = with_shards(rows, "page_id", bounds).repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = dealt.sortWithinPartitions("page_id", "kind", "url", "payload", "digest")
    store, name = filesystem(folder)
    store.create_dir(name, recursive=True)
    written = materialize(ordered.mapInArrow(_write_files(folder, file_bytes, date), MANIFEST), "manifest")
    return _publish(written, folder)


def _write_files(folder: str, file_bytes: int, date: str):
    def write(batches):
        out = path = shard = None
        number = n_records = 0
        page, answers, copies = None, {}, {}

        def closed():
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": number, "path": path, "n_records": n_records, "n_bytes": size}], schema=MANIFEST_ARROW
            )

        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                if row["page_id"] != page:
                    page, answers, copies = row["page_id"], {}, {}
                if row["kind"] == 0:
                    answers[row["digest"]] = row["refers_to"]
                    continue
                if out is None:
                    path = temporary_name(folder)
                    store, name = filesystem(path)
                    out = store.open_output_stream(name)
                    n_records = 0
                digest = hashlib.sha256(row["payload"]).digest()
                copy, refers_to = copies.get(digest, 0), answers.get(digest)
                copies[digest] = copy + 1
                if refers_to == page and copy == 0:  # the response itself
                    refers_to = None
                out.write(member(record(page, row["url"], row["payload"], refers_to, date, copy)))
                n_records += 1
                if out.tell() >= file_bytes:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    return write


def _publish(written: DataFrame, folder: str) -> DataFrame:
    """Give the listed files their final names; a task does some, and may do them again."""

    def rename(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                final = posixpath.join(folder, f"part-{row['shard']:06d}-{row['file']:04d}.warc.gz")
                publish(row["path"], final)
                row["path"] = final
            yield pa.RecordBatch.from_pylist(rows, schema=MANIFEST_ARROW)

    return materialize(written.mapInArrow(rename, MANIFEST), "manifest")


def members(source):
    """Bytes of each gzip member of a stream, one after the other."""
    unzip, parts, pending = None, [], b""
    while pending or (pending := source.read(1 << 20)):
        unzip = unzip or zlib.decompressobj(31)
        parts.append(unzip.decompress(pending))
        pending = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = None, []
    if unzip is not None:
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """A record as written by `record`; `sound`: lengths and digests are right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    sound = rest[len(block) :] == b"\r\n\r\n" and hashlib.sha1(block).digest() == base64.b32decode(fields["WARC-Block-Digest"].removeprefix("sha1:"))
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("WARC-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload_bytes": length,
        "payload_digest": digest.hex(),
        "payload": None if revisit else payload,
        "sound": sound and (revisit or (len(payload) == length and hashlib.sha1(payload).digest() == digest)),
    }


def read_warc(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists; without `payloads` that column is null."""
    listed = sorted(manifest.select("path").collect())  # one row per file
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = filesystem(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for data in members(source):
                        found = parse(data)
                        if not payloads:
                            found["payload"] = None
                        rows.append(found)
                        held += len(found["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = one_task_each(spark, [(k, row["path"]) for k, row in enumerate(listed)], "number int, path string")
    return files.mapInArrow(read, RECORDS)
