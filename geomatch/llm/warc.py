"""Web archives: pages written as WARC 1.1 records and read back as captures.

Writing. Each page gives a request, a response and a metadata record, both tied to the response by ``WARC-Concurrent-To``. Of equal
payloads of ``REVISIT_BYTES`` or more, the one with the smallest page_id is the response; the others are revisit records that refer to it and
hold no payload. Tasks write files of about ``FILE_BYTES`` into a folder of the shared storage, a gzip member a record, under
another name first, so that a task that runs again leaves the same files.

Reading. Tasks stream the files; each record becomes a row. Requests and metadata meet their response through the record they are concurrent to: one
nested row for each capture. Payload digests are made anew from the bytes read.

Size and skew. Payloads are written where their page is read: only digests of repeated payloads are joined, by broadcast if their counted
number is within ``BROADCAST_PAYLOADS``, else by a shuffle. A payload that a third of all pages share is one row of that join. Payloads are not
shuffled in reading unless asked for (``payload=True``).

Defined cases. A null html is an empty payload. A null page_id sorts last and is read back as null. A null url is written as
``urn:page:`` and the id. Rows that repeat the smallest page_id of a payload are all responses. Rows that repeat wholly share their record ids and are
each a capture. Urls are written with everything but printable ASCII percent-encoded. An empty table gives an
empty table. Only ``page_id``, ``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.llm.common import file_system, new_folder, text_bytes
from geomatch.storage import stored

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
BROADCAST_PAYLOADS = 200_000
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PRINTABLE = "".join(map(chr, range(33, 127)))

RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, fields string"


def record_id(kind: str, page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([kind, page_id, url, digest]))}>"


def _record(kind: str, own_id: str, headers: dict[str, str], content_type: str, block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers.items())]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple | None) -> list[bytes]:
    """The records of one page; refers: page_id and url of the response of a revisit."""
    target = quote(url, safe=_PRINTABLE) if url else f"urn:page:{page_id}"
    own = record_id("response", page_id, url, digest)
    common = {"WARC-Target-URI": target}
    tied = common | {"WARC-Concurrent-To": own}
    parts = urlsplit(target) if url else None
    ask = f"GET {(parts and parts.path) or '/'} HTTP/1.1\r\nHost: {(parts and parts.netloc) or ''}\r\n\r\n".encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    said = common | {"WARC-Payload-Digest": f"sha256:{digest}"}
    if refers:
        said |= {"WARC-Refers-To": record_id("response", *refers, digest), "WARC-Profile": PROFILE}
    answer = _record("revisit" if refers else "response", own, said, "application/http; msgtype=response", head if refers else head + payload)
    fields = json.dumps({"page_id": page_id, "url": url}).encode()
    return [
        _record("request", record_id("request", page_id, url, digest), tied, "application/http; msgtype=request", ask),
        answer,
        _record("metadata", record_id("metadata", page_id, url, digest), tied, "application/json", fields),
    ]


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; returns the path of each file."""
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    html = text_bytes(F.coalesce(F.col("html").cast("string"), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    repeated = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    repeated = stored(repeated.filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("known")))
    if repeated.count() <= BROADCAST_PAYLOADS:
        repeated = F.broadcast(repeated)
    revisit = F.coalesce("known", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", revisit.alias("revisit"), "first_id", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        part, number, stream, name = TaskContext.get().partitionId(), 0, None, ""
        size = 0
        done: list[str] = []

        def close() -> None:
            stream.close()
            final = f"{top}/{name}"
            store.move(f"{top}/_{name}.{TaskContext.get().taskAttemptId()}", final)
            done.append(name)

        for batch in batches:
            columns = [batch[c] for c in batch.schema.names]
            for at in range(batch.num_rows):
                page_id, url, payload, digest, again, first_id, first_url = (c[at].as_py() for c in columns)
                if stream is None:
                    name, size = f"part-{part:06d}-{number:04d}.warc.gz", 0
                    stream = store.open_output_stream(f"{top}/_{name}.{TaskContext.get().taskAttemptId()}", compression=None)
                for record in _capture(page_id, url, payload, digest, (first_id, first_url) if again else None):
                    member = gzip.compress(record, 1, mtime=0)
                    stream.write(member)
                    size += len(member)
                if size >= file_bytes:
                    close()
                    stream, number = None, number + 1
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    return stored(rows.mapInArrow(run, "name string").select(F.concat(F.lit(f"{folder}/"), "name").alias("path")))


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins here: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("the last record is cut off")
        yield headers, block


def read_records(paths: DataFrame, payload: bool = True) -> DataFrame:
    """One row for each record of the archives named in ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, at = file_system(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(at, compression=None) as raw, gzip.open(raw) as stream:
                    for headers, block in parse(stream):
                        kind = headers["warc-type"]
                        body = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
                        digest = hashlib.sha256(body).hexdigest() if kind == "response" else headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        rows.append(
                            (
                                kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest,
                                len(body) if kind == "response" else None, body if payload and kind == "response" else None, block.decode() if kind == "metadata" else None,
                            )
                        )
                        held += len(body) if payload else 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # A file is read by one task; files are of bounded size.
    return paths.select("path").repartition(max(1, paths.count())).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, response, request, metadata."""
    tied = records.filter("kind in ('request', 'metadata') and concurrent_to is not null").groupBy("concurrent_to")
    part = F.struct("record_id", "target_uri", "fields")
    tied = tied.agg(F.any_value(F.when(F.col("kind") == "request", part), ignoreNulls=True).alias("request"), F.any_value(F.when(F.col("kind") == "metadata", part), ignoreNulls=True).alias("metadata"))
    answer = F.struct("kind", "target_uri", "payload_digest", "payload_bytes", "payload", "refers_to")
    answers = records.filter("kind in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), answer.alias("response"))
    return answers.join(tied, answers.capture_id == tied.concurrent_to, "left").select("capture_id", "response", "request", "metadata")


def page_captures(nested: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture; a revisit takes its payload's facts from its response."""
    rows = stored(
        nested.select(
            "capture_id",
            F.get_json_object("metadata.fields", "$.page_id").cast("long").alias("page_id"),
            F.col("response.kind").alias("record_type"),
            F.col("response.payload_digest").alias("digest"),
            F.col("response.payload_bytes").alias("bytes"),
            F.col("response.refers_to").alias("refers_id"),
        )
    )
    heads = rows.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("head_id")).agg(F.any_value("page_id").alias("head_page"), F.any_value("digest").alias("head_digest"), F.any_value("bytes").alias("head_bytes"))
    responses = rows.filter("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    # Only revisits are joined: a response has no reference, and rows without a key would meet in one task.
    again = rows.filter("record_type = 'revisit'").join(heads, rows.refers_id == heads.head_id, "left")
    return responses.unionByName(again.select("page_id", F.col("head_bytes").alias("payload_bytes"), F.col("head_digest").alias("payload_digest"), "record_type", F.col("head_page").alias("refers_to")))


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    paths = write_archives(pages, new_folder(spark, "archives"))
    return page_captures(captures(read_records(paths, payload=False)))
