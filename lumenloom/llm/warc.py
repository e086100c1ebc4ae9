"""WARC archives by a deterministic sharded writer.

Records are dealt to ranges of page_id and sorted within them. Each range writes files one after another and
begins a new one when `roll_bytes` compressed bytes are reached; every record is a gzip member of its
own. Headers and digests are made again from the payload. A file is written under a temporary name
that no other attempt uses and renamed when complete, so a task that is run again replaces files by equal ones; the
manifest (a Parquet table of files with their record counts, sizes and SHA-256) is written last, and
readers take only what it lists.

Payloads of at least `revisit_bytes` that occur more than once are kept once: the record of the smallest page_id
is the response, others are revisits of it. Which pages share a payload is settled by an aggregate over
digests; pages themselves move once.

Defined results: null html is an empty payload; a null url becomes urn:page:(page_id). Rows of equal page_id are
sorted by their payload's digest; of equal payloads among them the first is the response. A null page_id goes first in
its range and never is a response that others revisit. Extra columns are ignored. An empty table gives an archive without files.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parts_for, range_bounds, range_part, shared_dir, small_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
MANIFEST = "part int, file string, records long, bytes long, sha256 string"


@dataclass(frozen=True)
class Warc:
    roll_bytes: int = 64_000_000
    revisit_bytes: int = 100
    part_pages: int = 1500
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A whole WARC record. refers_to: the page whose response this revisits."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if page_id is None else [f"Page-ID: {page_id}"]),
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += [f"Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Shards:
    """The files of one range."""

    def __init__(self, folder: str, part: int, how: Warc):
        self.fs, self.path = _open(folder)
        self.part, self.how, self.number, self.out, self.done = part, how, 0, None, []
        self.attempt = uuid.uuid4().hex

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.name = f"part-{self.part + 1:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(self.how.level, zlib.DEFLATED, 31)  # a gzip member without a time
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.how.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/{self.name}")
            self.done.append((self.part, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, folder: str, how: Warc = Warc()) -> DataFrame:
    """Write pages (page_id, url, html) to folder; returns the manifest as committed."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    long_ = rows.filter(F.octet_length("html") >= how.revisit_bytes).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    shared = long_.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    shared = materialize(shared, "shared")  # a table of its own, so that a join on a very frequent payload can be split
    marks = long_.join(shared, "digest").filter("not page_id <=> first").distinct()

    parts = parts_for(spark, pages.count(), how.part_pages)
    bounds = range_bounds(rows, "page_id", parts)
    part = range_part(F.col("page_id"), bounds).cast("int").alias("part")
    # A page's mark comes before it in its range.
    none = F.lit(None).cast("string")
    dealt = rows.select(part, "page_id", F.lit(1).alias("kind"), "url", "html", none.alias("digest"), F.lit(None).cast("long").alias("first"))
    dealt = dealt.union(marks.select(part, "page_id", F.lit(0), none, none, "digest", "first"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "page_id", "kind", F.sha2(F.col("html").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, page, refers, done = None, object(), {}, []
        for batch in batches:
            for number, page_id, kind, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if shards is None or shards.part != number:
                    if shards is not None:
                        shards.close()
                        done += shards.done
                    shards, page = Shards(folder, number, how), object()
                if page_id != page:
                    page, refers = page_id, {}
                if kind == 0:
                    refers[digest] = first
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                refer = refers.get(digest) if len(payload) >= how.revisit_bytes else None
                shards.add(record(page_id, url, payload, digest, refer, how.date))
                if page_id is not None and len(payload) >= how.revisit_bytes and digest not in refers:
                    refers[digest] = page_id  # for rows of the same page_id and payload
        if shards is not None:
            shards.close()
            done += shards.done
        cols = list(zip(*done)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["part", "file", "records", "bytes", "sha256"])

    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    files, path = _open(folder)
    if files.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
        files.delete_dir(f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive file, one in memory at a time."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                headers[name.strip()] = value.strip()
            yield headers, f.read(int(headers["Content-Length"]))


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string, file string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest lists; a digest that doesn't fit its payload is an error."""
    small_batches(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        files, path = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{path}/{name}") as stream:
                    for headers, block in records_of(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: {headers['WARC-Record-ID']} doesn't fit its digest")
                        number = lambda key: int(headers[key]) if key in headers else None  # noqa: B023, E731
                        html = None if payload is None else payload.decode("utf-8", "surrogatepass")
                        rows.append((number("Page-ID"), headers["WARC-Target-URI"], headers["WARC-Type"], int(headers["Payload-Length"]), digest, number("Refers-To-Page-ID"), html, name))
                        held += len(block)
                        if held > 8_000_000:
                            yield emit(rows)
                            rows, held = [], 0
                if rows:
                    yield emit(rows)

    # A task for a file: the manifest is tiny beside what it lists.
    listed = manifest.select("file", "part")
    return listed.repartition(parts_for(spark, listed.count(), 1), "file").mapInArrow(run, RECORD)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lumenloom/warc-{uuid.uuid4().hex}"


def describe(manifest: DataFrame) -> str:
    """A short account of an archive, from its manifest."""
    row = manifest.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    return json.dumps(row.asDict())
