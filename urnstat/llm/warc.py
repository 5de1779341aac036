"""Web archives: writing, normalising one-stream gzip files, and reading by offset.

``write`` puts a record per page into WARC files that are one gzip stream each; of
pages with equal payloads the one with the smallest id holds the payload and the others
are revisit records. ``normalise`` inflates such a file once from end to end, writes
every record again as a gzip member of its own and a sidecar index of offsets beside
it. ``read`` opens records by those offsets alone.

Files lie in the shared scratch folder (or one given), reached through its URI, and
each task writes files under a name of its own attempt; only the names that finished
tasks reported are read later, so lost and repeated tasks leave no half files behind
in the results. A file is closed once ``FILE_BYTES`` of records are in it, and a task
holds one record at a time.

A null page is an empty payload, a null url gives no target header, and control
characters in a url are percent-encoded. A null id counts as larger than any other.
Rows that repeat the smallest id of equal payloads are responses all. An empty table
gives no files and no rows; columns beside id, url and page are not read.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnstat.llm.common import slices
from urnstat.session import materialize, scratch_path

#: Shorter payloads are always stored.
LEAST_REVISIT = 100
#: Bytes of records after which a task begins another file.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Most tasks that files are dealt out to.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
GZIP = 31  # window bits of a gzip member
#: Compression of the one-stream files and of the members.
FAST, SMALL = 1, 6
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_unsafe = re.compile(r"[\x00-\x20\x7f-\U0010ffff]").sub


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; ``refers_to`` is null for responses.

    The payloads stay where they are unless the table of repeated digests, stored
    first so that Spark knows its size, is too large to broadcast.
    """
    text = F.coalesce("html", F.lit(""))
    made = pages.select("page_id", "url", F.encode(text, "UTF-8").alias("payload"), F.sha2(text, 256).alias("digest"))
    keys = pages.select("page_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size"))
    repeated = keys.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(repeated.where("n > 1 AND first IS NOT NULL").drop("n"), "digests")
    later = F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return made.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", later.alias("refers_to"))


def urn(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC record, its two closing line ends included."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = _unsafe(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {urn(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(decided: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``path, records``: the one-stream files that were written below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        number, out, packer, records, size = 0, None, None, 0, 0

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in slices(batches, 32):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    path = posixpath.join(root, f"{name}-{number:04d}.warc.gz")
                    out, packer = store.open_output_stream(path, compression=None), zlib.compressobj(FAST, zlib.DEFLATED, GZIP)
                    number, records, size = number + 1, 0, 0
                data = record(*row)
                out.write(packer.compress(data))
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return decided.mapInArrow(run, "path string, records bigint")


def inflate(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """Plain bytes of a gzip stream, or of several one behind the other, read once."""
    unpacker, raw = zlib.decompressobj(GZIP), source.read(chunk)
    while raw:
        yield unpacker.decompress(raw, 4 * chunk)
        raw = unpacker.unconsumed_tail or unpacker.unused_data
        if unpacker.eof:
            raw = raw or source.read(chunk)
            if raw:
                unpacker = zlib.decompressobj(GZIP)
        elif not raw:
            raw = source.read(chunk)
            if not raw:
                yield unpacker.flush()
                if not unpacker.eof:
                    raise ValueError("the stream ends inside a gzip member")


def headers(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a plain WARC stream, one at a time."""
    buffer = bytearray()
    need = None
    for chunk in chunks:
        buffer += chunk
        while True:
            if need is None:
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 8 + int(headers(bytes(buffer[:at]))["content-length"])
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the stream ends inside a record")


def normalise_file(store: fs.FileSystem, path: str, target: str) -> Iterator[tuple[int, int, str]]:
    """Rewrite one file with a member per record; yields (offset, length, record id) as written.

    The index also goes beside ``target``, one line of these three per record.
    """
    at = 0
    with (
        store.open_input_stream(path, compression=None) as source,
        store.open_output_stream(target, compression=None) as out,
        store.open_output_stream(f"{target}.idx", compression=None) as index,
    ):
        for data in records(inflate(source)):
            packer = zlib.compressobj(SMALL, zlib.DEFLATED, GZIP)
            member = packer.compress(data) + packer.flush()
            out.write(member)
            name = headers(data[: data.find(b"\r\n\r\n")])["warc-record-id"]
            index.write(f"{at}\t{len(member)}\t{name}\n".encode())
            yield at, len(member), name
            at += len(member)


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """``path, offset, length, record_id`` of every record of ``files.path``, rewritten below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                base = posixpath.basename(path).removesuffix(".warc.gz")
                target = posixpath.join(root, f"{base}-members-{attempt}.warc.gz")
                rows: list[tuple[int, int, str]] = []
                for row in normalise_file(store, path, target):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _index_batch(target, rows)
                        rows = []
                yield _index_batch(target, rows)

    # Files are dealt out one by one: each is a task's work, whoever wrote it. A number
    # given here is not merged again by adaptive execution, to which paths look tiny.
    spread = files.select("path").repartition(_tasks(files))
    return spread.mapInArrow(run, "path string, offset bigint, length bigint, record_id string")


def _tasks(rows: DataFrame) -> int:
    return max(1, min(MOST_TASKS, rows.select("path").distinct().count()))


def _index_batch(path: str, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    offset, length, name = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(name, pa.string())],
        ["path", "offset", "length", "record_id"],
    )


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """``record_id, record_type, url, payload_bytes, payload_digest, refers_to[, payload]`` by the index.

    Digest and size of a response are those of the payload read back, and a stored
    digest that differs is an error; a revisit has those of its headers.
    """
    names = ["record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to"]
    names += ["payload"] if with_payload else []
    types = "record_id string, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        path, source = None, None
        for batch in slices(batches):
            rows = []
            for own, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if own != path:
                    if source is not None:
                        source.close()
                    path, source = own, store.open_input_file(own)
                source.seek(offset)
                rows.append(parse(zlib.decompress(source.read(length), GZIP))[: len(names)])
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if source is not None:
            source.close()

    # A file is read from front to back by one task.
    ordered = index.select("path", "offset", "length").repartition(_tasks(index), "path").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, types + ", payload binary" * with_payload)


def parse(data: bytes) -> tuple:
    """Fields of one record, the payload last."""
    at = data.find(b"\r\n\r\n")
    head = headers(data[:at])
    block = data[at + 4 : at + 4 + int(head["content-length"])]
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
    if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{head['warc-record-id']}: the payload differs from its digest")
    refers_to = head.get("warc-refers-to")
    return head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), size, digest, refers_to, payload


def page_of(urn_column: str, kind: str):
    """The page id inside a record id; none for an empty one."""
    return F.nullif(F.regexp_extract(urn_column, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from normalised archives."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    files = materialize(write(decide(pages), f"{folder}/streams"), "warc-files")
    index = materialize(normalise(files, f"{folder}/members"), "warc-index")
    return read(index, folder, with_payload=False).select(
        page_of("record_id", kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to", kind).alias("refers_to"),
    )


def oracle_sql() -> str:
    """The same rows in DuckDB, from the pages alone."""
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
k AS (SELECT page_id, strlen(t) AS b, sha256(t) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM k),
r AS (SELECT *, CASE WHEN b >= {LEAST_REVISIT} AND (page_id > first OR page_id IS NULL) THEN first END AS refers_to FROM f)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r"""
