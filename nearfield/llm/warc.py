"""WARC archives: written as one gzip stream per file, normalised to a gzip member per record, read by an index.

Write: each task writes its pages into whole-file gzip streams of bounded size.  Normalise: each such file is inflated
once, as a stream, and every record goes as a member of its own into a new file; a sidecar index (one line per record:
offset, length, type) is written beside it.  Read: the index lines are spread over tasks, which fetch only the bytes of
their records.  Files are named by task attempt and only those that a successful task reports are used, so lost
executors and repeated tasks leave no trace in the result; files are opened through Arrow's file systems (local, HDFS,
S3, ...), by the URI of the shared folder.

Of records with equal payloads (of at least ``least`` bytes) the one of the smallest page_id is a response, the others
are revisits without the payload.  A null html is an empty payload.  A null page_id loses to any other; rows that share
the smallest page_id, or all have none, are responses each.  Null urls are written as empty.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import shared
from nearfield.session import remove, scratch_path, stored

#: A file takes no further record beyond this size before compression.
FILE_BYTES = 1 << 30
#: Records are fetched in pieces of neighbouring ones of about this size.
FETCH_BYTES = 8 << 20
_BLOCK = 1 << 20
_GZIP = 31  # zlib's window bits for the gzip format
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps files the same in every run


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit of the page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head[2:2] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int] | None:
    """The fields of a record's head that begins at ``at``, and where its block begins; None if it isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    lines = bytes(data[at:end]).decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}, end + 4


def inflated(file, block: int = _BLOCK) -> Iterator[bytes]:
    """The content of a gzip file, one member or several, in pieces of bounded size."""
    unpack = zlib.decompressobj(_GZIP)
    data = b""
    while data or (data := file.read(block)):
        yield unpack.decompress(data, 4 * block)
        data = unpack.unconsumed_tail
        if unpack.eof:
            data, unpack = unpack.unused_data, zlib.decompressobj(_GZIP)
    if tail := unpack.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Whole records of a stream, one at a time in memory."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (found := _head(held, at)) is not None:
            fields, start = found
            end = start + int(fields["content-length"]) + 4
            if len(held) < end:
                break
            yield fields, bytes(held[at:end])
            at = end
        del held[:at]
    if held:
        raise ValueError("the archive ends within a record")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _attempt() -> str:
    import uuid

    return uuid.uuid4().hex


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of rows (page_id, url, payload, digest, first): one row per file, (file, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name, size, count = f"{_attempt()}.warc.gz", 0, 0
                    out, pack = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                data = record(page_id, url or "", payload, digest, first)
                out.write(pack.compress(data))
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.write(pack.flush())
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            done.append((name, count))
        names, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return pages.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "file string, records bigint")


def normalise(files: DataFrame, folder: str, target: str) -> DataFrame:
    """Every file of ``folder`` rewritten in ``target`` with a member per record, and an index beside it.

    One row per file: file, records, bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        goal, goal_path = _open(target)
        goal.create_dir(goal_path, recursive=True)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new, at, count = f"{_attempt()}.warc.gz", 0, 0
                with (
                    system.open_input_stream(f"{path}/{name}", compression=None) as source,
                    goal.open_output_stream(f"{goal_path}/{new}", compression=None) as out,
                    goal.open_output_stream(f"{goal_path}/{new}.index", compression=None) as index,
                ):
                    for fields, data in records(inflated(source)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
                        member = pack.compress(data) + pack.flush()
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        at, count = at + len(member), count + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new]), pa.array([count], pa.int64()), pa.array([at], pa.int64())], names=["file", "records", "bytes"]
                )

    return files.select("file").mapInArrow(run, "file string, records bigint, bytes bigint")


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """The sidecar indexes: one row per piece of neighbouring records to fetch, (file, start, end, offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        kinds = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("offsets", pa.list_(pa.int64()))])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, offsets = [], []
                with system.open_input_stream(f"{path}/{name}.index", compression=None) as source:
                    for line in source.read().splitlines():
                        entry = json.loads(line)
                        offsets.append(entry["offset"])
                        end = entry["offset"] + entry["length"]
                        if end - offsets[0] >= FETCH_BYTES:
                            rows.append({"file": name, "start": offsets[0], "end": end, "offsets": offsets})
                            offsets = []
                if offsets:
                    rows.append({"file": name, "start": offsets[0], "end": end, "offsets": offsets})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("file").mapInArrow(run, "file string, start bigint, end bigint, offsets array<bigint>")


def read(parts: DataFrame, folder: str) -> DataFrame:
    """The records at the given places: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured and its digest computed anew; a revisit tells both in its heads.
    """

    def page(name: str) -> int | None:
        number = name.strip("<>").removeprefix("urn:page:")
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for part in batch.to_pylist():
                out = []
                with system.open_input_file(f"{path}/{part['file']}") as source:
                    data = source.read_at(part["end"] - part["start"], part["start"])
                for a, b in zip(part["offsets"], [*part["offsets"][1:], part["end"]]):
                    whole = zlib.decompress(data[a - part["start"] : b - part["start"]], _GZIP)
                    fields, start = _head(whole)
                    body = whole.index(b"\r\n\r\n", start) + 4
                    http = dict(line.split(b": ", 1) for line in whole[start : body - 4].split(b"\r\n")[1:])
                    size, digest, first = int(http[b"Content-Length"]), fields["warc-payload-digest"].removeprefix("sha1:"), None
                    if fields["warc-type"] == "revisit":
                        first = page(fields["warc-refers-to"])
                    else:
                        payload = whole[body : start + int(fields["content-length"])]
                        if len(payload) != size or base32_sha1(payload) != digest:
                            raise ValueError(f"damaged record {fields['warc-record-id']}")
                    out.append((page(fields["warc-record-id"]), size, digest, fields["warc-type"], first))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return parts.mapInArrow(run, schema)


def with_digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest); the digest is the bare base32 SHA-1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [base32_sha1(p) for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["page_id", "url", "payload", "digest"])

    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload)
    return rows.mapInArrow(run, "page_id bigint, url string, payload binary, digest string")


def with_first(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``first``: for revisits, the page_id of the response with the same payload.

    Digests are counted, and only repeated ones (a filter of them is broadcast) meet their group; other rows stay.
    """
    narrow = stored(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "page-digests")
    groups = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count(F.lit(1)).alias("rows"))
    repeated = stored(groups.where("rows > 1"), "repeated-payloads")
    bits = shared.filter_bits(repeated.count())
    marks = repeated.select(F.explode(F.array(*shared.slots([F.col("digest")], bits))).alias("slot"))
    probed = shared.maybe_in(rows, shared.filter_table(marks, "payload-filter"), [F.col("digest")], bits, "again")
    single = probed.where("not again").withColumn("least_id", F.lit(None).cast("bigint"))
    met = shared.attach(probed.where("again"), repeated, "digest", "rows", narrow.count(), "left")
    both = single.unionByName(met)
    long = F.octet_length("payload") >= least
    revisit = F.col("least_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least_id")) & long
    return both.withColumn("first", F.when(revisit, F.col("least_id"))).drop("again", "least_id")


def archive(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pages written, normalised and read back: one row per page."""
    spark = pages.sparkSession
    raw, clean = scratch_path(spark, "warc-streams"), scratch_path(spark, "warc-members")
    rows = with_first(with_digests(pages), least)
    streams = stored(write(rows, raw, file_bytes), "warc-streams-list")
    members = stored(normalise(streams.repartition(max(1, streams.count())), raw, clean), "warc-members-list")
    remove(spark, raw)  # all of it has been rewritten
    parts = stored(read_index(members.repartition(max(1, members.count())), clean), "warc-parts")
    spread = parts.repartition(max(1, min(parts.count(), 4 * spark.sparkContext.defaultParallelism * 64)))
    return read(spread, clean)
