"""WARC archives: writer with revisit records, and a splittable reader.

Writing: every page becomes one record in a gzip member of its own, so an
archive can be entered at any member. Pages with equal payloads of at least
`revisit_from` bytes are stored once, by the page with the largest id; the
others are revisit records that name it. Files end at about `file_bytes`.

Reading: archives are cut into byte ranges, and each task scans its range for
the gzip magic. The magic also occurs by chance inside compressed data, so a
candidate counts only if decoding its first bytes gives the head of a WARC
record. A task owns the records whose member starts inside its range and reads
past the range's end to finish the last one; after a complete member the scan
goes on behind it. Neither file names nor indexes are needed.

Files live under the shared folder and are opened in the tasks through pyarrow's
file systems (local or shared paths, hdfs, s3, gs). A file's name holds the task
attempt, so attempts of one task never touch each other's files; an archive
counts once it stands in the committed list, and the rest goes with the folder.

Skew: payload digests are pre-aggregated to one row before they meet the pages,
and only revisits (two numbers a row) are joined to the pages, by page_id.

Defined results: NULL html is an empty payload; a NULL url has no target line.
Rows that repeat the largest page_id of a payload are all responses. A NULL
page_id is never a revisit target unless all ids of the payload are NULL, which
are then responses. Extra columns are ignored; an empty table gives no archives.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, run_dir

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@dataclass(frozen=True)
class Warc:
    revisit_from: int = 1000
    file_bytes: int = 64 << 20
    range_bytes: int = 4 << 20
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"
    head_bytes: int = 64 << 10  # compressed bytes decoded to judge a candidate
    ranges_per_task: int = 16  # beyond two ranges a core


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else "/" + uri)


def _uri(uri: str) -> str:
    """file:/x as file:///x, which pyarrow reads."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def record(page: int | None, url: str | None, payload: bytes, target: int | None, spec: Warc) -> bytes:
    """One gzip member: the record of a page, or its revisit of the page `target`."""
    sha = base64.b32encode(hashlib.sha1(payload).digest())
    revisit = target is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    name = b"" if page is None else b"%d" % page
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%b>" % name, b"WARC-Date: " + spec.date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "").replace("\n", "").encode())
    if revisit:
        head += [b"WARC-Refers-To: <urn:page:%d>" % target, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"WARC-Payload-Digest: sha1:" + sha, b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(spec.level, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def revisits(pages: DataFrame, spec: Warc) -> DataFrame:
    """(page_id, target): pages whose payload another page's record holds."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.filter(F.octet_length("html") >= spec.revisit_from).select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"))
    held = keyed.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # With a NULL id among the pages the join below keeps it: NULL differs from every target.
    return keyed.join(held, "digest").filter("target IS NOT NULL AND NOT (page_id <=> target)").select("page_id", "digest", "target").distinct()


def write(pages: DataFrame, folder: str, spec: Warc = Warc()) -> DataFrame:
    """Write the archives and return their list (path, bytes, records), itself a written table."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.when(F.octet_length("html") >= spec.revisit_from, F.sha1(payload)).alias("digest"))
    refs = revisits(pages, spec)
    # A NULL id or digest matches nothing in a plain equality join; both sides get a value that cannot occur.
    none = F.lit(-(1 << 63)).cast("long")
    joined = rows.withColumn("id", F.coalesce("page_id", none)).join(
        refs.select(F.coalesce("page_id", none).alias("id"), F.col("digest").alias("ref_digest"), "target"), "id", "left")
    same = F.col("digest") == F.col("ref_digest")
    joined = joined.select("page_id", "url", "payload", "digest", "ref_digest", F.when(same, F.col("target")).alias("target"))
    uri = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _fs(uri)
        files.create_dir(base, recursive=True)
        context = TaskContext.get()
        number, out, size, records, made = 0, None, 0, 0, []

        def name() -> str:
            return f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:05d}.warc.gz"

        for batch in batches:
            for page, url, data, target in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "target")]):
                if out is None:
                    out, size, records = files.open_output_stream(name(), compression=None), 0, 0
                member = record(page.as_py(), url.as_py(), data.as_py(), target.as_py(), spec)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= spec.file_bytes:
                    out.close()
                    made.append((name(), size, records))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            made.append((name(), size, records))
        paths, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    return materialize(joined.mapInArrow(run, "path string, bytes long, records long"))


def parse(member: bytes) -> dict | None:
    """Head fields and payload of a decoded record, None if it is no WARC record."""
    head, gap, block = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    length = int(fields[b"Content-Length"])
    http, _, payload = block[:length].partition(b"\r\n\r\n")
    return {"fields": fields, "http": http, "payload": payload}


def members(read, begin: int, end: int, size: int, spec: Warc) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC members that start in [begin, end).

    `read(offset, length)` gives bytes of the file. Candidates are found by the
    magic and judged by decoding their first bytes.
    """
    at = begin
    while at < end:
        window = read(at, min(spec.range_bytes, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += min(spec.range_bytes, end - at)
            continue
        at += hit
        decoder = zlib.decompressobj(31)
        try:
            data = read(at, min(spec.head_bytes, size - at))
            text, position = decoder.decompress(data, 1 << 16), at + len(data)
            if not text.startswith(b"WARC/"):
                raise zlib.error("not a record")
            chunks = [text]
            while not decoder.eof:
                more = decoder.unconsumed_tail
                if not more:
                    more = read(position, min(1 << 20, size - position))
                    position += len(more)
                    if not more:
                        raise zlib.error("cut off")
                chunks.append(decoder.decompress(more, 8 << 20))
            yield at, b"".join(chunks)
            at = position - len(decoder.unused_data)
        except zlib.error:
            at += 1


RECORDS = "path string, offset long, record_type string, page_id long, refers_to long, url string, digest string, payload binary"


def read(archives: DataFrame, spec: Warc = Warc()) -> DataFrame:
    """All records of the archives (path, bytes), in ranges of `range_bytes`: `RECORDS`.

    `digest` is the head's SHA-1 as lower-case hex; a response whose payload does not match raises.
    """
    spark = archives.sparkSession
    step = spec.range_bytes
    total = archives.agg(F.sum(F.ceil(F.col("bytes") / step))).first()[0] or 0
    # Every range is a row of a few bytes, so the number of tasks is given: adaptive execution would make one of them.
    tasks = max(1, min(total, 2 * spark.sparkContext.defaultParallelism), total // spec.ranges_per_task)
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(spec.range_bytes).cast("long"))).alias("begin"))

    def number(field: bytes | None) -> int | None:
        text = (field or b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "begin")]):
                files, inner = _fs(path)
                rows, held = [], 0

                def flush():
                    columns = list(zip(*rows)) if rows else [[]] * 8
                    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in RECORDS.split(", ")])

                with files.open_input_file(inner) as file:
                    for offset, data in members(lambda a, n: file.read_at(n, a), begin, min(begin + spec.range_bytes, size), size, spec):
                        found = parse(data)
                        if found is None:
                            continue
                        fields, payload = found["fields"], found["payload"]
                        kind = fields[b"WARC-Type"].decode()
                        sha = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:"))
                        if kind == "response" and hashlib.sha1(payload).digest() != sha:
                            raise ValueError(f"payload of {path} at {offset} does not match its digest")
                        url = fields.get(b"WARC-Target-URI")
                        rows.append((path, offset, kind, number(fields[b"WARC-Record-ID"]), number(fields.get(b"WARC-Refers-To")), None if url is None else url.decode(), sha.hex(), payload if kind == "response" else None))
                        held += len(data)
                        if held >= 4 << 20:
                            yield flush()
                            rows, held = [], 0
                yield flush()

    # Neighbouring ranges of a file go to different tasks.
    dealt = F.pmod(F.floor(F.col("begin") / step) + F.crc32(F.col("path").cast("binary")), F.lit(tasks)).cast("int")
    return ranges.repartitionById(tasks, dealt).mapInArrow(run, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"


def resolve(records: DataFrame) -> DataFrame:
    """Records with payload_bytes; a revisit takes them from the response it names."""
    slim = materialize(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    own = slim.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.first("bytes").alias("full"))
    return slim.join(own, ["refers_to", "digest"], "left").select(
        "page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
