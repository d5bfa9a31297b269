"""WARC archives: a writer of one gzip member per record, and a reader that splits archives by byte ranges.

Paths are URIs in a folder that driver and executors share, opened by pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept, prepare, shared_dir

#: Records of equal payloads of at least so many bytes are written once and revisited.
LEAST_REVISIT = 1000
SPLIT_BYTES = 16 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Per page: page_id, url, html (null: empty), payload_digest (SHA-1, hex) and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the response (refers_to
    null), the others revisit it; rows that repeat its page_id and payload are responses too. Groups are counted by
    digest, without their payloads, and rows are joined to the ids of groups of two or more.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    large = rows.filter(F.octet_length("html") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    large = kept(large, "repeated-payloads")
    joined = rows.join(broadcast_if_small(large, large.count(), 200_000), "payload_digest", "left")
    return joined.select("page_id", "url", "html", "payload_digest", F.when(F.col("page_id") != F.col("__last"), F.col("__last")).alias("refers_to"))


#: What can't stand in a header as it is: line ends, and white space at an end.
LINE_END = re.compile(r"[\r\n]|^\s|\s$")


def url_of(headers: dict[str, str]) -> str | None:
    url = headers.get("warc-target-uri")
    if url is not None and headers.get("x-uri-escaped") == "1":
        url = re.sub("%(25|0D|0A|20|09)", lambda m: chr(int(m[1], 16)), url)
    return url


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP header, with its Content-Length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A').replace(' ', '%20').replace(chr(9), '%09') if LINE_END.search(url) else url}", f"X-URI-Escaped: {int(bool(LINE_END.search(url)))}"]), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write what plan_records() gives, one archive per task. Returns (path, bytes, records) of each archive.

    A task writes under a name of its own and returns it when the file is complete, so a retried or doubled task
    leaves a file that nothing names and no reader sees.
    """
    prepare(records.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, n, size, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or fs.open_output_stream(name, compression=None)
                size += out.write(data := member(page, url, html.encode(), digest, refers)) or len(data)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return records.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "path string, bytes long, records long")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int


class Broken(ValueError):
    """There is no whole record at a place."""


def record_at(read, at: int, size: int) -> tuple[Record, int]:
    """The record of the gzip member at `at`, and where the member ends.

    The member must unpack to its end, hold a WARC header with type and length, and as much content as that says.
    """
    start, piece, unpack, out = at, 1 << 12, zlib.decompressobj(31), []
    try:
        while at < size and not unpack.eof:
            data = read(at, min(piece, size - at))
            out.append(unpack.decompress(data))
            at += len(data) - len(unpack.unused_data)
            if sum(map(len, out[:8])) >= 6 and not b"".join(out[:8]).startswith(b"WARC/1."):
                raise Broken(f"another kind of member at {start}")
            piece = 1 << 16
    except zlib.error as e:
        raise Broken(f"a damaged member at {start}: {e}") from e
    if not unpack.eof:
        raise Broken(f"a member that is cut off at {start}")
    head, found, rest = b"".join(out).partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = headers.get("content-length", "")
    if not head.startswith(b"WARC/1.") or not found or "warc-type" not in headers or not length.isdigit() or rest[int(length) :] != b"\r\n\r\n" or len(rest) < int(length):
        raise Broken(f"a member without a whole record at {start}")
    return Record(headers, rest[: int(length)], start), at


#: Members within another's payload end within the block of that one's compression they lie in, which is at most 64 KB.
PROBE = 1 << 17


def first_record(read, size: int, start: int, end: int) -> int | None:
    """Where the first record that starts in [start, end) of an archive does.

    A candidate is the gzip magic, which also occurs by chance in compressed data, and, in front of whole records, in
    payloads that hold archives. So it counts if a record is there and records follow it for PROBE bytes, or to the
    end. If that is in doubt, the archive is walked from its start.
    """
    if start == 0:
        return 0 if size else None
    at = start
    while at < end:
        data = read(at, min((1 << 20) + 2, end + 2 - at, size - at))
        found = data.find(MAGIC)
        if found < 0 or at + found >= end:
            at += max(len(data) - 2, 1)
            continue
        at += found
        try:
            _, after = record_at(read, at, size)
        except Broken:
            at += 1
            continue
        try:
            while after < min(size, at + PROBE):
                _, after = record_at(read, after, size)
            return at
        except Broken:
            walk = 0
            while walk < start:  # raises where the archive itself is damaged
                _, walk = record_at(read, walk, size)
            return walk if walk < end else None
    return None


def records_in(read, size: int, start: int, end: int) -> Iterator[Record]:
    """Records whose members start in [start, end) of an archive of `size` bytes; the last may reach beyond.

    Raises Broken where a member is damaged, cut off or no record: nothing is left out in silence.
    """
    at = first_record(read, size, start, end)
    while at is not None and at < end:
        record, at = record_at(read, at, size)
        yield record
    if at is not None and end <= at < size:  # the next range can't tell a damaged record from none
        record_at(read, at, size)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in files(path, bytes), each read by as many tasks as it has ranges of split_bytes.

    Returns page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, and with with_payload payload
    (null for revisits). A response's digest and length are computed from the payload read; a revisit's are those its
    headers carry. A response whose payload doesn't match its header's digest raises an error. An empty list of
    files gives no rows.
    """
    spark = files.sparkSession
    prepare(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    place = shared_dir(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(place)
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(path) as f:
                    window: list = [0, b""]

                    def read(at: int, n: int) -> bytes:
                        if not window[0] <= at or at + n > window[0] + len(window[1]):
                            f.seek(at)
                            window[:] = at, f.read(max(n, 1 << 20))
                        return window[1][at - window[0] : at - window[0] + n]

                    rows: list[tuple] = []
                    for r in records_in(read, size, start, min(size, start + split_bytes)):
                        http, _, payload = r.block.partition(b"\r\n\r\n")
                        digest, kind = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex(), r.headers["warc-type"]
                        length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        if kind == "response":
                            length, own = len(payload), hashlib.sha1(payload).hexdigest()
                            if own != digest:
                                raise ValueError(f"{path} at {r.offset}: the payload's digest is {own}, not {digest}")
                        number = lambda k, h=r.headers: int(h[k]) if h.get(k) else None
                        rows.append((number("x-page-id"), url_of(r.headers), length, digest, kind, number("x-refers-to-page"), *([payload if kind == "response" else None] if with_payload else [])))
                        if len(rows) == 1000:
                            yield batch_of(rows, with_payload)
                            rows = []
                    yield batch_of(rows, with_payload)

    return ranges.mapInArrow(run, schema)


def batch_of(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names=names)


def through_archives(pages: DataFrame, least: int = LEAST_REVISIT, with_payload: bool = False) -> DataFrame:
    """Write pages(page_id, url, html) to archives in the shared folder and read them back."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    # the list of archives is written once: a task of it that ran again would write other archives
    files = write_warc(plan_records(pages, least), folder).checkpoint()
    return read_warc(files, with_payload=with_payload)


__all__ = ["plan_records", "read_warc", "records_in", "through_archives", "write_warc"]
