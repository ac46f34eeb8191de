"""WARC archives: a writer with revisit records, and a salvage reader.

The reader takes an archive of plain records or of gzip members. A record is
good if its version line, headers, length, closing line ends and block digest
hold. A member may hold any number of records, and of a damaged one those are
read that stand before the damage. After a failed check the reader searches for the next version line or
member from which a good record can be read, goes on there, and logs the bytes
between as a quarantined gap. Nothing that can be read is given up because of
what stands before it.

Files are read by Spark's binaryFile source, from any store, one at a time; the
writer ends a file at ``FILE_BYTES`` so that one fits in a task's memory; an archive of another origin must fit in it too.

Defined results: a null payload is written as an empty one; repeated rows and
equal payloads are written as often as they occur; rows with a null page_id are
written with an id of their own kind (``null``) and come back with a null id; an
empty table makes no files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 16 << 20
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "path string, offset long, length long, record_type string, record_id string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary"
GAPS = "path string, offset long, length long, reason string"
READ = RECORDS + ", reason string"
FILES = "path string, records long, bytes long"

_DIGITS = re.compile(rb"[0-9]{1,18}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, target: str, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record. A revisit has the HTTP header of the full payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    target = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", target)
    lines += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bad(ValueError):
    """A check that failed."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The good record that begins at ``at`` and the place after it."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    end = data.find(b"\r\n", at, at + 64)
    if end < 0:
        raise Bad("version line without an end")
    fields = {}
    while not data.startswith(b"\r\n", end + 2):  # headers may be of any length; the first line that is none ends the search
        begin, end = end + 2, data.find(b"\r\n", end + 2)
        if end < 0:
            raise Bad("headers without an end")
        name, colon, value = data[begin:end].partition(b":")
        if not colon:
            raise Bad("header without a colon")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not _DIGITS.fullmatch(length):
        raise Bad("no length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record without an end")
    block = data[start:stop]
    digest = fields.get(b"warc-block-digest")
    if digest and digest.lower().startswith(b"sha1:") and digest[5:].decode("latin-1").upper() != base32_sha1(block):
        raise Bad("block digest differs")
    head, blank, payload = block.partition(b"\r\n\r\n")
    is_http = fields.get(b"content-type", b"").startswith(b"application/http") and blank
    size = len(payload) if is_http else len(block)
    if is_http and fields.get(b"warc-type") == b"revisit":
        for line in head.split(b"\r\n")[1:]:
            if line.lower().startswith(b"content-length:") and _DIGITS.fullmatch(line[15:].strip()):
                size = int(line[15:])
    payload = payload if is_http else block
    promised = fields.get(b"warc-payload-digest", b"")
    if fields.get(b"warc-type") == b"response" and promised.lower().startswith(b"sha1:") and promised[5:].decode("latin-1").upper() != base32_sha1(payload):
        raise Bad("payload digest differs")
    text = {k: v.decode("utf-8", "surrogateescape") for k, v in fields.items()}
    return {
        "record_type": text.get(b"warc-type"), "record_id": text.get(b"warc-record-id"), "target": text.get(b"warc-target-uri"), "refers_to": text.get(b"warc-refers-to"),
        "payload_digest": promised[5:].decode("latin-1").upper() if promised.lower().startswith(b"sha1:") else base32_sha1(payload),
        "payload_bytes": size, "payload": payload,
    }, stop + 4


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` inflates to, the place after it, and what stopped it if it isn't whole."""
    inflate, pieces, stop, step = zlib.decompressobj(31), [], at, 1 << 12
    while not inflate.eof and stop < len(data):
        before = inflate.copy()
        try:
            pieces.append(inflate.decompress(data[stop : stop + step]))
        except zlib.error as e:
            try:  # again in small steps, for what stands before the damage
                for i in range(stop, stop + step, 64):
                    pieces.append(before.decompress(data[i : i + 64]))
            except zlib.error:
                pass
            return b"".join(pieces), stop, f"member does not inflate: {str(e)[:60]}"
        stop, step = stop + step, min(2 * step, 1 << 20)
    if not inflate.eof:
        return b"".join(pieces), stop, "member is cut off"
    return b"".join(pieces), min(stop, len(data)) - len(inflate.unused_data), None


def parse_member(data: bytes, at: int) -> tuple[list[tuple[dict | None, str | None]], int, str | None]:
    """The good records in the gzip member that begins at ``at`` (a reason for each gap between them), the place after it, and its damage.

    A member may hold any number of records, whatever stands before the first good one, and a damaged one is read as far as it inflates.
    """
    plain, end, damage = _inflated(data, at)
    found = [(record, f"in a member, {n} bytes at {place}: {reason}" if reason else None) for place, n, record, reason in salvage(plain, members=False)]
    if damage and found and found[-1][1]:
        found.pop()  # the end that the damage cut off
    if not any(record for record, _ in found):
        raise Bad(damage or "member holds no good record")
    return found, end, damage


def _parse(data: bytes, at: int, members: bool) -> tuple[list[tuple[dict | None, str | None]], int, str | None]:
    if members and data.startswith(b"\x1f\x8b\x08", at):
        return parse_member(data, at)
    record, end = parse_record(data, at)
    return [(record, None)], end, None


def _next(data: bytes, at: int, members: bool) -> int:
    """The next place from ``at`` where a version line or a member may begin."""
    found = [x for x in (data.find(VERSION, at), data.find(b"\x1f\x8b\x08", at) if members else -1) if x >= 0]
    return min(found, default=len(data))


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) for good records and (offset, length, None, reason) for gaps, in order.

    The lengths add up to that of the data: of what a gzip member holds, the
    first has the length of the member and the others have 0; records that are
    read from a damaged member have 0, and its bytes are a gap.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            found, end, damage = _parse(data, at, members)
        except Bad as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next(data, at + 1, members)
            continue
        if gap is not None:
            yield gap, at - gap, None, why
            gap = None
        for i, (record, reason) in enumerate(found):
            yield at, 0 if damage or i else end - at, record, reason
        if damage:
            gap, why = at, damage
            at = _next(data, at + 1, members)
        else:
            at = end
    if gap is not None:
        yield gap, len(data) - gap, None, why


def write(records: DataFrame, folder: str, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (record_type, record_id, target, payload, payload_digest, payload_bytes, refers_to) below ``folder``.

    Returns one row per file. Only files in the returned table count: a task
    that is repeated writes under new names. The table is written too, so the
    archives are written once.
    """
    spark = records.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(f"{top}/archives", recursive=True)
        part, stream, path, n, size, done = TaskContext.get().partitionId(), None, "", 0, 0, []
        for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            data = record_bytes(row[0], row[1], row[2] or "", row[3], row[4], row[5], row[6])
            if compress:
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = deflate.compress(data) + deflate.flush()
            if stream is None:
                path = f"{top}/archives/part-{part:06d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                stream, n, size = files.open_output_stream(path, compression=None), 0, 0
            stream.write(data)
            n, size = n + 1, size + len(data)
            if size >= file_bytes:
                stream.close()
                done.append((path.rpartition("/")[2], n, size))
                stream = None
        if stream is not None:
            stream.close()
            done.append((path.rpartition("/")[2], n, size))
        columns = zip(*done, strict=True) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["path", "records", "bytes"])

    columns = ["record_type", "record_id", "target", "payload", "payload_digest", "payload_bytes", "refers_to"]
    records.select(columns).mapInArrow(task, FILES).write.parquet(f"{folder}/files")
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def read(spark: SparkSession, paths: str | list[str], payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives at ``paths``; gaps have a reason and no record_type."""
    found = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in READ.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for offset, length, record, reason in salvage(data.as_buffer().to_pybytes()):
                    row = (record or {}) | {"path": name.as_py(), "offset": offset, "length": length, "reason": reason}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                for i in range(0, len(rows), 1000):
                    part = rows[i : i + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in part], kinds[k]) for f, k in fields], names=[f for f, _ in fields])

    return found.select("path", "content").mapInArrow(task, READ)


def written(files: DataFrame, folder: str) -> list[str]:
    """The archives that ``write`` made, as paths (Spark lists the files of a source on the driver in any case)."""
    return [f"{folder}/archives/{r['path']}" for r in files.select("path").toLocalIterator()]


def records(read_back: DataFrame) -> DataFrame:
    return read_back.where("record_type IS NOT NULL").drop("reason")


def gaps(read_back: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return read_back.where("reason IS NOT NULL").select("path", "offset", "length", "reason")


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A record for each page: of equal payloads of at least ``least`` bytes the one with the largest page_id is the response.

    What is grouped and joined is a digest and an id per page; the payloads stay
    where they are. A hot payload is one row on the small side of the join.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("target"), payload.alias("payload"), digest.alias("_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    kept = pages.select("page_id", digest.alias("_d"), F.octet_length(payload).alias("_n")).where(F.col("_n") >= least)
    kept = kept.groupBy("_d").agg(F.max("page_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = rows.join(kept, F.col("_digest") == F.col("_d"), "left")
    revisit = F.col("_kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_kept"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return out.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target",
        F.when(~revisit, F.col("payload")).alias("payload"),
        base32(F.col("_digest")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, urn(F.col("_kept"))).alias("refers_to"),
    )


def base32(hexadecimal):
    """Base32 of a hexadecimal SHA-1 (32 characters of five bits each)."""
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.lpad(F.conv(F.substring(hexadecimal, i, F.lit(1)), 16, 2), 4, "0")), "")
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    pick = lambda i: F.substring(letters, F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), pick), "")


def page_id(urn):
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
