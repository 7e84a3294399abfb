"""WARC records in ZIP-packaged archives: a writer and a range reader.

An archive is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``,
one gzip member a record, and ``indexes/index.cdxj``, a line a record with its offset
and length in the WARC member. The reader never extracts: it reads the end of the file,
the ZIP64 and central directories, the local header of a member, the index, and then
byte ranges of records.

Archives are written by tasks straight to the shared folder (any file system pyarrow
opens), under names no other attempt uses; the manifest lists those of finished tasks
only, so a lost executor or a repeated task leaves no duplicate records.

Defined results: a null payload is the empty payload. Of rows with equal payloads of at
least ``least_bytes`` bytes those with the least page_id are responses, the others
revisits of it; rows without page_id are responses. Repeated rows (one id and payload)
give a record each, of one type.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameseek.llm.common import prepare, staged, work_dir

#: Fixed values of the WARC and ZIP formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LOCAL_SIG, CENTRAL_SIG, END_SIG = 0x04034B50, 0x02014B50, 0x06054B50
END64_SIG, LOCATOR64_SIG = 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, digest_ok boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > "\x1f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of RECORD from one record's bytes."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length:"))
    page = lambda key: None if fields[key] == "<urn:page:None>" else int(fields[key][10:-1])
    kind, known = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    full = kind == "response"
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": known, "record_type": kind,
        "refers_to": None if full else page("WARC-Refers-To"), "payload": payload if full else None, "digest_ok": (digest(payload) == known and len(payload) == size) if full else None,
    }


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> list[bytes]:
    """The pieces of a ZIP file with stored members; ZIP64 fields where sizes need them, or always."""
    pieces, central, at = [], [], 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= FULL32 or at >= FULL32
        version, small = (45, FULL32) if wide else (20, size)
        local = struct.pack("<IHHHHHIIIHH", LOCAL_SIG, version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), 20 if wide else 0)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        pieces += [local, raw, extra, data]
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL_SIG, version, version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra)
        at += sum(map(len, pieces[-4:]))
    listing = b"".join(central)
    n, wide = len(members), zip64 or at >= FULL32 or len(members) >= FULL16
    if wide:
        end64 = struct.pack("<IQHHIIQQQQ", END64_SIG, 44, 45, 45, 0, 0, n, n, len(listing), at)
        tail = end64 + struct.pack("<IIQI", LOCATOR64_SIG, 0, at + len(listing), 1) + struct.pack("<IHHHHIIH", END_SIG, 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
    else:
        tail = struct.pack("<IHHHHIIH", END_SIG, 0, 0, n, n, len(listing), at, 0)
    return [*pieces, listing, tail]


class ZipRanges:
    """The stored members of a ZIP file, read by byte range. ``read(offset, length)`` gives bytes of the file."""

    def __init__(self, read, size: int) -> None:
        self._read = read
        tail_at = max(0, size - 22 - FULL16)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(struct.pack("<I", END_SIG))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(struct.pack("<I", END_SIG), 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if FULL16 == count or FULL32 in (length, at):
            locator = read(tail_at + end - 20, 20)
            if struct.unpack_from("<I", locator)[0] == LOCATOR64_SIG:
                end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if struct.unpack_from("<I", end64)[0] != END64_SIG:
                    raise ValueError("ZIP64 end of central directory missing")
                count, length, at = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int]] = {}
        listing, pos = read(at, length), 0
        for _ in range(count):
            sig, flags, method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack_from("<I4xHH8xIIHHH8xI", listing, pos)
            if sig != CENTRAL_SIG:
                raise ValueError("central directory damaged")
            name = listing[pos + 46 : pos + 46 + n_name].decode()
            extra = listing[pos + 46 + n_name : pos + 46 + n_name + n_extra]
            packed, plain, offset = self._wide(extra, packed, plain, offset)
            if method == 0 and packed == plain and not flags & 1:
                self.members[name] = (offset, plain)
            pos += 46 + n_name + n_extra + n_note

    @staticmethod
    def _wide(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
        """ZIP64 values replace those that are all ones, in the order plain, packed, offset."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                got = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                plain = next(got) if plain == FULL32 else plain
                packed = next(got) if packed == FULL32 else packed
                offset = next(got) if offset == FULL32 else offset
            at += 4 + n
        return packed, plain, offset

    def start(self, name: str) -> int:
        """Where the member's bytes begin, behind its local header."""
        offset = self.members[name][0]
        sig, n_name, n_extra = struct.unpack("<I22xHH", self._read(offset, 30))
        if sig != LOCAL_SIG:
            raise ValueError("local header damaged")
        return offset + 30 + n_name + n_extra

    def member(self, name: str) -> bytes:
        return self._read(self.start(name), self.members[name][1])


def _archive(rows: list[tuple], zip64: bool) -> list[bytes]:
    warc, index, at = [], [], 0
    for page_id, url, html, refers_to in rows:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = squeeze.compress(record(page_id, url, (html or "").encode(), refers_to)) + squeeze.flush()
        warc.append(data)
        index.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}))
        at += len(data)
    return zip_stored([(DATA, b"".join(warc)), (INDEX, "\n".join(index).encode())], zip64)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows that repeat a payload; aggregated before it is joined."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    firsts = ids.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return ids.select("page_id", "sha").join(firsts, "sha").where("page_id > refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_chars: int = 16_000_000, zip64: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; returns the manifest, a durable table."""
    prepare(pages.sparkSession)
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    again = revisits(pages, least_bytes).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    rows = rows.join(again, (F.col("page_id") == F.col("_page")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, at = pafs.FileSystem.from_uri(folder)

        def close(held: list[tuple]) -> pa.RecordBatch:
            path = f"{at}/{uuid.uuid4().hex}.wacz"
            pieces = _archive(held, zip64)
            with target.open_output_stream(path) as out:
                for p in pieces:
                    out.write(p)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([sum(map(len, pieces))], pa.int64())], names=["path", "records", "bytes"])

        held, chars = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(row)
                chars += len(row[2] or "") + 200
                if chars >= archive_chars:
                    yield close(held)
                    held, chars = [], 0
        if held:
            yield close(held)

    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False, gap: int = 4 << 20) -> DataFrame:
    """The records of the archives in ``manifest`` by range reads of up to ``gap`` bytes of neighbouring records."""
    schema = RECORD if payloads else RECORD.replace(" payload binary,", "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with source.open_input_file(path) as f:
                    archive = ZipRanges(lambda offset, length: f.read_at(length, offset), f.size())
                    start = archive.start(DATA)
                    entries = [json.loads(line) for line in archive.member(INDEX).decode().split("\n") if line]
                    i = 0
                    while i < len(entries):
                        j, first = i, entries[i]["offset"]
                        while j < len(entries) and entries[j]["offset"] + entries[j]["length"] - first <= max(gap, entries[i]["length"]):
                            j += 1
                        span = f.read_at(entries[j - 1]["offset"] + entries[j - 1]["length"] - first, start + first)
                        yield out([parse_record(zlib.decompress(span[e["offset"] - first : e["offset"] - first + e["length"]], 31)) for e in entries[i:j]])
                        i = j

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` into the shared folder and read the records back."""
    folder = f"{work_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder)
