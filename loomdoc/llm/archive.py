"""WARC records in ZIP-packaged archives, read by ranges.

*Writing.* Records are written one to a gzip member into ``archive/data.warc.gz``, a stored (uncompressed) ZIP member, with
an index ``indexes/index.cdxj`` beside it that tells place and length of each record. A record whose payload another record
has is a revisit of that one. ZIP64 fields are written where sizes or places need them.

*Reading.* The end-of-archive record, its ZIP64 form and the central directory are parsed, stored members located by their
local headers, the index read, and each record read by its range; nothing is extracted.

Archives are files in the shared folder, opened with ``pyarrow.fs``. Each is under a name of its own try, and a table of the names
is committed by Spark, so retried and speculative tasks leave no half-written archive to be read.

Cases: null html counts as empty; null page_ids are the smallest; of equal payloads the record with the largest page_id is the response, and
repeated rows of it are responses too; empty tables give no rows. Other columns are not used.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, written

#: Bytes of records in an archive, about; and of a read of neighbouring records.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
WIDE, WIDE16 = 0xFFFFFFFF, 0xFFFF


class ArchiveError(ValueError):
    pass


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Stored members into an open file, one after another."""

    def __init__(self, file) -> None:
        self.file, self.place, self.members = file, 0, []

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.place += len(data)

    def member(self, name: str, parts: list[bytes], force64: bool = False) -> None:
        size, crc, at = sum(map(len, parts)), 0, self.place
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide = force64 or size >= WIDE
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        raw = name.encode()
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x0800, 0, 0, 33, crc, WIDE if wide else size, WIDE if wide else size, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self.put(p)
        self.members.append((raw, crc, size, at, wide))

    def close(self, force64: bool = False) -> None:
        start = self.place
        for raw, crc, size, at, wide in self.members:
            far = wide or at >= WIDE
            extra = (struct.pack("<QQ", size, size) if wide else b"") + (struct.pack("<Q", at) if far else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if far else 20, 0x0800, 0, 0, 33, crc, WIDE if wide else size, WIDE if wide else size, len(raw), len(extra), 0, 0, 0, 0, WIDE if far else at) + raw + extra)
        length, count = self.place - start, len(self.members)
        if force64 or start >= WIDE or length >= WIDE or count >= WIDE16:
            at = self.place
            self.put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, length, start) + struct.pack("<IIQI", 0x07064B50, 0, at, 1))
            self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, WIDE16, WIDE16, WIDE, WIDE, 0))
        else:
            self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, length, start, 0))


def read_range(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ArchiveError("archive ends early")
    return data


def zip_members(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Start of the data, length and compression method of each member, from the central directory."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = read_range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(tail):
        raise ArchiveError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == WIDE16 or length == WIDE or start == WIDE:
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ArchiveError("no ZIP64 locator")
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = read_range(file, at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ArchiveError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, at = read_range(file, start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ArchiveError("damaged central directory")
        method, stored, whole, name_size, extra_size, note_size, place = (*struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<IIHHH", directory, at + 20), *struct.unpack_from("<I", directory, at + 42))
        name = directory[at + 46 : at + 46 + name_size].decode()
        extra, k = directory[at + 46 + name_size : at + 46 + name_size + extra_size], 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                fields = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                whole = next(fields) if whole == WIDE else whole
                stored = next(fields) if stored == WIDE else stored
                place = next(fields) if place == WIDE else place
            k += 4 + n
        local = read_range(file, place, 30)
        if local[:4] != b"PK\x03\x04":
            raise ArchiveError("damaged local header")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        out[name] = (place + 30 + own_name + own_extra, stored, method)
        at += 46 + name_size + extra_size + note_size
    return out


# ---------------------------------------------------------------- WARC


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return int(value) if value else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def safe(value: str) -> str:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, in lower case, and payload of a record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- DataFrames


def opened(uri: str):
    filesystem, path = pafs.FileSystem.from_uri(uri)
    return filesystem, path


def linked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``. The join partner of a payload is one row, from a written table, so that no sum stands
    between shuffle and join and the adaptive planner may split the pages of a frequent payload."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.withColumn("_digest", F.sha2("html", 256))
    last = rows.select("page_id", F.sha2("html", 256).alias("_digest")).groupBy("_digest").agg(F.max("page_id").alias("last"))
    revisit = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return marked.join(written(last, "last"), "_digest").select("page_id", "url", "html", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes all pages into archives in ``folder``; the table of archives (``archive, size, records``), read back."""
    spark = pages.sparkSession
    schema = pa.schema([("archive", pa.string()), ("size", pa.int64()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, index, size, rows = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal members, index, size, rows
            filesystem, path = opened(f"{folder}/archives/{uuid.uuid4().hex}.wacz")
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            with filesystem.open_output_stream(path) as file:
                z = ZipWriter(file)
                z.member(DATA, members)
                z.member(INDEX, ["".join(index).encode("utf-8", "surrogatepass")])
                z.close()
            out = pa.RecordBatch.from_arrays([pa.array([f"{folder}/archives/{path.rpartition('/')[2]}"]), pa.array([z.place], pa.int64()), pa.array([rows], pa.int64())], schema=schema)
            members, index, size, rows = [], [], 0, 0
            return out

        for b in slices(batches, name="html"):
            for page_id, url, html, refers_to, revisit in zip(*(b.column(j).to_pylist() for j in range(5))):
                data = gzip.compress(warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit), 4, mtime=0)
                index.append(json.dumps({"id": page_id, "url": url, "offset": size, "length": len(data)}) + "\n")
                members.append(data)
                size, rows = size + len(data), rows + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if rows:
            yield close()

    listed = linked(pages, least_bytes).mapInArrow(run, "archive string, size bigint, records bigint")
    listed.write.parquet(f"{folder}/listed")
    return spark.read.schema(listed.schema).parquet(f"{folder}/listed")


def ranges(archives: DataFrame) -> DataFrame:
    """``archive, start, length`` of neighbouring records, about ``READ_BYTES`` together, and ``cuts`` (their lengths)."""
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("cuts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                filesystem, path = opened(uri)
                with filesystem.open_input_file(path) as file:
                    members = zip_members(file, size)
                    (data, stored, method), (index, index_size, index_method) = members[DATA], members[INDEX]
                    if method or index_method:
                        raise ArchiveError("members are not stored")
                    entries = [json.loads(x) for x in read_range(file, index, index_size).decode("utf-8", "surrogatepass").split("\n") if x]
                rows, start, length, cuts = [], 0, 0, []
                for e in entries:
                    if cuts and (e["offset"] != start + length or length >= READ_BYTES):
                        rows.append((uri, data + start, length, cuts))
                        cuts = []
                    if not cuts:
                        start, length = e["offset"], 0
                    if e["offset"] + e["length"] > stored:
                        raise ArchiveError("index runs past its member")
                    cuts.append(e["length"])
                    length += e["length"]
                if cuts:
                    rows.append((uri, data + start, length, cuts))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return archives.select("archive", "size").mapInArrow(run, "archive string, start bigint, length bigint, cuts array<bigint>")


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` (and ``payload``) of each record, read by ranges."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start, length, cuts in zip(*(b.column(j).to_pylist() for j in range(4))):
                filesystem, path = opened(uri)
                with filesystem.open_input_file(path) as file:
                    data = read_range(file, start, length)
                rows, at = [], 0
                for n in cuts:
                    headers, payload = parse_record(gzip.decompress(data[at : at + n]))
                    at += n
                    revisit = headers["warc-type"] == "revisit"
                    size, mark = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (len(payload), digest_of(payload)) != (size, mark):
                        raise ArchiveError("payload and digest differ")
                    rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], size, mark, page_of(headers["warc-refers-to"]) if revisit else None, *[payload] * with_payload))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f[1]) for j, f in enumerate(fields)], schema=schema)

    parts = ranges(archives)
    # a range is a few MB: dealt anew, so that the tasks are even
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n).mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    folder = shared_dir(pages.sparkSession, "archives")
    return read_records(write_archives(pages, folder, least_bytes))
