"""Web archives in ZIP packages: WARC records written to them, and range-read from them.

A package holds two stored members: ``archive/data.warc.gz``, in which every
record is compressed on its own, and ``indexes/index.cdxj``, one JSON line per
record with its place. The reader finds members by the ZIP central directory
(ZIP64 included) and reads each record by its range; nothing is extracted.

A task writes packages under names of its own and reports them; only reported
packages are read, so what a lost or repeated task leaves behind does not count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, slices, text_or_empty

#: Compressed records in a package, about.
PACKAGE_BYTES = 64 << 20
_CHUNK_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


# --- ZIP -----------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipReader:
    """Members of a ZIP file by its directory, read by range."""

    def __init__(self, source) -> None:
        self.source = source
        self.members = {m.name: m for m in self._directory()}

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def _directory(self) -> Iterator[Member]:
        total = self.source.size()
        # The end record is 22 bytes and a comment of at most 65,535.
        tail_size = min(total, 22 + 0xFFFF)
        tail = self._at(total - tail_size, tail_size)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != tail_size:
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        count, size, start = struct.unpack_from("<10xHLL", tail, end)
        end += total - tail_size
        locator = self._at(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            record = self._at(int.from_bytes(locator[8:16], "little"), 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<32xQQQ", record)
        data, at = self._at(start, size), 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<8xHH", data, at)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<20xLLHHH", data, at)
            header = int.from_bytes(data[at + 42 : at + 46], "little")
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, header = _zip64(extra, full, packed, header)
            yield Member(name, method, full, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members are read by range")
        local = self._at(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"damaged header of {name}")
        n_name, n_extra = struct.unpack_from("<26xHH", local)
        return member.header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        """Part of a stored member."""
        member = self.members[name]
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError(f"range outside of {name}")
        return self._at(self.start(name) + offset, size)


def _zip64(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, from the ZIP64 field where they do not fit 32 bits."""
    out, at = list(values), 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            for i, value in enumerate(values):
                if value == 0xFFFFFFFF:
                    out[i] = int.from_bytes(extra[place : place + 8], "little")
                    place += 8
        at += 4 + size
    return out


# --- WARC ----------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without the payload where there is a record to refer to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id)}
    head["WARC-Date"] = _DATE
    if url is not None:
        head["WARC-Target-URI"] = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    head["WARC-Payload-Digest"] = f"sha1:{payload_digest(payload)}"
    if refers_to is not None:
        head |= {"WARC-Refers-To": _record_id(refers_to), "WARC-Profile": _PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, fields of its HTTP message, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


# --- Spark ---------------------------------------------------------------

_PACKAGES = pa.schema([("path", pa.string()), ("records", pa.int64())])
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


class _Package:
    """A package that is being written; ZIP needs no seeking for stored members."""

    def __init__(self, path: str) -> None:
        filesystem, place = FileSystem.from_uri(path)
        filesystem.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.size = path, 0
        self.stream = filesystem.open_output_stream(place, compression=None)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index: list[str] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.data.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(INDEX, "w") as member:
            member.write("".join(f"{line}\n" for line in self.index).encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES
) -> DataFrame:
    """Write a record for each page into packages below ``folder``; their ``path`` and number of ``records``.

    Of pages with equal payloads of at least ``least_bytes``, the one with the
    smallest id is a response and the others revisit it; smaller payloads are
    responses all. Rows that repeat the smallest id are responses, too. Rows
    without an id revisit a page that has one, else they are responses. A null
    ``html`` is an empty payload; a null ``url`` is left out of the record.
    Other columns are not read. The packages are written at once.
    """
    keyed = pages.select("page_id", "url", text_or_empty("html").alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary"))
    )
    repeated = (
        keyed.filter(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    records = keyed.join(repeated, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/packages/{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        package, done = None, []
        for batch in batches:
            for piece in slices(batch, "html", _CHUNK_BYTES):
                for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                    if package is None:
                        package = _Package(f"{name}-{len(done):04d}.wacz")
                    package.add(page_id, warc_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                    if package.size >= package_bytes:
                        done.append(package.close())
                        package = None
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=_PACKAGES)

    return saved(records.mapInArrow(write, "path string, records long"), folder, "manifest")


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in column ``path``, each read by its range.

    A revisit's size is that of the payload it stands for. A response whose
    payload does not have the recorded digest raises an error, as does a
    damaged package. ``payload`` is null for revisits and unless asked for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, place = FileSystem.from_uri(path)
                with filesystem.open_input_file(place) as source:
                    yield from _read_package(source, payloads)

    # A task for each package: paths are too small for their bytes to tell how many tasks they need.
    paths = packages.select("path")
    return paths.repartitionByRange(max(1, packages.count()), "path").mapInArrow(read, RECORD_SCHEMA)


def _read_package(source, payloads: bool) -> Iterator[pa.RecordBatch]:
    package = ZipReader(source)
    rows, held = [], 0
    for line in package.read(INDEX).decode().splitlines():
        entry = json.loads(line)
        record = gzip.decompress(package.read(DATA, entry["offset"], entry["length"]))
        warc, http, payload = parse_record(record)
        digest = warc["warc-payload-digest"].removeprefix("sha1:")
        response = warc["warc-type"] == "response"
        if response and payload_digest(payload) != digest:
            raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
        rows.append(
            (
                _page_id(warc["warc-record-id"]),
                warc.get("warc-target-uri"),
                len(payload) if response else int(http["content-length"]),
                digest,
                warc["warc-type"],
                _page_id(warc.get("warc-refers-to")),
                payload if payloads and response else None,
            )
        )
        held += len(record) if payloads else 0
        if held >= _CHUNK_BYTES or len(rows) >= 10_000:
            yield _record_rows(rows)
            rows, held = [], 0
    if rows:
        yield _record_rows(rows)


def _record_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records of the pages, after writing them to packages in the shared folder and reading those."""
    packages = write_archives(pages, new_folder(pages.sparkSession), least_bytes)
    return read_archives(packages, payloads=False)
