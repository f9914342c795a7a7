"""WARC archives packaged in ZIP files: writing, and reading by ranges.

Writing: each task puts its pages into archives in the shared folder. An archive
is a ZIP file with two stored members, the WARC file (one gzip member a record)
and an index with a line a record: offset and length in the WARC file and the
page's id. A task that runs again writes files of another name; only those that
the finished manifest lists are read.

Reading: the ZIP directory is parsed from the end of the file, with the ZIP64
records where sizes or offsets need them; members are located by their local
headers. Only the tail of the file, the directory and the index are read, then
byte ranges of the records themselves, neighbours in one range. Nothing is
unpacked to disk.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Workspace, prepare_workers

#: Payloads below this are always stored in full.
LEAST_REVISIT = 100
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
#: A range read joins neighbouring records up to this many bytes.
RANGE_BYTES = 4 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"
_MOST32, _MOST16 = 0xFFFFFFFF, 0xFFFF


# -- ZIP reading

def _open(path: str):
    filesystem, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pafs.LocalFileSystem(), path)
    return filesystem.open_input_file(inner)


class ZipMembers:
    """Stored members of a ZIP file, found through its central directory.

    ``file`` needs ``size()`` and ``read_at(n, offset)``.
    """

    def __init__(self, file):
        self.file = file
        self.members: dict[str, tuple[int, int]] = {}
        start, length, count, shift = self._directory()
        data, at = self._read(start, length), 0
        for _ in range(count):
            (sign, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, disk, _, _,
             header) = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if sign != 0x02014B50:
                raise ValueError("not a ZIP directory entry")
            name = data[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name:at + 46 + n_name + n_extra]
            packed, header = self._wide(extra, plain, packed, header, disk)
            if method == 0 and not name.endswith("/"):
                self.members[name] = (header + shift, packed)
            at += 46 + n_name + n_extra + n_note

    def _read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) < length:
            raise ValueError("the ZIP file is cut off")
        return data

    def _directory(self) -> tuple[int, int, int, int]:
        """Start, length and entries of the directory, and by how much offsets are shifted."""
        size = self.file.size()
        tail_at = max(0, size - 22 - _MOST16 - 20)
        tail = self._read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + 22 > len(tail)
                            or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        _, _, count, length, start = struct.unpack_from("<HHHII", tail, end + 6)[:5]
        below = tail_at + end
        if end >= 20 and tail[end - 20:end - 16] == b"PK\6\7":
            stated = struct.unpack_from("<Q", tail, end - 12)[0]
            # Something may stand before the archive: then the record is just before its locator.
            for at in (stated, tail_at + end - 20 - 56):
                record = self.file.read_at(56, at)
                if record[:4] == b"PK\6\6":
                    count, length, start = struct.unpack_from("<QQQ", record, 32)
                    below = at
                    break
            else:
                raise ValueError("no ZIP64 end record")
        return below - length, length, count, below - length - start

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, header: int, disk: int) -> tuple[int, int]:
        """Packed size and header offset, from the ZIP64 field where the short ones are full."""
        at = 0
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide, place = extra[at + 4:at + 4 + length], 0
                if plain == _MOST32:
                    place += 8
                if packed == _MOST32:
                    packed = struct.unpack_from("<Q", wide, place)[0]
                    place += 8
                if header == _MOST32:
                    header = struct.unpack_from("<Q", wide, place)[0]
            at += 4 + length
        return packed, header

    def locate(self, name: str) -> tuple[int, int]:
        """Where a member's bytes start in the file, and how many there are."""
        header, length = self.members[name]
        fixed = self._read(header, 30)
        if fixed[:4] != b"PK\3\4":
            raise ValueError("no local header")
        n_name, n_extra = struct.unpack_from("<HH", fixed, 26)
        return header + 30 + n_name + n_extra, length

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        start, whole = self.locate(name)
        length = whole - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > whole:
            raise ValueError("range outside the member")
        return self._read(start + offset, length)


# -- WARC records

def _clean(url: str) -> str:
    """A URL as a header value: white space and control characters percent-encoded."""
    return quote(url, safe="".join(chr(i) for i in range(33, 127)))


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None, revisit: bool) -> bytes:
    """One response or revisit record; a revisit holds the HTTP head alone."""
    name = "null" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
              f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
              f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{name}'}",
              f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.decode().strip().lower()] = value.decode("utf-8").strip()
    return found


def _page(value: str | None) -> int | None:
    name = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "null") else int(name)


def read_record(data: bytes) -> dict:
    """A record's fields; of a response also the payload, with size and digest worked out from it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    found = {"page_id": _page(fields["warc-record-id"]), "record_type": kind,
             "url": fields["warc-target-uri"], "refers_to": _page(fields.get("warc-refers-to"))}
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        found |= {"payload": payload, "payload_bytes": len(payload),
                  "payload_digest": hashlib.sha256(payload).hexdigest()}
        if found["payload_digest"] != stated:
            raise ValueError("a payload does not have its digest")
    else:
        found |= {"payload": None, "payload_bytes": int(_fields(http)["content-length"]),
                  "payload_digest": stated}
    return found


# -- writing

class _Archive:
    """One archive being written, front to back: the stream needs no seeking."""

    def __init__(self, path: str):
        self.path = path
        filesystem, inner = pafs.FileSystem.from_uri(path)
        filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
        self.stream = filesystem.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(self._info(WARC_MEMBER), "w", force_zip64=True)
        self.lines: list[str] = []
        self.offset = 0

    @staticmethod
    def _info(name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))

    def add(self, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.member.write(packed)
        self.lines.append(json.dumps([self.offset, len(packed), page_id]))
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(self._info(INDEX_MEMBER), "w", force_zip64=True) as index:
            index.write("\n".join(self.lines).encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.offset


def plan_records(pages: DataFrame, work: Workspace) -> DataFrame:
    """``page_id, url, html, digest, first, revisit``: which pages refer to which.

    Only payloads that occur twice have a row on the other side of the join,
    and that side is a written table: Spark sends it to all tasks if it is
    small, and else splits the digests that many pages share.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"),
                         F.octet_length(payload).alias("size"))
    repeated = work.save(keyed.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"), "repeated")
    joined = keyed.join(repeated, F.col("digest") == F.col("of"), "left")
    revisit = F.coalesce((F.col("size") >= LEAST_REVISIT) & F.col("first").isNotNull()
                         & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))


def write_archives(pages: DataFrame, work: Workspace) -> DataFrame:
    """Write all pages and return the manifest: ``path, records, warc_bytes``.

    Takes ``page_id``, ``url``, ``html``; other columns are ignored. A null
    html is an empty payload, a null url becomes ``urn:page:ID``. Of equal
    payloads of at least 100 bytes the rows with the smallest page id are
    responses and all others revisits. Repeated rows of the smallest id are
    all responses, a null id is never the smallest, and if all ids of a group
    are null its rows are all responses. No pages make no archive.
    """
    prepare_workers(pages.sparkSession)
    folder = f"{work.root}/archives"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:///", "file:/").replace("file:/", "file:///")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if archive is None:
                        archive = _Archive(f"{folder}/{uuid.uuid4().hex}.zip")
                    archive.add(row["page_id"], warc_record(
                        row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"),
                        row["digest"], row["first"], row["revisit"]))
                    if archive.offset >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([d[0] for d in done], pa.string()),
            "records": pa.array([d[1] for d in done], pa.int64()),
            "warc_bytes": pa.array([d[2] for d in done], pa.int64())})

    manifest = plan_records(pages, work).mapInArrow(run, "path string, records long, warc_bytes long")
    return work.save(manifest, "manifest")


# -- reading

def read_index(manifest: DataFrame) -> DataFrame:
    """``path, offset, length, page_id``: one row a record, offsets within the archive file."""
    prepare_workers(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    members = ZipMembers(file)
                    start, _ = members.locate(WARC_MEMBER)
                    lines = members.read(INDEX_MEMBER).decode().splitlines()
                for at in range(0, len(lines), 10_000):
                    rows = [json.loads(line) for line in lines[at:at + 10_000]]
                    yield pa.RecordBatch.from_pydict({
                        "path": pa.array([path] * len(rows), pa.string()),
                        "offset": pa.array([start + r[0] for r in rows], pa.int64()),
                        "length": pa.array([r[1] for r in rows], pa.int64()),
                        "page_id": pa.array([r[2] for r in rows], pa.int64())})

    return manifest.select("path").mapInArrow(run, "path string, offset long, length long, page_id long")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records at the ranges in ``index``: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest`` and, if asked for, ``payload`` (null for revisits)."""
    prepare_workers(index.sparkSession)
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string")
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                path, start = rows[at]["path"], rows[at]["offset"]
                end, last = start + rows[at]["length"], at + 1
                while (last < len(rows) and rows[last]["path"] == path and rows[last]["offset"] == end
                       and end + rows[last]["length"] - start <= RANGE_BYTES):
                    end += rows[last]["length"]
                    last += 1
                if path != opened:
                    if file is not None:
                        file.close()
                    file, opened = _open(path), path
                data = file.read_at(end - start, start)
                found = []
                for row in rows[at:last]:
                    part = data[row["offset"] - start:row["offset"] - start + row["length"]]
                    found.append(read_record(zlib.decompress(part, 31)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)],
                    names=names)
                at = last
        if file is not None:
            file.close()

    ordered = index.select("path", "offset", "length").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives and read every record back; see :func:`write_archives`."""
    spark: SparkSession = pages.sparkSession
    work = Workspace(spark, "warc")
    manifest = write_archives(pages, work)
    work.drop("repeated")
    index = work.save(read_index(manifest), "index")
    # Ranges of an archive may go to several tasks: a large archive is no task of its own.
    tasks = F.floor(F.col("offset") / (RANGE_BYTES * 4))
    return read_records(index.repartition(F.col("path"), tasks))
